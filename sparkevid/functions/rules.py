"""Ordered rules as data. A table renders to one Spark expression, and to one SQL expression of the same meaning.

Patterns use what Java's and RE2's regular expressions share: no look-around, no back-references."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row. Long rule tables would repeat it in every rule, and the generated code
    would outgrow a method."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first (value, pattern) whose pattern occurs."""

    def cases(t: Column) -> Column:
        out = None
        for value, pattern in rules:
            hit = F.regexp_like(t, F.lit(pattern))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(F.lit(default))

    return let(text, cases)


def first_match_sql(text: str, rules: Sequence[tuple[str, str]], default: str | None = None) -> str:
    cases = " ".join(f"WHEN regexp_matches({text}, {_quoted(p)}) THEN {_quoted(v)}" for v, p in rules)
    return f"CASE {cases} ELSE {'NULL' if default is None else _quoted(default)} END"


def any_match(text: Column, patterns: Iterable[str]) -> Column:
    return F.regexp_like(text, F.lit("|".join(f"(?:{p})" for p in patterns)))


def any_match_sql(text: str, patterns: Iterable[str]) -> str:
    return f"regexp_matches({text}, {_quoted('|'.join(f'(?:{p})' for p in patterns))})"


def first_group(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """What the first pattern that occurs captures, or null."""
    return let(text, lambda t: F.coalesce(*(F.nullif(F.regexp_extract(t, p, group), F.lit("")) for p in patterns)))


def first_group_sql(text: str, patterns: Sequence[str], group: int = 1) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {_quoted(p)}, {group}), '')" for p in patterns) + ")"


def template(by: Column, templates: dict[str, str], **parts: Column) -> Column:
    """The template for a key with {part} filled in; null for other keys or null parts that it names."""
    out = F.lit(None).cast("string")
    for key, text in templates.items():
        value = F.lit(text)
        for name, c in parts.items():
            if f"{{{name}}}" in text:
                value = F.replace(value, F.lit(f"{{{name}}}"), c)
        out = F.when(by == key, value).otherwise(out)
    return out


def template_sql(by: str, templates: dict[str, str], **parts: str) -> str:
    cases = []
    for key, text in templates.items():
        value = _quoted(text)
        for name, c in parts.items():
            if f"{{{name}}}" in text:
                value = f"replace({value}, '{{{name}}}', {c})"
        cases.append(f"WHEN {_quoted(key)} THEN {value}")
    return f"CASE {by} {' '.join(cases)} END"
