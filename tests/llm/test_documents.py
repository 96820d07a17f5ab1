"""Quality rules, HTML, licences, media, the pipeline and the registry."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkevid.llm import html_text, license_scan, motion_jpeg, quality_rules

SCHEMA = "doc_id long, text string, kept string, n int"


def rows(spark, data):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in data], SCHEMA).repartition(3)


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
    return *n, n[0] < 10 or 100 * n[4] > 20 * n[0]


TEXTS = [None, "", " \n ", "a", "a b c d e f g h i j", "x y z " * 30, "one two three four five six one two three four five seven eight nine ten eleven", "same\nsame\n same\n\n\nsame", "é# *a|b <c>\x0b\x0cd ü", "w " * 5000]


def test_statistics_against_python(spark):
    r = random.Random(1)
    data = list(enumerate(TEXTS + [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(40)]))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {x["doc_id"]: tuple(x[c] for c in columns) for x in quality_rules.apply_rules(rows(spark, data), []).collect()}
    assert got == {i: statistics(t) for i, t in data}


def test_learned_list_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    train = quality_rules.learn_rules(docs, labels.where("doc_id % 2 = 0"))
    assert train
    held = quality_rules.apply_rules(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right = held.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first()
    assert right[0] >= 0.97 and right[1] >= 0.97
    assert quality_rules.learn_rules(docs, labels.limit(0)) == []
    assert quality_rules.learn_rules(docs, labels.where("quality = 1")) == []


def test_kept_documents_keep_columns(spark):
    out = quality_rules.kept_documents(rows(spark, [(1, "ten words are here so that this text is kept"), (2, "no")]), []).collect()
    assert [tuple(r) for r in out] == [(1, "ten words are here so that this text is kept", "clash", 1)]


def test_plan_is_native(spark):
    plan = quality_rules.apply_rules(rows(spark, []), [(quality_rules.Condition("symbols_per_word", True, 0.5),)])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


ARTICLE = "<p>The first paragraph of the story has a good number of words in it, as stories do.</p><p>Short one.</p><p>The <a href='x'>last</a> paragraph\n   ends the story &amp; has &#8217;words&rsquo; as well, quite a few of them.</p>"
WANT = "The first paragraph of the story has a good number of words in it, as stories do.\nShort one.\nThe last paragraph ends the story & has ’words’ as well, quite a few of them."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now, a long advert text with many many words in it.</div><article>{ARTICLE}</article><footer>&copy; x</footer></body></html>",
        f"<body><header><h1>Site</h1></header><div id='sidebar'>Side</div><main>{ARTICLE}</main><div class='cookie-notice'>We use cookies and would like you to agree to that at once.</div></body>",
        f"<body><div class='menu'><a href=a>One</a> <a href=b>Two</a></div><div id='content'>{ARTICLE}</div><section class='comments'><p>I liked this story a lot, said a reader who wrote many words.</p></section><form>Name <input></form></body>",
        f"<body class='with-sidebar'><div id='page' class='layout-sidebar-right'><div class='post'>{ARTICLE}</div></div><div id='footer'>All rights reserved by the owners of this page, as of today.</div></body>",
        f"<script>var t='</p>';</script><article>{ARTICLE}<aside>Related</aside><script>x</script>",
    ],
)
def test_pages(page):
    assert html_text.extract(page) == WANT


LONG = [" ".join(f"{w}{i}" for i in range(60)) + "." for w in ("first", "second", "third")]
STORY = "".join(f"<p>{x}</p>" for x in LONG)
#: Pages without names that help: a row of links, an article, reader comments, a line of the owner's.
MENU = "<div><a href=a>One</a> <a href=b>Two</a></div>"
COMMENTS = "<div>" + "".join(f"<p><b>{n}</b> <a href=r>reply</a></p><p>So it is, {n}.</p>" for n in ("Ann", "Bo", "Cy", "Di")) + "</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<div><h1>A title</h1>{STORY}</div>{COMMENTS}<div>Owners of this page</div></body>",
        f"<body><div class='x1'>{MENU}</div><div class='x2'><h1>A title</h1>{STORY}</div><div class='x3'>{COMMENTS}</div></body>",
        f"<body>{MENU}<div class='story legal-news'><h1>A title</h1>{STORY}</div>{COMMENTS}</body>",
        f"<body>{MENU}<div class='post related-story'><h1>A title</h1>{STORY}</div><div class='related'><p>{LONG[0]}</p></div></body>",
        f"<body>{MENU}<div class='notice'><h1>A title</h1>{STORY}</div></body>",
        f"<body><div>{MENU}</div><article><header><h1>A title</h1><p>By Ann</p></header>{STORY}<div class='article-comments'><p>{LONG[0]}</p></div></article></body>",
    ],
)
def test_the_ratio_decides_where_names_do_not_help(monkeypatch, page):
    assert html_text.extract(page) == "\n".join(["A title", *LONG])


def test_without_the_ratio_menus_and_comments_come_in(monkeypatch):
    page = f"<body>{MENU}<div><h1>A title</h1>{STORY}</div>{COMMENTS * 2}</body>"
    assert html_text.extract(page) == "\n".join(["A title", *LONG])
    monkeypatch.setattr(html_text, "smoothed", lambda x: np.ones(len(x)))  # every line has the same ratio
    assert "One Two" in html_text.extract(page) and "reply" in html_text.extract(page)


def test_rows_of_links_inside_the_region_go():
    row = "<ul>" + "".join(f"<li><a href={i}>Other story {i}</a></li>" for i in range(4)) + "</ul>"
    assert html_text.extract(f"<article><p>{LONG[0]}</p>{row}<p>{LONG[1]} <a href=x>link</a></p><p><a href=y>{LONG[2]}</a></p></article>") == "\n".join([LONG[0], f"{LONG[1]} link", LONG[2]])


def test_pages_of_the_table_need_no_names():
    """With the ratio alone, tags of furniture and names unknown, nine in ten pages of the table give the same text; with one ratio for all
    lines a third do, and no more with tags and names."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    want = [html_text.extract(p) for p in pages]
    same = lambda: sum(html_text.extract(p) == w for p, w in zip(pages, want, strict=True)) / len(pages)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(html_text, "furniture", lambda *_: set())
        assert same() >= 0.9
    with pytest.MonkeyPatch.context() as m:
        m.setattr(html_text, "smoothed", lambda x: np.ones(len(x)))
        assert same() <= 0.4
        m.setattr(html_text, "furniture", lambda *_: set())
        assert same() <= 0.4


def test_pages_of_the_table_against_their_making():
    """An extractor that knows how the pages are made: what stands in the article, by a parser of its own."""
    import html as H

    import pyarrow.parquet as pq

    blocks = re.compile(r"</?(?:p|h1|h2|h3|li|ul|ol|div|table|tr|td|th|blockquote|pre|br)\b[^>]*>", re.I)
    right = 0
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in pages:
        inner = re.search(r"<article>(.*)</article>", page, re.S)
        inner = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", inner[1], flags=re.S)
        inner = re.sub(r"<br\s*/?>", " ", inner)
        lines = (" ".join(H.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in blocks.split(inner))
        right += "\n".join(x for x in lines if x) == html_text.extract(page)
    assert right >= 0.98 * len(pages)


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<div><div class='post-header'><h1>A title</h1></div><article>{STORY}</article></div><footer>x</footer></body>",
        f"<body>{MENU}<article><header><h1>A title</h1></header>{STORY}</article></body>",
    ],
)
def test_titles_in_headers_stay(page):
    assert html_text.extract(page) == "\n".join(["A title", *LONG])


def test_leads_and_references_stay():
    lead = "This lead says in one long sentence what the story is about, so that readers know whether to go on with it."
    assert html_text.extract(f"<body>{MENU}<article><header><h1>A title</h1><p>{lead}</p></header>{STORY}</article></body>") == "\n".join(["A title", lead, *LONG])
    references = "<ol>" + "".join(f"<li><a href={i}>Source number {i}</a></li>" for i in range(4)) + "</ol>"
    assert html_text.extract(f"<body>{MENU}<article>{STORY}{references}</article></body>") == "\n".join([*LONG, *(f"Source number {i}" for i in range(4))])


def test_comments_as_long_as_the_article_go_by_name():
    talk = f"<section class='comments'><p>{LONG[0]}</p><p>{LONG[1]}</p></section>"
    assert html_text.extract(f"<body>{MENU}<div>{STORY}</div>{talk}</body>") == "\n".join(LONG)


def test_time_is_linear_in_open_elements():
    import time

    def seconds(n):
        page = "<b>" * n + "<p>x <i>" * n + "<div><li>" * n
        began = time.perf_counter()
        html_text.extract(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(100_000) < 40 * max(seconds(10_000), 0.05)


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "w", f"<article>{ARTICLE}</article>", "x"), (3, "w", f"<article>{ARTICLE}</article>", "x"), (4, "v", "no tags", "x"), (5, "v", "<p>" * 3000 + "deep", "x")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract_pages(pages).select("page_id", "text").collect()))
    assert got == [(1, ""), (2, ""), (3, WANT), (3, WANT), (4, "no tags"), (5, "deep")]
    assert html_text.extract_pages(pages.limit(0)).collect() == []


def test_threshold_and_smoothing():
    x = np.array([1.0, 1, 2, 50, 60, 55])
    assert 2 < html_text.threshold(x) < 50
    assert abs(html_text.smoothed(np.ones(9)) - 1).max() < 1e-9


APACHE = """/*
 * Copyright 2024 The Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }"""
BSD = """Copyright (c) 2024, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def gpl(kind, version, thing="program", sign=":"):
    lines = f"This {thing} is free software{sign} you can redistribute it and/or modify|it under the terms of the GNU {kind}General Public License as published by|the Free Software Foundation, either version {version} of the License, or|(at your option) any later version.||This {thing} is distributed in the hope that it will be useful,|but WITHOUT ANY WARRANTY."
    return "\n".join(f"# {x}".rstrip() for x in lines.split("|"))


NOTICES = [
    (APACHE, ["Apache-2.0"]), (BSD, ["BSD-3-Clause"]), (BSD[: BSD.index("3. ")], ["BSD-2-Clause"]), (gpl("", "3"), ["GPL-3.0"]), (gpl("", "2", sign=";"), ["GPL-2.0"]), (gpl("Lesser ", "2.1", "library", ";"), ["LGPL-2.1"]),
    (gpl("Lesser ", "3", "library"), ["LGPL-3.0"]), (gpl("Affero ", "3"), ["AGPL-3.0"]), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Prose here. Licensed under CC BY-NC 4.0. And more prose.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("// SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0"]), ("Licensed under the MIT license. Parts are licensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
    ("licensed under the licence of the union, and released under the stars of the night", []), ("", []), (None, []), ("mit", []),
]


def test_one_licence_for_a_notice(spark):
    got = {}
    for r in license_scan.scan(rows(spark, [(i, t) for i, (t, _) in enumerate(NOTICES)])).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert [sorted(got.get(i, [])) for i in range(len(NOTICES))] == [want for _, want in NOTICES]


def places(text, threshold=0.8):
    """License, words and Dice of the passages that win, by trying every start and end."""
    w = license_scan.normal_words(text or "")
    pairs = lambda x: list(zip(x, x[1:], strict=False))
    good = []
    for t, (name, keys, template) in enumerate(license_scan.TEMPLATES):
        x = license_scan.normal_words(template)
        grams, n = pairs(x), len(x)
        own = set(grams)
        low, high = license_scan.bounds(len(own), threshold)
        votes = [s for s in range(-n, len(w)) if 4 * sum(0 <= s + k < len(w) - 1 and (w[s + k], w[s + k + 1]) == g for k, g in enumerate(grams)) >= len(own)]
        for lo, hi in {(max(a, 0), min(b + n, len(w))) for a in votes for b in votes if a <= b <= a + n // 2}:
            part = set(pairs(w[lo:hi]))
            dice = 2 * len(part & own) / (len(part) + len(own))
            if low <= len(part) <= high and set(keys.split()) <= set(w[lo:hi]) and dice >= threshold:
                good.append((dice, hi - lo, -t, -lo, name))
    best = [max(g for g in good if -g[3] <= p < -g[3] + g[1]) for p in range(len(w)) if any(-g[3] <= p < -g[3] + g[1] for g in good)]
    return {(g[4], tuple(w[-g[3] : -g[3] + g[1]]), round(g[0], 6)) for g in good if 2 * best.count(g) > g[1]}


def test_licences_against_python(spark):
    """Edited, repeated and overlapping notices, nulls, repeated rows, rows that share an id, rows without one."""
    r = random.Random(3)
    notices = [t for _, _, t in license_scan.TEMPLATES]
    data = [(1, None), (2, ""), (3, "word"), (4, APACHE), (5, BSD), (5, BSD), (6, gpl("", "3") + "\n" + gpl("Lesser ", "2.1", "library", ";")), (7, "MIT\nMIT\nReleased under the MIT License.\nReleased under the MIT License."), (None, notices[0]), (None, notices[30])]
    for i in range(40):
        words = " ".join(r.choice(notices) for _ in range(r.randint(1, 3))).split()
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(words))
            words[k : k + r.randint(0, 1)] = [r.choice(["of", "the", "other", "license"])] * r.randint(0, 2)
        data.append((100 + i // 2, " ".join(words)))
    want = {}
    for i, t in data:
        for name, words, dice in places(t):
            parts, most = want.setdefault((i, name), (set(), []))
            parts.add(words)
            most.append(dice)
    want = {k: (len(p), max(d)) for k, (p, d) in want.items() if not (k[1] == "BSD-2-Clause" and (k[0], "BSD-3-Clause") in want)}
    got = {(x["doc_id"], x["license"]): (x["n_parts"], x["dice"]) for x in license_scan.scan(rows(spark, data)).collect()}
    assert got == want and len(want) > 30
    assert license_scan.scan(rows(spark, [])).collect() == []


def test_media_round_trip(spark):
    r = random.Random(2)
    data = [(1, None), (2, ""), (3, "abc"), (4, "é" * 5000), (5, "".join(chr(r.randrange(32, 0x2000)) for _ in range(9000))), (5, "abc")]
    got = sorted((x["doc_id"], x["n_bytes"], bytes(x["media"])) for x in motion_jpeg.store(rows(spark, data)).collect())
    for (i, n, media), (j, t) in zip(got, sorted(data, key=lambda x: (x[0], len((x[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        avi, frames = motion_jpeg.opened(media)
        assert i == j and n == len(raw) and motion_jpeg.payload_of(frames, avi.payload) == raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert len(frames) == len(avi.frames) and frames[0].shape[1] == 64
    assert motion_jpeg.store(rows(spark, [])).collect() == []


def test_media_columns_of_a_table(spark, monkeypatch):
    """The registered columns against plain Python, for nulls, empty texts, repeated rows, rows without an id and clashing columns."""
    import hashlib

    r = random.Random(4)
    data = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "é" * 3000), (5, "x" * 64), (6, "".join(chr(r.randrange(32, 0x2000)) for _ in range(9000)))]
    got = sorted((str(x["doc_id"]), *list(x)[1:5]) for x in motion_jpeg.store(rows(spark, data)).mapInArrow(motion_jpeg.on_executors("motion_jpeg", "digests"), motion_jpeg.DIGEST).collect())
    want = []
    for i, t in data:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert got == sorted(want)
    assert motion_jpeg.store(rows(spark, [])).mapInArrow(motion_jpeg.on_executors("motion_jpeg", "digests"), motion_jpeg.DIGEST).collect() == []


def test_damaged_files_are_rows_with_an_error(spark):
    good = motion_jpeg.write_avi(bytes(range(256)) * 64)
    r = random.Random(5)
    files = [good, None, b"", good[:300]]
    for _ in range(300):
        x = bytearray(good)
        for _ in range(r.randint(1, 4)):
            x[r.randrange(len(x))] = r.randrange(256)
        files.append(bytes(x[: r.choice([len(x), r.randrange(1, len(x))])]))
    d = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")
    out = motion_jpeg.clips(d).collect()
    assert {x["doc_id"] for x in out if x["error"] is None} | {x["doc_id"] for x in out if x["error"]} == set(range(len(files)))
    assert all((x["clip"] is None) == (x["error"] is not None) for x in out) and {1, 2, 3} <= {x["doc_id"] for x in out if x["error"]}


def test_any_baseline_frame_decodes_bit_by_bit():
    values = np.random.default_rng(1).integers(0, 256, (2, 64), np.uint8)
    frame = motion_jpeg.encode_frame(values)
    at = frame.index(b"\xff\xda") + 10
    tables = [motion_jpeg._huffman(bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))[0], motion_jpeg._huffman(bytes([1] + [0] * 15) + b"\0")[0]]
    slow = motion_jpeg._blocks(frame[at:-2], 128, np.full(64, 8), *tables, 0)
    assert (slow == values.reshape(-1, 1, 1)).all() and (motion_jpeg.decode_frame(frame) == values).all()


def test_cuts_and_clips(spark):
    rng = np.random.default_rng(0)
    calm = [rng.integers(0, 60, (16, 64)).astype(np.uint8) for _ in range(6)]
    loud = [rng.integers(180, 250, (16, 64)).astype(np.uint8) for _ in range(5)]
    assert motion_jpeg.cuts(calm + loud) == [0, 6]
    assert motion_jpeg.cuts([]) == [] and motion_jpeg.cuts(calm[:1]) == [0]
    clips = motion_jpeg.clips(motion_jpeg.store(rows(spark, [(1, "a" * 9000), (2, "b")]))).collect()
    assert {(c["doc_id"], c["clip"], c["first_frame"]) for c in clips} >= {(1, 0, 0), (2, 0, 0)}
    assert all(c["end_s"] > c["start_s"] for c in clips)
    with pytest.raises(ValueError):
        motion_jpeg.read_avi(b"RIFF....WAVE")


def test_registry_has_every_operator(spark, small):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {re.match(r"op\d+_", n)[0] for n in names if re.match(r"op\d+_", n)} == {f"op{k}_" for k in range(1, 13)}
    assert set(entry.oracle_sql()) <= names and "pipeline" in names
    d = entry.queries()["op6_media_columns"](spark, small).first()
    assert d["payload_bytes"] % 64 == 0 and 0 <= d["tail_crc32"] < 1 << 32 and zlib.crc32(b"") == 0


def test_pipeline_against_brute_force(spark, small):
    """Each stage on what its predecessor kept: statistics and rules, shingles of all pairs, all strings of PASSAGE bytes, all ids."""
    import corpus_pipeline as p
    from collections import Counter

    import public_tokenizers

    from sparkevid.llm import packing

    from .test_dedup import shingle_groups

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(p.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rules = quality_rules.learn_rules(docs, spark.read.parquet(f"{small}/labels.parquet"))

    def keeps(text):
        n = statistics(text)
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        x = {
            "n_words": n[0], "word_length": n[1] / max(n[0], 1), "symbols_per_word": n[2] / max(n[0], 1), "repeat_share": n[4] / max(n[0], 1), "dup_line_share": n[3] / max(len(lines), 1),
            "upper_share": sum(c in quality_rules._UPPER for c in text) / max(n[1], 1), "marks_per_word": sum(c in quality_rules._MARKS for c in text) / max(n[0], 1), "distinct_share": len(set(w)) / max(n[0], 1),
        }
        holds = lambda c: x[c.feature] >= c.threshold if c.at_least else x[c.feature] < c.threshold
        return not n[5] and not any(all(map(holds, rule)) for rule in rules)

    docs = stages["quality_rules"](spark, docs, small).persist()
    assert docs.columns == columns
    texts = {i: t for i, t in texts.items() if keeps(t)}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts

    docs = stages["simhash_near_dedup"](spark, docs, small).persist()
    ids = list(texts)
    stay = {min(ids[k] for k in g) for g in shingle_groups([texts[i] for i in ids])}
    texts = {i: t for i, t in texts.items() if i in stay}
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == texts

    docs = stages["suffix_array_dedup"](spark, docs, small).persist()
    data = {i: t.encode() for i, t in texts.items()}
    size = p.PASSAGE
    seen = Counter(b[k : k + size] for b in data.values() for k in range(len(b) - size + 1))
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        at, kept = 0, []
        for c in texts[i]:  # a character goes if all of its bytes go
            n = len(c.encode())
            kept.append("" if all(gone[at : at + n]) else c)
            at += n
        texts[i] = "".join(kept)
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == texts

    packed = stages["best_fit_packing"](spark, docs, small).collect()
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, k, s, n) for i, t in texts.items() for k, (s, n) in enumerate(packing.cut(len(encode(t)) + 1, 1024)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed) == want
    assert max(Counter({s: sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed}}).values()) <= 1024


def test_cuts_at_the_start_and_short_shots():
    shot = lambda level, n: [np.full((16, 64), level, np.uint8)] * n
    assert motion_jpeg.cuts(shot(0, 1) + shot(200, 5)) == [0, 1]
    assert motion_jpeg.cuts(shot(0, 2) + shot(200, 5)) == [0, 2]
    assert motion_jpeg.cuts(shot(0, 4) + shot(90, 2) + shot(200, 2) + shot(0, 1) + shot(120, 1)) == [0, 4, 6, 8, 9]
    assert motion_jpeg.cuts(shot(0, 1) + shot(200, 3) + shot(0, 3)) == [0, 1, 4]
    assert motion_jpeg.cuts(shot(7, 9)) == [0]


def test_pages_keep_all_that_is_no_furniture():
    first, second = (" ".join(f"{w}{i}" for i in range(n)) + "." for w, n in (("first", 60), ("second", 40)))
    menu = "<div><a href=a>One</a> <a href=b>Two</a></div>"
    assert html_text.extract(f"<body>{menu}<main><article><p>{first}</p></article><article><p>{second}</p></article></main></body>") == f"{first}\n{second}"
    assert html_text.extract(f"<body>{menu}<article><p>{first}</p></article><div><article><p>{second}</p></article></div></body>").endswith(f"{first}\n{second}")
    body = "".join(f"<p>{first}</p>" for _ in range(5))
    want = "\n".join(["A title", "A short lead.", *[first] * 5])
    assert html_text.extract(f"<body><nav>Home</nav><div><h1>A title</h1><p>A short lead.</p><div>{body}</div></div></body>") == want
    assert html_text.extract(f"<body>{menu}<div><h1>A title</h1><p>A short lead.</p><article>{body}</article></div></body>") == want
    assert html_text.extract(f"<body>{menu}<div><p>{first}</p></div><div><p>{second}</p></div><footer>x</footer></body>").endswith(f"{first}\n{second}")


def test_pipeline_of_edge_cases(spark, small):
    """Null and empty texts, null and repeated ids, repeated rows, texts that share an id, extra columns; and an empty table."""
    import corpus_pipeline as p

    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    a, b, c, d = (text(80) for _ in range(4))
    near = " ".join([*a.split()[:40], "other", *a.split()[41:]])
    data = [(1, None), (2, ""), (3, a), (3, a), (4, near), (5, b), (5, c), (None, d), (None, d), (None, b.upper())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in data], schema).repartition(3)
    out, empty = docs, docs.limit(0)
    for name, stage in p.STAGES:
        out, empty = stage(spark, out, small), stage(spark, empty, small)
        if name != "best_fit_packing":
            assert out.columns == docs.columns == empty.columns
        if name == "quality_rules":
            assert sorted((str(x["doc_id"]), x["text"]) for x in out.collect()) == sorted((str(i), t) for i, t in data if t)
        if name == "simhash_near_dedup":
            assert sorted((str(x["doc_id"]), x["text"], x["kept"], x["spans"]) for x in out.collect()) == sorted((str(i), t, "clash", 1) for i, t in [(3, a), (5, b), (5, c), (None, d)])
    assert sorted(str(x["doc_id"]) for x in out.collect()) == ["3", "5", "5", "None"] and empty.collect() == []
