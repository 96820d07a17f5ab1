"""A slot for a language model: greedy continuation of prompts by a plugged-in model, loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Tokens that are generated at most.
LIMIT = 50


@dataclass(frozen=True)
class Model:
    """``scores`` gives a score for each id that may follow some ids; the greatest wins, the least id of equals."""

    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]
    scores: Callable[[list[int]], list[float]]
    end: int


def continued(model: Model, prompt: str, limit: int = LIMIT) -> str:
    ids = model.encode(prompt)
    start = len(ids)
    while len(ids) - start < limit:
        scores = model.scores(ids)
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        if best == model.end:
            break
        ids.append(best)
    return model.decode(ids[start:])


def generated(prompts: DataFrame, load: Callable[[], Model], limit: int = LIMIT) -> DataFrame:
    """Adds ``generated`` to rows with prompt; a null prompt stays null. ``load`` runs on the executors, once a task."""

    def run(batches: Iterator):
        model = load()
        for pdf in batches:
            yield pdf.assign(generated=[None if p is None else continued(model, p, limit) for p in pdf["prompt"]])

    return prompts.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, generated string")
