"""Compare retrieval systems on benchmark passages over a corpus.

    python jobs/evaluate_retrieval.py --config jobs/evaluate_retrieval.json [--documents PATH --benchmark PATH --target DIR]

Reads documents (doc_id, text) and passages (item_id, text). Each passage gives a case that should be found and one that should be
rejected; every system answers all cases at once. Writes, partitioned by system, ``cases`` (ranks and the reason of a failure) and
``summary`` (recall, reciprocal ranks, rejection by category), and ``paired`` (two systems side by side). A partition is replaced as a whole when
its system is run again, those of other systems stay; ``paired`` is made of what then stands in ``cases``.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkevid.operators import evaluation

LOG = logging.getLogger("jobs.evaluate_retrieval")
CASES = "qid long, item_id long, category string, question string, supported boolean, expected string, contradiction string, support_rank int, contradiction_rank int, reason string, system string"


def _replace(df: DataFrame, path: str) -> None:
    """Replace the partitions of the systems in ``df``."""
    df.repartition("system").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("system").parquet(path)


def run(spark: SparkSession, documents: str, benchmark: str, target: str, systems: tuple[str, ...] = ("keyword", "lexical"), k: int = 5) -> dict[str, int]:
    """Evaluate ``systems``; returns the numbers of documents, passages and rows written."""
    d, b = spark.read.parquet(documents), spark.read.parquet(benchmark)
    read = {"documents": d.count(), "passages": b.count()}
    LOG.info("read %d documents of %s and %d passages of %s", read["documents"], documents, read["passages"], benchmark)
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "text")
    chosen = {name: evaluation.SYSTEMS[name] for name in systems}
    results = evaluation.evaluate(chunks, b.select("item_id", "text"), k, chosen)
    _replace(results.select(*(c.split()[0] for c in CASES.split(", "))), f"{target}/cases")
    every = spark.read.schema(CASES).parquet(f"{target}/cases")
    _replace(evaluation.by_system(every.where(F.col("system").isin(list(systems)))), f"{target}/summary")
    if len(systems) == 2:
        evaluation.paired(every, *systems).write.mode("overwrite").parquet(f"{target}/paired")
    wrote = {"rows": every.where(F.col("system").isin(list(systems))).count()}
    LOG.info("wrote %d cases of %s to %s", wrote["rows"], ", ".join(systems), target)
    return read | wrote


def report(spark: SparkSession, target: str) -> DataFrame:
    """Every case with its system's figures for the case's category."""
    cases, summary = spark.read.schema(CASES).parquet(f"{target}/cases"), spark.read.parquet(f"{target}/summary")
    return cases.join(summary, ["system", "category"])


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--config", required=True)
    for name in ("documents", "benchmark", "target"):
        parser.add_argument(f"--{name}")
    given = vars(parser.parse_args(argv))
    with open(given.pop("config"), encoding="utf-8") as f:
        settings = json.load(f) | {k: v for k, v in given.items() if v}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("evaluate_retrieval").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **settings | {"systems": tuple(settings.get("systems", ("keyword", "lexical")))})
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
