"""Sinks: conversations as JSON or Markdown, JSON lines and arrays, the feedback log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEEDBACK = "schema_version int, ts double, iso string, vote int, question string, answer string, intent string, answer_type string, confidence double, supported boolean, sources array<struct<rank:int,id:bigint,preview:string,evidence:string,score:double>>, extra map<string,string>"


def _turns(conversations: DataFrame, key: str, order: str) -> DataFrame:
    """A conversation's turns in order; a conversation is one record of the export, so its turns meet."""
    return conversations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "role", "text"))).alias("t"))


def markdown(conversations: DataFrame, key: str, order: str) -> DataFrame:
    """key, n_turns, markdown: "**role:** text" paragraphs in order."""
    parts = F.transform("t", lambda x: F.concat(F.lit("**"), x["role"], F.lit(":** "), x["text"]))
    return _turns(conversations, key, order).select(key, F.size("t").cast("long").alias("n_turns"), F.array_join(parts, "\n\n").alias("markdown"))


def as_json(conversations: DataFrame, key: str, order: str) -> DataFrame:
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return _turns(conversations, key, order).select(key, F.to_json(F.struct(messages.alias("messages"))).alias("json"))


def vote(v: Column) -> Column:
    """Votes other than -1, 0 and 1 count as 0."""
    return F.when(v.isin(-1, 0, 1), v).otherwise(0)


def append_feedback(rows: DataFrame, path: str) -> None:
    """Append normalised feedback rows; a batch becomes visible as a whole when its job commits."""
    rows.withColumn("vote", vote(F.col("vote"))).write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, by: str) -> None:
    """One file with one JSON array of the rows, in order of a unique column: a format to hand over, which one task sorts and writes."""
    spark = df.sparkSession
    first = df.agg(F.min(by)).first()[0]
    text = F.concat(F.when(F.col(by) == F.lit(first), "").otherwise(","), F.to_json(F.struct(*df.columns)))
    rows = df.select(F.lit(1).alias("part"), F.col(by).alias("place"), text.alias("value"))
    ends = [spark.range(1).select(F.lit(part).alias("part"), F.lit(None).cast(df.schema[by].dataType).alias("place"), F.lit(x).alias("value")) for part, x in ((0, "["), (2, "]"))]
    rows.unionByName(ends[0]).unionByName(ends[1]).repartition(1).sortWithinPartitions("part", "place").select("value").write.mode("overwrite").text(path)
