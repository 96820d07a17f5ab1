"""What is broadcast: sides of few rows and few bytes."""

from pyspark.sql import functions as F

from sparkevid import session


def hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in df._jdf.queryExecution().logical().toString()


def test_small_sides_by_rows_and_bytes(spark, monkeypatch):
    few = spark.range(10).withColumn("text", F.repeat(F.lit("x"), 100)).withColumn("list", F.array("text", "text"))
    assert hinted(session.small(few))
    assert few.measured[0] == 10 and 10 * 300 < few.measured[1] < 10 * 400
    monkeypatch.setattr(session, "SMALL_BYTES", 1000)
    assert not hinted(session.small(few.select("*")))
    monkeypatch.setattr(session, "SMALL", 5)
    assert not hinted(session.small(spark.range(10)))
    assert hinted(session.small(spark.range(3)))


def test_sides_that_another_table_is_counted_for(spark, monkeypatch):
    ids, texts, of = spark.range(5), spark.range(5).withColumn("t", F.lit("x")), spark.range(20)
    assert hinted(session.small(ids, of=of, times=3))
    monkeypatch.setattr(session, "SMALL_TEXTS", 50)
    assert hinted(session.small(ids, of=of, times=3)) and not hinted(session.small(texts, of=of, times=3))
    monkeypatch.setattr(session, "SMALL", 50)
    assert not hinted(session.small(ids, of=of, times=3))


def test_empty(spark):
    assert session.small(spark.range(0)).count() == 0
