"""What happened before each row, against a plain loop: ties, NULL keys and times, hot keys, empty tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stallkeeper.operators.history import Level, as_of

START = datetime(2024, 1, 30)
PROBE = "id long, who string, kind string, at timestamp_ntz, n int"


def levels():
    return [Level([], {"events": F.lit(1).cast("long"), "spend": F.col("price")}), Level(["kind"], {"alike": F.lit(1).cast("long")})]


def tables(spark, n=400, seed=1):
    random.seed(seed)
    who = lambda: random.choice(["a"] * 6 + ["b", "c", None])
    kind = lambda: random.choice(["x", "y", None])
    time = lambda: random.choice([START + timedelta(hours=random.randint(0, 90)), START + timedelta(days=40, microseconds=random.randint(0, 3)), None])
    probes = [(i, who(), kind(), time(), i) for i in range(n)]
    events = [(who(), kind(), time(), random.choice([None, 1, 5, -2])) for _ in range(n)]
    return probes, events


def brute(probes, events):
    out = []
    for i, who, kind, at, n in probes:
        past = [e for e in events if who is not None and at is not None and e[0] == who and e[2] is not None and e[2] < at]
        out.append((i, who, kind, at, n, len(past), sum(e[3] or 0 for e in past), sum(kind is not None and e[1] == kind for e in past)))
    return sorted(out)


def run(spark, probes, events, **options):
    p, e = spark.createDataFrame(probes, PROBE), spark.createDataFrame(events, "who string, kind string, t timestamp_ntz, price int")
    out = as_of(p.repartition(3), e.withColumn("price", F.col("price").cast("decimal(12,2)")), ["who"], levels(), "at", "t", **options)
    assert out.columns == ["id", "who", "kind", "at", "n", "events", "spend", "alike"]
    return sorted((r[0], r[1], r[2], r[3], r[4], r[5], int(r[6]), r[7]) for r in out.collect())


def test_history_is_brute_force(spark):
    probes, events = tables(spark)
    for seconds in (3600, 86400, 10**8):
        assert run(spark, probes, events, chunk_seconds=seconds) == brute(probes, events)


def test_history_of_empty_tables(spark):
    probes, events = tables(spark, 30)
    assert run(spark, probes, []) == brute(probes, [])
    assert run(spark, [], events) == []


def test_a_hot_key_is_cut_into_stretches(spark):
    """One customer has all rows; no task of the window sees more than a day of them."""
    rows = spark.range(4800).select("id", F.lit("a").alias("who"), F.lit("x").alias("kind"), (F.lit(START) + F.make_dt_interval(hours=(F.col("id") % 480).cast("int"))).cast("timestamp_ntz").alias("at"), F.lit(1).alias("n"))
    events = rows.select("who", "kind", F.col("at").alias("t"), F.lit(1).cast("decimal(12,2)").alias("price"))
    out = as_of(rows, events, ["who"], levels(), "at", "t")
    wrong = out.where(F.col("events") != 10 * (F.col("id") % 480))
    assert wrong.count() == 0 and out.count() == 4800
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1
