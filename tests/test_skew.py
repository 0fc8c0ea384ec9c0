"""Operators on data where one key holds most rows, against plain windows and brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window, functions as F

from stallkeeper.functions import hashing as H
from stallkeeper.operators import access, behaviour, builders as B, inventory as I, relational as R, windows as W

T0 = datetime(2024, 3, 1)


def key(rng):
    return "hot" if rng.random() < 0.6 else f"k{rng.randrange(8)}"


def test_running_equals_plain_window(spark):
    rng = random.Random(1)
    rows = [(i, key(rng), T0 + timedelta(minutes=rng.randrange(60 * 24 * 20)), rng.randrange(-9, 20)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v int")
    got = W.running(df, ["k"], W.chunk_of("ts", 6 * 3600), ["ts", "id"], {"s": F.col("v").cast("long"), "n": F.lit(1).cast("long")})
    plain = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"s": F.sum("v").over(plain), "n": F.count("*").over(plain)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    before = W.running(df, ["k"], W.chunk_of("ts", 3600), ["ts", "id"], {"s": F.col("v").cast("long")}, include_current=False)
    prior = df.withColumn("s", F.coalesce(F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, prior.collect()))


def test_sessions_equal_plain_window_for_any_chunk(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), T0 + timedelta(seconds=rng.randrange(86400 * 9))) for i in range(2500)]
    df = spark.createDataFrame(rows, "http_request_id long, customer_id long, timestamp timestamp_ntz")
    order = Window.partitionBy("customer_id").orderBy("timestamp", "http_request_id")
    gap = F.col("timestamp") - F.lag("timestamp").over(order) < F.expr("interval 30 minutes")
    want = df.withColumn("f", F.when(F.coalesce(gap, F.lit(False)), 0).otherwise(1)).withColumn("session_no", F.sum("f").over(order)).drop("f")
    expected = sorted(map(tuple, want.collect()))
    for chunk in (600, 3600, 7 * 86400):
        assert sorted(map(tuple, W.sessionize(df, chunk_seconds=chunk).collect())) == expected


def test_sequence_ids_are_contiguous(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=rng.randrange(9000))) for i in range(2000)], "id long, ts timestamp_ntz").repartition(7)
    rows = sorted(W.sequence_ids(df, "n", ["ts", "id"]).collect(), key=lambda r: (r.ts, r.id))
    assert [r.n for r in rows] == list(range(1, 2001))
    assert W.sequence_ids(df.limit(0), "n", ["ts", "id"]).count() == 0


def test_a_dense_second_is_numbered_by_several_tasks(spark):
    """Nine rows in ten are at one instant; no range has much more than its share."""
    ts = F.when(F.col("id") % 10 != 0, F.lit(T0)).otherwise(F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int")))
    df = spark.range(20_000).withColumn("ts", ts.cast("timestamp_ntz")).repartition(5)
    out = W.sequence_ids(df, "n", ["ts", "id"], first=0, parts=8)
    sizes = [r["count"] for r in out.groupBy(F.floor(F.col("n") * 0 + F.spark_partition_id())).count().collect()]
    assert sum(sizes) == 20_000
    assert [r.id for r in out.orderBy("n").select("id").collect()] == [r.id for r in df.orderBy("ts", "id").select("id").collect()]
    assert out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (0, 19_999, 20_000)
    dealt = df.repartitionByRange(8, "ts", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in dealt.collect()) < 2 * 20_000 / 8


def brute_allocate(requests, offers):
    left, result = {}, {}
    for sku, merchant, stock in sorted(offers):
        left.setdefault(sku, []).append([merchant, stock])
    for rid, sku, quantity, _ in sorted(requests, key=lambda r: (r[3], r[0])):
        result[rid] = None
        for entry in left.get(sku, []):
            if entry[1] >= quantity:
                entry[1] -= quantity
                result[rid] = entry[0]
                break
    return result


def test_greedy_allocation_equals_brute_force_with_a_hot_sku(spark):
    for seed in range(3):
        rng = random.Random(seed)
        requests = [(i, key(rng), rng.choice([1, 1, 2, 3, 5, 40]), T0 + timedelta(minutes=rng.randrange(60 * 24 * 10))) for i in range(2500)]
        offers = [(s, f"m{j}", rng.randrange(0, 120)) for s in ["hot", *[f"k{i}" for i in range(7)]] for j in range(rng.randrange(1, 6))]
        asked = spark.createDataFrame(requests, "id long, sku string, quantity int, ts timestamp_ntz").repartition(5)
        got = I.greedy_allocate(asked, spark.createDataFrame(offers, "sku string, merchant_id string, stock int"), ["ts", "id"], 7200)
        rows = got.collect()
        assert len(rows) == 2500 and {r.id: r.merchant_id for r in rows} == brute_allocate(requests, offers)


def test_greedy_allocation_survives_small_arrow_batches(spark):
    rng = random.Random(9)
    requests = [(i, key(rng), rng.choice([1, 2, 3]), T0 + timedelta(minutes=i)) for i in range(600)]
    offers = [("hot", "a", 50), ("hot", "b", 60), ("k1", "a", 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = I.greedy_allocate(spark.createDataFrame(requests, "id long, sku string, quantity int, ts timestamp_ntz"),
                                spark.createDataFrame(offers, "sku string, merchant_id string, stock int"), ["ts", "id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: r.merchant_id for r in got} == brute_allocate(requests, offers)


def test_views_near_sales_equals_brute_force(spark):
    rng = random.Random(4)
    at = lambda: T0 + timedelta(seconds=rng.randrange(86400), microseconds=rng.choice([0, 0, 500000]))
    views = [(i, key(rng), rng.choice([1, 1, 2]), at(), rng.random() < 0.8) for i in range(600)]
    sales = [(i, key(rng), rng.choice([1, 1, 2]), at()) for i in range(300)]
    sales += [(900 + i, v[1], v[2], v[3] + timedelta(seconds=d)) for i, (v, d) in enumerate(zip(views, [3600, -3600, 3599, 0] * 20))]
    got = R.views_near_sales(
        spark.createDataFrame(sales, "order_id long, sku string, customer_id long, order_timestamp timestamp_ntz"),
        spark.createDataFrame(views, "http_request_id long, sku string, customer_id long, timestamp timestamp_ntz, instock boolean"))
    for r in got.collect():
        near = [v for v in views if v[1] == r.sku and v[2] == r.customer_id and abs((v[3] - r.order_timestamp).total_seconds()) < 3600]
        assert (r.has_view, r.has_out_of_stock_view) == (bool(near), any(not v[4] for v in near))


def test_rule_matching_equals_pairwise_test(spark):
    rng = random.Random(5)
    level = lambda: rng.choice(["a", "b", "+", "c.d"])
    rules = [("u" + str(rng.randrange(2)), "/".join([level() for _ in range(rng.randrange(1, 4))] + (["#"] if rng.random() < 0.3 else [])), rng.choice([1, 2, 3])) for _ in range(60)]
    asked = [(i, "u" + str(rng.randrange(3)), "/".join(rng.choice(["a", "b", "c.d", ""]) for _ in range(rng.randrange(1, 5)))) for i in range(200)]
    rule_df = spark.createDataFrame(rules, "username string, topic string, rw int")
    ask_df = spark.createDataFrame(asked, "id long, username string, topic string")
    got = access.match_rules(ask_df, rule_df).select("id", "pattern", "granted").collect()
    pairs = ask_df.alias("a").join(rule_df.alias("r"), F.col("a.username") == F.col("r.username")).filter(access.topic_matches(F.col("a.topic"), F.col("r.topic")))
    want = pairs.select("id", F.col("r.topic"), "rw").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_draws_do_not_depend_on_partitioning(spark):
    ids = spark.range(500)
    one = behaviour.enrich_customers(B.customers(ids.repartition(1), "id"))
    many = behaviour.enrich_customers(B.customers(ids.repartition(200), "id"))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_fan_out_is_distinct_and_even(spark):
    products = spark.range(4000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sku"))
    rows = B.fan_out_offers(products, F.lit(10)).groupBy("sku").agg(F.count("*").alias("n"), F.countDistinct("merchant_id").alias("d")).collect()
    assert len(rows) == 4000 and all(r.n == r.d and 1 <= r.n <= 4 for r in rows)
    shares = [r["count"] for r in B.fan_out_offers(products, F.lit(10)).groupBy("merchant_id").count().collect()]
    assert len(shares) == 10 and min(shares) > 850 and max(shares) < 1150


def test_sampling_shapes(spark):
    ids = spark.range(20000)
    row = ids.agg(
        F.avg(H.u("a", "id")).alias("u"), F.avg(H.normal(5.0, 2.0, H.u("b", "id"), H.u("c", "id"))).alias("n"), F.avg(H.exponential(3.0, H.u("d", "id"))).alias("e"),
        F.avg(H.beta(2, 6, "e", "id")).alias("b"), F.avg(H.poisson(F.lit(2.1), 20, H.u("f", "id"))).alias("p")).first()
    for got, want, width in zip(row, (0.5, 5.0, 3.0, 0.25, 2.1), (0.01, 0.05, 0.08, 0.01, 0.05)):
        assert abs(got - want) < width


def test_allocation_among_a_thousand_merchants(spark):
    rng = random.Random(11)
    offers = [("S", f"M{i:04d}", rng.choice([0, 1, 2, 5, 9])) for i in range(1000)] + [("T", "M1", 3)]
    requests = [(i, "S", rng.choice([1, 2, 3, 5, 8, 9, 10]), T0 + timedelta(seconds=i // 3)) for i in range(2500)] + [(9000 + i, "T", 1, T0) for i in range(5)]
    asked = spark.createDataFrame(requests, "id long, sku string, quantity int, ts timestamp_ntz")
    got = I.greedy_allocate(asked, spark.createDataFrame(offers, "sku string, merchant_id string, stock int"), ["ts", "id"])
    assert {r.id: r.merchant_id for r in got.collect()} == brute_allocate(requests, offers)


def test_first_fit_tree():
    rng = random.Random(12)
    for n in (0, 1, 2, 3, 7, 64, 100):
        plain = [rng.randrange(20) for _ in range(n)]
        tree = I.FirstFit(plain)
        for _ in range(300):
            need = rng.randrange(1, 22)
            want = next((i for i, have in enumerate(plain) if have >= need), None)
            assert tree.take(need) == want
            if want is not None:
                plain[want] -= need


def test_null_keys_of_a_left_join_are_spread(spark):
    """Three rows in four have no key; with shuffled joins no task gets them all, and the rows are those of a plain join."""
    left = spark.range(8000).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 50).alias("k"), F.lit("x").alias("j")).repartition(4)
    right = spark.createDataFrame([(i, "x", i * 2) for i in range(40)] + [(None, "x", 9), (7, None, 9)], "k long, j string, v int")
    plain = sorted(map(tuple, left.join(right, ["k", "j"], "left").select("id", "k", "j", "v").collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = R.left_join(left, right, ["k", "j"])
        assert joined.columns == ["k", "j", "id", "v"]
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2] and sum(sizes) == 8000
        assert sorted(map(tuple, joined.select("id", "k", "j", "v").collect()), key=lambda r: r[0]) == sorted(plain, key=lambda r: r[0])
        found = R.lookup_default(left, right, ["k", "j"], "v", -1)
        assert found.where("k IS NULL AND v <> -1").count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
