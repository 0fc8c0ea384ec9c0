"""Small hand-written tables for the edge cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stallkeeper import dims, values as V
from stallkeeper.functions import calendar as C, hashing as H, scalar as S, scores
from stallkeeper.operators import access, aggregates as A, behaviour, inventory as I, relational as R, windows as W

T0 = datetime(2024, 1, 1, 23, 50)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_session_gap_is_exclusive_and_crosses_midnight(spark):
    at = [T0, T0, T0 + timedelta(seconds=1799, microseconds=999999), T0 + timedelta(seconds=3599, microseconds=999999)]
    rows = [(1, t, i) for i, t in enumerate(at)] + [(2, T0, 9)]
    events = frame(spark, rows, "customer_id long, timestamp timestamp_ntz, http_request_id long")
    got = {r.http_request_id: r.session_no for r in W.sessionize(events).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 9: 1}


def test_promo_calendar(spark):
    days = {"2024-01-22": 1.0, "2024-01-23": 3.0, "2024-01-29": 3.0, "2024-01-30": 1.0, "2024-02-29": 1.0, "2024-03-16": 2.0, "2024-11-03": 4.0,
            "2024-11-04": 1.0, "2024-12-23": 1.8, "2024-12-30": 1.0, "2024-06-01": 1.4, "2024-06-02": 1.4}
    df = frame(spark, [(d,) for d in days], "d string").select("d", C.promo_multiplier("to_date(d)").alias("m"))
    assert {r.d: r.m for r in df.collect()} == days


def test_whole_days_and_seconds(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 23:00:00' AS a, TIMESTAMP_NTZ'2024-01-02 00:00:00' AS b, DATE'2024-02-29' AS d")
    row = df.select(C.whole_days(F.col("a"), F.col("b")).alias("w"), C.at_second(F.col("d"), F.lit(86399)).alias("s")).first()
    assert (row.w, str(row.s)) == (0, "2024-02-29 23:59:59")


def test_stock_status_order(spark):
    rows = [(0, 0, 0), (9, 0, 1), (10, 0, 1), (20, 20, 1), (20, 0, 21), (20, 25, 0)]
    df = frame(spark, rows, "stock int, reserved int, requested int").withColumns(R.stock_status(F.col("stock"), F.col("reserved"), F.col("requested")))
    got = [(r.available_qty, r.can_fulfill, r.stock_status) for r in df.collect()]
    assert got == [(0, True, "out_of_stock"), (9, True, "low_stock"), (10, True, "in_stock"), (0, False, "insufficient_stock"),
                   (20, False, "insufficient_stock"), (0, True, "in_stock")]


def test_allocation_skips_then_succeeds(spark):
    asked = frame(spark, [(1, "s", 6, T0), (2, "s", 6, T0 + timedelta(days=1)), (3, "s", 4, T0 + timedelta(days=2)), (4, "x", 1, T0)],
                  "id long, sku string, quantity int, ts timestamp_ntz")
    offers = frame(spark, [("s", "m1", 10)], "sku string, merchant_id string, stock int")
    got = {r.id: r.merchant_id for r in I.greedy_allocate(asked, offers, ["ts", "id"]).collect()}
    assert got == {1: "m1", 2: None, 3: "m1", 4: None}


def test_topic_patterns(spark):
    cases = [("admin/t", "admin/t/#", True), ("admin/t/a/b", "admin/t/#", True), ("admin/u", "admin/t/#", False), ("a/b/c", "a/+", False),
             ("a/b", "a/+", True), ("any/thing", "#", True), ("a.c", "a+c", False), ("a//c", "a/+/c", True), ("a/", "a/+", True), ("a", "a/+", False)]
    df = frame(spark, cases, "topic string, pattern string, want boolean")
    shaped = df.select("*", access.topic_matches(F.col("topic"), F.col("pattern")).alias("got"),
                       (access.pattern_of(F.col("topic"), access.pattern_shape(F.col("pattern"))) == F.col("pattern")).alias("by_shape"))
    for r in shaped.collect():
        assert r.got == r.want and bool(r.by_shape) == r.want, r


def access_tables(spark):
    users = frame(spark, [(1, "tenant1_admin", True, True, "h"), (2, "tenant1_user1", False, True, "h"), (3, "gone", False, False, "h")],
                  "id long, username string, is_admin boolean, is_active boolean, password_hash string")
    acls = frame(spark, [(1, "iot/tenant_001/+/+", 3), (1, "iot/tenant_001/+/+", 4), (1, "admin/tenant_001/#", 3), (2, "iot/tenant_001/+/data", 1),
                         (2, "iot/tenant_001/+/data", 4), (2, "iot/tenant_001/+/commands", 2), (3, "#", 3)], "user_id long, topic_pattern string, access_type int")
    return users, access.user_rules(users, acls)


def test_seven_scenarios(spark):
    users, rules = access_tables(spark)
    decided = access.decide(dims.scenarios(spark).withColumn("rw", F.lit(access.WRITE)), users, rules)
    verdicts = {r.test_id: r.verdict for r in decided.collect()}
    assert verdicts == {"001": "allowed", "002": "denied", "003": "denied", "004": "allowed", "005": "denied", "006": "allowed", "007": "unknown_user"}
    report = access.delivery_report(decided, decided.filter("verdict = 'allowed'"))
    assert {r.test_id: r.outcome for r in report.collect()} == {t: "OK" if t in ("001", "004", "006") else "BLOCKED_OK" for t in verdicts}
    summary = access.run_summary(decided.select((F.col("verdict") != "unknown_user").alias("connected"), "expected_delivery")).first()
    assert tuple(summary) == (7, 6, 1, 3, 3)


def test_delivery_report_names_leaks_and_gaps(spark):
    expected = frame(spark, [("a", True), ("b", True), ("c", False), ("d", False)], "test_id string, expected_delivery boolean")
    seen = frame(spark, [("a",), ("a",), ("c",), ("z",)], "test_id string")
    got = {r.test_id: r.outcome for r in access.delivery_report(expected, seen).collect()}
    assert got == {"a": "OK", "b": "MISSING", "c": "LEAK", "d": "BLOCKED_OK", "z": "UNPLANNED"}


def test_exact_and_lenient_codes_and_superuser(spark):
    users, rules = access_tables(spark)
    asked = frame(spark, [("tenant1_admin", "iot/tenant_001/x/y", 1), ("tenant1_admin", "other", 2), ("gone", "x", 1)], "username string, topic string, rw int")
    run = lambda **kw: {(r.username, r.topic): r.verdict for r in access.decide(asked, users, rules, **kw).collect()}
    assert run()[("tenant1_admin", "iot/tenant_001/x/y")] == "allowed"
    assert run(exact_code=True)[("tenant1_admin", "iot/tenant_001/x/y")] == "denied"
    assert run(superuser_bypass=True)[("tenant1_admin", "other")] == "superuser"
    assert run()[("gone", "x")] == "unknown_user"


def test_message_classes(spark):
    cases = {'{"test_id": "1", "expected_delivery": true}': "EXPECTED", '{"test_id": "1", "expected_delivery": false}': "UNEXPECTED",
             '{"test_id": "1", "expected_delivery": null}': "UNEXPECTED", '{"test_id": "1"}': "REGULAR", "not json": "REGULAR", "[1, 2]": "REGULAR", "17": "REGULAR"}
    df = frame(spark, [(p,) for p in cases], "payload string")
    got = {r.payload: r.delivery_class for r in access.classify_messages(df).collect()}
    assert got == cases


def test_scalar_edges(spark):
    df = frame(spark, [(None, None), (-1.0, "A@b"), (9.0, "nope")], "x double, t string")
    rows = df.select(S.clip(F.col("x"), 0.0, 5.0).alias("c"), S.contains_at(F.col("t")).alias("a"), S.keyword_match(F.col("t"), ["nop"]).alias("k")).collect()
    assert [r.c for r in rows] == [None, 0.0, 5.0] and [r.a for r in rows] == [False, True, False] and rows[2].k


def test_missing_price_never_converts(spark):
    df = spark.sql("SELECT 'premium' AS segment, CAST(NULL AS DOUBLE) AS price, 0.5D AS s, CAST(NULL AS DOUBLE) AS past, 0 AS n, 0.03D AS base")
    factor = scores.price_factor("segment", F.col("s"), F.col("price"), F.col("past"))
    p = scores.conversion_probability(F.col("base"), factor, F.lit(True), F.col("n"))
    row = df.select(p.alias("p"), H.gate(p, F.lit(0.0)).alias("g")).first()
    assert row.p is None and row.g is False


def test_unknown_age_category_and_subcategory_get_defaults(spark):
    people = frame(spark, [(1, 70), (2, 18), (3, 65)], "customer_id long, age int")
    got = {r.customer_id: r.tech_affinity for r in behaviour.age_behaviour(people).collect()}
    assert got == {1: 0.5, 2: 0.9, 3: 0.4}
    empty = behaviour.enrich_customers(frame(spark, [], "customer_id long, age int, gender string"))
    summary = A.segment_summary(empty).collect()
    assert len(summary) == 4 and all(r.customer_count == 0 and r.avg_price_sensitivity == 0 for r in summary)


def test_sku_availability_branches(spark):
    asked = frame(spark, [(i, s) for i, s in enumerate(["none", "empty", "full"])], "http_request_id long, sku string")
    stock = frame(spark, [("empty", 0), ("full", 5)], "sku string, stock int")
    products = frame(spark, [("none", "Toys"), ("empty", "Home"), ("full", "Home")], "sku string, category string")
    got = {r.sku: (r.available, r.stock_reason) for r in R.sku_availability(asked, stock, products).collect()}
    assert got["none"] == (False, V.NO_MERCHANT) and got["empty"][0] is False and got["empty"][1] in dims.flat_reasons()


def test_median_of_even_and_odd_counts(spark):
    for values in ([1.0, 250.0, 99.0], [100.0, 100.0, 1.0, 7000.0], [5.0]):
        df = frame(spark, [(v,) for v in values] + [(None,)], "x double")
        ordered = sorted(values)
        want = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
        assert A.exact_median(df, "x").first().median == want


def test_empty_inputs_keep_their_schema(spark):
    views = frame(spark, [], "http_request_id long, timestamp timestamp_ntz, sku string, instock boolean, price_viewed decimal(12,2), customer_id long")
    sales = frame(spark, [], "order_id long, customer_id long, merchant_id string, sku string, quantity int, unit_price decimal(12,2), order_timestamp timestamp_ntz")
    offers = frame(spark, [], "sku string, merchant_id string, stock int")
    assert W.sessionize(views).count() == 0
    assert R.views_near_sales(sales, views).columns[-2:] == ["has_view", "has_out_of_stock_view"]
    assert I.greedy_allocate(sales.drop("merchant_id"), offers, ["order_timestamp", "order_id"]).count() == 0
    assert A.sales_velocity(sales).count() == 0 and A.exact_median(sales, "unit_price").first().median is None
    assert A.funnel(views, frame(spark, [], "event_type string"), sales).first().view_to_cart is None


def test_null_keys_run_and_form_sessions(spark):
    day = datetime(2024, 1, 1, 12)
    rows = [(k, i, day + timedelta(hours=20 * i), 1) for k in (None, 7) for i in range(4)]
    df = spark.createDataFrame(rows, "customer_id long, http_request_id long, timestamp timestamp_ntz, v int")
    for current, want in ((True, [1, 2, 3, 4]), (False, [0, 1, 2, 3])):
        sums = W.running(df, ["customer_id"], C.chunk_of("timestamp", 86400), ["timestamp"], {"n": F.col("v").cast("long")}, current)
        for key in (None, 7):
            assert sorted(r["n"] for r in sums.collect() if r["customer_id"] == key) == want
    sessions = W.sessionize(df).collect()
    for key in (None, 7):
        assert sorted(r["session_no"] for r in sessions if r["customer_id"] == key) == [1, 2, 3, 4]
