"""Files, streams and the full data set."""

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallkeeper.operators import callbacks, quality as Q
from stallkeeper.plans import dataset
from stallkeeper.session import scratch, stored
from stallkeeper.sources import files
from stallkeeper.streaming import messages as M, run, state

T0 = datetime(2024, 1, 1)


def feed(spark, tmp_path, name, batches, schema):
    """One file per batch, in order of arrival."""
    folder = tmp_path / name
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return run.read_files(spark, str(folder), schema, "*.parquet", files_per_batch=1)


def test_csv_round_trip_keeps_blanks_quotes_and_microseconds(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "q", b ', T0 + timedelta(microseconds=7), None)], "id long, t string, ts timestamp_ntz, x double")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()


def test_clean_load_and_profile(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x" * 300), (2, 1.5, None)], "`order id` long, `unit-price` double, `größe` string")
    files.write_csv(df, str(tmp_path / "raw"))
    loaded = files.clean_load(spark, str(tmp_path / "raw"), df.schema, str(tmp_path / "table"))
    assert loaded.columns == ["order_id", "unit_price", "größe"]
    assert sorted(r.unit_price is None for r in loaded.collect()) == [False, True]
    profile = {r.name: r for r in files.schema_profile(df).collect()}
    assert profile["größe"].sql_type == "VARCHAR(600)" and profile["größe"].null_count == 1
    assert (profile["unit-price"].clean_name, profile["order id"].sql_type) == ("unit_price", "BIGINT")


def test_table_append_and_listing(spark, tmp_path):
    df = spark.range(5).toDF("id")
    for batch in ("a", "b", "a"):
        files.append(df, str(tmp_path / "t"), batch)
    assert files.read_appended(spark, str(tmp_path / "t"), "id long").count() == 10
    files.append(df.limit(2), str(tmp_path / "t"), "b")
    files.append(df.limit(0), str(tmp_path / "t"), "c")
    assert files.read_appended(spark, str(tmp_path / "t"), "id long").count() == 7
    with pytest.raises(ValueError, match="own"):
        files.append(df.withColumn(files.BATCH, F.lit(1)), str(tmp_path / "t"), "d")
    folder = tmp_path / "listed"
    folder.mkdir()
    (folder / "Sales.csv").write_text("id\n1\n")
    (folder / "notes.txt").write_text("x")
    assert [r.table_name for r in files.list_tables(spark, str(folder), ".csv").collect()] == ["sales"]


def test_catalog_table_append_survives_a_repeat(spark, tmp_path):
    df = spark.range(4).select("id", F.col("id").cast("string").alias("name"))
    try:
        for batch in ("day 1", "o'clock", "o'clock"):
            files.append_table(df.select("name", "id") if batch == "o'clock" else df, "appended_rows", batch, str(tmp_path / "appended"))
        assert spark.table("appended_rows").groupBy(files.BATCH).agg(F.sum("id")).orderBy(files.BATCH).collect() == [("day 1", 6), ("o'clock", 6)]
    finally:
        spark.sql("DROP TABLE IF EXISTS appended_rows")


def test_types_come_from_all_values(spark, tmp_path):
    rows = [("1", "1", "2024-02-29", "true", "", "x", "2024-02-30"), ("-22", "2.5e3", "2024-01-01 10:11:12.5", "FALSE", None, "7", "2024-01-01"), (" 3 ", None, None, None, " ", "", None)]
    texts = spark.createDataFrame(rows, "i string, d string, t string, b string, e string, s string, u string")
    assert list(files.infer_types(texts).values()) == ["bigint", "double", "timestamp_ntz", "boolean", "string", "string", "string"]
    got = files.typed(texts).collect()
    assert [r.i for r in got] == [1, -22, 3] and got[1].d == 2500.0 and got[1].t == datetime(2024, 1, 1, 10, 11, 12, 500000) and got[2].b is None
    assert set(files.infer_types(texts.limit(0)).values()) == {"string"}
    files.write_csv(spark.range(3).select(F.col("id").alias("a b"), F.lit("z").alias("a.b"), (F.col("id") / 2).alias("A-B")), str(tmp_path / "u"))
    assert dict(files.clean_load(spark, str(tmp_path / "u"), None, str(tmp_path / "v")).dtypes) == {"a_b": "bigint", "a_b_2": "string", "A_B_3": "double"}


def test_clashing_names_are_numbered():
    assert files.clean_names(["a-b", "a.b", "a_b_2", "A b", "größe"]) == ["a_b", "a_b_3", "a_b_2", "A_b_4", "größe"]


def test_scratch_follows_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/run-"
    assert scratch(spark, "x").startswith(root) and scratch(spark, "x") != scratch(spark, "x")
    assert stored(spark.range(3), "ids").count() == 3


def test_batch_callback(spark):
    got = callbacks.batch_apply(spark.range(10), lambda b: b.assign(y=b["id"] * 2), "id long, y long")
    assert got.agg(F.sum("y")).first()[0] == 90


def test_repeats_and_late_messages(spark, tmp_path):
    schema = "message_id long, timestamp timestamp_ntz, payload string"
    later = T0 + timedelta(hours=2)
    # The batch after the one that moves the watermark still uses the old one for late rows.
    batches = [[(1, T0, "a"), (1, T0, "a"), (2, T0, "b")], [(3, later, "c"), (2, T0, "b")], [(6, later, "f")], [(4, T0, "late"), (5, later, "e")]]
    got = run.drain(M.without_repeats(feed(spark, tmp_path, "r", batches, schema)), "repeats")
    assert sorted(r.message_id for r in got.collect()) == [1, 2, 3, 5, 6]


def test_subscription_and_classes(spark, tmp_path):
    rows = [(1, "iot/tenant_001/d/data", '{"test_id": 1, "expected_delivery": false}'), (2, "other/topic", "[]"), (3, "admin/tenant_002/x", "{broken")]
    source = feed(spark, tmp_path, "m", [rows], "message_id long, topic string, payload string")
    got = run.drain(M.classified(M.subscribe(source, ["iot/+/+/data", "admin/#"])), "classes").collect()
    assert sorted((r.message_id, r.delivery_class) for r in got) == [(1, "UNEXPECTED"), (3, "REGULAR")]


MOVES = "merchant_id string, sku string, order_id long, line_no int, unit_price double, quantity int, timestamp timestamp_ntz, initial int"


def move(order_id, quantity, hour, sku="s", price=1.0):
    return ("m", sku, order_id, 1, price, quantity, T0 + timedelta(hours=hour), 10)


def balances(spark, tmp_path, name, batches, delay="6 hours", **options):
    step = lambda s: state.live_balance(run.event_time(s, "timestamp", delay), groups=2)
    got = run.drain_closed(feed(spark, tmp_path, name, batches, MOVES), "timestamp", step, name, **options)
    return sorted((r.sku or "", r.order_id, r.accepted, r.balance, r.alert_level) for r in got.collect())


def test_live_balance_follows_event_time_not_batches(spark, tmp_path):
    rows = [move(2, -6, 2), move(1, -3, 1), move(4, 4, 4), move(3, -5, 3), move(5, -5, 5), move(7, -1, 2, "t"), move(6, -10, 1, "t"), move(8, -2, 1, None)]
    want = sorted([("s", 1, True, 7, "warning"), ("s", 2, True, 1, "warning"), ("s", 3, False, 1, "warning"), ("s", 4, True, 5, "warning"),
                   ("s", 5, True, 0, "critical"), ("t", 6, True, 0, "critical"), ("t", 7, False, 0, "critical"), ("", 8, True, 8, "warning")])
    assert balances(spark, tmp_path, "one", [rows]) == want
    assert balances(spark, tmp_path, "many", [rows[4:], rows[2:4], rows[1:2], rows[:1]]) == want


def test_equal_moments_go_by_order_and_price_also_below_zero(spark, tmp_path):
    assert [r[1:4] for r in balances(spark, tmp_path, "ties", [[move(1, -8, 1, price=2.0), move(1, -9, 1, price=-3.0)]])] == [(1, False, 1), (1, True, 1)]


def test_late_rows_are_counted(spark, tmp_path):
    # A batch still uses the watermark of the one before, so a row is late two batches after the one that made it late.
    batches = [[move(1, -1, 1)], [move(2, -1, 50)], [move(3, -1, 51)], [move(4, -1, 2)]]
    assert [r[1] for r in balances(spark, tmp_path, "late", batches, allow_late=True)] == [1, 2, 3]
    with pytest.raises(RuntimeError, match="1 rows came after the watermark"):
        balances(spark, tmp_path, "late-again", batches)


def test_windows_close_once_over_several_files(spark, tmp_path):
    schema = "message_id long, timestamp timestamp_ntz"
    batches = [[(1, T0), (2, T0 + timedelta(seconds=40))], [(3, T0 + timedelta(seconds=29))], [(4, T0 + timedelta(minutes=30))], [(5, T0 + timedelta(minutes=29))]]
    source = feed(spark, tmp_path, "w", batches, schema)
    got = run.drain_closed(source, "timestamp", lambda s: M.periodic_counts(s, delay="5 minutes"), "windows").collect()
    offset = {int((r.window_start.replace(tzinfo=None) - T0).total_seconds()): r.n for r in got}
    assert offset == {0: 2, 30: 1, 1740: 1, 1800: 1} and len(got) == 4


def test_a_stream_without_rows_ends_empty(spark, tmp_path):
    assert balances(spark, tmp_path, "none", [[]]) == []


def test_cart_reservations_expire(spark, tmp_path):
    schema = "cart_id long, event_id long, event_type string, timestamp timestamp_ntz"
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    rows = [(1, 1, "add_to_cart", T0), (2, 2, "add_to_cart", T0), (3, 3, "add_to_cart", T0), (1, 4, "ready_to_purchase", at(10)),
            (2, 5, "cart_abandoned", at(20)), (4, 6, "add_to_cart", at(5)), (4, 7, "ready_to_purchase", at(65)), (5, 8, "cart_abandoned", at(1))]
    want = sorted([(1, "active", 0), (1, "converted", 10), (2, "active", 0), (2, "abandoned", 20), (3, "active", 0), (3, "expired", 60), (4, "active", 5), (4, "expired", 65)])
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for name, batches in {"once": [rows], "parts": [rows[3:6], rows[6:], rows[:3]]}.items():
        step = lambda s: state.cart_status(run.event_time(s, "timestamp", "2 hours"), groups=2)
        got = run.drain_closed(feed(spark, tmp_path, name, batches, schema), "timestamp", step, name).collect()
        assert sorted((r.cart_id, r.status, int((r.at.replace(tzinfo=None) - T0).total_seconds() // 60)) for r in got) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_full_data_set(spark, tmp_path):
    made = dataset.generate(spark, str(tmp_path / "d"), customers=200, products=300, merchants=8, start="2024-10-20", end="2024-11-10", avg_views_per_day=900, as_csv=True)
    assert made["views"].count() == made["instock_events"].count()
    assert made["inventory_events"].filter("new_balance < 0").count() == 0
    stock = made["offers"].agg(F.sum("initial_inventory")).first()[0]
    assert 0 < made["sales"].agg(F.sum("quantity")).first()[0] <= stock
    ids = [r.order_id for r in made["sales"].select("order_id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    tables = {n: made[n] for n in ("customers", "products", "offers", "views", "sales", "inventory_events", "cart_events")}
    fired = {r.rule_id for r in Q.rules(tables).filter("violations > 0").collect()}
    assert fired <= {"DQ42", "DQ46"}
    assert len(glob.glob(f"{tmp_path}/d/csv/*/part-*.csv")) >= 12
