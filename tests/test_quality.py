"""Each data-quality rule fires on a copy with one bad row and stays silent on clean tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallkeeper.operators import aggregates as A, quality as Q, validation
from stallkeeper.sources import damaged
from stallkeeper.sources.model import Model

T = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def clean(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    views = [(i, T, "SKU1", True, 5000.0, 1) for i in range(100)]
    return {
        "customers": make([(1, "n", "a@b", "c", 30, "F"), (2, "n", "a@b", "c", 40, "M")], "customer_id long, name string, email string, city string, age int, gender string"),
        "products": make([("SKU1", 1, "Home", "Decor", 5000.0), ("SKU2", 2, "Sports", "Fitness", 6000.0)], "sku string, product_id long, category string, subcategory string, base_price double"),
        "offers": make([("M1", "SKU1", 5, 5000.0), ("M2", "SKU1", 5, 5100.0)], "merchant_id string, sku string, inventory int, offer_price double"),
        "views": make(views, "http_request_id long, timestamp timestamp_ntz, sku string, instock boolean, price_viewed double, customer_id long"),
        "sales": make([(1, 1, "M1", "SKU1", 2, 5000.0, T, "Shipped"), (2, 1, "M2", "SKU1", 1, 5000.0, T, "Delivered")],
                      "order_id long, customer_id long, merchant_id string, sku string, quantity int, unit_price double, order_timestamp timestamp_ntz, fulfilment_status string"),
        "inventory_events": make([(T, "M1", "SKU1", "initial_stock", 5, 5), (T, "M1", "SKU1", "sale", -2, 3), (T, "M2", "SKU1", "sale", -1, 4)],
                                 "timestamp timestamp_ntz, merchant_id string, sku string, event_type string, quantity int, new_balance int"),
        "cart_events": make([(1, 1, "SKU1", "add_to_cart", T), (2, 1, "SKU1", "add_to_cart", T), (2, 1, "SKU1", "cart_abandoned", T)],
                            "cart_id long, customer_id long, sku string, event_type string, timestamp timestamp_ntz"),
    }


def change(table, column, value, first):
    return lambda t: {table: t[table].withColumn(column, F.when(F.expr(first), F.expr(value)).otherwise(F.col(column)))}


def twice(table, first):
    return lambda t: {table: t[table].unionByName(t[table].filter(first))}


def without(table, column):
    return lambda t: {table: t[table].drop(column)}


DAMAGE = {
    "DQ01": lambda t: {"cart_events": t["cart_events"].filter("false")},
    "DQ02": without("customers", "city"), "DQ03": twice("customers", "customer_id = 1"), "DQ04": change("customers", "customer_id", "0", "customer_id = 2"),
    "DQ05": change("customers", "age", "101", "customer_id = 2"), "DQ06": change("customers", "gender", "NULL", "customer_id = 2"),
    "DQ07": change("customers", "email", "NULL", "customer_id = 2"), "DQ08": without("products", "product_id"), "DQ09": twice("products", "sku = 'SKU2'"),
    "DQ10": change("products", "category", "'Toys'", "sku = 'SKU2'"), "DQ11": change("products", "base_price", "0", "sku = 'SKU2'"),
    "DQ12": change("products", "base_price", "1000001", "sku = 'SKU2'"), "DQ13": change("products", "subcategory", "'Mobiles'", "sku = 'SKU2'"),
    "DQ14": without("offers", "inventory"), "DQ15": change("offers", "inventory", "-1", "merchant_id = 'M1'"), "DQ16": change("offers", "offer_price", "0", "merchant_id = 'M1'"),
    "DQ17": twice("offers", "merchant_id = 'M1'"), "DQ18": without("views", "sku"), "DQ19": twice("views", "http_request_id = 3"),
    "DQ20": lambda t: {"views": t["views"].withColumn("timestamp", F.expr("if(http_request_id = 3, 'x', cast(timestamp as string))"))},
    "DQ21": lambda t: {"views": t["views"].withColumn("instock", F.expr("if(http_request_id = 3, 'maybe', cast(instock as string))"))},
    "DQ22": change("views", "price_viewed", "NULL", "http_request_id = 3"), "DQ23": without("sales", "unit_price"), "DQ24": change("sales", "order_id", "1", "order_id = 2"),
    "DQ25": change("sales", "quantity", "0", "order_id = 2"), "DQ26": change("sales", "quantity", "101", "order_id = 2"), "DQ27": change("sales", "unit_price", "0", "order_id = 2"),
    "DQ28": change("sales", "fulfilment_status", "'Lost'", "order_id = 2"), "DQ29": without("inventory_events", "timestamp"),
    "DQ30": change("inventory_events", "event_type", "'gift'", "quantity = 5"), "DQ31": change("inventory_events", "quantity", "-5", "quantity = 5"),
    "DQ32": change("inventory_events", "quantity", "1", "quantity = -1"), "DQ33": without("cart_events", "timestamp"),
    "DQ34": change("cart_events", "event_type", "'gift'", "cart_id = 1"), "DQ35": change("views", "customer_id", "9", "http_request_id = 3"),
    "DQ36": change("views", "sku", "'SKU9'", "http_request_id = 3"), "DQ37": change("offers", "merchant_id", "'M3'", "merchant_id = 'M1'"),
    "DQ40": change("inventory_events", "new_balance", "-1", "quantity = 5"), "DQ41": change("inventory_events", "quantity", "-4", "quantity = -2"),
    "DQ42": lambda t: {"sales": t["sales"].filter("false")}, "DQ43": change("cart_events", "event_type", "'cart_abandoned'", "cart_id = 1"),
    "DQ44": change("customers", "age", "95", "true"), "DQ45": change("products", "base_price", "500", "true"),
}


def run(tables, rule=None):
    return {r.rule_id: r for r in Q.rules(tables, [rule] if rule else None).filter("violations > 0").collect()}


def test_clean_tables_have_no_issue(clean):
    assert run(clean) == {}


@pytest.mark.parametrize("rule", sorted(DAMAGE))
def test_rule_fires_once(clean, rule):
    tables = {**clean, **DAMAGE[rule](clean)}
    found = run(tables, rule)
    assert rule in found
    if rule not in ("DQ44", "DQ45"):
        assert found[rule].violations == 1


def test_sold_out_of_stock_and_unseen_prices(spark, clean):
    late = change("views", "instock", "false", "http_request_id = 7")(clean)
    assert run({**clean, **late}, "DQ38")["DQ38"].violations == 2
    sold = clean["sales"].select(*[F.lit(9).cast("long").alias("order_id") if c == "order_id" else F.lit(1.5).alias(c) if c == "unit_price" else F.col(c) for c in clean["sales"].columns])
    many = clean["sales"]
    for _ in range(3):
        many = many.unionByName(sold)
    found = run({**clean, "sales": many}, "DQ39")["DQ39"]
    assert found.measure == round(6 / many.count(), 9) and found.violations == 1
    assert Q.price_mismatches({**clean, "sales": many}).count() == 6


def test_uneven_days(spark, clean):
    days = clean["views"].withColumn("timestamp", F.expr("timestamp + make_dt_interval(if(http_request_id < 90, 0, cast(http_request_id - 80 as int)))"))
    assert run({**clean, "views": days}, "DQ46")["DQ46"].measure > 2


def test_scores_report_and_run(spark, clean):
    tables = {**clean, **DAMAGE["DQ35"](clean), **DAMAGE["DQ15"](clean)}
    scores = validation.quality_scores(tables).first()
    assert scores == Q.quality_scores(Q.issues(Q.rules(tables))).first()
    assert (scores.total_issues, scores.referential_integrity, scores.business_logic_compliance, scores.overall_quality_score) == (2, 0.99, 0.9, 0.96)
    lines = [r.line for r in validation.report_lines(tables).collect()]
    assert lines[:2] == ["Overall Status: FAILED", "Total Issues Found: 2"] and "  customers: 2 rows, 6 columns, 0 null values" in lines
    assert [x for x in lines if x.startswith("DQ")] == [f"{r.rule_id} {r.issue_text}" for r in Q.issues(Q.rules(tables)).orderBy("rule_id").collect()]
    assert "  ... and 1 more issues" in [r.line for r in validation.report_lines(tables, first=1).collect()]
    empty = {name: df.filter("false") for name, df in clean.items()}
    assert {r.item: r.value for r in validation.validation_run(empty).collect()}["total_issues"] == 7
    items = {r.item: r.value for r in validation.validation_run(clean).collect()}
    assert items["is_valid"] == 1.0 and items["total_issues"] == 0 and items["customer_purchase_rate"] == 0.5


def test_rules_build_only_the_tables_they_read(spark, monkeypatch):
    def ledger(self):
        raise AssertionError("the ledger starts jobs while it is built")

    monkeypatch.setattr(Model, "ledger", ledger)
    m = Model(spark, "/root/testdata/sf0.001")
    lone = [r for r in (f"DQ{i:02d}" for i in range(2, 47)) if "inventory_events" not in Q.tables_of(r)]
    assert len(lone) == 39
    for rule_id in lone:
        needed = Q.tables_of(rule_id)
        tables = damaged.tables(m, needed)
        assert set(tables) == needed and needed
        assert Q.rules(tables, [rule_id]).columns[0] == "rule_id"


def as_set(results):
    return {(r.rule_id, r.table_name, r.issue, r.violations, None if r.measure is None else round(r.measure, 9), r.example) for r in results.collect()}


def test_the_fused_run_gives_what_the_rules_give_one_by_one(spark, clean):
    damaged_all = dict(clean)
    for rule in ("DQ03", "DQ09", "DQ17", "DQ19", "DQ24", "DQ04", "DQ05", "DQ06", "DQ13", "DQ15", "DQ22", "DQ28", "DQ30", "DQ34", "DQ35", "DQ36", "DQ40", "DQ41", "DQ43"):
        damaged_all |= DAMAGE[rule](damaged_all)
    damaged_all["sales"] = damaged_all["sales"].unionByName(damaged_all["sales"].withColumns({"merchant_id": F.lit(None).cast("string"), "quantity": F.lit(7)}))
    text = DAMAGE["DQ20"](clean) | {"customers": without("customers", "city")(clean)["customers"]} | {"offers": without("offers", "inventory")(clean)["offers"]}
    for tables in (clean, damaged_all, clean | text, {"customers": clean["customers"]}, {n: t.filter("false") for n, t in clean.items()}):
        assert as_set(validation.rules(tables)) == as_set(Q.rules(tables))


def test_the_full_run_reads_tables_a_few_times(spark):
    tables = damaged.tables(Model(spark, "/root/testdata/sf0.001"), [n for n in Q.EXAMPLE if n != "inventory_events"])
    plan = validation.Run({n: validation.stored(df, n) for n, df in tables.items()}).result()
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert text.count("FileScan") <= 8  # each of six tables once, sales and views once more below a subquery


def test_median_of_many_values_between_zero_and_one(spark, monkeypatch):
    rows = spark.range(100_001).select((F.pmod(F.col("id") * 7919, F.lit(100_001)) / 100_001).alias("x"))
    lo, hi = A.median_bounds(rows, "x", 1000)
    inside = rows.where(F.col("x").between(lo, hi)).count()
    assert inside < 1000 and A.exact_median(rows, "x", 1000).first().median == 50_000 / 100_001
    assert A.exact_median(rows, "x", 5).first().median == 50_000 / 100_001  # bounds are narrowed again
    tied = rows.select(F.when(F.col("x") < 0.9, F.lit(3.0)).otherwise(F.col("x")).alias("x"))
    assert A.exact_median(tied, "x", 5).first().median == 3.0


def test_duplicates_by_row_digest(spark):
    rows = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, None, "a"), (None, None, None), (None, None, None), (1, 1, "")], "x int, y int, z string")
    found = A.table_summary({"t": rows, "none": rows.filter("false")}).orderBy("table_name").collect()
    assert [(r.table_name, r.row_count, r.column_count, r.null_values, r.duplicate_rows) for r in found] == [("none", 0, 3, 0, 0), ("t", 6, 3, 9, 2)]
