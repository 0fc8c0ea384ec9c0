"""Free past purchases, stock by numbers of the pair, validation without sorted facts: results, and plans that stay small."""

import math

import pytest
from pyspark.sql import functions as F

from stallkeeper import schemas
from stallkeeper.functions import scores
from stallkeeper.operators import validation
from stallkeeper.plans.registry import QUERIES
from stallkeeper.sources.model import Model

c = F.col


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_scores_after_free_purchases(spark):
    rows = [(1, 5.0, 0.0), (2, 0.0, 0.0), (3, None, 0.0), (4, 6.0, 3.0), (5, 6.0, None)]
    df = spark.createDataFrame(rows, "id int, price double, past double").withColumns({"sens": F.lit(0.5), "segment": F.lit("none")})
    args = c("sens"), c("price"), c("past")
    out = df.select(
        "id", scores.view_probability(F.lit(0.5), c("price"), c("sens"), c("past"), F.lit(0)).alias("view"),
        scores.add_to_cart_probability(F.lit(0.1), "segment", *args, F.lit(1)).alias("add"),
        scores.abandonment_probability(F.lit(0.5), F.lit(1.0), "segment", *args).alias("abandon"),
        scores.price_factor("segment", *args).alias("factor"),
    ).orderBy("id").collect()
    assert tuple(out[0])[1:] == (0.01, 0.01, 0.85, 0.0)  # infinitely dear beside free ones
    assert tuple(out[1])[1:4] == (0.9, 0.4, 0.85) and math.isnan(out[1].factor)  # 0 / 0 is above all bounds, as in SQL
    assert out[2].add is None and out[2].abandon is None and out[2].factor is None
    assert out[3].factor == pytest.approx(math.exp(-0.5)) and out[3].abandon == pytest.approx(0.55)
    assert out[4].factor is not None


@pytest.fixture
def folder(spark, tmp_path):
    line = "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    lines = [
        (1, 1, 1, 1, 5.0, "R", "O"), (1, 1, 1, 2, 3.0, "A", "F"), (1, 1, 1, 2, 3.0, "A", "F"), (2, 1, 1, 1, 7.0, "N", "F"),
        (9, 1, 1, 1, 90.0, "R", "F"), (1, 2, 1, 1, 4.0, "R", "F"), (None, 3, 1, 1, 4.0, "R", "O"), (1, None, 1, 1, 4.0, "R", "O"),
        (2, None, None, 1, 4.0, None, "O"), (2, 1, 2, 1, None, "R", "O"), (2, 1000001, 2000000, 1, 6.0, None, "O"),
    ]
    table = spark.createDataFrame(lines, line).withColumns({n: F.lit(1.5) for n in ("l_extendedprice", "l_discount", "l_tax")})
    table.withColumn("l_shipdate", F.lit("2000-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 1, "O", 1.0, "p"), (2, 1, "O", 1.0, "p"), (2, 2, "O", 1.0, "p"), (None, 1, "O", 1.0, "p")]
    table = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
    table.withColumn("o_orderdate", F.lit("2000-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    assert {"lineitem", "orders"} <= set(schemas.TABLES)
    return str(tmp_path)


def test_stock_is_the_sum_of_movements(spark, folder):
    m = Model(spark, folder)
    by_text = m.line_sales().join(m.offers().select("merchant_id", "sku"), ["merchant_id", "sku"], "left_semi")
    sign = F.when(c("fulfilment_status") == "Returned", c("quantity")).otherwise(-c("quantity"))
    moved = by_text.select("merchant_id", "sku", sign.alias("quantity"))
    expected = m.offers().select("merchant_id", "sku", c("inventory").alias("quantity")).unionByName(moved).groupBy("merchant_id", "sku").agg(F.sum("quantity").alias("stock"))
    key = lambda row: tuple(map(str, row))
    rows = sorted(map(tuple, expected.collect()), key=key)
    assert ("MER0001", "SKU000001", 10 + 20 + 5 - 6 - 14) in rows and len(rows) == 6
    assert sorted(map(tuple, m.stock().collect()), key=key) == rows
    summed = m.movements().groupBy("merchant_id", "sku").agg(F.sum("quantity").alias("stock"))
    assert sorted(map(tuple, summed.collect()), key=key) == rows


def test_pairs_meet_by_number(spark, folder):
    m = Model(spark, folder)
    assert "LeftSemi" not in plan(m.stock()) and "SortMergeJoin" not in plan(m.stock(), "executedPlan")
    semi = [line for line in plan(m.movements()).splitlines() if "LeftSemi" in line]
    assert semi and all("l_suppkey" in line and "merchant_id" not in line for line in semi)


def test_ledger_derives_movements_once(spark, folder):
    df = QUERIES["iv08_event_ledger"](spark, folder)
    assert "l_returnflag" not in plan(df) and df.count() == 6 + 9


def products(spark, n=3000):
    rows = spark.range(n).select(F.format_string("SKU%06d", "id").alias("sku"), c("id").alias("product_id"), F.lit("Electronics").alias("category"), F.lit("Laptops").alias("subcategory"))
    return rows.withColumn("base_price", F.when(c("product_id") % 1000 == 7, -1).otherwise(2000).cast("decimal(12,2)"))


def test_facts_are_hashed_and_merged(spark):
    run = validation.Run({"products": products(spark).unionByName(products(spark, 2))})
    seen, whole = [], run._merged
    run._merged = lambda keyed: (seen.append((keyed, whole(keyed))), seen[0][1])[1]
    row = run.result().first()
    keyed, merged = seen[0]
    assert "SortAggregate" not in plan(keyed, "executedPlan") and "SortAggregate" not in plan(merged, "executedPlan")
    assert keyed.count() > 6000 and merged.count() < 50
    rules = {r.rule_id: r for r in row.results}
    assert (rules["DQ11"].violations, rules["DQ11"].example) == (3, "SKU000007")
    assert (rules["DQ09"].violations, rules["DQ09"].example) == (2, "SKU000000")
    assert (row.summary[0].row_count, row.summary[0].duplicate_rows) == (3002, 2) and rules["DQ45"].measure == 2000


def test_scored_queries_after_free_purchases(spark, tmp_path):
    """Whole queries: customers whose purchases were all free, before views at a price and for nothing."""
    at = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, event_id)"
    rows = [(1, 1, "purchase", 0.0), (2, 1, "purchase", 0.0), (3, 1, "view", 8.0), (4, 1, "view", 0.0), (6, 2, "purchase", 4.0), (7, 2, "view", 8.0), (8, 3, "view", 8.0), (9, 1, "error", 8.0)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").withColumns({"ts": F.expr(at), "props": F.lit('{"k": 1}')})
    tables = {
        "events": events, "nation": spark.sql("SELECT 0 AS n_nationkey, 'n' AS n_name, 0 AS n_regionkey"),
        "customer": spark.sql("SELECT id AS c_custkey, 'c' AS c_name, 0 AS c_nationkey, 0D AS c_acctbal, 's' AS c_mktsegment FROM range(1, 4)"),
        "part": spark.sql("SELECT 1L AS p_partkey, 'p' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size, 5D AS p_retailprice"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    score = lambda name: {r[0]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    add, left, factor, sold = map(score, ("fn33_add_to_cart_probability", "fn34_abandonment_probability", "fn35_price_factor", "fn36_conversion_probability"))
    assert (add[3], left[3], factor[3], sold[3]) == (0.01, 0.85, 0.0, 0.001)  # infinitely dear beside free ones
    assert (add[4], left[4], sold[4]) == (0.4, 0.85, 0.15) and math.isnan(factor[4])
    assert add[9] is None and left[9] is None and 0 < factor[7] < 1
    for name in ("tb10_build_cart_events", "tb11_candidate_sales"):
        QUERIES[name](spark, str(tmp_path)).collect()
