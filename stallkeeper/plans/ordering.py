"""Windows and top-k."""

from pyspark.sql import functions as F

from stallkeeper.operators import relational as R, windows as W
from stallkeeper.plans.base import query

MOVE_ORDER = '"timestamp", order_id, line_no, unit_price, quantity'
SALE_ORDER = ["order_timestamp", "order_id", "line_no", "merchant_id", "sku", "unit_price", "quantity"]
SALE_SQL = ", ".join(SALE_ORDER)


@query("wn01_latest_balance", """
    SELECT merchant_id, sku, CAST(sum(quantity) AS BIGINT) AS balance FROM movements GROUP BY 1, 2""")
def wn01(m):
    return W.latest_balance(m.ledger())


@query("wn02_running_balance", "SELECT merchant_id, sku, order_id, line_no, quantity, unit_price::DOUBLE AS unit_price, new_balance FROM ledger")
def wn02(m):
    return m.ledger().select("merchant_id", "sku", "order_id", "line_no", "quantity", "unit_price", "new_balance")


HISTORY = f"""
    SELECT customer_id, order_id, line_no, merchant_id, sku, unit_price::DOUBLE AS unit_price, count(*) OVER w AS prior_purchases,
           sum(unit_price) OVER w::DOUBLE / count(*) OVER w AS prior_avg_price FROM line_sales
    WINDOW w AS (PARTITION BY customer_id ORDER BY {SALE_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("wn03_prior_purchase_count", f"SELECT customer_id, order_id, line_no, merchant_id, sku, prior_purchases FROM ({HISTORY})")
def wn03(m):
    return W.purchase_history(m.line_sales(), SALE_ORDER, chunk_seconds=30 * W.DAY).select(
        "customer_id", "order_id", "line_no", "merchant_id", "sku", "prior_purchases")


@query("wn04_prior_avg_price", f"""
    SELECT customer_id, order_id, line_no, merchant_id, sku, CASE WHEN prior_purchases > 0 THEN prior_avg_price END AS prior_avg_price FROM ({HISTORY})""")
def wn04(m):
    return W.purchase_history(m.line_sales(), SALE_ORDER, chunk_seconds=30 * W.DAY).select(
        "customer_id", "order_id", "line_no", "merchant_id", "sku", "prior_avg_price")


@query("wn05_sessionize", "SELECT http_request_id, customer_id, CAST(session_no AS BIGINT) AS session_no FROM sessions_raw")
def wn05(m):
    return W.sessionize(m.views().dropna(subset=["customer_id"])).select("http_request_id", "customer_id", "session_no")


@query("wn05_session_table", """
    SELECT customer_id, CAST(session_no AS BIGINT) AS session_no, CAST(min("timestamp") AS VARCHAR) AS start_time, CAST(max("timestamp") AS VARCHAR) AS end_time,
           count(*) AS pages_viewed, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories_browsed
    FROM sessions_raw JOIN products USING (sku) GROUP BY 1, 2""")
def wn05_table(m):
    return W.session_table(W.sessionize(m.views().dropna(subset=["customer_id"])), m.products())


@query("wn05_sessionize_six_hours", """
    SELECT http_request_id, CAST(sum(CASE WHEN prev IS NULL OR "timestamp" - prev >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
           OVER (PARTITION BY customer_id ORDER BY "timestamp", http_request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM sessions_raw""")
def wn05_six(m):
    return W.sessionize(m.views().dropna(subset=["customer_id"]), gap_seconds=6 * 3600).select("http_request_id", "session_no")


@query("wn06_affinity_growth", f"""
    SELECT order_id, line_no, merchant_id, sku, customer_id, round(0.5::DOUBLE * pow(1.1::DOUBLE, count(*) OVER (PARTITION BY customer_id, category
           ORDER BY {SALE_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 6) AS affinity
    FROM line_sales JOIN products USING (sku)""")
def wn06(m):
    sales = m.line_sales().join(m.products().select("sku", "category"), "sku")
    grown = W.affinity_growth(sales, F.lit(0.5), SALE_ORDER)
    return grown.select("order_id", "line_no", "merchant_id", "sku", "customer_id", F.round("affinity", 6).alias("affinity"))


@query("wn07_normalized_price", """
    SELECT p_partkey, round(p_retailprice / mean, 9) AS price_ratio, round(1 / pow(p_retailprice / mean, 0.5 + (p_partkey % 5) / 10.0::DOUBLE), 9) AS conversion_curve
    FROM part, (SELECT CAST(sum(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS mean FROM part)""")
def wn07(m):
    parts = m.table("part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    curve = W.normalized_price(parts, "price", 0.5 + (F.col("p_partkey") % 5) / F.lit(10.0))
    return curve.select("p_partkey", F.round("price_ratio", 9).alias("price_ratio"), F.round("conversion_curve", 9).alias("conversion_curve"))


@query("wn08_sequence_ids", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS view_id FROM events")
def wn08(m):
    events = m.table("events").select("event_id", "ts")
    return W.sequence_ids(events, "view_id", ["ts", "event_id"]).select("event_id", "view_id")


@query("tk01_head_sample", f"SELECT order_id, line_no, merchant_id, sku, customer_id FROM line_sales ORDER BY {SALE_SQL} LIMIT 100")
def tk01(m):
    return R.head(m.line_sales(), SALE_ORDER, 100).select("order_id", "line_no", "merchant_id", "sku", "customer_id")


@query("tk03_keep_last_n", f"SELECT order_id, line_no, merchant_id, sku FROM line_sales ORDER BY {', '.join(c + ' DESC' for c in SALE_ORDER)} LIMIT 1000")
def tk03(m):
    return R.keep_last(m.line_sales(), SALE_ORDER, 1000).select("order_id", "line_no", "merchant_id", "sku")


@query("tk04_first_violation", """
    SELECT 'big' AS rule, CAST(min(l_orderkey) FILTER (l_quantity > 49) AS VARCHAR) AS example FROM lineitem
    UNION ALL SELECT 'untaxed', CAST(min(l_orderkey) FILTER (l_tax = 0 AND l_discount = 0) AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'negative', CAST(min(l_orderkey) FILTER (l_quantity < 0) AS VARCHAR) FROM lineitem""")
def tk04(m):
    rules = {"big": F.col("l_quantity") > 49, "untaxed": (F.col("l_tax") == 0) & (F.col("l_discount") == 0), "negative": F.col("l_quantity") < 0}
    return R.first_violation(m.table("lineitem"), rules, "l_orderkey")


def _sample_sql() -> str:
    from stallkeeper.plans.duck import u

    return f"""SELECT sku, merchant_id, pick FROM (SELECT sku, merchant_id, row_number() OVER (PARTITION BY sku ORDER BY draw, merchant_id) AS pick
        FROM (SELECT DISTINCT sku, merchant_id, {u('sample', 'sku', 'merchant_id')} AS draw FROM line_sales)) WHERE pick <= 3"""


@query("tk05_sample_k_per_key", _sample_sql())
def tk05(m):
    return R.sample_per_key(m.line_sales(), ["sku"], "merchant_id", 3, "sample")


@query("tk06_low_stock_alerts", """
    SELECT merchant_id, sku, stock, CASE WHEN stock = 0 THEN 'critical' ELSE 'warning' END AS alert_level FROM stock WHERE stock <= 10""")
def tk06(m):
    return R.low_stock_alerts(m.stock(), "stock")
