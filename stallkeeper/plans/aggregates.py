"""Aggregations."""

from pyspark.sql import functions as F

from stallkeeper import dims, values as V
from stallkeeper.functions.scalar import classify
from stallkeeper.operators import access, aggregates as A, behaviour, quality as Q, relational as R
from stallkeeper.plans import duck as D
from stallkeeper.plans.base import query
from stallkeeper.plans.joins import LENIENT, VERDICT
from stallkeeper.plans.scored import EXTRA


def mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,9))) AS DOUBLE) / count({column})"


@query("funnel_by_segment", """
    SELECT d.segment, coalesce(v, 0) AS views, coalesce(c, 0) AS carts, coalesce(s, 0) AS sales,
           coalesce(c, 0)::DOUBLE / v AS view_to_cart, coalesce(s, 0)::DOUBLE / c AS cart_to_sale
    FROM seg_dim d
    LEFT JOIN (SELECT segment, count(*) AS v FROM views JOIN segmented USING (customer_id) GROUP BY 1) USING (segment)
    LEFT JOIN (SELECT segment, count(*) AS c FROM cart_events JOIN segmented USING (customer_id) WHERE event_type = 'add_to_cart' GROUP BY 1) USING (segment)
    LEFT JOIN (SELECT segment, count(*) AS s FROM event_sales JOIN segmented USING (customer_id) GROUP BY 1) USING (segment)""")
def funnel_by_segment(m):
    segments = behaviour.assign_segment(m.customers()).select("customer_id", "segment")
    tagged = lambda df: df.join(segments, "customer_id")
    steps = A.funnel(tagged(m.views()), tagged(m.cart_events()), tagged(m.event_sales()), ["segment"])
    return dims.segments(m.spark).select("segment").join(steps, "segment", "left").fillna({"views": 0, "carts": 0, "sales": 0})


@query("ag01_segment_summary", f"""
    SELECT segment, count(*) AS customer_count, {mean('price_sensitivity')} AS avg_price_sensitivity,
           {mean('cart_abandonment_rate')} AS avg_cart_abandonment, {mean('conversion_base')} AS avg_conversion_base
    FROM profiles GROUP BY segment""")
def ag01(m):
    return A.segment_summary(m.profiles())


@query("ag02_segment_performance", f"""
    SELECT segment, count(customer_id) AS customers, {mean('conversion_base')} AS mean_conversion_base,
           {mean('cart_abandonment_rate')} AS mean_cart_abandonment FROM profiles GROUP BY segment""")
def ag02(m):
    return A.segment_performance(m.profiles())


@query("ag03_funnel_rates", """
    SELECT v AS views, c AS carts, s AS sales, c::DOUBLE / v AS view_to_cart, s::DOUBLE / c AS cart_to_sale
    FROM (SELECT (SELECT count(*) FROM views) AS v, (SELECT count(*) FROM cart_events WHERE event_type = 'add_to_cart') AS c,
                 (SELECT count(*) FROM event_sales) AS s)""")
def ag03(m):
    return A.funnel(m.views(), m.cart_events(), m.event_sales())


@query("ag04_stock_movement", """
    SELECT merchant_id, sku, event_type, count(*) AS n, CAST(max(total) AS BIGINT) AS quantity
    FROM (SELECT *, sum(quantity) OVER (PARTITION BY merchant_id, sku) AS total FROM movements) GROUP BY 1, 2, 3""")
def ag04(m):
    return A.stock_movement(m.movements()).select("merchant_id", "sku", "quantity", F.explode("event_types").alias("event_type", "n"))


@query("ag05_daily_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def ag05(m):
    return A.daily_counts(m.views(), "timestamp")


CV = """SELECT count(*) AS days, round(sqrt((sum(n * n)::DOUBLE - sum(n)::DOUBLE * sum(n)::DOUBLE / count(*)) / (count(*) - 1))
        / (sum(n)::DOUBLE / count(*)), 9) AS cv FROM (SELECT CAST(ts AS DATE), count(*) AS n FROM events GROUP BY 1)"""


@query("ag06_daily_cv", CV)
def ag06(m):
    return A.daily_cv(m.views(), "timestamp").withColumn("cv", F.round("cv", 9))


VELOCITY = """
    SELECT merchant_id, sku, CAST(sum(quantity) AS BIGINT) AS units,
           sum(quantity)::DOUBLE / greatest(1, date_diff('day', CAST(min(order_timestamp) AS DATE), CAST(max(order_timestamp) AS DATE))
           - CASE WHEN CAST(max(order_timestamp) AS TIME) < CAST(min(order_timestamp) AS TIME) THEN 1 ELSE 0 END) AS velocity
    FROM {sales} GROUP BY 1, 2"""


@query("ag07_sales_velocity", VELOCITY.format(sales="line_sales"))
def ag07(m):
    return A.sales_velocity(m.line_sales())


@query("ag07_sales_velocity_events", VELOCITY.format(sales="event_sales"))
def ag07_events(m):
    return A.sales_velocity(m.event_sales())


@query("ag07_trailing_velocity", """
    SELECT merchant_id, sku, CAST(sum(quantity) AS BIGINT) AS units, sum(quantity)::DOUBLE / 7.0::DOUBLE AS velocity FROM event_sales
    WHERE order_timestamp > (SELECT max(order_timestamp) FROM event_sales) - INTERVAL 7 DAY GROUP BY 1, 2""")
def ag07_trailing(m):
    return A.sales_velocity(m.event_sales(), trailing_days=7)


@query("ag08_customer_lifetime_value", """
    SELECT customer_id, coalesce(t, 0)::DOUBLE AS total_spent, coalesce(n, 0) AS total_orders,
           CASE WHEN n > 0 THEN t::DOUBLE / n ELSE 0 END AS avg_order_value,
           coalesce(t, 0)::DOUBLE * CASE WHEN n >= 3 THEN 2.5 WHEN n >= 1 THEN 1.5 ELSE 1.0 END::DOUBLE AS ltv
    FROM customers LEFT JOIN (SELECT customer_id, sum(unit_price * quantity) AS t, count(*) AS n FROM event_sales GROUP BY 1) USING (customer_id)""")
def ag08(m):
    return A.lifetime_value(m.customers(), m.event_sales())


@query("ag09_sum_by_pair", """
    SELECT merchant_id, sku, CAST(abs(sum(quantity)) AS BIGINT) AS depleted FROM movements WHERE event_type = 'sale' GROUP BY 1, 2""")
def ag09(m):
    sold = m.movements().filter("event_type = 'sale'")
    return sold.groupBy("merchant_id", "sku").agg(F.abs(F.sum("quantity")).alias("depleted"))


CARTS = """SELECT count(DISTINCT cart_id) FILTER (event_type = 'add_to_cart') AS total_carts,
           count(DISTINCT cart_id) FILTER (event_type = 'cart_abandoned') AS abandoned_carts FROM cart_events"""


@query("ag10_distinct_by_condition", CARTS)
def ag10(m):
    return A.distinct_carts(m.cart_events())


@query("ag11_cart_abandonment_rate", f"SELECT *, abandoned_carts::DOUBLE / total_carts AS abandonment_rate FROM ({CARTS})")
def ag11(m):
    return A.abandonment_rate(m.cart_events())


def ratio(part: str, whole: str, name: str) -> str:
    return f"SELECT p AS part, w AS whole, p::DOUBLE / w AS {name} FROM (SELECT ({part}) AS p, ({whole}) AS w)"


CONVERSION = ratio("SELECT count(*) FROM event_sales", "SELECT count(*) FROM views WHERE customer_id IS NOT NULL", "conversion_rate")


@query("ag12_conversion_rate", CONVERSION)
def ag12(m):
    return A.ratio_of_counts(m.event_sales(), m.views().filter("customer_id IS NOT NULL"), "conversion_rate")


@query("ag13_overall_conversion", ratio("SELECT count(*) FROM event_sales", "SELECT count(*) FROM views", "overall_conversion_rate"))
def ag13(m):
    return A.ratio_of_counts(m.event_sales(), m.views(), "overall_conversion_rate")


@query("ag14_purchase_rate", ratio("SELECT count(DISTINCT customer_id) FROM event_sales", "SELECT count(*) FROM customers", "purchase_rate"))
def ag14(m):
    return A.purchase_rate(m.event_sales(), m.customers())


@query("ag15_column_mean_median", f"""
    SELECT (SELECT {mean('age')} FROM customers) AS mean_age, (SELECT median(base_price::DOUBLE) FROM products) AS median_price,
           (SELECT median(unit_price::DOUBLE) FROM line_sales) AS median_sale_price""")
def ag15(m):
    means = m.customers().agg(A.exact_mean(F.col("age")).alias("mean_age"))
    price = A.exact_median(m.products(), "base_price").scalar()
    paid = A.exact_median(m.line_sales(), "unit_price").scalar()
    return means.select("mean_age", price.alias("median_price"), paid.alias("median_sale_price"))


@query("ag16_min_max_checks", """
    SELECT min(quantity)::DOUBLE AS min_quantity, max(quantity)::DOUBLE AS max_quantity, min(unit_price)::DOUBLE AS min_unit_price,
           max(unit_price)::DOUBLE AS max_unit_price FROM line_sales""")
def ag16(m):
    return A.min_max(m.line_sales(), ["quantity", "unit_price"])


def summary_sql(name: str, columns: list[str]) -> str:
    quoted = [f'"{c}"' for c in columns]
    nulls = " + ".join(f"CAST(sum(({c} IS NULL)::INT) AS BIGINT)" for c in quoted)
    return f"""SELECT '{name}' AS table_name, count(*) AS row_count, {len(columns)}::BIGINT AS column_count, {nulls} AS null_values,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(quoted)} FROM {name})) AS duplicate_rows FROM {name}"""


SUMMARY_COLUMNS = {
    "views": ["http_request_id", "timestamp", "sku", "instock", "price_viewed", "customer_id"],
    "cart_events": ["cart_id", "customer_id", "sku", "quantity", "price", "timestamp", "event_type", "event_id"],
    "line_sales": ["order_id", "line_no", "customer_id", "merchant_id", "sku", "quantity", "unit_price", "order_timestamp", "fulfilment_status"],
    "customers": ["customer_id", "name", "email", "city", "age", "gender", "c_mktsegment"],
}
SUMMARY = " UNION ALL ".join(summary_sql(n, c) for n, c in SUMMARY_COLUMNS.items())


def summary_tables(m):
    return {"views": m.views(), "cart_events": m.cart_events(), "line_sales": m.line_sales(), "customers": m.customers()}


@query("ag17_table_summary", SUMMARY)
def ag17(m):
    return A.table_summary(summary_tables(m))


@query("ag18_data_completeness", f"SELECT 1 - sum(null_values)::DOUBLE / sum(row_count * column_count)::DOUBLE AS data_completeness FROM ({SUMMARY})")
def ag18(m):
    return A.completeness(A.table_summary(summary_tables(m)))


@query("ag20_sku_stock_total", "SELECT sku, CAST(sum(stock) AS BIGINT) AS total_stock FROM stock GROUP BY 1")
def ag20(m):
    return R.sku_stock(m.stock())


@query("ag21_category_purchases", "SELECT customer_id, category, count(*) AS category_purchases FROM line_sales JOIN products USING (sku) GROUP BY 1, 2")
def ag21(m):
    return behaviour.category_purchases(m.line_sales(), m.products())


@query("ag22_price_expectation", """
    SELECT v.http_request_id, coalesce(h.purchases, 0) AS purchases, h.past_price FROM views v LEFT JOIN view_history h ON v.http_request_id = h.http_request_id""", EXTRA)
def ag22(m):
    found = behaviour.with_history(m.views(), m.event_sales(), m.products())
    return found.select("http_request_id", "purchases", "past_price")


@query("ag23_superuser_count", """
    SELECT m.message_id, coalesce(n, 0) AS superusers FROM messages m LEFT JOIN
    (SELECT username, count(*) AS n FROM users WHERE is_active AND is_admin GROUP BY 1) u ON m.username = u.username""")
def ag23(m):
    return access.superuser_count(m.messages().select("message_id", "username"), m.users()).select("message_id", "superusers")


@query("ag24_run_summary", f"""
    SELECT count(*) AS tests, count(*) FILTER (c) AS connected, count(*) FILTER (NOT c) AS failed, count(*) FILTER (c AND e) AS should_deliver,
           count(*) FILTER (c AND NOT e) AS should_block
    FROM (SELECT v.verdict <> 'unknown_user' AS c, m.payload NOT LIKE '%"expected_delivery": false%' AS e
          FROM messages m JOIN verdicts v ON m.message_id = v.message_id)""", extra={"verdicts": VERDICT.format(bypass="", grant=LENIENT)})
def ag24(m):
    rules = access.all_rules(m.users(), m.devices(), m.user_acls(), m.device_acls())
    decided = access.decide(m.messages(), m.users(), rules)
    expected = classify(F.col("payload")) != "UNEXPECTED"
    return access.run_summary(decided.select((F.col("verdict") != "unknown_user").alias("connected"), expected.alias("expected_delivery")))


@query("ag25_calendar_total", f"""
    SELECT CAST(day AS VARCHAR) AS day, n, CAST(trunc(n * {D.promo('day')}) AS BIGINT) AS volume FROM
    (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)""")
def ag25(m):
    return A.calendar_total(A.daily_counts(m.table("orders"), "o_orderdate"), F.col("n"))


@query("ag26_dataset_totals", """
    SELECT CAST(sum(n) AS BIGINT) AS total_records, count(*) AS tables FROM (SELECT count(*) AS n FROM customers UNION ALL SELECT count(*) FROM products
    UNION ALL SELECT count(*) FROM offers UNION ALL SELECT count(*) FROM views UNION ALL SELECT count(*) FROM line_sales)""")
def ag26(m):
    return A.dataset_totals({"c": m.customers(), "p": m.products(), "o": m.offers(), "v": m.views(), "s": m.line_sales()})


@query("ag27_distinct_domain", "SELECT DISTINCT event_type FROM cart_events")
def ag27(m):
    return m.cart_events().select("event_type").distinct()


@query("ag28_status_mix", f"""
    SELECT d.fulfilment_status, d.target, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM line_sales) AS share
    FROM ({D.values('fulfilment_status, target', V.FULFILMENT)}) d
    LEFT JOIN (SELECT fulfilment_status, count(*) AS n FROM line_sales GROUP BY 1) s ON d.fulfilment_status = s.fulfilment_status""")
def ag28(m):
    targets = dims.values(m.spark, "fulfilment_status, target", V.FULFILMENT)
    return A.share_vs_target(m.line_sales(), "fulfilment_status", targets)
