"""Joins and set operations."""

from pyspark.sql import functions as F

from stallkeeper import values as V
from stallkeeper.functions.scalar import payload_struct
from stallkeeper.operators import access, aggregates as A, builders, relational as R, windows
from stallkeeper.plans import duck as D
from stallkeeper.plans.base import query

USER_RULES = "SELECT u.username, a.topic_pattern AS topic, a.access_type AS rw FROM users u JOIN user_acls a ON u.id = a.user_id WHERE u.is_active"
DEVICE_RULES = """SELECT u.username, a.topic_pattern AS topic, a.access_type AS rw FROM users u JOIN devices d ON u.id = d.user_id
    JOIN device_acls a ON d.id = a.device_id WHERE u.is_active AND d.is_active"""
REGEX = "'^' || replace(replace(a.topic, '/#', '(/.*)?'), '+', '[^/]*') || '$'"
VERDICT = f"""
    SELECT m.message_id, CASE WHEN s.username IS NULL THEN 'unknown_user' {{bypass}} WHEN g.message_id IS NOT NULL THEN 'allowed'
           ELSE 'denied' END AS verdict
    FROM messages m LEFT JOIN (SELECT username, is_admin FROM users WHERE is_active) s ON m.username = s.username
    LEFT JOIN (SELECT DISTINCT message_id FROM messages m JOIN acls a ON m.username = a.username
               WHERE {{grant}} AND regexp_matches(m.topic, {REGEX})) g ON m.message_id = g.message_id"""
LENIENT, STRICT = "(a.rw = m.rw OR a.rw = 3)", "a.rw = m.rw"


@query("jn01_inner_equi", USER_RULES)
def jn01(m):
    return access.user_rules(m.users(), m.user_acls())


@query("jn02_inner_three_way", DEVICE_RULES)
def jn02(m):
    return access.device_rules(m.users(), m.devices(), m.device_acls())


@query("jn03_dim_lookup", """
    SELECT order_id, line_no, merchant_id, s.sku, coalesce(category, 'Unknown') AS category FROM line_sales s
    LEFT JOIN products p ON s.sku = p.sku""")
def jn03(m):
    sales = m.line_sales().select("order_id", "line_no", "merchant_id", "sku")
    return R.lookup_default(sales, m.products().select("sku", "category"), ["sku"], "category", "Unknown")


@query("jn04_key_to_list", """
    SELECT http_request_id, v.sku, coalesce(n, 0) AS num_offers FROM views v
    LEFT JOIN (SELECT sku, count(*) AS n FROM offers GROUP BY sku) o ON v.sku = o.sku""")
def jn04(m):
    return R.num_offers(m.views().select("http_request_id", "sku"), m.offers())


@query("jn04_offer_positions", """
    SELECT sku, merchant_id, offer_price::DOUBLE AS offer_price, row_number() OVER (PARTITION BY sku ORDER BY
           CAST(('0x' || substr(md5(merchant_id), 1, 4)) AS UBIGINT) % 64, merchant_id) AS position FROM offers""")
def jn04_positions(m):
    return windows.number_in_key(m.offers().select("sku", "merchant_id", "offer_price"), ["sku"], "position", "merchant_id")


@query("jn05_orphan_keys", """
    SELECT DISTINCT 'customer' AS kind, CAST(customer_id AS VARCHAR) AS missing_key FROM views
    WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM users WHERE is_active)
    UNION ALL
    SELECT DISTINCT 'buyer', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)""")
def jn05(m):
    active = m.users().filter("is_active").select(F.col("id").alias("customer_id"))
    buyers = m.table("orders").select(F.col("o_custkey").alias("user_id"))
    customers = R.orphan_keys(m.views(), active, ["customer_id"]).toDF("missing_key").withColumn("kind", F.lit("customer"))
    unseen = R.orphan_keys(buyers, m.table("events"), ["user_id"]).toDF("missing_key").withColumn("kind", F.lit("buyer"))
    return customers.unionByName(unseen).select("kind", F.col("missing_key").cast("string").alias("missing_key"))


@query("jn06_orphan_composite", "SELECT DISTINCT merchant_id, sku FROM line_sales EXCEPT SELECT merchant_id, sku FROM offers")
def jn06(m):
    return R.orphan_keys(m.line_sales(), m.offers(), ["merchant_id", "sku"])


RECONCILED = """
    SELECT coalesce(s.merchant_id, g.merchant_id) AS merchant_id, coalesce(s.sku, g.sku) AS sku,
           coalesce(sold, 0) AS sold, coalesce(depleted, 0) AS depleted
    FROM (SELECT merchant_id, sku, CAST(sum(quantity) AS BIGINT) AS sold FROM line_sales GROUP BY ALL) s
    FULL JOIN (SELECT merchant_id, sku, CAST(abs(sum(quantity)) AS BIGINT) AS depleted FROM movements WHERE event_type = 'sale' GROUP BY ALL) g
    ON s.merchant_id = g.merchant_id AND s.sku = g.sku
    WHERE abs(coalesce(sold, 0) - coalesce(depleted, 0)) > 1"""


@query("jn07_reconcile_outer", RECONCILED)
def jn07(m):
    return R.reconcile(m.line_sales(), m.movements())


def _interval_sql(seconds: int) -> str:
    near = f'abs(epoch_us(v."timestamp") - epoch_us(s.order_timestamp)) < {seconds * 1_000_000}'
    return f"""
    SELECT s.order_id, coalesce(bool_or({near}), false) AS has_view, coalesce(bool_or({near} AND NOT v.instock), false) AS has_out_of_stock_view
    FROM event_sales s LEFT JOIN views v ON s.customer_id = v.customer_id AND s.sku = v.sku GROUP BY s.order_id"""


@query("jn08_interval_join", _interval_sql(3600))
def jn08(m):
    return R.views_near_sales(m.event_sales(), m.views()).select("order_id", "has_view", "has_out_of_stock_view")


@query("jn08_interval_join_week", _interval_sql(7 * 86400))
def jn08_week(m):
    return R.views_near_sales(m.event_sales(), m.views(), 7 * 86400).select("order_id", "has_view", "has_out_of_stock_view")


@query("jn09_topic_pattern_join", f"""
    SELECT m.message_id, a.username, a.topic AS pattern, a.rw AS granted FROM messages m JOIN acls a ON m.username = a.username
    WHERE regexp_matches(m.topic, {REGEX})""")
def jn09(m):
    rules = access.all_rules(m.users(), m.devices(), m.user_acls(), m.device_acls())
    requests = m.messages().select("message_id", "username", "topic")
    return access.match_rules(requests, rules).select("message_id", "username", "pattern", "granted")


@query("jn10_value_in_history", """
    SELECT s.order_id, EXISTS (SELECT 1 FROM views v WHERE v.customer_id = s.customer_id AND v.sku = s.sku AND price_viewed IS NOT NULL) AS has_price,
           EXISTS (SELECT 1 FROM views v WHERE v.customer_id = s.customer_id AND v.sku = s.sku AND price_viewed = s.unit_price) AS price_seen
    FROM event_sales s""")
def jn10(m):
    return R.price_in_history(m.event_sales(), m.views()).select("order_id", "has_price", "price_seen")


@query("jn11_delivery_reconcile", f"""
    SELECT CAST(m.message_id AS VARCHAR) AS test_id, CASE WHEN m.payload LIKE '%true%' THEN CASE WHEN v.verdict = 'allowed' THEN 'OK' ELSE 'MISSING' END
           ELSE CASE WHEN v.verdict = 'allowed' THEN 'LEAK' ELSE 'BLOCKED_OK' END END AS outcome
    FROM messages m JOIN verdicts v ON m.message_id = v.message_id WHERE m.payload LIKE '%expected_delivery%'""",
    extra={"verdicts": VERDICT.format(bypass="", grant=LENIENT)})
def jn11(m):
    rules = access.all_rules(m.users(), m.devices(), m.user_acls(), m.device_acls())
    decided = access.decide(m.messages(), m.users(), rules)
    tests = decided.select(payload_struct(F.col("payload")).alias("p"), "verdict").select("p.test_id", "p.expected_delivery", "verdict")
    tests = tests.filter("test_id IS NOT NULL AND expected_delivery IS NOT NULL")
    return access.delivery_report(tests, tests.filter("verdict = 'allowed'")).select("test_id", "outcome")


@query("jn12_dim_preserving_left", """
    SELECT d.segment, count(p.customer_id) AS customers,
           coalesce(CAST(sum(CAST(p.cart_abandonment_rate AS DECIMAL(18,9))) AS DOUBLE) / count(p.cart_abandonment_rate), 0) AS avg_cart_abandonment
    FROM seg_dim d LEFT JOIN profiles p ON d.segment = p.segment GROUP BY d.segment""")
def jn12(m):
    summary = A.segment_summary(m.profiles())
    return summary.select("segment", F.col("customer_count").alias("customers"), "avg_cart_abandonment")


def _fan_out_sql() -> str:
    n = "(SELECT count(*) FROM supplier)"
    draw = lambda i: D.u(f"merchant{i}", "sku")
    steps = f"SELECT sku, {D.randint(1, 4, D.u('fan_out', 'sku'))} AS k, {n} AS n FROM products"
    picks = []
    for i in range(4):
        top = f"(n - k + {i + 1})"
        d = f"CAST(1 + floor({top} * {draw(i)}) AS BIGINT)"
        used = " OR ".join(f"{d} = p{j}" for j in picks) or "false"
        steps = f"SELECT *, CASE WHEN {i} < k THEN CASE WHEN {used} THEN {top} ELSE {d} END END AS p{i} FROM ({steps})"
        picks.append(i)
    return f"SELECT sku, printf('MER%04d', p) AS merchant_id FROM (SELECT sku, unnest([p0, p1, p2, p3]) AS p FROM ({steps})) WHERE p IS NOT NULL"


@query("jn13_fan_out_offers", _fan_out_sql())
def jn13(m):
    return builders.fan_out_offers(m.products(), m.table("supplier").agg(F.count("*")).scalar()).select("sku", "merchant_id")


AVAILABILITY = f"""
    SELECT v.http_request_id, total IS NOT NULL AND total > 0 AND NOT gated AS available,
           CASE WHEN total IS NULL THEN 'No merchants carry this SKU' WHEN total > 0 AND NOT gated THEN 'Instock'
                ELSE {D.choice([r for g in V.OOS_REASONS.values() for r in g], D.u('oos_reason', 'v.http_request_id'))} END AS stock_reason
    FROM (SELECT v.http_request_id, s.total, {D.u('oos', 'v.http_request_id')} < coalesce(d.oos_rate, 0.1::DOUBLE) AS gated FROM views v
          LEFT JOIN products p ON v.sku = p.sku LEFT JOIN oos_dim d ON p.category = d.category
          LEFT JOIN (SELECT sku, sum(stock) AS total FROM stock GROUP BY sku) s ON v.sku = s.sku) v"""


@query("jn14_sku_availability", AVAILABILITY)
def jn14(m):
    return R.sku_availability(m.views(), m.stock(), m.products()).select("http_request_id", "available", "stock_reason")


@query("jn15_access_decision", VERDICT.format(bypass="", grant=LENIENT))
def jn15(m):
    rules = access.all_rules(m.users(), m.devices(), m.user_acls(), m.device_acls())
    return access.decide(m.messages(), m.users(), rules).select("message_id", "verdict")


@query("jn15_access_decision_superuser", VERDICT.format(bypass="WHEN s.is_admin THEN 'superuser'", grant=STRICT))
def jn15_superuser(m):
    rules = access.all_rules(m.users(), m.devices(), m.user_acls(), m.device_acls())
    decided = access.decide(m.messages(), m.users(), rules, superuser_bypass=True, exact_code=True)
    return decided.select("message_id", "verdict")


@query("so01_union_all", f"{USER_RULES} UNION ALL {DEVICE_RULES}")
def so01(m):
    return access.all_rules(m.users(), m.devices(), m.user_acls(), m.device_acls())


@query("so02_concat_batches", 'SELECT merchant_id, sku, event_type, quantity, order_id, line_no FROM movements')
def so02(m):
    rows = m.movements()
    parts = [rows.filter(F.col("event_type") == kind) for kind in ("initial_stock", "restock", "sale", "damage")]
    return R.union_all(*parts).select("merchant_id", "sku", "event_type", "quantity", "order_id", "line_no")


@query("so03_except_values", "SELECT DISTINCT p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')")
def so03(m):
    return R.except_values(m.table("part"), "p_type", ["ECONOMY", "SMALL"])


@query("so04_except_columns", """
    SELECT c AS column_name, (SELECT count(*) FROM customer) AS rows_checked FROM (VALUES ('c_custkey'), ('segment'), ('loyalty')) t(c)
    WHERE c NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM customer))""")
def so04(m):
    customers = m.table("customer")
    missing = R.missing_columns(customers, ["c_custkey", "segment", "loyalty"])
    return missing.withColumn("rows_checked", customers.agg(F.count("*")).scalar())


@query("so05_subset_test", """
    SELECT bool_and(o_orderstatus IN ('P', 'O')) AS two_codes, bool_and(o_orderstatus IN ('P', 'O', 'F')) AS three_codes FROM orders""")
def so05(m):
    orders = m.table("orders")
    two = R.subset_test(orders, "o_orderstatus", ["P", "O"]).select(F.col("all_allowed").alias("two_codes"))
    three = R.subset_test(orders, "o_orderstatus", ["P", "O", "F"]).scalar()
    return two.withColumn("three_codes", three)


@query("so06_dedup_rows", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS repeats FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def so06(m):
    return R.repeated_keys(m.table("lineitem"), ["l_orderkey", "l_linenumber"])
