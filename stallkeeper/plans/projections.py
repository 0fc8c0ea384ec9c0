"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from stallkeeper import dims, values as V
from stallkeeper.functions.calendar import is_promotional
from stallkeeper.functions.hashing import u
from stallkeeper.operators import access, behaviour, builders, relational as R
from stallkeeper.plans import duck as D
from stallkeeper.plans.base import query

OOS_CASE = f"CASE WHEN instock THEN 'Instock' ELSE {D.choice(dims.flat_reasons(), D.u('reason', 'http_request_id'))} END"


@query("pr01_drop_null_key", "SELECT http_request_id, sku, customer_id FROM views WHERE customer_id IS NOT NULL")
def pr01(m):
    return m.views().dropna(subset=["customer_id"]).select("http_request_id", "sku", "customer_id")


@query("pr02_negated_flag_filter", "SELECT http_request_id, sku FROM views WHERE NOT instock")
def pr02(m):
    return m.views().filter(~F.col("instock")).select("http_request_id", "sku")


@query("pr03_compound_filter", "SELECT http_request_id, sku, price_viewed::DOUBLE AS price_viewed FROM views WHERE instock AND customer_id IS NOT NULL AND price_viewed > 20")
def pr03(m):
    wanted = F.col("instock") & F.col("customer_id").isNotNull() & (F.col("price_viewed") > 20)
    return m.views().filter(wanted).select("http_request_id", "sku", "price_viewed")


@query("pr04_active_users_view", "SELECT username, password_hash AS password FROM users WHERE is_active")
def pr04(m):
    return access.active_users(m.users())


@query("pr05_superusers_view", "SELECT username, is_admin AS is_superuser FROM users WHERE is_active")
def pr05(m):
    return access.superusers(m.users())


@query("pr06_point_lookup", """
    SELECT e.event_id AS request_id, 'user_' || (e.user_id * 2) AS username, u.password FROM events e
    LEFT JOIN (SELECT username, password_hash AS password FROM users WHERE is_active) u ON u.username = 'user_' || (e.user_id * 2)""")
def pr06(m):
    requests = m.table("events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("user_"), (F.col("user_id") * 2).cast("string")).alias("username")
    )
    return R.point_lookup(requests, access.active_users(m.users()), "username", "password")


@query("pr07_stock_status", """
    SELECT merchant_id, sku, stock, stock % 7 AS requested, greatest(0, stock - stock % 3) AS available_qty,
           greatest(0, stock - stock % 3) >= stock % 7 AS can_fulfill,
           CASE WHEN stock = 0 THEN 'out_of_stock' WHEN greatest(0, stock - stock % 3) < stock % 7 THEN 'insufficient_stock'
                WHEN stock < 10 THEN 'low_stock' ELSE 'in_stock' END AS stock_status
    FROM stock""")
def pr07(m):
    parts = R.stock_status(F.col("stock"), F.col("stock") % 3, F.col("requested"))
    return m.stock().withColumn("requested", F.col("stock") % 7).withColumns(parts)


@query("pr08_age_band", """
    SELECT customer_id, age, coalesce(tech_affinity, 0.5::DOUBLE) AS tech_affinity, coalesce(age_sensitivity, 0.5::DOUBLE) AS age_sensitivity,
           coalesce(social_influence, 0.3::DOUBLE) AS social_influence
    FROM (SELECT customer_id, age + 5 AS age FROM customers) c LEFT JOIN age_dim ON age BETWEEN age_from AND age_to""")
def pr08(m):
    return behaviour.age_behaviour(m.customers().select("customer_id", (F.col("age") + 5).alias("age")))


@query("pr09_lookup_default", """
    SELECT http_request_id, gender, category, coalesce(gender_weight, 1.0::DOUBLE) AS gender_weight,
           coalesce(oos_rate, 0.1::DOUBLE) AS oos_rate, coalesce(array_to_string(attributes, ','), 'Brand') AS attributes
    FROM (SELECT v.http_request_id, coalesce(c.gender, '?') AS gender, p.category, p.subcategory FROM views v
          JOIN products p ON v.sku = p.sku LEFT JOIN customers c ON v.customer_id = c.customer_id)
    LEFT JOIN gender_dim USING (gender, category) LEFT JOIN oos_dim USING (category) LEFT JOIN attr_dim USING (subcategory)""")
def pr09(m):
    seen = m.views().select("http_request_id", "sku", "customer_id").join(m.products().select("sku", "category", "subcategory"), "sku")
    base = R.left_join(seen, m.customers().select("customer_id", "gender"), ["customer_id"]).fillna({"gender": "?"})
    spark = m.spark
    weighted = R.lookup_default(base, dims.gender_weights(spark), ["gender", "category"], "gender_weight", 1.0)
    rated = R.lookup_default(weighted, dims.oos_rates(spark), ["category"], "oos_rate", V.OOS_RATE_DEFAULT)
    listed = R.lookup_default(rated, dims.attributes(spark), ["subcategory"], "attributes", dims.literal_array(V.ATTRIBUTES_DEFAULT))
    return listed.select("http_request_id", "gender", "category", "gender_weight", "oos_rate", F.array_join("attributes", ",").alias("attributes"))


@query("pr10_unpack_struct", 'SELECT cart_id, customer_id, sku, event_type FROM cart_events')
def pr10(m):
    packed = m.cart_events().select(F.struct("cart_id", "customer_id", "sku", "event_type").alias("s"))
    return packed.select("s.*")


@query("pr11_retention_filter", 'SELECT merchant_id, sku, order_id, line_no, quantity FROM movements WHERE "timestamp" >= TIMESTAMP \'1998-01-01\'')
def pr11(m):
    kept = m.movements().filter(F.col("timestamp") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return kept.select("merchant_id", "sku", "order_id", "line_no", "quantity")


@query("pr12_instock_reason", f"SELECT http_request_id, sku, {OOS_CASE} AS reason FROM views")
def pr12(m):
    return builders.instock_events(m.views())


@query("pr13_is_promotional", f"SELECT o_orderkey, {D.promo('CAST(o_orderdate AS DATE)')} > 1.0 AS promotional FROM orders")
def pr13(m):
    return m.table("orders").select("o_orderkey", is_promotional("to_date(o_orderdate)").alias("promotional"))


@query("pr14_add_merchant_attributes", f"""
    SELECT merchant_id, sku, merchant_type, price_strategy, fulfillment_speed, quality_score
    FROM (SELECT *, {D.weighted([t[0] for t in V.MERCHANT_TYPES], [t[1] for t in V.MERCHANT_TYPES], D.u('merchant_type', 'merchant_id'))} AS merchant_type FROM offers)
    JOIN merchant_dim USING (merchant_type)""")
def pr14(m):
    offers = builders.add_merchant_attributes(m.offers())
    return offers.select("merchant_id", "sku", "merchant_type", "price_strategy", "fulfillment_speed", "quality_score")
