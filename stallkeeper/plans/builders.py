"""Derived tables."""

from pyspark.sql import functions as F

from stallkeeper import values as V
from stallkeeper.functions.calendar import promo_multiplier
from stallkeeper.operators import aggregates as A, builders as B, windows
from stallkeeper.plans import duck as D
from stallkeeper.plans.base import query
from stallkeeper.plans.functions import CART_QUANTITY, INITIAL, OFFER_PRICE, TYPE
from stallkeeper.plans.inventory import greedy_sql
from stallkeeper.plans.joins import jn13  # noqa: F401
from stallkeeper.plans.joins import _fan_out_sql
from stallkeeper.plans.scored import EXTRA, SESSION_TYPE, scored_views

c = F.col
AS_OF = "2025-05-18"


@query("tb01_build_customers", f"""
    SELECT c_custkey AS customer_id, 'Customer ' || c_custkey AS name, 'customer' || c_custkey || '@example.com' AS email,
           'City ' || {D.randint(1, 500, D.u('city', 'c_custkey'))} AS city, {D.randint(18, 65, D.u('age', 'c_custkey'))} AS age,
           {D.choice(V.GENDERS, D.u('gender', 'c_custkey'))} AS gender FROM customer""")
def tb01(m):
    return B.customers(m.table("customer"), "c_custkey")


_cats, _subs = D.text(list(V.CATEGORIES)), D.text(list(V.CATEGORIES.values()))
BUILT_PRODUCTS = f"""
    SELECT printf('SKU%06d', p_partkey) AS sku, p_partkey AS product_id, ({_cats})[spot] AS category,
           ({_subs})[spot][CAST(floor({D.u('subcategory', 'p_partkey')} * len(({_subs})[spot])) AS BIGINT) + 1] AS subcategory,
           CAST({D.uniform(100.0, 100000.0, D.u('base_price', 'p_partkey'))} AS DECIMAL(12,2)) AS base_price
    FROM (SELECT p_partkey, CAST(floor({D.u('category', 'p_partkey')} * 5) AS BIGINT) + 1 AS spot FROM part)"""


@query("tb02_build_products", f"SELECT sku, product_id, category, subcategory, CAST(base_price AS DOUBLE) AS base_price FROM ({BUILT_PRODUCTS})")
def tb02(m):
    return B.products(m.table("part"), "p_partkey")


@query("tb03_build_attributes", """
    SELECT sku, description, 'V' || substr(md5(concat_ws('|', sku, description)), 1, 8) AS value
    FROM (SELECT sku, unnest(attributes) AS description FROM products JOIN attr_dim USING (subcategory))""")
def tb03(m):
    return B.attributes(m.products())


BUILT_OFFERS = f"""
    SELECT merchant_id, sku, {D.randint(0, 1000, D.u('inventory', 'sku', 'merchant_id'))} AS inventory, {OFFER_PRICE} AS offer_price,
           CAST(DATE '{AS_OF}' - CAST({D.randint(0, 730, D.u('listing', 'sku', 'merchant_id'))} AS INTEGER) AS VARCHAR) AS listing_date
    FROM ({_fan_out_sql()}) JOIN products USING (sku)"""


@query("tb04_build_offers", BUILT_OFFERS)
def tb04(m):
    return B.offers(m.products(), m.table("supplier").agg(F.count("*")).scalar(), AS_OF)


@query("tb05_build_merchants", f"""
    SELECT merchant_id, merchant_type, price_strategy, stock_levels, fulfillment_speed, quality_score,
           {D.uniform(0.7, 0.98, D.u('reliability', 'merchant_id'))} AS reliability, {D.randint(3, 14, D.u('restock_days', 'merchant_id'))} AS avg_restock_days
    FROM (SELECT merchant_id, {TYPE} AS merchant_type FROM (SELECT DISTINCT merchant_id FROM offers)) JOIN merchant_dim USING (merchant_type)""")
def tb05(m):
    return B.merchants(m.offers())


ENRICHED_OFFERS = f"SELECT merchant_id, sku, inventory, {INITIAL} AS initial_inventory, merchant_type, quality_score FROM (SELECT *, {TYPE} AS merchant_type FROM offers) JOIN merchant_dim USING (merchant_type)"


@query("tb06_enrich_offers", ENRICHED_OFFERS)
def tb06(m):
    return B.enrich_offers(m.offers()).select("merchant_id", "sku", "inventory", "initial_inventory", "merchant_type", "quality_score")


@query("tb07_enrich_customers", """
    SELECT customer_id, segment, round(price_sensitivity, 9) AS price_sensitivity, cart_abandonment_rate, conversion_base, category, round(preference, 9) AS preference
    FROM profiles JOIN preferences USING (customer_id)""")
def tb07(m):
    from stallkeeper.operators import behaviour

    profiles = behaviour.preference_map(m.profiles())
    rows = profiles.select("customer_id", "segment", F.round("price_sensitivity", 9).alias("price_sensitivity"), "cart_abandonment_rate",
                           "conversion_base", F.explode("category_preferences").alias("category", "preference"))
    return rows.withColumn("preference", F.round("preference", 9))


_vid = "http_request_id"
PLANNED = {
    "planned_days": f"SELECT day, CAST(trunc(n * {D.promo('day')}) AS BIGINT) AS n_views FROM calendar_days",
    "planned": f"""SELECT CAST(first + n AS BIGINT) AS http_request_id, day FROM (SELECT day, coalesce(sum(n_views) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first,
        unnest(generate_series(1, n_views)) AS n FROM planned_days)""",
    "drawn": f"""SELECT http_request_id, CAST(day AS TIMESTAMP) + to_seconds({D.randint(0, 86399, D.u('view_second', _vid))}) AS "timestamp",
        CAST(floor({D.u('view_product', _vid)} * (SELECT count(*) FROM products)) AS BIGINT) AS product_index,
        CASE WHEN {D.u('view_known', _vid)} < 0.8 THEN CAST(floor({D.u('view_customer', _vid)} * (SELECT count(*) FROM customers)) AS BIGINT) END AS customer_id FROM planned""",
    "shelf": """SELECT p.product_id AS product_index, p.sku, p.category, o.num_offers, o.avg_price, s.total_stock, coalesce(d.oos_rate, 0.1::DOUBLE) AS oos_rate
        FROM products p LEFT JOIN (SELECT sku, count(*) AS num_offers, sum(offer_price)::DOUBLE / count(*) AS avg_price FROM offers GROUP BY 1) o ON p.sku = o.sku
        LEFT JOIN (SELECT sku, sum(stock) AS total_stock FROM stock GROUP BY 1) s ON p.sku = s.sku LEFT JOIN oos_dim d ON p.category = d.category""",
    "numbered": """SELECT sku, offer_price, row_number() OVER (PARTITION BY sku ORDER BY CAST(('0x' || substr(md5(merchant_id), 1, 4)) AS UBIGINT) % 64, merchant_id) AS position, merchant_id FROM offers""",
    "chanced": f"""SELECT w.*, h.sku, h.category, h.num_offers, h.total_stock, h.oos_rate, CASE WHEN w.customer_id IS NOT NULL THEN
            {D.clip("least(0.8::DOUBLE, coalesce(q.preference, 0.5::DOUBLE) * 0.4::DOUBLE) / 1.0::DOUBLE * (1 + 0 * 0.1::DOUBLE)", 0.01, 0.9)} END AS chance
        FROM drawn w JOIN shelf h ON w.product_index = h.product_index LEFT JOIN preferences q ON w.customer_id = q.customer_id AND h.category = q.category""",
    "gated": f"""SELECT *, total_stock IS NOT NULL AND total_stock > 0 AND NOT ({D.u('oos', _vid)} < oos_rate) AS instock FROM chanced
        WHERE customer_id IS NULL OR {D.u('view_gate', _vid)} <= chance""",
    "built_views": f"""SELECT g.http_request_id, CAST(g."timestamp" AS VARCHAR) AS "timestamp", g.sku, coalesce(g.num_offers, 0) AS num_offers, g.instock,
        CAST(n.offer_price AS DOUBLE) AS price_viewed, g.customer_id
        FROM gated g LEFT JOIN numbered n ON g.instock AND g.sku = n.sku AND n.position = 1 + CAST(floor({D.u('view_price', 'g.http_request_id')} * g.num_offers) AS BIGINT)""",
}


def planned_days(m):
    counts = A.daily_counts(m.table("events"), "ts")
    return A.calendar_total(counts, c("n")).select("day", c("volume").alias("n_views"))


@query("tb08_build_views", "SELECT * FROM built_views", PLANNED)
def tb08(m):
    products = m.products().withColumn("product_index", c("product_id"))
    profiles = m.profiles().withColumn("customer_index", c("customer_id"))
    return B.views(planned_days(m), products, profiles, m.offers(), m.stock())


@query("tb08_flat_views", f"""
    SELECT w.http_request_id, CAST(w."timestamp" AS VARCHAR) AS "timestamp", h.sku, coalesce(h.num_offers, 0) AS num_offers, {D.u('oos', 'w.http_request_id')} >= h.oos_rate AS instock,
           CAST(n.offer_price AS DOUBLE) AS price_viewed, w.customer_id
    FROM drawn w JOIN shelf h ON w.product_index = h.product_index
    LEFT JOIN numbered n ON h.sku = n.sku AND n.position = 1 + CAST(floor({D.u('view_price', 'w.http_request_id')} * h.num_offers) AS BIGINT)""", PLANNED)
def tb08_flat(m):
    products = m.products().withColumn("product_index", c("product_id"))
    return B.flat_views(planned_days(m), products, m.table("customer").agg(F.count("*")).scalar(), m.offers())


REASON = D.choice([r for g in V.OOS_REASONS.values() for r in g], D.u("reason", "http_request_id"))


@query("tb09_build_instock_events", f"SELECT http_request_id, sku, CASE WHEN instock THEN 'Instock' ELSE {REASON} END AS reason FROM views")
def tb09(m):
    return B.instock_events(m.views())


CARTS = {**EXTRA, "carted": f"""
    SELECT http_request_id AS cart_id, customer_id, sku, CAST(session_no AS BIGINT) AS session_no, price, {CART_QUANTITY} AS quantity,
           ts + to_seconds({D.randint(10, 300, D.u('cart_delay', _vid))}) AS added, {D.u('cart_abandon', _vid)} < abandon_probability AS abandoned,
           {D.u('cart_minutes', _vid)} AS draw
    FROM scored WHERE coalesce({D.u('cart_add', _vid)} < add_probability, false)"""}


@query("tb10_build_cart_events", f"""
    SELECT cart_id, customer_id, sku, quantity, price, session_no, CAST(added AS VARCHAR) AS "timestamp", 'add_to_cart' AS event_type FROM carted
    UNION ALL
    SELECT cart_id, customer_id, sku, quantity, price, session_no,
           CAST(added + to_minutes(CASE WHEN abandoned THEN {D.randint(1, 60, 'draw')} ELSE {D.randint(1, 30, 'draw')} END) AS VARCHAR),
           CASE WHEN abandoned THEN 'cart_abandoned' ELSE 'ready_to_purchase' END FROM carted""", CARTS)
def tb10(m):
    return B.cart_events(scored_views(m))


SOLD = {**EXTRA, "candidates": f"""
    SELECT http_request_id, customer_id, sku, {D.randint(1, 3, D.u('sale_quantity', _vid))} AS quantity, price AS unit_price, ts AS order_timestamp,
           {D.weighted([s for s, _ in V.FULFILMENT], [w for _, w in V.FULFILMENT], D.u('sale_status', _vid))} AS fulfilment_status
    FROM scored WHERE coalesce({D.u('sale_gate', _vid)} < conversion_probability, false)"""}


@query("tb11_candidate_sales", "SELECT * EXCLUDE (order_timestamp), CAST(order_timestamp AS VARCHAR) AS order_timestamp FROM candidates", SOLD)
def tb11(m):
    return B.candidate_sales(scored_views(m))


@query("tb12_build_sales", f"""
    {greedy_sql('candidates', 'shop', ['order_timestamp', 'http_request_id'], ['http_request_id', 'customer_id', 'quantity', 'unit_price', 'order_timestamp', 'fulfilment_status'])}
    SELECT row_number() OVER (ORDER BY order_timestamp, http_request_id) AS order_id, http_request_id, customer_id, merchant_id, sku, quantity, unit_price,
           CAST(order_timestamp AS VARCHAR) AS order_timestamp, fulfilment_status FROM allocated WHERE merchant_id IS NOT NULL""",
    {**SOLD, "shop": f"SELECT merchant_id, sku, initial_inventory AS stock FROM ({ENRICHED_OFFERS})"}, recursive=True)
def tb12(m):
    shop = B.enrich_offers(m.offers()).select("merchant_id", "sku", c("initial_inventory").alias("stock"))
    return B.sales(B.candidate_sales(scored_views(m)), shop)


@query("tb12_flat_sales", f"""
    SELECT v.http_request_id, v.customer_id, n.merchant_id, v.sku, {D.randint(1, 3, D.u('sale_quantity', 'v.http_request_id'))} AS quantity,
           CAST(v.price_viewed AS DOUBLE) AS unit_price, CAST(v."timestamp" AS VARCHAR) AS order_timestamp,
           {D.weighted([s for s, _ in V.FULFILMENT], [w for _, w in V.FULFILMENT], D.u('sale_status', 'v.http_request_id'))} AS fulfilment_status
    FROM views v JOIN (SELECT sku, count(*) AS num FROM offers GROUP BY 1) o ON v.sku = o.sku
    JOIN numbered n ON v.sku = n.sku AND n.position = 1 + CAST(floor({D.u('flat_merchant', 'v.http_request_id')} * o.num) AS BIGINT)
    WHERE v.customer_id IS NOT NULL AND {D.u('flat_gate', 'v.http_request_id')} < 0.02 * CASE WHEN {D.promo('CAST(v."timestamp" AS DATE)')} > 1 THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END""",
    {"numbered": PLANNED["numbered"]})
def tb12_flat(m):
    return B.flat_sales(m.views(), m.offers())


@query("tb13_build_ratings", f"""
    SELECT order_id AS rating_id, customer_id, sku, {D.randint(1, 5, D.u('rating', 'order_id'))} AS rating, 'Review of ' || sku || ' for order ' || order_id AS review,
           CAST(order_timestamp + to_days(CAST({D.randint(1, 30, D.u('rating_delay', 'order_id'))} AS INTEGER)) AS VARCHAR) AS rating_timestamp
    FROM event_sales WHERE {D.u('rating_gate', 'order_id')} < 0.4""")
def tb13(m):
    return B.ratings(m.event_sales())


@query("tb14_initial_stock_events", f"""
    SELECT '2024-05-19 00:00:00' AS "timestamp", merchant_id, sku, 'initial_stock' AS event_type, initial_inventory AS quantity, 'Initial listing' AS reason,
           initial_inventory AS new_balance FROM ({ENRICHED_OFFERS})""")
def tb14(m):
    return B.initial_stock_events(B.enrich_offers(m.offers()), "2024-05-19")


_skey = ["customer_id", "session_no"]
_ranks = ", ".join(f"{{'rank': -ln(1 - {D.u('session_category', *_skey, D.text(k))}) / max(CASE WHEN category = {D.text(k)} THEN preference END), 'item': {D.text(k)}}}" for k in V.CATEGORIES)


@query("tb15_session_enrichment", f"""
    SELECT s.customer_id, s.session_no, session_type, CAST(start_time AS VARCHAR) AS start_time,
           CAST(start_time + to_minutes({D.randint('minutes_from', 'minutes_to', D.u('session_minutes', *_skey))}) AS VARCHAR) AS end_time,
           {D.randint('pages_from', 'pages_to', D.u('session_pages', *_skey))} AS pages_viewed, categories_browsed
    FROM (SELECT customer_id, session_no, min("timestamp") AS start_time, {SESSION_TYPE} AS session_type FROM sessions_raw GROUP BY 1, 2) s
    JOIN session_dim USING (session_type)
    JOIN (SELECT customer_id, session_no, array_to_string(list_transform(list_sort([{_ranks}])[1:{D.randint(1, 3, D.u('session_categories', *_skey))}], lambda s: s.item), ',') AS categories_browsed
          FROM (SELECT DISTINCT customer_id, CAST(session_no AS BIGINT) AS session_no FROM sessions_raw) JOIN preferences USING (customer_id) GROUP BY 1, 2) k USING (customer_id, session_no)""")
def tb15(m):
    sessioned = windows.sessionize(m.views().dropna(subset=["customer_id"]))
    starts = sessioned.groupBy("customer_id", "session_no").agg(F.min("timestamp").alias("start_time"))
    return B.sessions(starts, m.profiles()).withColumn("categories_browsed", F.array_join("categories_browsed", ","))
