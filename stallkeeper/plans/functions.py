"""Scalar functions, scores and hash sampling."""

from pyspark.sql import functions as F

from stallkeeper import dims, values as V
from stallkeeper.functions import calendar as C, hashing as H, scalar as S, scores
from stallkeeper.operators import behaviour, builders
from stallkeeper.plans import duck as D
from stallkeeper.plans.base import query
from stallkeeper.plans.scored import EXTRA, scored_views

c = F.col


@query("fn01_clip", f"SELECT http_request_id, {D.clip('CAST(price_viewed AS DOUBLE)', 5.0, 50.0)} AS clipped FROM views")
def fn01(m):
    return m.views().select("http_request_id", S.clip(c("price_viewed").cast("double"), 5.0, 50.0).alias("clipped"))


@query("fn02_format_key", "SELECT l_orderkey, l_linenumber, printf('SKU%06d', l_partkey) AS sku, printf('MER%04d', l_suppkey) AS merchant_id FROM lineitem")
def fn02(m):
    sku, merchant = S.format_key("SKU", 6, c("l_partkey")), S.format_key("MER", 4, c("l_suppkey"))
    return m.table("lineitem").select("l_orderkey", "l_linenumber", sku.alias("sku"), merchant.alias("merchant_id"))


@query("fn03_contains_at", "SELECT doc_id, coalesce(strpos(text, '@') > 0, false) AS has_at FROM documents")
def fn03(m):
    return m.table("documents").select("doc_id", S.contains_at(c("text")).alias("has_at"))


@query("fn04_keyword_match", "SELECT doc_id, lower(text) LIKE '%price%' OR lower(text) LIKE '%stock%' OR lower(text) LIKE '%reference%' AS hit FROM documents")
def fn04(m):
    return m.table("documents").select("doc_id", S.keyword_match(c("text"), ["price", "stock", "reference"]).alias("hit"))


@query("fn05_truncate_preview", "SELECT message_id, CASE WHEN length(payload) > 30 THEN left(payload, 30) || '...' ELSE payload END AS preview FROM messages")
def fn05(m):
    return m.messages().select("message_id", S.preview(c("payload")).alias("preview"))


@query("fn06_array_to_text", "SELECT customer_id, array_to_string(preferred_categories, ',') AS categories FROM profiles")
def fn06(m):
    return m.profiles().select("customer_id", F.array_join("preferred_categories", ",").alias("categories"))


@query("fn07_flatten_tree", f"""
    SELECT t.reason_group, t.reason, count(*) AS n FROM ({D.values('reason_group, reason', [(g, r) for g, rs in V.OOS_REASONS.items() for r in rs])}) t
    JOIN (SELECT {D.choice(dims.flat_reasons(), D.u('reason', 'http_request_id'))} AS reason FROM views WHERE NOT instock) e ON t.reason = e.reason GROUP BY 1, 2""")
def fn07(m):
    flat = dims.reason_tree(m.spark).select("reason_group", F.explode("reasons").alias("reason"))
    return builders.instock_events(m.views()).join(flat, "reason").groupBy("reason_group", "reason").agg(F.count("*").alias("n"))


@query("fn08_explode_attributes", "SELECT sku, unnest(attributes) AS description FROM products JOIN attr_dim USING (subcategory)")
def fn08(m):
    return builders.attributes(m.products()).select("sku", "description")


@query("fn09_map_build_lookup", f"""
    SELECT v.http_request_id, round(coalesce(q.preference, 0.5::DOUBLE), 9) AS preference FROM views v
    JOIN (SELECT sku, CASE WHEN product_id % 9 = 0 THEN 'Toys' ELSE category END AS category FROM products) p ON v.sku = p.sku
    LEFT JOIN preferences q ON v.customer_id = q.customer_id AND p.category = q.category WHERE v.customer_id IS NOT NULL""")
def fn09(m):
    maps = behaviour.preference_map(m.profiles()).select("customer_id", "category_preferences")
    kinds = m.products().select("sku", F.when(c("product_id") % 9 == 0, "Toys").otherwise(c("category")).alias("category"))
    joined = m.views().dropna(subset=["customer_id"]).join(kinds, "sku").join(maps, "customer_id")
    return joined.select("http_request_id", F.round(behaviour.lookup(c("category_preferences"), c("category"), 0.5), 9).alias("preference"))


@query("fn10_json_parse", """
    SELECT message_id, CASE WHEN payload LIKE '%}' THEN payload->>'test_id' END AS test_id,
           CASE WHEN payload LIKE '%}' THEN CAST(payload->>'expected_delivery' AS BOOLEAN) END AS expected_delivery FROM messages""")
def fn10(m):
    return m.messages().select("message_id", S.payload_struct(c("payload")).alias("p")).select("message_id", "p.test_id", "p.expected_delivery")


@query("fn11_json_build")
def fn11(m):
    fields = [F.concat(F.lit("t"), c("message_id").cast("string")).alias("test_id"), (c("qos") == 1).alias("expected_delivery"), c("username"), c("topic")]
    return m.messages().select("message_id", S.build_payload(fields).alias("payload"))


CLASS = """CASE WHEN payload NOT LIKE '%}' OR payload NOT LIKE '%expected_delivery%' THEN 'REGULAR'
           WHEN payload LIKE '%false}' THEN 'UNEXPECTED' ELSE 'EXPECTED' END"""


@query("fn12_classify_delivery", f"SELECT message_id, {CLASS} AS delivery_class FROM messages")
def fn12(m):
    return m.messages().select("message_id", S.classify(c("payload")).alias("delivery_class"))


@query("fn20_date_range", """
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(o_orderkey) AS n
    FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)
    LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1""")
def fn20(m):
    orders = m.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    days = C.days_between(orders.agg(F.min("day").alias("lo"), F.max("day").alias("hi")), "lo", "hi").select("day")
    return days.join(orders.groupBy("day").agg(F.count("*").alias("n")), "day", "left").fillna({"n": 0})


@query("fn21_promo_multiplier", f"SELECT o_orderkey, {D.promo('CAST(o_orderdate AS DATE)')} AS multiplier FROM orders")
def fn21(m):
    return m.table("orders").select("o_orderkey", C.promo_multiplier("to_date(o_orderdate)").alias("multiplier"))


@query("fn22_at_second_of_day", f"SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds({D.randint(0, 86399, D.u('second', 'o_orderkey'))}) AS VARCHAR) AS ts FROM orders")
def fn22(m):
    second = H.int_inclusive(0, 86399, H.u("second", "o_orderkey"))
    return m.table("orders").select("o_orderkey", C.at_second(F.to_date("o_orderdate"), second).alias("ts"))


@query("fn23_add_interval", """
    SELECT event_id, CAST(ts + to_seconds(10 + event_id % 291) AS VARCHAR) AS plus_seconds, CAST(ts + to_minutes(1 + event_id % 60) AS VARCHAR) AS plus_minutes,
           CAST(ts + to_days(CAST(1 + event_id % 30 AS INTEGER)) AS VARCHAR) AS plus_days FROM events""")
def fn23(m):
    ts, e = c("ts"), c("event_id")
    return m.table("events").select(
        "event_id", C.add_interval(ts, seconds=10 + e % 291).alias("plus_seconds"), C.add_interval(ts, minutes=1 + e % 60).alias("plus_minutes"),
        C.add_interval(ts, days=1 + e % 30).alias("plus_days"))


@query("fn24_whole_days", "SELECT user_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS BIGINT) AS days FROM events GROUP BY 1")
def fn24(m):
    spans = m.table("events").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return spans.select("user_id", C.whole_days(c("lo"), c("hi")).alias("days"))


@query("fn25_try_parse_ts", """
    SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) IS NOT NULL AS parseable FROM events""")
def fn25(m):
    text = F.when(c("event_type") == "error", "n/a").otherwise(c("ts").cast("string"))
    return m.table("events").select("event_id", C.try_parse(text).isNotNull().alias("parseable"))


@query("fn26_to_day_midnight", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(date_trunc('day', ts)::TIMESTAMP AS VARCHAR) AS midnight FROM events")
def fn26(m):
    return m.table("events").select("event_id", F.to_date("ts").alias("day"), C.midnight(c("ts")).alias("midnight"))


@query("fn30_price_sensitivity", "SELECT customer_id, segment, round(price_sensitivity, 9) AS price_sensitivity FROM profiles")
def fn30(m):
    return m.profiles().select("customer_id", "segment", F.round("price_sensitivity", 9).alias("price_sensitivity"))


@query("fn31_category_preference", "SELECT customer_id, category, round(preference, 9) AS preference FROM preferences")
def fn31(m):
    return behaviour.preferences(m.profiles()).withColumn("preference", F.round("preference", 9))


def _score(name: str, column: str, sql_column: str | None = None) -> None:
    @query(name, f"SELECT http_request_id, round({sql_column or column}, 9) AS {column} FROM scored", EXTRA)
    def run(m):
        return scored_views(m).select("http_request_id", F.round(column, 9).alias(column))


_score("fn32_view_probability", "view_probability")
_score("fn33_add_to_cart_probability", "add_probability")
_score("fn34_abandonment_probability", "abandon_probability")
_score("fn35_price_factor", "price_factor", "factor")
_score("fn36_conversion_probability", "conversion_probability")

_velocity = "(CASE WHEN sku_no % 3 = 0 THEN NULL ELSE (sku_no % 40) / 10.0::DOUBLE END)"
STOCKED = """SELECT merchant_id, sku, stock, CAST(substr(sku, 4) AS BIGINT) AS sku_no FROM stock"""
RESTOCK_P = f"""CASE WHEN stock <= 50 THEN 0.15::DOUBLE * least(2.0::DOUBLE, coalesce({_velocity}, 0.0::DOUBLE) * 10) * greatest(0.1::DOUBLE, (50 - stock) / 50.0::DOUBLE) * 0.8::DOUBLE END"""


def _stocked(m):
    number = F.expr("substring(sku, 4)").cast("long")
    rate = F.when(number % 3 != 0, (number % 40) / F.lit(10.0))
    return m.stock().select("merchant_id", "sku", "stock", rate.alias("velocity"))


@query("fn37_restock_probability", f"SELECT merchant_id, sku, round({RESTOCK_P}, 9) AS probability FROM ({STOCKED})")
def fn37(m):
    p = scores.restock_probability(c("stock"), c("velocity"), F.lit(None).cast("double"))
    return _stocked(m).select("merchant_id", "sku", F.round(p, 9).alias("probability"))


@query("fn38_restock_quantity", f"""
    SELECT merchant_id, sku, greatest(10, CAST(trunc(greatest(1.0::DOUBLE, coalesce({_velocity}, 0.0::DOUBLE) * 7) * {D.uniform(0.3, 2.0, D.u('rq', 'merchant_id', 'sku'))}) AS INTEGER)) AS quantity
    FROM ({STOCKED})""")
def fn38(m):
    return _stocked(m).select("merchant_id", "sku", scores.restock_quantity(c("velocity"), H.u("rq", "merchant_id", "sku")).alias("quantity"))


@query("fn39_damage_quantity", f"""
    SELECT merchant_id, sku, least(stock, greatest(1, CAST(trunc(stock * {D.uniform(0.01, 0.10, D.u('dq', 'merchant_id', 'sku'))}) AS BIGINT))) AS quantity FROM stock WHERE stock > 0""")
def fn39(m):
    return m.stock().filter("stock > 0").select("merchant_id", "sku", scores.damage_quantity(c("stock"), H.u("dq", "merchant_id", "sku")).alias("quantity"))


INITIAL = " ".join(
    f"WHEN '{level}' THEN {D.uniform(lo, hi, D.u('initial_stock', 'merchant_id', 'sku'))}" for level, lo, hi in (("high", 1.2, 2.0), ("low", 0.3, 0.8)))
INITIAL = f"CAST(trunc(inventory * (CASE stock_levels {INITIAL} ELSE {D.uniform(0.8, 1.2, D.u('initial_stock', 'merchant_id', 'sku'))} END)) AS INTEGER)"
TYPE = D.weighted([t[0] for t in V.MERCHANT_TYPES], [t[1] for t in V.MERCHANT_TYPES], D.u("merchant_type", "merchant_id"))


@query("fn40_initial_stock", f"SELECT merchant_id, sku, {INITIAL} AS initial_inventory FROM (SELECT *, {TYPE} AS merchant_type FROM offers) JOIN merchant_dim USING (merchant_type)")
def fn40(m):
    return builders.enrich_offers(m.offers()).select("merchant_id", "sku", "initial_inventory")


CART_QUANTITY = f"CASE WHEN session_type = 'impulse_buy' THEN 1 ELSE least(5, greatest(1, {D.poisson('avg_items_per_cart', 5, D.u('cart_quantity', 'http_request_id'))})) END"


@query("fn41_cart_quantity", f"SELECT http_request_id, {CART_QUANTITY} AS quantity FROM scored", EXTRA)
def fn41(m):
    q = scores.cart_quantity(c("session_type"), c("avg_items_per_cart"), H.u("cart_quantity", "http_request_id"))
    return scored_views(m).select("http_request_id", q.alias("quantity"))


OFFER_PRICE = f"CAST(round(base_price * CAST({D.uniform(0.7, 1.2, D.u('offer_price', 'sku', 'merchant_id'))} AS DECIMAL(12,9)), 2) AS DOUBLE)"


@query("fn42_offer_price", f"SELECT merchant_id, sku, {OFFER_PRICE} AS offer_price FROM offers JOIN products USING (sku)")
def fn42(m):
    joined = m.offers().select("merchant_id", "sku").join(m.products().select("sku", "base_price"), "sku")
    return joined.select("merchant_id", "sku", scores.offer_price(c("base_price"), H.u("offer_price", "sku", "merchant_id")).alias("offer_price"))


@query("fn43_session_shape", f"""
    SELECT http_request_id, session_type, {D.randint('minutes_from', 'minutes_to', D.u('m', 'http_request_id'))} AS minutes, {D.randint('pages_from', 'pages_to', D.u('p', 'http_request_id'))} AS pages
    FROM (SELECT http_request_id, {D.weighted([s[0] for s in V.SESSION_TYPES], [s[1] for s in V.SESSION_TYPES], D.u('kind', 'http_request_id'))} AS session_type FROM views) JOIN session_dim USING (session_type)""")
def fn43(m):
    kind = H.weighted_choice([s[0] for s in V.SESSION_TYPES], [s[1] for s in V.SESSION_TYPES], H.u("kind", "http_request_id"))
    typed = m.views().select("http_request_id", kind.alias("session_type")).join(dims.session_types(m.spark), "session_type")
    return typed.select(
        "http_request_id", "session_type", H.int_inclusive(c("minutes_from"), c("minutes_to"), H.u("m", "http_request_id")).alias("minutes"),
        H.int_inclusive(c("pages_from"), c("pages_to"), H.u("p", "http_request_id")).alias("pages"))


# -- hash sampling over every event

E = "event_id"


@query("rn01_uniform", f"SELECT event_id, {D.uniform(2.0, 5.0, D.u('a', E))} AS x FROM events")
def rn01(m):
    return m.table("events").select(E, H.uniform(2.0, 5.0, H.u("a", E)).alias("x"))


@query("rn02_int_inclusive", f"SELECT event_id, {D.randint(1, 6, D.u('a', E))} AS x FROM events")
def rn02(m):
    return m.table("events").select(E, H.int_inclusive(1, 6, H.u("a", E)).alias("x"))


@query("rn03_normal", f"SELECT event_id, round(10.0::DOUBLE + 3.0::DOUBLE * sqrt(-2 * ln(1 - {D.u('a', E)})) * cos(2 * pi() * {D.u('b', E)}), 9) AS x FROM events")
def rn03(m):
    return m.table("events").select(E, F.round(H.normal(10.0, 3.0, H.u("a", E), H.u("b", E)), 9).alias("x"))


@query("rn04_exponential", f"SELECT event_id, round(-4.0::DOUBLE * ln(1 - {D.u('a', E)}), 9) AS x FROM events")
def rn04(m):
    return m.table("events").select(E, F.round(H.exponential(4.0, H.u("a", E)), 9).alias("x"))


def _gamma(first: int, last: int) -> str:
    return "(" + " + ".join(f"(-ln(1 - {D.u(f'b{i}', E)}))" for i in range(first, last)) + ")"


@query("rn05_beta", f"SELECT event_id, round({_gamma(0, 2)} / {_gamma(0, 7)}, 9) AS x FROM events")
def rn05(m):
    return m.table("events").select(E, F.round(H.beta(2, 5, "b", E), 9).alias("x"))


@query("rn06_weighted_choice", f"SELECT event_id, {D.weighted(['a', 'b', 'c'], [5.0, 3.0, 2.0], D.u('w', E))} AS x FROM events")
def rn06(m):
    return m.table("events").select(E, H.weighted_choice(["a", "b", "c"], [5.0, 3.0, 2.0], H.u("w", E)).alias("x"))


@query("rn07_weighted_choice_by_row", f"""
    SELECT event_id, CASE WHEN d * (w1 + w2 + w3) < w1 THEN 'low' WHEN d * (w1 + w2 + w3) < w1 + w2 THEN 'mid' ELSE 'high' END AS x
    FROM (SELECT event_id, {D.u('r', E)} AS d, 1.0::DOUBLE AS w1, (event_id % 4)::DOUBLE AS w2, (event_id % 7)::DOUBLE AS w3 FROM events)""")
def rn07(m):
    weights = F.array(F.lit(1.0), (c(E) % 4).cast("double"), (c(E) % 7).cast("double"))
    return m.table("events").select(E, H.weighted_choice_by_row(dims.literal_array(["low", "mid", "high"]), weights, H.u("r", E)).alias("x"))


@query("rn08_poisson", f"SELECT event_id, {D.poisson('rate', 8, D.u('p', E))} AS x FROM (SELECT event_id, 1.0::DOUBLE + (event_id % 3) * 0.7::DOUBLE AS rate FROM events)")
def rn08(m):
    return m.table("events").select(E, H.poisson(1.0 + (c(E) % 3) * 0.7, 8, H.u("p", E)).alias("x"))


_sample = ", ".join(f"{{'rank': -ln(1 - {D.u('s', E, D.text(k))}) / {w!r}::DOUBLE, 'item': {D.text(k)}}}" for k, w in zip(V.CATEGORIES, (5.0, 1.0, 2.0, 4.0, 3.0)))


@query("rn09_weighted_sample_no_replace", f"SELECT event_id, array_to_string(list_transform(list_sort([{_sample}])[1:1 + event_id % 3], lambda s: s.item), ',') AS x FROM events")
def rn09(m):
    weights = dims.literal_array([5.0, 1.0, 2.0, 4.0, 3.0])
    picked = H.weighted_sample(dims.literal_array(list(V.CATEGORIES)), weights, 1 + c(E) % 3, "s", E)
    return m.table("events").select(E, F.array_join(picked, ",").alias("x"))


@query("rn10_gate", f"SELECT event_id, coalesce({D.u('g', E)} < CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END, false) AS x FROM events")
def rn10(m):
    p = F.when(c("event_type") != "error", c("value") / 100)
    return m.table("events").select(E, H.gate(p, H.u("g", E)).alias("x"))


@query("rn11_assign_segment", "SELECT customer_id, segment FROM segmented")
def rn11(m):
    return behaviour.assign_segment(m.customers()).select("customer_id", "segment")


@query("rn12_weighted_date", f"""
    SELECT event_id, CAST(day AS VARCHAR) AS day FROM (SELECT event_id, {D.u('date', E)} AS draw FROM events) e
    JOIN (SELECT day, coalesce(lag(hi) OVER (ORDER BY day), 0) AS lo, hi FROM (SELECT day, sum(w) OVER (ORDER BY day)::DOUBLE / sum(w) OVER ()::DOUBLE AS hi
          FROM (SELECT CAST(d AS DATE) AS day, CAST({D.promo('CAST(d AS DATE)')} AS DECIMAL(9,3)) AS w
                FROM (SELECT unnest(generate_series(TIMESTAMP '2024-05-19', TIMESTAMP '2025-05-18', INTERVAL 1 DAY)) AS d)))) k
    ON e.draw >= k.lo AND e.draw < k.hi""")
def rn12(m):
    days = C.date_range(m.spark, "2024-05-19", "2025-05-18")
    return builders.weighted_date(m.table("events").select(E), days, H.u("date", E)).select(E, "day")
