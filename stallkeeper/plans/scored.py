"""The scored view table both sides share: customer views with session, profile, history before each view and scores."""

from stallkeeper import values as V
from stallkeeper.operators import behaviour, windows
from stallkeeper.plans import duck as D
from stallkeeper.session import stored

KINDS, WEIGHTS = [s[0] for s in V.SESSION_TYPES], [s[1] for s in V.SESSION_TYPES]
SESSION_TYPE = D.weighted(KINDS, WEIGHTS, D.u("session_type", "customer_id", "session_no"))

_ratio = "(price / past_price)"
_cart = D.pick("segment", V.CART_PRICE, V.CART_PRICE_DEFAULT)
_sale = f"(price / coalesce(past_price, {D.pick('segment', V.SALE_PRICE, V.SALE_PRICE_DEFAULT)}))"
_view = D.clip(
    f"(least(0.8::DOUBLE, coalesce(preference, 0.5::DOUBLE) * 0.4::DOUBLE) / (CASE WHEN {_ratio} > 1 THEN pow({_ratio}, sens) ELSE 1.0::DOUBLE END)"
    " * (1 + category_purchases * 0.1::DOUBLE))", 0.01, 0.9)
_add = D.clip(
    f"(add_base * (CASE WHEN past_price IS NOT NULL THEN exp(-sens * 0.5::DOUBLE * ({_ratio} - 1)) "
    f"ELSE exp(-greatest(0.0::DOUBLE, sens * 0.3::DOUBLE * (price / {_cart} - 1))) END) * (1 + purchases * 0.05::DOUBLE))", 0.01, 0.4)
_abandon = D.clip(
    f"(cart_abandonment_rate * (CASE WHEN past_price IS NOT NULL THEN 1 + ({_ratio} - 1) * sens * 0.2::DOUBLE "
    f"ELSE 1 + greatest(0.0::DOUBLE, least((price / {_cart} - 1) * sens * 0.3::DOUBLE, 2.0::DOUBLE)) END) * abandon_factor)", 0.10, 0.85)
_factor = f"(CASE WHEN {_sale} <= 1 THEN 1 + (1 - {_sale}) * (1 - sens) ELSE exp(-({_sale} - 1) * sens) END)"
_convert = D.clip(
    f"(conversion_base * factor * (CASE WHEN {D.promo('CAST(ts AS DATE)')} > 1 THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END) * (1 + purchases * 0.05::DOUBLE))", 0.001, 0.15)

EXTRA = {
    "past_sales": """
        SELECT v.http_request_id, s.unit_price, p.category AS sold, q.category FROM views v JOIN event_sales s
            ON s.customer_id = v.customer_id AND s.order_timestamp < v."timestamp" JOIN products p ON s.sku = p.sku JOIN products q ON v.sku = q.sku""",
    "view_history": """
        SELECT http_request_id, count(*) AS purchases, sum(unit_price)::DOUBLE / count(unit_price) AS past_price, count(*) FILTER (sold = category) AS category_purchases
        FROM past_sales GROUP BY 1""",
    "scored_base": f"""
        SELECT r.http_request_id, r.customer_id, r.session_no, r.sku, r."timestamp" AS ts, r.price_viewed, CAST(r.price_viewed AS DOUBLE) AS price,
               {SESSION_TYPE.replace('customer_id', 'r.customer_id')} AS session_type, p.category, f.segment, f.price_sensitivity AS sens,
               f.cart_abandonment_rate, f.conversion_base, f.avg_items_per_cart, q.preference, coalesce(h.purchases, 0) AS purchases, h.past_price,
               coalesce(h.category_purchases, 0) AS category_purchases
        FROM sessions_raw r JOIN products p ON r.sku = p.sku JOIN profiles f ON r.customer_id = f.customer_id
        JOIN preferences q ON r.customer_id = q.customer_id AND p.category = q.category
        LEFT JOIN view_history h ON r.http_request_id = h.http_request_id""",
    "scored": f"""
        SELECT *, {_convert} AS conversion_probability FROM (
            SELECT *, {_view} AS view_probability, CASE WHEN price IS NOT NULL THEN {_add} END AS add_probability,
                   CASE WHEN price IS NOT NULL THEN {_abandon} END AS abandon_probability, {_factor} AS factor
            FROM scored_base JOIN session_dim USING (session_type))""",
}


def view_history(m):
    """Customer views with what each customer had bought before; written, as sessions read it twice."""
    return stored(behaviour.with_history(m.views().dropna(subset=["customer_id"]), m.event_sales(), m.products()), "view_history")


def scored_views(m):
    return behaviour.score_views(windows.sessionize(view_history(m)), m.profiles(), m.products())
