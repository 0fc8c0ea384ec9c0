"""DuckDB text for the oracles: hash sampling, fixed tables and the mapping of the test tables."""

from __future__ import annotations

import re
from itertools import accumulate

from stallkeeper import values as V

SEED = 42


def u(stream: str, *keys: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{SEED}|{stream}', {parts})), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def uniform(lo, hi, draw: str) -> str:
    return f"({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {draw})"


def randint(lo, hi, draw: str) -> str:
    return f"CAST({lo} + floor(({hi} - {lo} + 1) * {draw}) AS BIGINT)"


def text(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(text(v) for v in value) + "]"
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def choice(items: list, draw: str) -> str:
    return f"({text(items)})[CAST(floor({draw} * {len(items)}) AS BIGINT) + 1]"


def weighted(items: list, weights: list[float], draw: str) -> str:
    total = sum(weights)
    bounds = [c / total for c in accumulate(weights)]
    whens = " ".join(f"WHEN {draw} < {b!r}::DOUBLE THEN {text(i)}" for i, b in zip(items[:-1], bounds))
    return f"(CASE {whens} ELSE {text(items[-1])} END)"


def values(names: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def clip(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE) END)"


def pick(key: str, pairs: dict, default) -> str:
    whens = " ".join(f"WHEN {key} = {text(k)} THEN {text(v)}" for k, v in pairs.items())
    return f"(CASE {whens} ELSE {text(default)} END)"


def promo(day: str) -> str:
    month_day = f"(month({day}) * 100 + day({day}))"
    whens = " ".join(f"WHEN {month_day} BETWEEN {a} AND {b} THEN {m!r}::DOUBLE" for a, b, m in V.PROMO_WINDOWS)
    return f"(CASE {whens} WHEN isodow({day}) >= 6 THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END)"


def poisson(rate: str, cap: int, draw: str) -> str:
    whens, term, below = [], f"exp(-{rate})", ""
    for k in range(cap):
        below = f"{below} + {term}" if below else f"0.0::DOUBLE + {term}"
        whens.append(f"WHEN {draw} <= {below} THEN {k}")
        term = f"{term} * {rate} / {k + 1}"
    return f"(CASE {' '.join(whens)} ELSE {cap} END)"


CATS = list(V.CATEGORIES)

MODEL: dict[str, str] = {
    "customers": """
        SELECT c_custkey AS customer_id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
               n_name AS city, CAST(18 + c_custkey % 48 AS INTEGER) AS age,
               (['M', 'F', 'O'])[c_custkey % 3 + 1] AS gender, c_mktsegment
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "products": f"""
        SELECT printf('SKU%06d', p_partkey) AS sku, p_partkey AS product_id,
               ({text(CATS)})[p_partkey % 5 + 1] AS category,
               ({text(list(V.CATEGORIES.values()))})[p_partkey % 5 + 1][(p_partkey // 5) % len(({text(list(V.CATEGORIES.values()))})[p_partkey % 5 + 1]) + 1] AS subcategory,
               CAST(p_retailprice AS DECIMAL(12,2)) AS base_price
        FROM part""",
    "offers": """
        SELECT printf('MER%04d', l_suppkey) AS merchant_id, printf('SKU%06d', l_partkey) AS sku,
               CAST(10 + (l_partkey * 7 + l_suppkey * 13) % 100 AS INTEGER) AS inventory,
               CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS offer_price, CAST(min(l_shipdate) AS DATE) AS listing_date
        FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey, l_partkey""",
    "views": """
        SELECT event_id AS http_request_id, ts AS "timestamp", printf('SKU%06d', CAST(props->>'k' AS BIGINT)) AS sku,
               event_type <> 'error' AS instock,
               CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(12,2)) END AS price_viewed,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS customer_id
        FROM events""",
    "event_sales": """
        SELECT event_id AS order_id, user_id AS customer_id, printf('MER%04d', event_id % 100) AS merchant_id,
               printf('SKU%06d', CAST(props->>'k' AS BIGINT)) AS sku, CAST(1 + event_id % 3 AS INTEGER) AS quantity,
               CAST(value AS DECIMAL(12,2)) AS unit_price, ts AS order_timestamp
        FROM events WHERE event_type = 'purchase'""",
    "line_sales": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id,
               printf('MER%04d', l_suppkey) AS merchant_id, printf('SKU%06d', l_partkey) AS sku,
               CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
               o_orderdate AS order_timestamp,
               CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Delivered' ELSE 'Shipped' END AS fulfilment_status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "movements": """
        SELECT TIMESTAMP '1995-01-01' AS "timestamp", merchant_id, sku, 'initial_stock' AS event_type,
               inventory AS quantity, 'Initial listing' AS reason,
               CAST(-1 AS BIGINT) AS order_id, 0 AS line_no, CAST(0 AS DECIMAL(12,2)) AS unit_price
        FROM offers
        UNION ALL
        SELECT order_timestamp, l.merchant_id, l.sku,
               CASE fulfilment_status WHEN 'Returned' THEN 'restock' WHEN 'Delivered' THEN 'sale' ELSE 'damage' END,
               CASE fulfilment_status WHEN 'Returned' THEN quantity ELSE -quantity END, 'Order ' || order_id,
               order_id, line_no, unit_price
        FROM line_sales l JOIN offers o ON l.merchant_id = o.merchant_id AND l.sku = o.sku""",
    "ledger": """
        SELECT *, CAST(sum(quantity) OVER (PARTITION BY merchant_id, sku
            ORDER BY "timestamp", order_id, line_no, unit_price, quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_balance
        FROM movements""",
    "stock": """
        SELECT merchant_id, sku, CAST(sum(quantity) AS BIGINT) AS stock FROM movements GROUP BY merchant_id, sku""",
    "cart_events": """
        SELECT user_id * 100000000 + year(ts) * 10000 + month(ts) * 100 + day(ts) AS cart_id, user_id AS customer_id,
               printf('SKU%06d', CAST(props->>'k' AS BIGINT)) AS sku, CAST(1 + event_id % 3 AS INTEGER) AS quantity,
               CAST(value AS DECIMAL(12,2)) AS price, ts AS "timestamp",
               CASE event_type WHEN 'click' THEN 'add_to_cart' WHEN 'error' THEN 'cart_abandoned'
                    WHEN 'purchase' THEN 'ready_to_purchase' ELSE 'removed_from_cart' END AS event_type, event_id
        FROM events WHERE event_type <> 'view'""",
    "users": """
        SELECT c_custkey AS id, 'user_' || c_custkey AS username, md5(c_name) AS password_hash, c_custkey % 10 = 0 AS is_admin,
               c_acctbal >= 0 AS is_active, printf('tenant_%03d', c_nationkey) AS tenant_id, c_nationkey AS tenant_no
        FROM customer""",
    "devices": """
        SELECT s_suppkey AS id, 'dev_' || s_suppkey AS device_id, s_suppkey AS user_id, u.tenant_id, s_acctbal >= 0 AS is_active
        FROM supplier LEFT JOIN users u ON s_suppkey = u.id""",
    "user_acls": """
        SELECT id AS user_id, unnest(CASE WHEN is_admin
            THEN ['iot/' || tenant_id || '/+/+', 'iot/' || tenant_id || '/+/+', 'admin/' || tenant_id || '/#']
            ELSE ['iot/' || tenant_id || '/+/data', 'iot/' || tenant_id || '/+/data', 'iot/' || tenant_id || '/+/commands'] END) AS topic_pattern,
            unnest(CASE WHEN is_admin THEN [3, 4, 3] ELSE [1, 4, 2] END) AS access_type
        FROM users""",
    "device_acls": """
        SELECT id AS device_id, 'iot/' || tenant_id || '/' || device_id || '/#' AS topic_pattern, 3 AS access_type FROM devices""",
    "acls": """
        SELECT u.username, a.topic_pattern AS topic, a.access_type AS rw FROM users u JOIN user_acls a ON u.id = a.user_id
        WHERE u.is_active
        UNION ALL
        SELECT u.username, a.topic_pattern, a.access_type FROM users u JOIN devices d ON u.id = d.user_id
        JOIN device_acls a ON d.id = a.device_id WHERE u.is_active AND d.is_active""",
    "messages": """
        SELECT event_id AS message_id, ts AS "timestamp", username, is_admin, 2 AS rw, 1 AS qos,
               CASE event_type WHEN 'click' THEN 'iot/' || tenant_id || '/dev_' || (event_id % 7) || '/commands'
                    WHEN 'signup' THEN 'admin/' || tenant_id || '/alerts'
                    WHEN 'error' THEN 'iot/' || printf('tenant_%03d', (tenant_no + 1) % 25) || '/dev_' || (event_id % 7) || '/data'
                    ELSE 'iot/' || tenant_id || '/dev_' || (event_id % 7) || '/data' END AS topic,
               CASE WHEN event_id % 11 = 0 THEN '{"test_id": '
                    WHEN event_id % 13 = 0 THEN '{"temperature": ' || (event_id % 40) || '}'
                    ELSE '{"test_id": "' || event_id || '", "expected_delivery": ' ||
                         CASE WHEN event_type = 'error' THEN 'false' ELSE 'true' END || '}' END AS payload
        FROM events LEFT JOIN users ON user_id = id""",
    "calendar_days": """
        SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""",
    "seg_dim": values("segment, weight, seg_sensitivity, cart_abandonment_rate, conversion_base, avg_items_per_cart, preferred_categories", V.SEGMENTS),
    "age_dim": values("age_from, age_to, tech_affinity, age_sensitivity, social_influence, preferred_categories", V.AGE_BANDS),
    "gender_dim": values("gender, category, gender_weight", [(g, c, w) for g, ws in V.GENDER_WEIGHTS.items() for c, w in zip(V.CATEGORIES, ws)]),
    "cat_dim": values("category, subcategories", list(V.CATEGORIES.items())),
    "session_dim": values("session_type, weight, minutes_from, minutes_to, pages_from, pages_to, add_base, abandon_factor", V.SESSION_TYPES),
    "merchant_dim": values("merchant_type, weight, price_strategy, stock_levels, fulfillment_speed, quality_score", V.MERCHANT_TYPES),
    "attr_dim": values("subcategory, attributes", list(V.ATTRIBUTES.items())),
    "oos_dim": values("category, oos_rate", V.OOS_RATES),
    "segmented": f"""
        SELECT c.*, {weighted([s[0] for s in V.SEGMENTS], [s[1] for s in V.SEGMENTS], u('segment', 'customer_id'))} AS segment
        FROM customers c""",
    "profiles": f"""
        SELECT c.customer_id, c.gender, c.age, c.segment, coalesce(a.tech_affinity, 0.5::DOUBLE) AS tech_affinity,
               {clip(f"(s.seg_sensitivity * coalesce(a.age_sensitivity, 0.5::DOUBLE) * {uniform(0.8, 1.2, u('sensitivity', 'c.customer_id'))})", 0.1, 1.0)} AS price_sensitivity,
               s.cart_abandonment_rate, s.conversion_base, s.avg_items_per_cart, s.preferred_categories
        FROM segmented c JOIN seg_dim s ON c.segment = s.segment
        LEFT JOIN age_dim a ON c.age BETWEEN a.age_from AND a.age_to""",
    "preferences": f"""
        SELECT p.customer_id, c.category, {clip(
            f"((CASE WHEN list_contains(p.preferred_categories, c.category) THEN {uniform(0.7, 1.0, u('preference', 'p.customer_id', 'c.category'))} "
            f"ELSE {uniform(0.3, 0.7, u('preference', 'p.customer_id', 'c.category'))} END) * coalesce(g.gender_weight, 1.0::DOUBLE) "
            f"* (CASE WHEN c.category = 'Electronics' THEN p.tech_affinity ELSE 1.0::DOUBLE END))", 0.1, 2.0)} AS preference
        FROM profiles p CROSS JOIN cat_dim c LEFT JOIN gender_dim g ON p.gender = g.gender AND c.category = g.category""",
    "sessions_raw": """
        SELECT *, sum(CASE WHEN prev IS NULL OR "timestamp" - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY customer_id ORDER BY "timestamp", http_request_id ROWS UNBOUNDED PRECEDING) AS session_no
        FROM (SELECT *, lag("timestamp") OVER (PARTITION BY customer_id ORDER BY "timestamp", http_request_id) AS prev
              FROM views WHERE customer_id IS NOT NULL)""",
}


def oracle(sql: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix the model CTEs the query needs, dependencies first."""
    known = {**MODEL, **(extra or {})}
    order: list[str] = []

    def need(body: str, own: str | None = None) -> None:
        for name in known:
            if name != own and name not in order and re.search(rf"\b{name}\b", body):
                need(known[name], name)
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    head = ",\n".join(f"{name} AS ({known[name]})" for name in order)
    body = sql.lstrip()
    if recursive or body.upper().startswith("WITH"):
        rest = re.sub(r"^WITH(\s+RECURSIVE)?", "", body, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{rest}"
    return f"WITH {head}\n{body}"
