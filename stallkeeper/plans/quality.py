"""Data-quality rules on tables with planted defects."""

from pyspark.sql import functions as F

from stallkeeper import values as V
from stallkeeper.operators import quality as Q, validation
from stallkeeper.plans import duck as D
from stallkeeper.plans.base import query
from stallkeeper.session import stored
from stallkeeper.sources import damaged


def _bad(stream: str, keys: str, column: str, value: str, share: float = 0.02) -> str:
    return f'CASE WHEN {D.u("bad_" + stream, *keys.split())} < {share} THEN {value} ELSE {column} END AS "{column.strip(chr(34))}"'


def _twice(name: str, body: str, keys: str) -> dict[str, str]:
    return {f"{name}_once": body, name: f"SELECT * FROM {name}_once UNION ALL SELECT * FROM {name}_once WHERE {D.u('twice_' + name[2:], *keys.split())} < 0.01"}


_price = f"CASE WHEN {D.u('bad_high', 'sku')} < 0.02 THEN 2000000 WHEN {D.u('bad_price', 'sku')} < 0.02 THEN 0 ELSE base_price END AS base_price"
_quantity = f"CASE WHEN {D.u('bad_many', 'order_id')} < 0.02 THEN 150 WHEN {D.u('bad_none', 'order_id')} < 0.02 THEN 0 ELSE quantity END AS quantity"
_status = f"CASE WHEN {D.u('bad_status', 'order_id')} < 0.02 THEN 'Lost' ELSE {D.weighted([s for s, _ in V.FULFILMENT], [w for _, w in V.FULFILMENT], D.u('status', 'order_id'))} END AS fulfilment_status"
_pair = "merchant_id sku order_id line_no"

EXTRA = {
    **_twice("d_customers", f"SELECT customer_id, name, {_bad('email', 'customer_id', 'email', chr(39).join(['replace(email, ', '@', ', ', '#', ')']))}, city, {_bad('age', 'customer_id', 'age', '150')}, {_bad('gender', 'customer_id', 'gender', chr(39) + 'X' + chr(39))} FROM customers", "customer_id"),
    **_twice("d_products", f"SELECT sku, product_id, {_bad('category', 'sku', 'category', chr(39) + 'Toys' + chr(39))}, {_bad('subcategory', 'sku', 'subcategory', chr(39) + 'Mobiles' + chr(39), 0.05)}, {_price} FROM products", "sku"),
    **_twice("d_offers", f"SELECT merchant_id, sku, {_bad('inventory', 'merchant_id sku', 'inventory', '-5')}, {_bad('offer_price', 'merchant_id sku', 'offer_price', '0')}, listing_date FROM offers", "merchant_id sku"),
    **_twice("d_views", f"""SELECT http_request_id, {_bad('time', 'http_request_id', 'ts_text', "'not a time'").replace('AS "ts_text"', 'AS "timestamp"')},
        {_bad('sku', 'http_request_id', 'sku', "'SKU-none'")}, {_bad('instock', 'http_request_id', 'CAST(instock AS VARCHAR)', "'maybe'").replace('AS "CAST(instock AS VARCHAR)"', 'AS instock')},
        {_bad('shown', 'http_request_id', 'price_viewed', 'NULL')}, {_bad('visitor', 'http_request_id', 'customer_id', '-1')}
        FROM (SELECT *, CAST("timestamp" AS VARCHAR) AS ts_text FROM views)""", "http_request_id"),
    **_twice("d_sales", f"SELECT order_id, customer_id, merchant_id, sku, {_quantity}, {_bad('paid', 'order_id', 'unit_price', '-1')}, order_timestamp, {_status} FROM event_sales", "order_id"),
    "d_ledger": f"""SELECT "timestamp", merchant_id, sku, {_bad('kind', _pair, 'event_type', "'teleport'")}, {_bad('sign', _pair, 'quantity', '-quantity')},
        reason, order_id, line_no, unit_price, new_balance FROM ledger""",
    "d_carts": f"SELECT cart_id, customer_id, sku, quantity, price, \"timestamp\", {_bad('cart', 'event_id', 'event_type', chr(39) + 'lost' + chr(39))}, event_id FROM cart_events",
}
CTE = {"customers": "d_customers", "products": "d_products", "offers": "d_offers", "views": "d_views", "sales": "d_sales", "inventory_events": "d_ledger", "cart_events": "d_carts"}
KEY = {"customers": "customer_id", "products": "sku", "offers": "merchant_id || '/' || sku", "views": "http_request_id", "sales": "order_id",
       "inventory_events": "merchant_id || '/' || sku", "cart_events": "cart_id"}


def _inside(column: str, allowed: list[str]) -> str:
    return f"coalesce({column} NOT IN ({', '.join(D.text(a) for a in allowed)}), true)"


ROW_SQL = {
    "DQ04": ["customer_id < 1"], "DQ05": ["age < 18 OR age > 100"], "DQ06": [_inside("gender", V.GENDERS)],
    "DQ07": ["coalesce(strpos(email, '@') = 0, true)"], "DQ10": [_inside("category", list(V.CATEGORIES))],
    "DQ11": ["base_price <= 0"], "DQ12": ["base_price > 1000000"],
    "DQ13": [f"(category, subcategory) NOT IN ({', '.join(f'({D.text(k)}, {D.text(s)})' for k, ss in V.CATEGORIES.items() for s in ss)})"],
    "DQ15": ["inventory < 0"], "DQ16": ["offer_price <= 0"], "DQ20": ['TRY_CAST("timestamp" AS TIMESTAMP) IS NULL'],
    "DQ21": ["instock NOT IN ('true', 'false')"], "DQ22": ["instock = 'true' AND price_viewed IS NULL"],
    "DQ25": ["quantity <= 0"], "DQ26": ["quantity > 100"], "DQ27": ["unit_price <= 0"], "DQ28": [_inside("fulfilment_status", [s for s, _ in V.FULFILMENT])],
    "DQ30": [_inside("event_type", V.INVENTORY_EVENTS)],
    "DQ31": [f"event_type = '{k}' AND quantity < 0" for k in ("initial_stock", "restock", "adjustment")],
    "DQ32": [f"event_type = '{k}' AND quantity > 0" for k in ("sale", "damage")],
    "DQ34": [_inside("event_type", V.CART_EVENTS)], "DQ40": ["new_balance < 0"],
}


def _row_sql(rule_id: str) -> str:
    found = [r for r in Q.ROW_RULES if r.rule_id == rule_id]
    return " UNION ALL ".join(
        f"SELECT '{rule_id}' AS rule_id, '{r.table}' AS table_name, '{r.issue}' AS issue, count(*) FILTER ({cond}) AS violations, "
        f"CAST(min({KEY[r.table]}) FILTER ({cond}) AS VARCHAR) AS example FROM {CTE[r.table]}"
        for r, cond in zip(found, ROW_SQL[rule_id])
    )


def _required_sql(rule_id: str) -> str:
    table, needed = Q.REQUIRED[rule_id]
    return (f"SELECT '{rule_id}' AS rule_id, '{table}' AS table_name, 'A needed column is absent' AS issue, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS violations, "
            f"CAST(NULL AS VARCHAR) AS example FROM {CTE[table]}")


def _duplicate_sql(rule_id: str) -> str:
    table, keys, issue = Q.DUPLICATES[rule_id]
    cols = ", ".join(keys)
    return (f"SELECT '{rule_id}' AS rule_id, '{table}' AS table_name, '{issue}' AS issue, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations, CAST(min(k) AS VARCHAR) AS example "
            f"FROM (SELECT {KEY[table]} AS k, count(*) AS n FROM {CTE[table]} GROUP BY {cols} HAVING count(*) > 1)")


def _cross(rule_id: str, table: str, issue: str, body: str) -> str:
    return f"SELECT '{rule_id}' AS rule_id, '{table}' AS table_name, '{issue}' AS issue, count(*) AS violations, CAST(min(k) AS VARCHAR) AS example FROM ({body})"


def _measure(rule_id: str, table: str, issue: str, body: str, bad: str) -> str:
    return f"SELECT '{rule_id}' AS rule_id, '{table}' AS table_name, '{issue}' AS issue, CASE WHEN {bad} THEN 1 ELSE 0 END AS violations, round(m::DOUBLE, 9) AS measure FROM (SELECT {body} AS m)"


_mean_age = "(SELECT CAST(sum(CAST(age AS DECIMAL(18,9))) AS DOUBLE) / count(age) FROM d_customers)"
_cv = """(SELECT sqrt((sum(n * n)::DOUBLE - sum(n)::DOUBLE * sum(n)::DOUBLE / count(*)) / (count(*) - 1)) / (sum(n)::DOUBLE / count(*))
    FROM (SELECT CAST(TRY_CAST("timestamp" AS TIMESTAMP) AS DATE) AS d, count(*) AS n FROM d_views GROUP BY 1) WHERE d IS NOT NULL)"""
_unseen = """SELECT order_id AS k FROM {sales} s WHERE EXISTS (SELECT 1 FROM d_views v WHERE v.customer_id = s.customer_id AND v.sku = s.sku AND price_viewed IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM d_views v WHERE v.customer_id = s.customer_id AND v.sku = s.sku AND price_viewed = s.unit_price)"""

CROSS_SQL = {
    "DQ35": _cross("DQ35", "views", "View has a reference to an unknown customer", "SELECT DISTINCT customer_id AS k FROM d_views WHERE customer_id NOT IN (SELECT customer_id FROM d_customers)"),
    "DQ36": _cross("DQ36", "views", "View has a reference to an unknown sku", "SELECT DISTINCT sku AS k FROM d_views WHERE sku NOT IN (SELECT sku FROM d_products)"),
    "DQ37": _cross("DQ37", "sales", "Sale has a reference to an unknown offer", "SELECT merchant_id || '/' || sku AS k FROM (SELECT merchant_id, sku FROM d_sales EXCEPT SELECT merchant_id, sku FROM d_offers)"),
    "DQ38": _cross("DQ38", "sales", "Sold although shown as out of stock", """SELECT order_id AS k FROM d_sales s WHERE EXISTS (SELECT 1 FROM d_views v WHERE v.customer_id = s.customer_id
        AND v.sku = s.sku AND v.instock = 'false' AND abs(epoch_us(TRY_CAST(v."timestamp" AS TIMESTAMP)) - epoch_us(s.order_timestamp)) < 3600000000)"""),
    "DQ41": _cross("DQ41", "inventory_events", "Inventory went down by another amount than was sold", """SELECT coalesce(s.merchant_id, g.merchant_id) || '/' || coalesce(s.sku, g.sku) AS k
        FROM (SELECT merchant_id, sku, sum(quantity) AS sold FROM d_sales GROUP BY ALL) s
        FULL JOIN (SELECT merchant_id, sku, abs(sum(quantity)) AS gone FROM d_ledger WHERE event_type = 'sale' GROUP BY ALL) g
        ON s.merchant_id = g.merchant_id AND s.sku = g.sku WHERE abs(coalesce(sold, 0) - coalesce(gone, 0)) > 1"""),
}
MEASURE_SQL = {
    "DQ39": _measure("DQ39", "sales", "Paid price was never shown", f"(SELECT count(*) FROM ({_unseen.format(sales='d_sales')}))::DOUBLE / (SELECT count(*) FROM d_sales)", "m > 0.05"),
    "DQ42": _measure("DQ42", "sales", "Sales per view outside the usual range", "(SELECT count(*) FROM d_sales)::DOUBLE / (SELECT count(*) FROM d_views WHERE customer_id IS NOT NULL)", "m < 0.005 OR m > 0.1"),
    "DQ43": _measure("DQ43", "cart_events", "Share of left carts outside the usual range", "(SELECT count(DISTINCT cart_id) FILTER (event_type = 'cart_abandoned')::DOUBLE / count(DISTINCT cart_id) FILTER (event_type = 'add_to_cart') FROM d_carts)", "m < 0.2 OR m > 0.85"),
    "DQ44": _measure("DQ44", "customers", "Mean age outside the usual range", _mean_age, "m < 25 OR m > 50"),
    "DQ45": _measure("DQ45", "products", "Median price outside the usual range", "(SELECT median(base_price::DOUBLE) FROM d_products)", "m < 1000 OR m > 80000"),
    "DQ46": _measure("DQ46", "views", "Views per day vary strongly", _cv, "m > 2"),
}
NAMES = {
    1: "empty_table", 2: "customers_required", 3: "customer_id_duplicated", 4: "customer_id_below_one", 5: "age_range", 6: "gender_domain", 7: "email_format",
    8: "products_required", 9: "sku_duplicated", 10: "category_domain", 11: "price_not_positive", 12: "price_too_high", 13: "subcategory_of_category",
    14: "offers_required", 15: "inventory_negative", 16: "offer_price_not_positive", 17: "offer_duplicated", 18: "views_required", 19: "request_id_duplicated",
    20: "timestamp_unparsable", 21: "instock_not_boolean", 22: "instock_without_price", 23: "sales_required", 24: "order_id_duplicated",
    25: "quantity_not_positive", 26: "quantity_too_high", 27: "unit_price_not_positive", 28: "status_domain", 29: "inventory_events_required",
    30: "inventory_event_domain", 31: "negative_inflow", 32: "positive_outflow", 33: "cart_events_required", 34: "cart_event_domain",
    35: "unknown_customer", 36: "unknown_sku", 37: "unknown_offer", 38: "sold_out_of_stock", 39: "price_never_seen", 40: "negative_balance",
    41: "sales_depletion_mismatch", 42: "conversion_rate", 43: "abandonment_rate", 44: "mean_age", 45: "median_price", 46: "daily_variation",
}
DROPPED = {"DQ02": "city", "DQ08": "product_id", "DQ14": "offer_price", "DQ18": "sku", "DQ23": "unit_price", "DQ29": "quantity", "DQ33": "sku"}
EMPTY_SQL = " UNION ALL ".join(
    f"SELECT 'DQ01' AS rule_id, '{t}' AS table_name, 'Table is empty' AS issue, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS violations, CAST(NULL AS VARCHAR) AS example FROM {x}"
    for t, x in CTE.items())


def _register(number: int) -> None:
    rule_id = f"DQ{number:02d}"
    if rule_id in MEASURE_SQL:
        sql, keep = MEASURE_SQL[rule_id], ["rule_id", "table_name", "issue", "violations", "measure"]
    else:
        keep = ["rule_id", "table_name", "issue", "violations", "example"]
        if rule_id == "DQ01":
            sql = EMPTY_SQL
        elif rule_id in Q.REQUIRED:
            sql = _required_sql(rule_id)
        elif rule_id in Q.DUPLICATES:
            sql = _duplicate_sql(rule_id)
        else:
            sql = CROSS_SQL.get(rule_id) or _row_sql(rule_id)

    @query(f"dq{number:02d}_{NAMES[number]}", sql, EXTRA)
    def run(m):
        tables = damaged.tables(m, Q.tables_of(rule_id))
        if rule_id in DROPPED:
            table = Q.REQUIRED[rule_id][0]
            tables[table] = tables[table].drop(DROPPED[rule_id])
        return Q.rules(tables, [rule_id]).withColumn("measure", F.round("measure", 9)).select(*keep)


for _number in NAMES:
    _register(_number)


@query("dq39_price_never_seen_all", f"SELECT k AS order_id FROM ({_unseen.format(sales='d_sales')})", EXTRA)
def dq39_all(m):
    return Q.price_mismatches(damaged.tables(m, ["sales", "views"])).select("order_id")


ALL_RULES = " UNION ALL ".join(
    f"SELECT rule_id, table_name, issue, violations FROM ({sql})"
    for sql in [EMPTY_SQL, *[_duplicate_sql(r) for r in Q.DUPLICATES], *[_row_sql(r) for r in ROW_SQL], *CROSS_SQL.values(), *MEASURE_SQL.values()])
ISSUES = f"""SELECT rule_id, CASE WHEN rule_id < 'DQ35' THEN table_name || '.csv: ' || issue ELSE issue END AS issue_text,
    table_name, issue FROM ({ALL_RULES}) WHERE violations > 0"""
SCORES = """SELECT greatest(0, 1 - count(*) FILTER (lower(issue_text) LIKE '%reference%') / 100.0::DOUBLE) AS referential_integrity,
    greatest(0, 1 - count(*) FILTER (lower(issue_text) LIKE '%price%' OR lower(issue_text) LIKE '%stock%' OR lower(issue_text) LIKE '%inventory%') / 10.0::DOUBLE) AS business_logic_compliance,
    greatest(0, 1 - count(*) / 50.0::DOUBLE) AS overall_quality_score, count(*) AS total_issues FROM found"""
FOUND = {**EXTRA, "found": ISSUES}


def run_tables(m):
    """All tables; those that the full run reads twice, and the ledger, are written first."""
    tables = damaged.tables(m)
    return {name: stored(df, name) if name in ("views", "sales", "inventory_events") else df for name, df in tables.items()}


@query("ag19_quality_scores", SCORES, FOUND)
def ag19(m):
    return validation.quality_scores(run_tables(m))


@query("tk02_first_issues", """SELECT rule_id, issue_text, greatest(0, (SELECT count(*) FROM found) - 20) AS more
    FROM (SELECT * FROM found ORDER BY rule_id, table_name, issue LIMIT 20)""", FOUND)
def tk02(m):
    return Q.first_issues(Q.issues(validation.rules(run_tables(m))))


COLUMNS = {
    "d_customers": ["customer_id", "name", "email", "city", "age", "gender"], "d_products": ["sku", "product_id", "category", "subcategory", "base_price"],
    "d_offers": ["merchant_id", "sku", "inventory", "offer_price", "listing_date"], "d_views": ["http_request_id", "timestamp", "sku", "instock", "price_viewed", "customer_id"],
    "d_sales": ["order_id", "customer_id", "merchant_id", "sku", "quantity", "unit_price", "order_timestamp", "fulfilment_status"],
    "d_ledger": ["timestamp", "merchant_id", "sku", "event_type", "quantity", "reason", "order_id", "line_no", "unit_price", "new_balance"],
    "d_carts": ["cart_id", "customer_id", "sku", "quantity", "price", "timestamp", "event_type", "event_id"],
}
CELLS = " UNION ALL ".join(
    "SELECT count(*) * {n} AS cells, {nulls} AS nulls FROM {t}".format(n=len(cols), t=t, nulls=" + ".join(f'count(*) - count("{x}")' for x in cols))
    for t, cols in COLUMNS.items())


@query("dq47_validation_run", f"""
    SELECT unnest(['total_issues', 'is_valid', 'data_completeness', 'referential_integrity', 'business_logic_compliance', 'overall_quality_score',
                   'customer_purchase_rate', 'overall_conversion_rate']) AS item,
           unnest([total_issues::DOUBLE, (total_issues = 0)::INT::DOUBLE, (SELECT 1 - sum(nulls)::DOUBLE / sum(cells)::DOUBLE FROM ({CELLS})), referential_integrity,
                   business_logic_compliance, overall_quality_score,
                   (SELECT count(DISTINCT customer_id) FROM d_sales)::DOUBLE / (SELECT count(*) FROM d_customers),
                   (SELECT count(*) FROM d_sales)::DOUBLE / (SELECT count(*) FROM d_views)]) AS value
    FROM ({SCORES})""", FOUND)
def dq47(m):
    return validation.validation_run(run_tables(m))


TABLE_LINES = " UNION ALL ".join(
    "SELECT 10 AS section, printf('  {name}: %d rows, %d columns, %d null values', count(*), {n}, {nulls}) AS line FROM {t}".format(
        name=name, n=len(COLUMNS[t]), nulls=" + ".join(f'count(*) - count("{x}")' for x in COLUMNS[t]), t=t)
    for name, t in CTE.items())


@query("dq48_report", f"""
    SELECT 0 AS section, CASE WHEN total_issues = 0 THEN 'Overall Status: PASSED' ELSE 'Overall Status: FAILED' END AS line FROM ({SCORES})
    UNION ALL SELECT 1, 'Total Issues Found: ' || total_issues FROM ({SCORES})
    UNION ALL SELECT 2, printf('  referential_integrity: %.1f%%', 100 * referential_integrity) FROM ({SCORES})
    UNION ALL SELECT 3, printf('  business_logic_compliance: %.1f%%', 100 * business_logic_compliance) FROM ({SCORES})
    UNION ALL SELECT 4, printf('  overall_quality_score: %.1f%%', 100 * overall_quality_score) FROM ({SCORES})
    UNION ALL {TABLE_LINES}
    UNION ALL SELECT 20, rule_id || ' ' || issue_text FROM (SELECT * FROM found ORDER BY rule_id, table_name, issue LIMIT 20)
    UNION ALL SELECT 30, printf('  ... and %d more issues', n - 20) FROM (SELECT count(*) AS n FROM found) WHERE n > 20""", FOUND)
def dq48(m):
    return validation.report_lines(run_tables(m))
