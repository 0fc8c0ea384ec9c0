"""Inventory operators."""

from pyspark.sql import functions as F

from stallkeeper.operators import aggregates as A, builders as B, inventory as I, relational as R
from stallkeeper.plans import duck as D
from stallkeeper.plans.aggregates import VELOCITY
from stallkeeper.plans.base import query
from stallkeeper.plans.ordering import SALE_ORDER
from stallkeeper.session import scratch, stored, stored_tight

c = F.col
DAY = "2001-12-31"
REQUEST_ORDER = ["order_timestamp", "order_id", "line_no", "merchant", "unit_price"]


def greedy_sql(requests: str, offers: str, order: list[str], columns: list[str]) -> str:
    """Allocation as a recursive CTE named allocated: one step per position in the sku, a list of balances as state."""
    wanted = ", ".join(columns)
    pick = "list_position(list_transform(s.left_, lambda b: b >= r.quantity), true)"
    return f"""WITH ranked AS (SELECT sku, {wanted}, row_number() OVER (PARTITION BY sku ORDER BY {', '.join(order)}) AS n FROM {requests}),
    held AS (SELECT sku, list(merchant_id ORDER BY merchant_id) AS names, list(CAST(stock AS BIGINT) ORDER BY merchant_id) AS left_ FROM {offers} GROUP BY sku),
    steps AS (
        SELECT sku, CAST(0 AS BIGINT) AS n, left_, CAST(NULL AS BIGINT) AS pick FROM held
        UNION ALL
        SELECT sku, n, CASE WHEN pick > 0 THEN list_transform(left_, lambda b, i: CASE WHEN i = pick THEN b - quantity ELSE b END) ELSE left_ END, pick
        FROM (SELECT s.sku, r.n, s.left_, r.quantity, coalesce({pick}, 0) AS pick FROM steps s JOIN ranked r ON s.sku = r.sku AND r.n = s.n + 1)),
    allocated AS (SELECT r.*, h.names[nullif(t.pick, 0)] AS merchant_id FROM ranked r LEFT JOIN steps t ON r.sku = t.sku AND r.n = t.n LEFT JOIN held h ON r.sku = h.sku)"""


REQUESTS = {"requests": "SELECT order_id, line_no, merchant_id AS merchant, sku, quantity, CAST(unit_price AS DOUBLE) AS unit_price, order_timestamp FROM line_sales",
            "shop": "SELECT merchant_id, sku, inventory AS stock FROM offers"}


def requests(m):
    return m.line_sales().select("order_id", "line_no", c("merchant_id").alias("merchant"), "sku", "quantity", c("unit_price").cast("double").alias("unit_price"), "order_timestamp")


def shop(m):
    return m.offers().select("merchant_id", "sku", c("inventory").alias("stock"))


STATUS = """CASE WHEN stock = 0 THEN 'out_of_stock' WHEN greatest(0, stock - reserved) < requested_qty THEN 'insufficient_stock'
    WHEN stock < 10 THEN 'low_stock' ELSE 'in_stock' END"""


@query("iv01_stock_check_batch", f"""
    SELECT order_id, merchant_id, sku, requested_qty, greatest(0, stock - reserved) AS available_qty, greatest(0, stock - reserved) >= requested_qty AS can_fulfill, {STATUS} AS stock_status
    FROM (SELECT l.order_id, l.merchant_id, l.sku, l.quantity AS requested_qty, coalesce(s.stock, 0) AS stock, coalesce(r.q, 0) AS reserved FROM line_sales l
          LEFT JOIN stock s ON l.merchant_id = s.merchant_id AND l.sku = s.sku
          LEFT JOIN (SELECT merchant_id, sku, sum(quantity) AS q FROM event_sales GROUP BY 1, 2) r ON l.merchant_id = r.merchant_id AND l.sku = r.sku)""")
def iv01(m):
    asked = m.line_sales().select("order_id", "merchant_id", "sku", c("quantity").alias("requested_qty"))
    held = m.event_sales().groupBy("merchant_id", "sku").agg(F.sum("quantity").alias("reserved"))
    return I.stock_checks(asked, m.stock(), held)


@query("iv02_greedy_allocate", f"""
    {greedy_sql('requests', 'shop', REQUEST_ORDER, ['order_id', 'line_no', 'merchant', 'quantity', 'unit_price', 'order_timestamp'])}
    SELECT order_id, line_no, merchant, sku, quantity, unit_price, merchant_id FROM allocated""", REQUESTS, recursive=True)
def iv02(m):
    return I.greedy_allocate(stored_tight(requests(m), "requests"), shop(m), REQUEST_ORDER, 30 * 86400).drop("order_timestamp")


@query("iv03_fifo_allocate", f"""
    SELECT order_id, line_no, merchant, sku, quantity, unit_price, demand, CAST(greatest(0, least(quantity, coalesce(total, 0) - (demand - quantity))) AS BIGINT) AS units,
           demand <= coalesce(total, 0) AS filled
    FROM (SELECT *, CAST(sum(quantity) OVER (PARTITION BY sku ORDER BY {', '.join(REQUEST_ORDER)}, quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS demand FROM requests)
    LEFT JOIN (SELECT sku, sum(stock) AS total FROM shop GROUP BY 1) USING (sku)""", REQUESTS)
def iv03(m):
    return I.fifo_allocate(requests(m), shop(m), [*REQUEST_ORDER, "quantity"], 30 * 86400).drop("order_timestamp")


@query("iv04_reservation_view", """
    SELECT s.merchant_id, s.sku, stock AS current_inventory, coalesce(q, 0) AS reserved_inventory, greatest(0, stock - coalesce(q, 0)) AS available_inventory,
           CASE WHEN greatest(0, stock - coalesce(q, 0)) > 0 THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status
    FROM stock s LEFT JOIN (SELECT merchant_id, sku, CAST(sum(quantity) AS BIGINT) AS q FROM event_sales GROUP BY 1, 2) r ON s.merchant_id = r.merchant_id AND s.sku = r.sku""")
def iv04(m):
    return I.reservation_view(m.stock(), m.event_sales())


def _draw(stream: str) -> str:
    return D.u(stream, "merchant_id", "sku", f"'{DAY}'")


PLAN = {
    "velocities": VELOCITY.format(sales="line_sales"),
    "plan": f"""
    SELECT merchant_id, sku, greatest(10, CAST(trunc(greatest(1.0::DOUBLE, v * 7) * {D.uniform(0.3, 2.0, _draw('restock_quantity'))}) AS INTEGER)) AS quantity,
           DATE '{DAY}' + CAST({D.randint(1, 7, _draw('restock_delay'))} AS INTEGER) AS delivery_date
    FROM (SELECT s.merchant_id, s.sku, s.stock, coalesce(v.velocity, 0.0::DOUBLE) AS v FROM stock s LEFT JOIN velocities v ON s.merchant_id = v.merchant_id AND s.sku = v.sku)
    WHERE stock <= 50 AND {_draw('restock_gate')} < 0.15::DOUBLE * least(2.0::DOUBLE, v * 10) * greatest(0.1::DOUBLE, (50 - stock) / 50.0::DOUBLE)
          * {D.uniform(0.7, 0.98, D.u('reliability', 'merchant_id'))}""",
}


def plan(m):
    return I.plan_restocks(m.stock(), A.sales_velocity(m.line_sales()), B.merchants(m.offers()), DAY)


@query("iv05_plan_restocks", f"SELECT merchant_id, sku, quantity, '{DAY}' AS ordered_date, CAST(delivery_date AS VARCHAR) AS delivery_date FROM plan", PLAN)
def iv05(m):
    return plan(m)


@query("iv06_deliver_due", """
    SELECT 'delivered' AS state, p.merchant_id, p.sku, p.quantity, p.quantity + s.stock AS new_balance FROM plan p JOIN stock s ON p.merchant_id = s.merchant_id AND p.sku = s.sku
    WHERE delivery_date <= DATE '2002-01-03'
    UNION ALL SELECT 'pending', merchant_id, sku, quantity, NULL FROM plan WHERE delivery_date > DATE '2002-01-03'""", PLAN)
def iv06(m):
    events, waiting = I.deliver_due(plan(m), m.stock(), F.lit("2002-01-03").cast("date"))
    done = events.select(F.lit("delivered").alias("state"), "merchant_id", "sku", "quantity", "new_balance")
    rest = waiting.select(F.lit("pending").alias("state"), "merchant_id", "sku", "quantity", F.lit(None).cast("long").alias("new_balance"))
    return done.unionByName(rest)


REASONS = D.choice(["Water damage", "Handling damage", "Expiry", "Quality issue", "Theft"], _draw("damage_reason"))


@query("iv07_damage_events", f"""
    SELECT '{DAY} 00:00:00' AS "timestamp", merchant_id, sku, 'damage' AS event_type, {REASONS} AS reason,
           -least(stock, greatest(1, CAST(trunc(stock * {D.uniform(0.01, 0.10, _draw('damage_quantity'))}) AS BIGINT))) AS quantity
    FROM stock WHERE stock > 0 AND {_draw('damage_gate')} < 0.002""")
def iv07(m):
    return I.damage_events(m.stock(), DAY)


@query("iv08_event_ledger", 'SELECT merchant_id, sku, event_type, quantity, reason, order_id, line_no, new_balance FROM ledger')
def iv08(m):
    rows = stored(m.movements(), "movements")  # read once by kind, and twice by running totals
    kinds = [rows.filter(c("event_type") == k) for k in ("initial_stock", "sale", "restock", "damage")]
    return I.event_ledger(*kinds).select("merchant_id", "sku", "event_type", "quantity", "reason", "order_id", "line_no", "new_balance")


@query("iv09_stock_check_log", f"""
    SELECT order_id, line_no, merchant_id, sku, quantity, coalesce(stock, 0) >= quantity AS can_fulfill
    FROM (SELECT l.*, s.stock FROM line_sales l LEFT JOIN stock s ON l.merchant_id = s.merchant_id AND l.sku = s.sku)""")
def iv09(m):
    """Checks appended to a log table by year half; the whole log."""
    checks = I.stock_checks(m.line_sales().withColumn("requested_qty", c("quantity")), m.stock()).select(*SALE_ORDER, "can_fulfill")
    path = scratch(m.spark, "stock_checks")
    for early in (True, False):
        checks.filter((F.month("order_timestamp") <= 6) == early).write.mode("append").parquet(path)
    log = m.spark.read.schema(checks.schema).parquet(path)
    return log.select("order_id", "line_no", "merchant_id", "sku", "quantity", "can_fulfill")
