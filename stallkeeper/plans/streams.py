"""Streams drained over the whole event and line tables, compared with batch oracles."""

from pyspark import StorageLevel
from pyspark.sql import functions as F

from stallkeeper import schemas
from stallkeeper.operators import access
from stallkeeper.plans.base import query
from stallkeeper.plans.functions import CLASS
from stallkeeper.plans.joins import LENIENT, VERDICT
from stallkeeper.session import scratch, stored_tight, write_tight
from stallkeeper.streaming import messages as M, run, state

c = F.col
#: Batches of an arriving table, files of a batch, the longest time in days from event to arrival, and the delay that covers it.
STRETCHES, FILES, LATEST, WIDEST = 4, 2, 3, "4 days"


def stream(m, name):
    return run.read_files(m.spark, m.folder, schemas.TABLES[name], f"{name}.parquet")


def message_stream(m):
    return m.messages(stream(m, "events"))


@query("src04_message_source", "SELECT message_id, topic FROM messages WHERE username IS NOT NULL")
def src04(m):
    return run.drain(M.subscribe(message_stream(m)).select("message_id", "topic"), "received")


@query("src04_tenant_filter", "SELECT message_id, topic FROM messages WHERE regexp_matches(topic, '^(iot/tenant_00[12]/[^/]*/[^/]*|admin/tenant_00[12]/[^/]*)$')")
def src04_tenant(m):
    filters = ["iot/tenant_001/+/+", "iot/tenant_002/+/+", "admin/tenant_001/+", "admin/tenant_002/+"]
    return run.drain(M.subscribe(message_stream(m), filters).select("message_id", "topic"), "tenants")


@query("snk03_message_sink", 'SELECT message_id, CAST("timestamp" AS VARCHAR) AS "timestamp", topic, payload, qos FROM messages')
def snk03(m):
    return run.drain(message_stream(m).select("message_id", "timestamp", "topic", "payload", "qos"), "kept")


@query("st01_classify_stream", f"SELECT message_id, {CLASS} AS delivery_class FROM messages")
def st01(m):
    return run.drain(M.classified(message_stream(m)).select("message_id", "delivery_class"), "classified")


def arriving(m, rows, name):
    """A table as a stream of STRETCHES batches of several files: rows arrive up to LATEST days after their timestamp, so
    order of arrival and order of events differ. Stretches are cut at quantiles of the arrival, one pass each way.
    """
    late = F.make_dt_interval(F.abs(F.xxhash64(*rows.columns)) % LATEST)
    arrived = stored_tight(rows.withColumn("arrival", c("timestamp") + late), f"{name}-rows")
    clock = F.unix_micros(c("arrival").cast("timestamp"))
    cuts = arrived.agg(F.percentile_approx(clock, [k / STRETCHES for k in range(1, STRETCHES)])).first()[0] or []
    path, stretch = scratch(m.spark, name), sum((clock > cut).cast("int") for cut in cuts) if cuts else F.lit(0)
    for k in range(len(cuts) + 1):
        part = arrived.filter(stretch == k).drop("arrival")
        write_tight(part.repartition(FILES, *part.columns), path, "append")
    return run.read_files(m.spark, path, rows.schema, "*.parquet", files_per_batch=FILES)


def events_as_messages(m):
    return arriving(m, m.table("events").select(c("event_id").alias("message_id"), c("ts").alias("timestamp")), "messages-in")


@query("st02_periodic_counts", "SELECT CAST(time_bucket(INTERVAL 30 SECOND, ts) AS VARCHAR) AS window_start, count(*) AS n FROM events GROUP BY 1")
def st02(m):
    return run.drain_closed(events_as_messages(m), "timestamp", lambda s: M.periodic_counts(s, delay=WIDEST), "counts")


@query("st03_topic_acl_stream", VERDICT.format(bypass="", grant=LENIENT))
def st03(m):
    users, rules = m.users(), access.all_rules(m.users(), m.devices(), m.user_acls(), m.device_acls())
    decide = lambda batch: access.decide(batch, users, rules).select("message_id", "verdict")
    return run.drain_batches(message_stream(m), decide, "verdicts", "message_id bigint, verdict string")


@query("st04_dedup_redelivery", "SELECT event_id AS message_id, event_type FROM events")
def st04(m):
    """Every message arrives twice."""
    once = stream(m, "events").select(c("event_id").alias("message_id"), c("ts").alias("timestamp"), "event_type")
    again = stream(m, "events").select(c("event_id").alias("message_id"), c("ts").alias("timestamp"), "event_type")
    return run.drain(M.without_repeats(once.unionByName(again)).select("message_id", "event_type"), "deduplicated")


@query("st05_session_stream", """
    SELECT customer_id, CAST(min("timestamp") AS VARCHAR) AS start_time, CAST(max("timestamp") AS VARCHAR) AS end_time, count(*) AS pages_viewed
    FROM sessions_raw GROUP BY customer_id, session_no""")
def st05(m):
    views = arriving(m, m.table("events").filter("event_id % 5 <> 0").select(c("user_id").alias("customer_id"), c("ts").alias("timestamp")), "sessions-in")
    return run.drain_closed(views, "timestamp", lambda s: M.sessions(s, delay=WIDEST), "sessions")


ST06 = """WITH sold AS (SELECT m.merchant_id, m.sku, order_id, line_no, m.quantity, row_number() OVER (PARTITION BY m.merchant_id, m.sku
        ORDER BY "timestamp", order_id, line_no, unit_price, m.quantity) AS n FROM movements m WHERE event_type <> 'initial_stock'),
    steps AS (
        SELECT merchant_id, sku, CAST(0 AS BIGINT) AS n, CAST(inventory AS BIGINT) AS balance, false AS accepted FROM offers
        UNION ALL
        SELECT s.merchant_id, s.sku, r.n, CASE WHEN s.balance + r.quantity >= 0 THEN s.balance + r.quantity ELSE s.balance END, s.balance + r.quantity >= 0
        FROM steps s JOIN sold r ON s.merchant_id = r.merchant_id AND s.sku = r.sku AND r.n = s.n + 1)
    SELECT s.merchant_id, s.sku, order_id, line_no, quantity, accepted, balance,
           CASE WHEN balance = 0 THEN 'critical' WHEN balance <= 10 THEN 'warning' END AS alert_level
    FROM steps s JOIN sold r ON s.merchant_id = r.merchant_id AND s.sku = r.sku AND s.n = r.n"""


@query("st06_live_balance", ST06, recursive=True)
def st06(m):
    opening = stored_tight(m.offers().select("merchant_id", "sku", c("inventory").alias("initial")), "opening")
    moves = arriving(m, m.sold_movements().drop("event_type", "reason"), "movements-in")
    groups = state.groups_for(opening.count())
    pairs = state.by_group(opening, groups).persist(StorageLevel.DISK_ONLY)  # every batch reads them; dealt once
    pairs.count()
    step = lambda s: state.live_balance(run.event_time(s, "timestamp", WIDEST), groups, pairs)
    try:
        return run.drain_closed(moves, "timestamp", step, "balances", on_disk=True)
    finally:
        pairs.unpersist()


@query("st07_reservation_timeout", """
    WITH steps AS (SELECT cart_id, "timestamp" AS "at", event_type, lag(event_type) OVER w AS before_type, lag("timestamp") OVER w AS before_at,
            lead("timestamp") OVER w AS after_at
        FROM cart_events WHERE event_type <> 'removed_from_cart' WINDOW w AS (PARTITION BY cart_id ORDER BY "timestamp", event_id)),
    changes AS (
        SELECT cart_id, 'active' AS status, "at" FROM steps WHERE event_type = 'add_to_cart'
        UNION ALL
        SELECT cart_id, CASE event_type WHEN 'cart_abandoned' THEN 'abandoned' ELSE 'converted' END, "at" FROM steps
        WHERE event_type <> 'add_to_cart' AND before_type = 'add_to_cart' AND "at" < before_at + INTERVAL 1 HOUR
        UNION ALL
        SELECT cart_id, 'expired', "at" + INTERVAL 1 HOUR FROM steps
        WHERE event_type = 'add_to_cart' AND (after_at IS NULL OR after_at >= "at" + INTERVAL 1 HOUR))
    SELECT cart_id, status, CAST("at" AS VARCHAR) AS "at" FROM changes""")
def st07(m):
    carts = arriving(m, m.cart_events().select("cart_id", "event_id", "event_type", "timestamp"), "carts-in")
    return run.drain_closed(carts, "timestamp", lambda s: state.cart_status(run.event_time(s, "timestamp", WIDEST)), "carts")


@query("st08_sliding_counts", """
    SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS VARCHAR) AS window_start, count(*) AS n
    FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1""")
def st08(m):
    return run.drain_closed(events_as_messages(m), "timestamp", lambda s: M.sliding_counts(s, delay=WIDEST), "sliding")
