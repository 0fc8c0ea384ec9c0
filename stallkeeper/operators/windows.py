"""Ordered operators that stay parallel when one key holds a large share of the rows.

A plain window puts all rows of a key into one task. Here the rows of a key are cut into chunks that follow the order
(a stretch of time, by default a day): running values are computed inside each (key, chunk), and the totals of earlier
chunks, pre-aggregated before their own shuffle, are added by an equi-join. The results are exact. Chunks come from the
data alone, so a retried task sees the same rows. Chunks are joined on a struct of key and chunk, which is never NULL: NULL
is a key like any other, and windows and joins share one shuffle. The input is read twice: store a costly one first
(session.stored).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper.functions.calendar import chunk_of
from stallkeeper.session import stored

DAY = 86400


def running(
    df: DataFrame, keys: list[str], chunk: Column, order: list[str], sums: dict[str, Column], include_current: bool = True
) -> DataFrame:
    """Add running sums of `sums` by key in (chunk, order); chunk must not decrease along the order.

    With include_current=False a row sees only rows before it; the first row of a key gets 0.
    """
    rows = df.withColumns({"_at": F.struct(*keys, chunk.alias("_chunk")), **{f"_v_{n}": e for n, e in sums.items()}})
    totals = rows.groupBy("_at").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = W.partitionBy(*[F.col("_at")[k] for k in keys]).orderBy("_at._chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_at", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = W.partitionBy("_at").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    local = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    joined = local.join(offsets, "_at", "left")
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def running_balance(movements: DataFrame, chunk_seconds: int = 7 * DAY) -> DataFrame:
    """Signed quantities accumulated to new_balance by (merchant, sku)."""
    order = ["timestamp", "order_id", "line_no", "unit_price", "quantity"]
    chunk = chunk_of("timestamp", chunk_seconds)
    return running(movements, ["merchant_id", "sku"], chunk, order, {"new_balance": F.col("quantity").cast("long")})


def latest_balance(ledger: DataFrame) -> DataFrame:
    """Last balance by (merchant, sku): max_by combines on the map side, so a hot pair moves one row per task."""
    last = F.struct("timestamp", "order_id", "line_no", "unit_price", F.negative("quantity").alias("q"))
    return ledger.groupBy("merchant_id", "sku").agg(F.max_by("new_balance", last).alias("balance"))


def purchase_history(sales: DataFrame, order: list[str], ts: str = "order_timestamp", chunk_seconds: int = DAY) -> DataFrame:
    """Purchases and mean unit price before each sale of the customer; the mean is NULL for the first."""
    sums = {"prior_purchases": F.lit(1).cast("long"), "prior_spend": F.col("unit_price")}
    done = running(sales, ["customer_id"], chunk_of(ts, chunk_seconds), order, sums, include_current=False)
    mean = F.when(F.col("prior_purchases") > 0, F.col("prior_spend").cast("double") / F.col("prior_purchases"))
    return done.withColumn("prior_avg_price", mean).drop("prior_spend")


def affinity_growth(sales: DataFrame, base: Column, order: list[str], ts: str = "order_timestamp") -> DataFrame:
    """Category affinity times 1.1 per earlier purchase of the customer in that category."""
    counted = running(
        sales, ["customer_id", "category"], chunk_of(ts, DAY), order, {"earlier": F.lit(1).cast("long")}, include_current=False
    )
    return counted.withColumn("affinity", base * F.pow(F.lit(1.1), F.col("earlier")))


def sequence_ids(df: DataFrame, name: str, order: list[str], first: int = 1, parts: int | None = None) -> DataFrame:
    """Contiguous ids in row order, in two passes: rows are dealt to `parts` ranges of the whole order, written with their
    place in the range, and numbered from the counts of the ranges before.

    Bounds come from a sample of the order columns, not from stretches of time, so a dense second is cut as finely as its rows
    differ in any of them; only rows equal in all must share a range. Ids of such rows are in no particular order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # In a written table the row's number is its range in the upper bits and its place there in the lower 33.
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(dealt, "ordered").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + first
    return placed.join(F.broadcast(before), "_range").select(*df.columns, number.alias(name))  # one row a range


def number_in_key(df: DataFrame, keys: list[str], name: str, order: str, slots: int = 64) -> DataFrame:
    """1-based position of each row in its key by (hash slot, order): an arbitrary but fixed order, split into slots."""
    slot = F.expr(f"pmod(CAST(conv(substring(md5(CAST({order} AS STRING)), 1, 4), 16, 10) AS BIGINT), {slots})")
    return running(df, keys, slot, [order], {name: F.lit(1).cast("long")})


def sessionize(
    events: DataFrame, key: str = "customer_id", ts: str = "timestamp", tie: str = "http_request_id",
    gap_seconds: int = 1800, chunk_seconds: int = DAY,
) -> DataFrame:
    """Add session_no (1-based per key). A gap shorter than gap_seconds continues a session; an equal gap starts one."""
    gap = F.expr(f"interval {gap_seconds} seconds")
    rows = events.withColumn("_at", F.struct(F.col(key).alias("key"), chunk_of(ts, chunk_seconds).alias("chunk")))
    ends = rows.groupBy("_at").agg(F.max(ts).alias("_end"))
    by_chunk = W.partitionBy("_at.key").orderBy("_at.chunk")
    before = ends.select("_at", F.lag("_end").over(by_chunk).alias("_before"))
    inside = W.partitionBy("_at").orderBy(ts, tie)
    previous = F.coalesce(F.lag(ts).over(inside), F.col("_before"))
    flagged = rows.join(before, "_at", "left").withColumn("_prev", previous)
    starts = F.when(F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") >= gap), 1).otherwise(0).cast("long")
    flagged = flagged.withColumn("_start", starts)
    totals = flagged.groupBy("_at").agg(F.sum("_start").alias("_n"))
    offsets = totals.select("_at", F.coalesce(F.sum("_n").over(by_chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = F.sum("_start").over(inside.rowsBetween(W.unboundedPreceding, 0))
    numbered = flagged.withColumn("_local", local).join(offsets, "_at", "left")
    return numbered.select(*events.columns, (F.col("_local") + F.col("_offset")).alias("session_no"))


def session_table(sessioned: DataFrame, products: DataFrame, key: str = "customer_id", ts: str = "timestamp") -> DataFrame:
    """One row per session: start, end, pages and number of distinct categories."""
    with_category = sessioned.join(products.select("sku", "category"), "sku", "left")
    return with_category.groupBy(key, "session_no").agg(
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.count("*").alias("pages_viewed"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories_browsed"),
    )


def normalized_price(df: DataFrame, price: str, sensitivity: Column) -> DataFrame:
    """price / mean(price) and the conversion curve 1 / ratio^sensitivity; the mean is a scalar subquery."""
    mean = df.agg((F.sum(price).cast("double") / F.count(price)).alias("m")).scalar()
    ratio = F.col(price).cast("double") / mean
    return df.withColumn("price_ratio", ratio).withColumn("conversion_curve", 1 / F.pow(F.col("price_ratio"), sensitivity))
