"""Projections, filters, joins, set operations and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper import dims
from stallkeeper.functions.calendar import chunk_of
from stallkeeper.functions.hashing import choice, gate, u
from stallkeeper import values as V


def stock_status(stock: Column, reserved: Column, requested: Column) -> dict[str, Column]:
    """Available quantity net of reservations, fulfilment flag and status; the order of the tests matters."""
    available = F.greatest(F.lit(0), stock - reserved)
    status = (
        F.when(stock == 0, "out_of_stock")
        .when(available < requested, "insufficient_stock")
        .when(stock < 10, "low_stock")
        .otherwise("in_stock")
    )
    return {"available_qty": available, "can_fulfill": available >= requested, "stock_status": status}


def instock_reason(instock: Column, draw: Column) -> Column:
    return F.when(instock, F.lit("Instock")).otherwise(choice(dims.flat_reasons(), draw))


def point_lookup(requests: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """At most one value per request (the smallest if the key repeats); NULL when unknown."""
    return requests.join(table.groupBy(key).agg(F.min(value).alias(value)), key, "left")


def left_join(df: DataFrame, other: DataFrame, on: list[str], spread: int = 1024) -> DataFrame:
    """Left join whose rows with a NULL key, which match nothing, are dealt over `spread` groups instead of one task.

    Rows with keys join as usual (a hot key is split by adaptive execution); columns and rows are those of a plain left join.
    """
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    spot = F.when(missing, F.pmod(F.monotonically_increasing_id(), F.lit(spread)) + 1).otherwise(F.lit(0).cast("long"))
    # Always 0, but no constant: the optimizer would take a constant out of the keys, and with it the spread.
    zero = F.least(F.lit(0), F.abs(F.hash(*on) % 2)).cast("long")
    return df.withColumn("_spot", spot).join(other.withColumn("_spot", zero), [*on, "_spot"], "left").drop("_spot")


def lookup_default(df: DataFrame, dim: DataFrame, on: list[str], value: str, default) -> DataFrame:
    joined = left_join(df, dim, on)
    return joined.withColumn(value, F.coalesce(F.col(value), default if isinstance(default, Column) else F.lit(default)))


def num_offers(df: DataFrame, offers: DataFrame) -> DataFrame:
    """Attach the number of offers of the sku, 0 when there is none. Offers are counted, never collected."""
    counts = offers.groupBy("sku").agg(F.count("*").alias("num_offers"))
    return df.join(counts, "sku", "left").fillna({"num_offers": 0})


def orphan_keys(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-null child keys without a parent."""
    return child.select(*keys).dropna().distinct().join(parent.select(*keys), keys, "left_anti")


def reconcile(sales: DataFrame, movements: DataFrame, tolerance: int = 1) -> DataFrame:
    """Pairs whose sold and depleted quantities differ by more than the tolerance; a missing side counts as 0."""
    pair = ["merchant_id", "sku"]
    sold = sales.groupBy(*pair).agg(F.sum("quantity").alias("sold"))
    gone = movements.filter("event_type = 'sale'").groupBy(*pair).agg(F.abs(F.sum("quantity")).alias("depleted"))
    both = sold.join(gone, pair, "full_outer").fillna({"sold": 0, "depleted": 0})
    return both.filter(F.abs(F.col("sold") - F.col("depleted")) > tolerance)


def views_near_sales(sales: DataFrame, views: DataFrame, seconds: int = 3600) -> DataFrame:
    """Per sale: is there a view of the same customer and sku less than `seconds` away, and an out-of-stock one?

    No sale-view pairs are formed. Views shrink to first and last time per (customer, sku, bucket) with a bucket as wide
    as the limit. Any view in the sale's own bucket is near; in the bucket before only its last view can be nearest, in
    the bucket after only its first.
    """
    keys = ["customer_id", "sku", "_bucket"]
    out_ts = F.when(~F.col("instock"), F.col("timestamp"))
    spans = (
        views.filter("customer_id IS NOT NULL")
        .withColumn("_bucket", chunk_of("timestamp", seconds))
        .groupBy(*keys)
        .agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.min(out_ts).alias("out_lo"), F.max(out_ts).alias("out_hi"))
    )
    shifted = spans.withColumn("_shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    side = lambda shift, name: F.max(F.when(F.col("_shift") == shift, F.col(name)))
    around = (
        shifted.withColumn("_bucket", F.col("_bucket") + F.col("_shift"))
        .groupBy(*keys)
        .agg(*[side(s, c).alias(f"{c}_{tag}") for s, tag in ((1, "before"), (0, "here"), (-1, "after")) for c in ("lo", "hi", "out_lo", "out_hi")])
    )
    limit = F.expr(f"interval {seconds} seconds")
    t = F.col("order_timestamp")

    def near(prefix: str) -> Column:
        before = t - F.col(f"{prefix}hi_before") < limit
        after = F.col(f"{prefix}lo_after") - t < limit
        return F.col(f"{prefix}hi_here").isNotNull() | F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    joined = sales.withColumn("_bucket", chunk_of("order_timestamp", seconds)).join(around, keys, "left")
    return joined.select(*sales.columns, near("").alias("has_view"), near("out_").alias("has_out_of_stock_view"))


def price_in_history(sales: DataFrame, views: DataFrame) -> DataFrame:
    """Per sale: did the customer see a price for the sku, and was it the price paid? Seen prices are deduplicated first."""
    seen = views.select("customer_id", "sku", F.col("price_viewed").alias("unit_price")).dropna().distinct()
    priced = seen.select("customer_id", "sku").distinct().withColumn("has_price", F.lit(True))
    flagged = sales.join(priced, ["customer_id", "sku"], "left").join(
        seen.withColumn("price_seen", F.lit(True)), ["customer_id", "sku", "unit_price"], "left"
    )
    return flagged.fillna({"has_price": False, "price_seen": False})


def sku_stock(stock: DataFrame) -> DataFrame:
    return stock.groupBy("sku").agg(F.sum("stock").alias("total_stock"))


def sku_availability(requests: DataFrame, stock: DataFrame, products: DataFrame, key: str = "http_request_id") -> DataFrame:
    """(instock, reason) per request: carried by a merchant, any stock left, then the category's out-of-stock gate."""
    rates = dims.oos_rates(requests.sparkSession)
    joined = requests.join(products.select("sku", "category"), "sku", "left").join(sku_stock(stock), "sku", "left").join(rates, "category", "left")
    rate = F.coalesce(F.col("oos_rate"), F.lit(V.OOS_RATE_DEFAULT))
    blocked = (F.col("total_stock") <= 0) | gate(rate, u("oos", key))
    available = F.col("total_stock").isNotNull() & ~F.coalesce(blocked, F.lit(False))
    reason = F.when(F.col("total_stock").isNull(), F.lit(V.NO_MERCHANT)).otherwise(instock_reason(available, u("oos_reason", key)))
    return joined.withColumn("available", available).withColumn("stock_reason", reason).select(*requests.columns, "available", "stock_reason")


def except_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.select(column).distinct().filter(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    present = dims.values(df.sparkSession, "column_name", [(c,) for c in df.columns])
    return dims.values(df.sparkSession, "column_name", [(c,) for c in required]).join(present, "column_name", "left_anti")


def subset_test(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(F.col(column).isin(allowed)), F.lit(True)).alias("all_allowed"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of repeats after the first."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("repeats")).filter("repeats > 0")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """First n rows: each task keeps n, the driver merges n rows per task."""
    return df.orderBy(*order).limit(n)


def keep_last(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sample_per_key(df: DataFrame, keys: list[str], item: str, k: int, stream: str) -> DataFrame:
    """k distinct items per key, uniform: the k smallest hash draws. The rank limit is applied before the shuffle too."""
    drawn = df.select(*keys, item).distinct().withColumn("draw", u(stream, *keys, item))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("draw", item))
    return drawn.withColumn("pick", rank).filter(F.col("pick") <= k).drop("draw")


def first_violation(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """Smallest violating key per rule in one pass."""
    found = df.agg(*[F.min(F.when(bad, F.col(key))).alias(name) for name, bad in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").cast("string").alias("example")) for n in rules]
    return found.select(F.inline(F.array(*pairs)))


def low_stock_alerts(stock: DataFrame, column: str, threshold: int = 10) -> DataFrame:
    level = F.when(F.col(column) == 0, "critical").otherwise("warning")
    return stock.filter(F.col(column) <= threshold).withColumn("alert_level", level)
