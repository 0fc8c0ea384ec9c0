"""Aggregations.

Means are exact decimal sums over counts, so a result does not depend on task order. Distinct counts group by the key
first, so a hot key is combined on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper import dims
from stallkeeper.functions.calendar import promo_multiplier, whole_days


def exact_mean(column: Column) -> Column:
    return F.try_divide(F.sum(column.cast("decimal(18,9)")).cast("double"), F.count(column).cast("double"))


def segment_summary(profiles: DataFrame) -> DataFrame:
    """Count and means per segment; all segments are listed, empty ones with zeros."""
    stats = profiles.groupBy("segment").agg(
        F.count("*").alias("customer_count"),
        exact_mean(F.col("price_sensitivity")).alias("avg_price_sensitivity"),
        exact_mean(F.col("cart_abandonment_rate")).alias("avg_cart_abandonment"),
        exact_mean(F.col("conversion_base")).alias("avg_conversion_base"),
    )
    return dims.segments(profiles.sparkSession).select("segment").join(stats, "segment", "left").fillna(0)


def segment_performance(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("segment").agg(
        F.count("customer_id").alias("customers"),
        exact_mean(F.col("conversion_base")).alias("mean_conversion_base"),
        exact_mean(F.col("cart_abandonment_rate")).alias("mean_cart_abandonment"),
    )


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def funnel(views: DataFrame, cart_events: DataFrame, sales: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Views, carts, sales and their rates, overall or by key. Each table is counted before they meet."""
    keys = keys or []

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("step", F.lit(name))

    steps = [counted(views, "views"), counted(cart_events.filter("event_type = 'add_to_cart'"), "carts"), counted(sales, "sales")]
    total = lambda name: F.coalesce(F.sum(F.when(F.col("step") == name, F.col("n"))), F.lit(0))
    wide = reduce(DataFrame.unionByName, steps).groupBy(*keys).agg(*[total(s).alias(s) for s in ("views", "carts", "sales")])
    return wide.withColumns({"view_to_cart": rate(F.col("carts"), F.col("views")), "cart_to_sale": rate(F.col("sales"), F.col("carts"))})


def stock_movement(movements: DataFrame) -> DataFrame:
    """Net quantity and a map event type -> count per (merchant, sku); counted by type first, so maps stay tiny."""
    by_type = movements.groupBy("merchant_id", "sku", "event_type").agg(F.sum("quantity").alias("q"), F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    return by_type.groupBy("merchant_id", "sku").agg(F.sum("q").alias("quantity"), F.map_from_entries(entries).alias("event_types"))


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def daily_cv(df: DataFrame, ts: str) -> DataFrame:
    """Sample standard deviation over mean of the daily counts, from exact integer moments."""
    n, s, q = F.count("*"), F.sum("n"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("n"))
    moments = daily_counts(df, ts).agg(n.alias("days"), s.alias("s"), q.alias("q"))
    return moments.select("days", variation(F.col("days"), F.col("s"), F.col("q")).alias("cv"))


def variation(count: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation over mean of `count` numbers from their sum and sum of squares; NULL below two."""
    k, s = count.cast("double"), total.cast("double")
    return F.when(count > 1, F.sqrt((squares.cast("double") - s * s / k) / (k - 1)) / (s / k))


def sales_velocity(sales: DataFrame, trailing_days: int | None = None) -> DataFrame:
    """Units per day per (merchant, sku) between first and last sale (at least one day), or over trailing days."""
    ts = F.col("order_timestamp").cast("timestamp_ntz")
    if trailing_days is not None:
        newest = sales.agg(F.max(ts)).scalar()
        recent = sales.filter(ts > newest - F.expr(f"interval {trailing_days} days"))
        units = recent.groupBy("merchant_id", "sku").agg(F.sum("quantity").alias("units"))
        return units.withColumn("velocity", F.col("units") / F.lit(float(trailing_days)))
    span = sales.groupBy("merchant_id", "sku").agg(F.sum("quantity").alias("units"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    days = F.greatest(F.lit(1), whole_days(F.col("lo"), F.col("hi")))
    return span.select("merchant_id", "sku", "units", (F.col("units").cast("double") / days).alias("velocity"))


def lifetime_value(customers: DataFrame, sales: DataFrame) -> DataFrame:
    """Spend, orders, mean order value and value with the loyalty multiplier, for every customer."""
    spent = sales.groupBy("customer_id").agg(
        F.sum(F.col("unit_price") * F.col("quantity")).alias("spent"), F.count("*").alias("total_orders")
    )
    joined = customers.select("customer_id").join(spent, "customer_id", "left")
    orders, total = F.coalesce(F.col("total_orders"), F.lit(0)), F.coalesce(F.col("spent").cast("double"), F.lit(0.0))
    factor = F.when(orders >= 3, 2.5).when(orders >= 1, 1.5).otherwise(1.0)
    return joined.select(
        "customer_id", total.alias("total_spent"), orders.alias("total_orders"),
        F.when(orders > 0, total / orders).otherwise(F.lit(0.0)).alias("avg_order_value"), (total * factor).alias("ltv"),
    )


def distinct_carts(cart_events: DataFrame) -> DataFrame:
    """Distinct carts per event type, added and abandoned carts side by side."""
    flags = cart_events.groupBy("cart_id").agg(
        F.bool_or(F.col("event_type") == "add_to_cart").alias("added"), F.bool_or(F.col("event_type") == "cart_abandoned").alias("abandoned")
    )
    return flags.agg(F.count_if("added").alias("total_carts"), F.count_if("abandoned").alias("abandoned_carts"))


def abandonment_rate(cart_events: DataFrame) -> DataFrame:
    counts = distinct_carts(cart_events)
    return counts.withColumn("abandonment_rate", rate(F.col("abandoned_carts"), F.col("total_carts")))


def ratio_of_counts(part: DataFrame, whole: DataFrame, name: str) -> DataFrame:
    """count(part) / count(whole); NULL when the whole is empty."""
    counts = part.agg(F.count("*").alias("part")).select(F.col("part"), whole.agg(F.count("*")).scalar().alias("whole"))
    return counts.withColumn(name, rate(F.col("part"), F.col("whole")))


def purchase_rate(sales: DataFrame, customers: DataFrame) -> DataFrame:
    return ratio_of_counts(sales.select("customer_id").dropna().distinct(), customers, "purchase_rate")


#: Values that may meet in one task to pick a median, and the share of ranks left between sketched bounds.
MEDIAN_VALUES, SPAN = 1_000_000, 0.0025


def median_bounds(df: DataFrame, column: str, most: int = MEDIAN_VALUES) -> tuple[float, float] | None:
    """Bounds (inclusive) of the middle ranks with at most about `most` distinct values between them; None without any value.

    A sketch knows ranks to 1 / 10,000 of the rows, so bounds a thousandth of the ranks to either side hold the middle. As long
    as too many values lie between, those below are counted exactly and the ones between are sketched again.
    """
    rows, v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), F.col("v")
    sketch = lambda value, at: F.percentile_approx(value, [max(0.0, at - 0.001), min(1.0, at + 0.001)], 10_000).alias("at")
    found = rows.agg(F.count("*").alias("n"), sketch(v, 0.5)).first()
    if not found["n"]:
        return None
    (lo, hi), left = found["at"], found["n"]
    while left * SPAN > most and lo < hi:
        between = F.when(v.between(lo, hi), v)
        counted = rows.agg(F.count_if(v < lo).alias("below"), F.count(between).alias("left")).first()
        left, middle = counted["left"], (found["n"] / 2 - counted["below"]) / counted["left"]
        narrower = rows.agg(sketch(between, middle)).first()["at"]
        if list(narrower) == [lo, hi]:
            break
        lo, hi = narrower
    return lo, hi


def middle_of(values: Column, rows: Column, below: Column) -> Column:
    """Median of `rows` values, of which `below` are smaller than the sorted array<struct<v, n>> of values and their counts."""
    lo, hi = F.floor((rows + 1) / 2), F.floor((rows + 2) / 2)
    none = F.lit(None).cast("double")
    start = F.struct(below.cast("long").alias("at"), none.alias("lo"), none.alias("hi"))

    def step(state: Column, value: Column) -> Column:
        at = state["at"] + value["n"]
        pick = lambda name, rank: F.when(state[name].isNull() & (at >= rank), value["v"]).otherwise(state[name]).alias(name)
        return F.struct(at.alias("at"), pick("lo", lo), pick("hi", hi))

    return F.aggregate(values, start, step, lambda state: (state["lo"] + state["hi"]) / 2)


def exact_median(df: DataFrame, column: str, most: int = MEDIAN_VALUES) -> DataFrame:
    """Median without sorting all rows: a sketch bounds the middle, values outside are counted, those between are ranked.

    Two scans up to `most` / SPAN rows. NULL without any value.
    """
    bounds = median_bounds(df, column, most)
    lo, hi = bounds or (0.0, 0.0)
    rows, v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), F.col("v")
    counts = rows.groupBy(F.when(v.between(lo, hi), v).alias("v")).agg(F.count("*").alias("n"), F.count_if(v < lo).alias("below"))
    inside = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("v", "n"))))
    total = counts.agg(inside.alias("inside"), F.sum("n").alias("rows"), F.sum("below").alias("below"))
    return total.select(middle_of(F.col("inside"), F.col("rows"), F.col("below")).alias("median"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = [agg(c).cast("double").alias(f"{name}_{c}") for c in columns for name, agg in (("min", F.min), ("max", F.max))]
    return df.agg(*aggs)


def row_digest(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a row. Hashes pass over NULLs, so which columns are NULL is hashed as well."""
    columns = [F.col(f"`{name}`") for name in df.columns]
    nulls = F.concat(*[F.when(x.isNull(), F.lit("1")).otherwise(F.lit("0")) for x in columns])
    return F.xxhash64(nulls, *columns), F.xxhash64(F.lit(7), *reversed(columns), nulls)


def null_cells(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{name}`").isNull().cast("long") for name in df.columns])


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, null cells and duplicate rows per table: one scan each, counted by row digest before the shuffle.

    What is shuffled does not depend on the width of a row. Two different rows count as equal if 128 bits agree; among 10^12
    rows that has a chance of 10^-15.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        h1, h2 = row_digest(df)
        rows = df.select(h1.alias("h1"), h2.alias("h2"), null_cells(df).alias("nulls")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("nulls").alias("nulls"))
        whole = lambda value, as_: F.coalesce(F.sum(value), F.lit(0)).alias(as_)
        summed = rows.agg(whole("n", "row_count"), whole("nulls", "null_values"), whole(F.col("n") - 1, "duplicate_rows"))
        return summed.withColumns({"table_name": F.lit(name), "column_count": F.lit(len(df.columns)).cast("long")})

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def completeness(summary: DataFrame) -> DataFrame:
    cells = F.sum(F.col("row_count") * F.col("column_count"))
    return summary.agg(F.coalesce(1 - rate(F.sum("null_values"), cells), F.lit(0.0)).alias("data_completeness"))


def calendar_total(days: DataFrame, per_day: Column) -> DataFrame:
    """Days with their volume int(per_day x multiplier)."""
    return days.withColumn("volume", (per_day * promo_multiplier("day")).cast("long"))


def dataset_totals(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")) for df in tables.values()]
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("total_records"), F.count("*").alias("tables"))


def share_vs_target(df: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """Row share per value next to its target weight; every target value is listed."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    joined = targets.join(counts, column, "full_outer").fillna({"n": 0})
    return joined.withColumn("share", rate(F.col("n"), total))
