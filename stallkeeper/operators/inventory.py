"""Stock checks, allocation, restock planning and the event ledger."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallkeeper import values as V
from stallkeeper.functions import scores
from stallkeeper.functions.calendar import chunk_of
from stallkeeper.functions.hashing import choice, gate, int_inclusive, u
from stallkeeper.operators import windows
from stallkeeper.operators.relational import stock_status
from stallkeeper.session import stored_tight

PAIR = ["merchant_id", "sku"]


def stock_checks(requests: DataFrame, stock: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """Check a table of requests (merchant, sku, requested_qty) against a stock snapshot; a missing pair has none."""
    joined = requests.join(stock.select(*PAIR, "stock"), PAIR, "left")
    if reserved is None:
        joined = joined.withColumn("reserved", F.lit(0))
    else:
        joined = joined.join(reserved, PAIR, "left")
    filled = joined.fillna({"stock": 0, "reserved": 0})
    return filled.withColumns(stock_status(F.col("stock"), F.col("reserved"), F.col("requested_qty"))).drop("stock", "reserved")


#: Requests are counted by hash of the sku into so many buckets; a bucket above so many rows may hold a hot sku.
BUCKETS, HOT_ROWS = 1 << 16, 200_000
#: About so many requests are on their way through a shuffle at once, unless that made more than so many slices.
SLICE_ROWS, MOST_SLICES = 40_000_000, 8


def greedy_allocate(
    requests: DataFrame, offers: DataFrame, order: list[str], chunk_seconds: int = windows.DAY,
    hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Give each request, in order, to the first merchant (by id) of its sku with enough stock, or to none.

    A request that does not fit is skipped and a later smaller one may still fit. The sequential step streams sorted rows
    through Arrow batches and keeps only the balances of the sku at hand, in a tree that finds the first merchant with enough.

    Stock only falls, so once a quantity does not fit, no later request of that quantity fits. Of each (sku, quantity) at most
    sum(stock) // quantity requests can be filled, and they are the first ones. Where a sku may have more than `hot_rows`
    requests (counted by hash), all others are unfilled without looking at any state, so the rows that the sequential step sees
    of a sku are bounded by `hot_rows` or by its stock, however many requests it has. The others go there directly: ranking them
    would shuffle all rows three times more.

    Each slice of the skus is allocated and written before the next, so that the disk holds the shuffle of one slice only.
    `requests` is read twice, and once more a slice. It has sku, quantity (> 0) and the order columns, first of which is the
    time; `offers` has sku, merchant_id, stock.
    """
    bucket = F.pmod(F.xxhash64("sku"), F.lit(BUCKETS))
    sizes = requests.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("quantity").alias("least")).collect()
    ranked = bucket.isin([r.bucket for r in sizes if r.n > hot_rows or (r.least is not None and r.least <= 0)])
    slices = min(MOST_SLICES, 1 + sum(r.n for r in sizes) // slice_rows)
    if slices == 1:
        return _allocate(requests, offers, order, chunk_seconds, ranked)
    of = lambda df, k: df.filter(bucket % slices == k)
    parts = [_allocate(of(requests, k), of(offers, k), order, chunk_seconds, ranked) for k in range(slices)]
    return reduce(DataFrame.unionByName, [stored_tight(part, "allocated") for part in parts])


def _allocate(requests: DataFrame, offers: DataFrame, order: list[str], chunk_seconds: int, ranked: Column) -> DataFrame:
    """Allocation in one shuffle by sku; rows where `ranked` holds are numbered by (sku, quantity) first."""
    columns = requests.columns
    # At a hot sku requests of one quantity are numbered chunk by chunk.
    numbered = windows.running(
        requests.filter(ranked), ["sku", "quantity"], chunk_of(order[0], chunk_seconds), order, {"_rank": F.lit(1).cast("long")}
    )
    supply = offers.filter(ranked).groupBy("sku").agg(F.sum("stock").alias("_total"), F.max("stock").alias("_most"))
    can = (F.col("quantity") <= F.col("_most")) & (F.col("_rank") * F.col("quantity") <= F.col("_total"))
    judged = numbered.join(supply, "sku", "left").withColumn("_can", F.coalesce(can, F.lit(False)))
    hopeless = judged.filter(~F.col("_can")).select(*columns, F.lit(None).cast("string").alias("merchant_id"))

    slots = {"_kind": F.lit(1), "_merchant": F.lit(None).cast("string"), "_stock": F.lit(None).cast("long")}
    asking = requests.filter(~ranked).unionByName(judged.filter("_can").select(*columns)).select(*columns, *[c.alias(n) for n, c in slots.items()])
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in requests.schema.fields if f.name != "sku"}
    supplying = offers.select(
        *["sku" if c == "sku" else blank[c] for c in columns],
        F.lit(0).alias("_kind"), F.col("merchant_id").alias("_merchant"), F.col("stock").cast("long").alias("_stock"),
    )
    stream = supplying.unionByName(asking).repartition("sku").sortWithinPartitions("sku", "_kind", "_merchant", *order)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in requests.schema.fields] + [T.StructField("merchant_id", T.StringType())])
    return stream.mapInArrow(_fill_in_order(columns), schema).unionByName(hopeless)


class FirstFit:
    """Stocks of a sku's merchants below a tree of their maxima: the first one with enough is found in log2(merchants) steps."""

    def __init__(self, stocks: list[int]):
        self.leaves = 1 << max(0, len(stocks) - 1).bit_length()
        self.most = array("q", bytes(16 * self.leaves))
        self.most[self.leaves : self.leaves + len(stocks)] = array("q", stocks)
        for i in range(self.leaves - 1, 0, -1):
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def take(self, need: int) -> int | None:
        """Takes `need` (> 0) from the first stock that has it; its number, or None."""
        most, at = self.most, 1
        if most[1] < need:
            return None
        while at < self.leaves:
            at *= 2
            if most[at] < need:
                at += 1
        most[at] -= need
        found = at - self.leaves
        while at > 1:
            at //= 2
            top = max(most[2 * at], most[2 * at + 1])
            if most[at] == top:
                break
            most[at] = top
        return found


def _fill_in_order(columns: list[str]):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, stocks, fit = None, [], [], None
        for batch in batches:
            skus, kinds = batch.column("sku").to_pylist(), batch.column("_kind").to_numpy()
            merchants, stock = batch.column("_merchant").to_pylist(), batch.column("_stock").fill_null(0).to_numpy()
            wanted = batch.column("quantity").to_pylist()
            result = [None] * len(skus)
            for i, sku in enumerate(skus):
                if sku != current:
                    current, names, stocks, fit = sku, [], [], None
                if kinds[i] == 0:
                    names.append(merchants[i])
                    stocks.append(int(stock[i]))
                elif sku is not None and wanted[i] is not None:  # without a sku or a quantity nothing fits
                    fit = fit or FirstFit(stocks)
                    found = fit.take(int(wanted[i]))
                    if found is not None:
                        result[i] = names[found]
            filled = pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(result, pa.string())], names=[*columns, "merchant_id"]
            )
            yield filled.filter(pa.array(kinds == 1))

    return fill


def fifo_allocate(requests: DataFrame, offers: DataFrame, order: list[str], chunk_seconds: int = windows.DAY) -> DataFrame:
    """Pooled stock per sku handed out in order until it runs out. Unlike greedy_allocate a large request blocks later
    ones, a request may be filled partly, and no merchant is chosen."""
    pool = offers.groupBy("sku").agg(F.sum("stock").alias("_total"))
    asked = windows.running(
        requests, ["sku"], chunk_of(order[0], chunk_seconds), order, {"demand": F.col("quantity").cast("long")}
    )
    joined = asked.join(pool, "sku", "left").fillna({"_total": 0})
    rest = F.col("_total") - (F.col("demand") - F.col("quantity"))
    units = F.greatest(F.lit(0), F.least(F.col("quantity"), rest))
    return joined.withColumns({"units": units, "filled": F.col("demand") <= F.col("_total")}).drop("_total")


def reservation_view(stock: DataFrame, reservations: DataFrame) -> DataFrame:
    """Current, reserved and available stock per pair."""
    held = reservations.groupBy(*PAIR).agg(F.sum("quantity").alias("reserved_inventory"))
    joined = stock.select(*PAIR, F.col("stock").alias("current_inventory")).join(held, PAIR, "left").fillna({"reserved_inventory": 0})
    available = F.greatest(F.lit(0), F.col("current_inventory") - F.col("reserved_inventory"))
    return joined.withColumn("available_inventory", available).withColumn(
        "stock_status", F.when(F.col("available_inventory") > 0, "in_stock").otherwise("out_of_stock")
    )


def plan_restocks(stock: DataFrame, velocity: DataFrame, merchants: DataFrame, day: str) -> DataFrame:
    """Restock orders of a day: pairs at or below 50 units that pass the gate, with quantity and delivery date."""
    joined = (
        stock.filter("stock <= 50").join(velocity.select(*PAIR, "velocity"), PAIR, "left")
        .join(merchants.select("merchant_id", "reliability"), "merchant_id", "left")
    )
    draw = lambda stream: u(stream, "merchant_id", "sku", f"'{day}'")
    ordered = joined.filter(scores.restock_gate(F.col("stock"), F.col("velocity"), F.col("reliability"), draw("restock_gate")))
    today = F.lit(day).cast("date")
    return ordered.select(
        *PAIR, scores.restock_quantity(F.col("velocity"), draw("restock_quantity")).alias("quantity"), today.alias("ordered_date"),
        F.date_add(today, int_inclusive(1, 7, draw("restock_delay")).cast("int")).alias("delivery_date"),
    )


def deliver_due(pending: DataFrame, stock: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Due restocks as events with their new balance, in order of delivery; and the orders still pending."""
    due, waiting = pending.filter(F.col("delivery_date") <= today), pending.filter(F.col("delivery_date") > today)
    summed = windows.running(due, PAIR, F.unix_date("delivery_date"), ["delivery_date", "quantity"], {"_delivered": F.col("quantity").cast("long")})
    events = summed.join(stock.select(*PAIR, "stock"), PAIR, "left").fillna({"stock": 0}).select(
        today.cast("timestamp_ntz").alias("timestamp"), *PAIR, F.lit("restock").alias("event_type"), "quantity",
        F.lit("Scheduled delivery").alias("reason"), (F.col("stock") + F.col("_delivered")).alias("new_balance"),
    )
    return events, waiting


def damage_events(stock: DataFrame, day: str, rate: float = 0.002) -> DataFrame:
    """Damage of stocked pairs on one day, at most the stock at hand. Draws depend on pair and day."""
    draw = lambda stream: u(stream, "merchant_id", "sku", f"'{day}'")
    hit = stock.filter(F.col("stock") > 0).filter(gate(rate, draw("damage_gate")))
    return hit.select(
        F.lit(day).cast("timestamp_ntz").alias("timestamp"), *PAIR, F.lit("damage").alias("event_type"),
        (-scores.damage_quantity(F.col("stock"), draw("damage_quantity"))).alias("quantity"),
        choice(V.DAMAGE_REASONS, draw("damage_reason")).alias("reason"),
    )


def event_ledger(initial: DataFrame, *others: DataFrame) -> DataFrame:
    """All stock events in one table with running balances."""
    rows = initial
    for df in others:
        rows = rows.unionByName(df)
    return windows.running_balance(rows)
