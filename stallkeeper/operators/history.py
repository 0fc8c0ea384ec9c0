"""What had happened before each row: an as-of merge of two tables by key and time.

Rows of interest (probes) and events become one tagged table, cut by key into stretches of time. Inside a stretch a running
sum counts the events so far and is read off at the probes; totals of earlier stretches, summed before their own shuffle, are
added by an equi-join. No row meets another one: the work is one sort, whatever the number of (probe, event) pairs, and a key
with a third of all rows spreads over its stretches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper.functions.calendar import chunk_of

DAY = 86400
#: Probes without a key have no history; they are dealt over so many groups.
SPREAD = 4096


class Level(NamedTuple):
    """Sums of event values by the common keys and `keys`, named by column."""

    keys: list[str]
    sums: dict[str, Column]


def as_of(probes: DataFrame, events: DataFrame, keys: list[str], levels: list[Level], at: str, event_at: str, chunk_seconds: int = DAY) -> DataFrame:
    """`probes` with each level's sums over the events of equal keys strictly before the probe's time; 0 if there are none.

    Events at the same instant do not count. NULL is no key: events with a NULL key or time are no history, probes with one
    see none. Values that are NULL are not summed. `probes` is read twice: store a costly one first.
    """
    extras = list(dict.fromkeys(k for level in levels for k in level.keys))
    sums = {name: value for level in levels for name, value in level.sums.items()}
    keyed = lambda names: F.forall(F.array(*[F.col(k).isNotNull() for k in names]), lambda x: x)
    place = lambda ts, chunk: F.struct(*keys, chunk.cast("long").alias("_chunk"))

    known = events.where(keyed([*keys, event_at]))
    counted = known.withColumn("_at", place(event_at, chunk_of(event_at, chunk_seconds)))
    counted = counted.groupBy("_at", *extras, F.col(event_at).alias("_ts")).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    kinds = dict(counted.dtypes)

    chunk = F.when(keyed([*keys, at]), chunk_of(at, chunk_seconds)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    asked = probes.select(F.struct(*probes.columns).alias("_probe"), place(at, chunk).alias("_at"), *extras, F.col(at).alias("_ts"), *[F.lit(None).cast(kinds[n]).alias(n) for n in sums])
    merged = asked.unionByName(counted.withColumn("_probe", F.lit(None).cast(dict(asked.dtypes)["_probe"])))

    # A probe (0) comes before the events (1) of its instant.
    so_far = lambda by: W.partitionBy("_at", *by).orderBy("_ts", F.col("_probe").isNull().cast("int")).rowsBetween(W.unboundedPreceding, 0)
    local = merged.withColumns({f"_l_{n}": F.sum(n).over(so_far(level.keys)) for level in levels for n in level.sums}).where("_probe IS NOT NULL")
    for level in levels:
        totals = merged.groupBy("_at", *level.keys).agg(*[F.sum(n).alias(n) for n in level.sums])
        earlier = W.partitionBy(*[F.col("_at")[k] for k in keys], *level.keys).orderBy("_at._chunk").rowsBetween(W.unboundedPreceding, -1)
        named = F.struct("_at", *level.keys).alias("_where")
        offsets = totals.select(named, *[F.sum(n).over(earlier).alias(f"_o_{n}") for n in level.sums]).where(f"_o_{next(iter(level.sums))} IS NOT NULL")
        local = local.withColumn("_where", F.struct("_at", *level.keys)).join(offsets, "_where", "left").drop("_where")
    fine = F.forall(F.array(*[F.col(f"_probe.`{k}`").isNotNull() for k in [*keys, at]]), lambda x: x)

    def value(level: Level, name: str) -> Column:
        seen = fine & keyed(level.keys) if level.keys else fine
        nothing = F.lit(0).cast(kinds[name])
        return F.when(seen, F.coalesce(f"_l_{name}", nothing) + F.coalesce(f"_o_{name}", nothing)).otherwise(nothing).alias(name)

    return local.select("_probe.*", *[value(level, n) for level in levels for n in level.sums])
