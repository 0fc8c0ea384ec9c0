"""Keyed state in event time: live stock balances and cart reservations with a timeout.

Rows wait in the state of their key until the watermark has passed them and are then handled in the order of their event
times. So results depend neither on the borders of the micro-batches nor on the order of arrival within the delay. Keys share
groups by hash, since a call costs milliseconds however few rows it has: a group holds one small value for each of its keys
and the rows of one delay, so `groups` should grow with the keys (`groups_for`). Balances are kept as packed columns, since they
cover every pair ever seen; `run.drain_closed(..., on_disk=True)` keeps them out of the heap. The size of a micro-batch is bounded at the source. Rows later than the
watermark are dropped by Spark and counted by `run.append_to`. `run.drain_closed` ends a stream, so that nothing waits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Microseconds in a millisecond; watermarks and timers count the latter.
MILLI = 1000
HOLD_MS = 3_600_000
CART_NAMES = {"add_to_cart": "active", "cart_abandoned": "abandoned", "ready_to_purchase": "converted"}

GROUPS = 512
#: Keys that share a group, about, and rows handled at once in a group.
GROUP_KEYS, ROWS = 16384, 65536

#: A move in the order of handling: by time, then by the others.
MOVE = pa.schema([
    ("at", pa.int64()), ("order_id", pa.int64()), ("line_no", pa.int32()), ("unit_price", pa.float64()), ("quantity", pa.int64()),
    ("merchant_id", pa.string()), ("sku", pa.string()), ("initial", pa.int64()),
])
UNITS = pa.schema([("merchant_id", pa.string()), ("sku", pa.string()), ("units", pa.int64())])
MOVE_STATE = "units binary, waiting binary"
MOVED = "merchant_id string, sku string, order_id bigint, line_no int, quantity int, accepted boolean, balance bigint"
CART = ["at", "event_id", "event_type", "cart_id"]
CART_STATE = "due array<struct<cart_id:bigint,due:bigint>>, waiting array<struct<at:bigint,event_id:bigint,event_type:string,cart_id:bigint>>"
CART_STATUS = "cart_id bigint, status string, at bigint"


def _nulls_first(row: tuple) -> list[tuple]:
    return [(value is not None, value if value is not None else 0) for value in row]


def _plain(column: pd.Series) -> list:
    return column.astype(object).where(column.notna(), None).tolist() if column.hasnans else column.tolist()


def _released(waiting: Iterable, rows: Iterator[pd.DataFrame], columns: list[str], watermark: int) -> tuple[list, list]:
    """Rows that the watermark has passed in order, and those that still wait."""
    held = [tuple(row) for row in waiting]
    for part in rows:
        held += zip(*(_plain(part[name]) for name in columns), strict=True)
    held.sort(key=_nulls_first)
    cut = next((k for k, row in enumerate(held) if row[0] > watermark * MILLI), len(held))
    return held[:cut], held[cut:]


def _wait(state: GroupState, watermark: int, *moments: int | None) -> None:
    """Wake the key up as soon as the watermark is past the earliest of the moments (microseconds)."""
    known = [-(-at // MILLI) for at in moments if at is not None]
    if known:
        state.setTimeoutTimestamp(max(min(known), watermark, 1))


def groups_for(keys: int) -> int:
    """Groups of state for so many keys."""
    return max(GROUPS, -(-keys // GROUP_KEYS))


def _packed(table: pa.Table) -> bytes | None:
    """One compressed row of lists; texts go as lengths and one run of characters, since offsets hardly compress."""
    if not table.num_rows:
        return None
    columns = {}
    for name, values in zip(table.column_names, table.combine_chunks().columns):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        if pa.types.is_string(values.type):
            known, values = values.is_valid(), values.fill_null("")
            ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
            columns[f"{name}_text"] = pa.array([values.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if ends[-1] else b""], pa.large_binary())
            values = pc.if_else(known, pa.array(np.diff(ends)), None)
        columns[name] = pa.ListArray.from_arrays([0, len(values)], values)
    sink, row = pa.BufferOutputStream(), pa.table(columns)
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(row)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes | None, schema: pa.Schema) -> pa.Table:
    if not packed:
        return schema.empty_table()
    row, columns = pa.ipc.open_stream(packed).read_all().combine_chunks(), []
    for field in schema:
        values = row[field.name].chunk(0).flatten()
        if pa.types.is_string(field.type):
            ends = np.concatenate([[0], np.cumsum(values.fill_null(0).to_numpy())]).astype(np.int32)
            texts = pa.StringArray.from_buffers(len(values), pa.py_buffer(ends), pa.py_buffer(row[f"{field.name}_text"][0].as_py()))
            values = pc.if_else(values.is_valid(), texts, None) if values.null_count else texts
        columns.append(values)
    return pa.table(columns, schema)


def _pairs(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    return zip(table.column("merchant_id").to_pylist(), table.column("sku").to_pylist())


def _move(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Stock of each (merchant, sku): an outflow larger than the balance is rejected."""
    watermark = state.getCurrentWatermarkMs()
    packed, waiting = state.get if state.exists else (None, None)
    arrived = [pa.Table.from_pandas(part[MOVE.names], MOVE, preserve_index=False) for part in rows]
    held = pa.concat_tables([_unpacked(waiting, MOVE), *arrived])
    passed = pc.less_equal(held["at"], watermark * MILLI)
    ready, waiting = held.filter(passed), held.filter(pc.invert(passed))
    del arrived, held
    if ready.num_rows:
        known = _unpacked(packed, UNITS)
        units = dict(zip(_pairs(known), known["units"].to_pylist()))
        order = pc.sort_indices(ready, [(name, "ascending") for name in MOVE.names], null_placement="at_start")
        for at in range(0, len(order), ROWS):
            part = ready.take(order[at : at + ROWS]).combine_chunks()
            changes, opening = (part[name].fill_null(0).to_pylist() for name in ("quantity", "initial"))
            accepted, balances = [], []
            for pair, change, first in zip(_pairs(part), changes, opening):
                left = units.get(pair, first)
                fits = left + change >= 0
                units[pair] = left = left + change if fits else left
                accepted.append(fits)
                balances.append(left)
            yield part.drop_columns(["at", "unit_price", "initial"]).to_pandas().assign(accepted=accepted, balance=balances)
        packed = _packed(pa.table([[m for m, _ in units], [k for _, k in units], list(units.values())], UNITS))
    state.update((packed, _packed(waiting)))
    _wait(state, watermark, pc.min(waiting["at"]).as_py())


def _cart(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Status of each cart: active, then abandoned or converted, or expired when nothing happens until the timeout."""
    watermark = state.getCurrentWatermarkMs()
    known, waiting = state.get if state.exists else ([], [])
    due, found = dict(tuple(pair) for pair in known), []
    ready, waiting = _released(waiting, rows, CART, watermark)
    for at, _, kind, cart in ready:
        if cart in due and at >= due[cart]:
            found.append((cart, "expired", due.pop(cart)))
        status = CART_NAMES.get(kind)
        if status == "active":
            due[cart] = at + HOLD_MS * MILLI
            found.append((cart, status, at))
        elif status and due.pop(cart, None) is not None:
            found.append((cart, status, at))
    over = [cart for cart, end in due.items() if end <= watermark * MILLI]
    found += [(cart, "expired", due.pop(cart)) for cart in over]
    if due or waiting:
        state.update((list(due.items()), waiting))
        _wait(state, watermark, *due.values(), waiting[0][0] if waiting else None)
    elif state.exists:
        state.remove()
    if found:
        yield pd.DataFrame(found, columns=["cart_id", "status", "at"])


def _group(groups: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("group")


def by_group(table: DataFrame, groups: int) -> DataFrame:
    """Rows of pairs dealt by their group, as live_balance deals its movements: tables dealt alike are joined without a shuffle."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.withColumn("group", _group(groups, "merchant_id", "sku")).repartition(parts, "group")


def live_balance(movements: DataFrame, groups: int = GROUPS, opening: DataFrame | None = None) -> DataFrame:
    """Accepted or rejected movements with the balance after each, in the order of their timestamps (equal ones by order,
    line, price and quantity). `initial` is the opening stock of the pair, equal in all its rows; NULL is 0, and so is a NULL
    quantity. Needs an event-time watermark on `timestamp`. Rows without a timestamp are dropped by the watermark and counted.
    With `opening`, a batch table of pairs dealt by `by_group` with the same groups, `initial` is looked up there.
    """
    dealt = by_group(movements, groups)
    if opening is not None:
        dealt = dealt.join(opening.hint("shuffle_hash"), ["group", "merchant_id", "sku"], "left")
    at = F.unix_micros("timestamp").alias("at")
    numbers = [F.col("unit_price").cast("double").alias("unit_price"), *(F.col(n).cast("long").alias(n) for n in ("quantity", "initial"))]
    moves = dealt.select("merchant_id", "sku", "timestamp", at, "order_id", "line_no", *numbers, "group")
    moved = moves.groupBy("group").applyInPandasWithState(_move, MOVED, MOVE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    level = F.when(F.col("balance") == 0, "critical").when(F.col("balance") <= 10, "warning")
    return moved.withColumn("alert_level", level)


def cart_status(cart_events: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Status changes of carts; needs an event-time watermark on `timestamp`."""
    events = cart_events.select("cart_id", "timestamp", F.unix_micros("timestamp").alias("at"), "event_id", "event_type", _group(groups, "cart_id"))
    changed = events.groupBy("group").applyInPandasWithState(_cart, CART_STATUS, CART_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return changed.select("cart_id", "status", F.timestamp_micros("at").alias("at"))
