"""Allocation and live balances on little disk and memory, with the results of brute force."""

import random
from datetime import datetime, timedelta

import pyarrow as pa

from stallkeeper.operators import inventory as I
from stallkeeper.session import stored, stored_tight
from stallkeeper.streaming import run, state

from test_skew import brute_allocate, key

T0 = datetime(2024, 3, 1)
ASKED, OFFERED = "id long, sku string, quantity int, ts timestamp_ntz", "sku string, merchant_id string, stock int"


def allocation_input(seed):
    rng = random.Random(seed)
    requests = [(i, key(rng), rng.choice([1, 1, 2, 3, 5, 40]), T0 + timedelta(minutes=rng.randrange(60 * 24 * 10))) for i in range(2500)]
    offers = [(s, f"m{j}", rng.randrange(0, 120)) for s in ["hot", *[f"k{i}" for i in range(7)]] for j in range(rng.randrange(1, 6))]
    return requests, offers


def test_allocation_is_the_same_by_slices_and_by_ranks(spark):
    for seed in range(2):
        requests, offers = allocation_input(seed)
        odd = [(9001, None, 1, T0), (9002, "hot", None, T0), (9003, None, None, T0)]
        asked, offered = spark.createDataFrame(requests + odd, ASKED).repartition(5), spark.createDataFrame(offers + [(None, "m0", 50)], OFFERED)
        want = brute_allocate(requests, offers) | dict.fromkeys([9001, 9002, 9003])
        for limits in ({}, {"hot_rows": 400}, {"slice_rows": 900}, {"hot_rows": 0, "slice_rows": 10}):
            rows = I.greedy_allocate(asked, offered, ["ts", "id"], 7200, **limits).collect()
            assert len(rows) == len(want) and {r.id: r.merchant_id for r in rows} == want, limits


def test_requests_of_usual_skus_are_shuffled_once(spark):
    requests, offers = allocation_input(7)
    got = I.greedy_allocate(spark.createDataFrame(requests, ASKED), spark.createDataFrame(offers, OFFERED), ["ts", "id"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_tight_tables_leave_no_shuffles(spark):
    def shuffles():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}

    df = spark.range(4000).repartition(3, "id")
    for store, kept in ((stored, True), (stored_tight, False)):
        before = shuffles()
        table = store(df, "t")
        assert bool(shuffles() - before) is kept
        assert table.count() == 4000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_packed_balances_come_back_and_are_small():
    rows = [("m", None, 1), (None, "s", 2), (None, None, 0), ("", "é", -3), ("日本", "", None)]
    for part in (rows, rows[2:3] * 2, []):
        table = pa.Table.from_pylist([dict(zip(state.UNITS.names, r)) for r in part], state.UNITS)
        assert state._unpacked(state._packed(table), state.UNITS).equals(table)
        assert state._unpacked(state._packed(table.slice(1)), state.UNITS).equals(table.slice(1))
    rng = random.Random(5)
    many = pa.table([[f"MER{rng.randrange(10**6):06d}" for _ in range(9000)], [f"SKU{rng.randrange(10**7):07d}" for _ in range(9000)], list(range(9000))], state.UNITS)
    assert len(state._packed(many)) < 14 * 9000


def test_balances_with_opening_stock_looked_up_and_many_pairs_a_group(spark, tmp_path):
    rng = random.Random(8)
    moves = [(f"m{rng.randrange(3)}", rng.choice(["a", "b", "c", "z"]), i, 1, 1.0, rng.choice([-9, -5, -2, 4]), T0 + timedelta(hours=rng.randrange(300))) for i in range(400)]
    moves += [(None, "a", 900, 1, 1.0, -1, T0), ("m0", None, 901, 1, 1.0, 2, T0)]
    stock = {(f"m{j}", s): 10 + j for j in range(3) for s in "abc"}
    want, left = {}, dict(stock)
    for merchant, sku, order, _, _, quantity, at in sorted(moves, key=lambda r: (r[6], r[2])):
        have = left.get((merchant, sku), 0)
        left[merchant, sku] = have + quantity if have + quantity >= 0 else have
        want[order] = (have + quantity >= 0, left[merchant, sku])
    schema = "merchant_id string, sku string, order_id long, line_no int, unit_price double, quantity int, timestamp timestamp_ntz"
    folder = str(tmp_path / "moves")
    for half in (moves[:200], moves[200:]):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(folder)
    pairs = state.by_group(spark.createDataFrame([(*pair, n) for pair, n in stock.items()], "merchant_id string, sku string, initial int"), 3).persist()
    pairs.count()

    step = lambda s: state.live_balance(run.event_time(s, "timestamp", "14 days"), 3, pairs)
    source = run.read_files(spark, folder, schema, "*.parquet", files_per_batch=1)
    try:
        got = run.drain_closed(source, "timestamp", step, "looked-up", on_disk=True).collect()
    finally:
        pairs.unpersist()
    assert len(got) == len(want) and {r.order_id: (r.accepted, r.balance) for r in got} == want
    assert spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory") == "2"


def test_groups_grow_with_the_pairs():
    assert state.groups_for(10) == state.GROUPS and state.groups_for(10**8) * state.GROUP_KEYS >= 10**8


def test_a_null_spoils_no_other_row_of_its_batch(spark, tmp_path):
    """Before, one missing line number made pandas read the column as doubles, and those came back from the state as NULL."""
    schema = "merchant_id string, sku string, order_id long, line_no int, unit_price double, quantity int, timestamp timestamp_ntz, initial int"
    moves = [("m", "s", i, None if i == 3 else i, 1.0, None if i == 4 else -2, T0 + timedelta(hours=i), 50) for i in range(8)]
    spark.createDataFrame(moves, schema).coalesce(1).write.parquet(str(tmp_path / "moves"))
    source = run.read_files(spark, str(tmp_path / "moves"), schema, "*.parquet")
    step = lambda s: state.live_balance(run.event_time(s, "timestamp", "1 hour"), groups=1)
    got = sorted(run.drain_closed(source, "timestamp", step, "nulls").collect(), key=lambda r: r.order_id)
    assert [(r.line_no, r.quantity) for r in got] == [(m[3], m[5]) for m in moves]
    assert [r.balance for r in got] == [48, 46, 44, 42, 42, 40, 38, 36]
