"""Ranked lexical search over an index stratified by length.

A document's normaliser m depends on its length alone, so documents of equal m are a stratum, in which a term adds the same
score for the same number of occurrences tf. A stratum is cut into segments of at most SEGMENT documents; a segment is one row
of the index: its documents, and for each term its postings by descending tf. The impact of (m, tf) is computed once per
tf group of a segment, not per posting, and the largest tf of each term bounds what a query can score there.

A block of queries is answered in three passes over the index, none of which moves postings:

1. bounds of all segments; each query notes the FIRST segments of largest bound,
2. these are scored, and the k-th best score becomes the query's threshold,
3. every task visits its segments by descending bound, leaves a query out where its bound is below the threshold (which rises
   with what the task finds), and keeps the k best documents per query; a window merges those.

A segment is left out only if its bound is strictly below the k-th best score, so ties and results are exact. Scores are
64-bit integers. Terms are compared by 64-bit hashes: among 10^10 distinct words and 10^4 asked ones a false match has a chance
of 10^-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm import words as W
from stallkeeper.llm.bitmap import bitmap, dense, has_bits
from stallkeeper.session import stored

#: Documents of a segment, segments that give a query its first threshold, and query terms that are sent to the tasks at once.
SEGMENT, FIRST, BLOCK_TERMS = 4096, 4, 100_000
#: Postings and documents that a task scores in one go, about, and strata of several segments that are sent to all executors.
WORK, MOST_STRATA = 1 << 20, 100_000
#: Stands for a null doc_id inside the index; it comes last among equal scores.
NO_ID = 2**63 - 1
TOKENS = "row long, doc_id long, n long, terms array<long>, tfs array<int>"
INDEX = "m long, segment int, docs array<long>, terms array<long>, tfs array<int>, ends array<int>, places array<int>"


def _counts(column: pa.Array, cells: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, words of each text, text, term and tf of each pair that the bitmap has) of slices of texts."""
    for lo, hi, data, offsets in W.slices(column):
        words = W.split(data, offsets, W.ALNUM)
        hashes, text = words.hashes(), words.texts()
        if cells is not None:
            asked = has_bits(cells, hashes)
            hashes, text = hashes[asked], text[asked]
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        yield lo, hi, words.counts(), text[at], hashes[at], np.diff(np.append(at, len(hashes)))


def tokens(documents: DataFrame, only: tuple | None = None) -> DataFrame:
    """(row, doc_id, n, terms, tfs): length and term counts of each document that has a term; `only`: a bitmap of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None if only is None else dense(only)
        for batch in batches:
            for lo, hi, n, text, terms, tfs in _counts(batch.column(2), cells):
                ends = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(terms.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))],
                    ["row", "doc_id", "n", "terms", "tfs"])

    source = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, TOKENS).where("n > 0")


@dataclass
class Index:
    """`segments`: the index rows; `documents`: N; `terms`: L, all terms with repeats."""

    segments: DataFrame
    documents: int
    terms: int


def build(documents: DataFrame, only: tuple | None = None, segment: int = SEGMENT) -> Index:
    """Index of `documents` (doc_id, text, ...), of all terms or those of a bitmap; N and L count all terms either way.

    Rows count by themselves: repeated rows, rows with equal and rows without ids are documents of their own. Texts without
    a term (null, empty) are no documents of the index.
    """
    rows = stored(tokens(documents, only), "tokens")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n, total = int(size["n"]), int(size["l"])
    # No overflow while documents times words of the longest one stay below 1.8 * 10^17.
    placed = rows.withColumn("m", F.expr(f"50L + (50L * n * {n}L) div {max(total, 1)}L")).where(F.size("terms") > 0)
    counted = placed.groupBy("m").agg(F.ceil(F.count("*") / segment).cast("int").alias("parts"))
    large = stored(counted.where(F.col("parts") > 1), "strata")
    # Sent to the executors the cuts leave only one shuffle, by (m, segment); a join on m alone would deal a stratum to one task.
    small_enough = large.count() <= MOST_STRATA
    placed = placed.join(F.broadcast(large) if small_enough else large, "m", "left")
    placed = placed.withColumn("segment", F.pmod(F.hash("row"), F.coalesce("parts", F.lit(1))))
    if not small_enough:
        placed = placed.repartition("m", "segment")

    def make(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids))
        sizes = np.diff(table["terms"].combine_chunks().offsets.to_numpy())
        terms, tfs = table["terms"].combine_chunks().flatten().to_numpy(), table["tfs"].combine_chunks().flatten().to_numpy()
        where = np.repeat(place, sizes)
        by = np.lexsort((where, -tfs, terms))
        terms, tfs, where = terms[by], tfs[by], where[by]
        last = np.ones(len(terms), bool)
        last[:-1] = (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])
        ends = np.flatnonzero(last)
        wide = lambda x, t: pa.array([x], pa.list_(t))
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), wide(ids[order], pa.int64()), wide(terms[ends], pa.int64()),
             wide(tfs[ends], pa.int32()), wide(ends + 1, pa.int32()), wide(where, pa.int32())],
            ["m", "segment", "docs", "terms", "tfs", "ends", "places"])

    made = placed.select("m", "segment", "doc_id", "terms", "tfs").groupBy("m", "segment").applyInArrow(make, INDEX)
    return Index(stored(made, "index"), n, total)


@dataclass
class Block:
    """Queries 0 to `size` - 1 by (query, term, weight) pairs; `terms` are the distinct terms, ascending."""

    size: int
    terms: np.ndarray
    query: np.ndarray
    term: np.ndarray
    weight: np.ndarray


class Segment:
    """One row of the index, seen by the queries of a block."""

    def __init__(self, m: int, groups: tuple[np.ndarray, np.ndarray], block: Block):
        terms, tfs = groups
        self.at = np.searchsorted(block.terms, terms)
        self.asked = np.flatnonzero((self.at < len(block.terms)) & (block.terms[np.minimum(self.at, len(block.terms) - 1)] == terms))
        self.at = self.at[self.asked]
        tf = tfs[self.asked].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)  # once per (term, tf) group
        best = np.zeros(len(block.terms), np.int64)
        np.maximum.at(best, self.at, self.impact)
        self.bounds = _sums(block.query, block.weight * best[block.term], block.size)

    def scores(self, block: Block, active: np.ndarray, ends: np.ndarray, places: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of all documents with a score above 0 for the `active` queries."""
        begin, stop = np.concatenate([[0], ends[:-1]])[self.asked], ends[self.asked]
        # Groups of a term are neighbours; a (query, term) pair meets all postings of its groups.
        first, last = np.searchsorted(self.at, block.term), np.searchsorted(self.at, block.term, "right")
        pairs = np.flatnonzero(active[block.query] & (last > first))
        postings = stop[last[pairs] - 1] - begin[first[pairs]]
        work = np.cumsum(_sums(block.query[pairs], postings, block.size) + docs * active)
        part, out = work // WORK, [[np.empty(0, np.int64)] * 3]
        for number in np.unique(part[active]):  # a few queries at a time bound the memory
            mine = np.flatnonzero(active & (part == number))
            chosen = pairs[(block.query[pairs] >= mine[0]) & (block.query[pairs] <= mine[-1])]
            group = _runs(first[chosen], last[chosen])
            pair = np.repeat(chosen, last[chosen] - first[chosen])
            sizes = (stop - begin)[group]
            cell = np.repeat(np.searchsorted(mine, block.query[pair]) * docs, sizes) + places[_runs(begin[group], stop[group])]
            score = _sums(cell, np.repeat(block.weight[pair] * self.impact[group], sizes), len(mine) * docs)
            hit = np.flatnonzero(score > 0)
            out.append([mine[hit // docs], hit % docs, score[hit]])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, last), one after the other."""
    sizes = last - first
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Integer sums by index. Doubles hold them exactly below 2^53; above, they are summed as integers."""
    if not len(values):
        return np.zeros(size, np.int64)
    if float(values.max()) * len(values) < 2**53:
        return np.bincount(index, weights=values, minlength=size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, index, values)
    return out


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """The list columns of each row as arrays."""
    lists = [batch.column(batch.schema.get_field_index(n)) for n in names]
    cut = [(column.offsets.to_numpy(), column.values.to_numpy()) for column in lists]
    for i in range(batch.num_rows):
        yield [values[offsets[i] : offsets[i + 1]] for offsets, values in cut]


class Best:
    """The k best (score, doc) of every query of a block, and the score that a newcomer must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.found, self.waiting = [np.empty(0, np.int64)] * 3, []

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        fit = score >= self.least[query]
        self.waiting.append((query[fit], doc[fit], score[fit]))
        if sum(len(x[0]) for x in self.waiting) > 4 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        query, doc, score = (np.concatenate([old, *new]) for old, new in zip(self.found, zip(*self.waiting, strict=True) if self.waiting else [[]] * 3, strict=True))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kth = rank == self.k - 1
        self.least[query[kth]] = np.maximum(self.least[query[kth]], score[kth])
        self.found, self.waiting = [x[rank < self.k] for x in (query, doc, score)], []


HEAD = ["m", "segment", "terms", "tfs"]


def _first_segments(index: DataFrame, block: Block) -> DataFrame:
    """(query, m, segment): the segments of largest bound for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, np.int64)] * 4

        def top(parts: list) -> list:
            query, bound, m, segment = parts
            order = np.lexsort((segment, m, -bound, query))
            order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < FIRST]
            return [x[order] for x in parts]

        for batch in batches:
            parts = [[x] for x in best]
            for m, segment, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _columns(batch, "terms", "tfs"), strict=True):
                bounds = Segment(m, groups, block).bounds
                query = np.flatnonzero(bounds)
                for part, x in zip(parts, (query, bounds[query], np.full(len(query), m), np.full(len(query), segment)), strict=True):
                    part.append(x)
            best = top([np.concatenate(p) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best], ["query", "bound", "m", "segment"])

    found = index.select(*HEAD).mapInArrow(run, "query long, bound long, m long, segment long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "m", "segment")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST).select("query", "m", "segment")


def _visit(index: DataFrame, block: Block, k: int, least: np.ndarray, only: dict | None = None) -> DataFrame:
    """(query, doc, score): k best documents of each query in each task; `only`: the queries of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, least)
        for batch in batches:
            ms, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            heads = [Segment(m, groups, block) for m, groups in zip(ms, _columns(batch, "terms", "tfs"), strict=True)]
            rows = list(_columns(batch, "docs", "ends", "places"))
            # By descending largest bound, so that thresholds rise early.
            for i in sorted(range(len(heads)), key=lambda i: -int(heads[i].bounds.max(initial=0))):
                bounds, (docs, ends, places) = heads[i].bounds, rows[i]
                active = (bounds >= best.least) & (bounds > 0)
                if only is not None:
                    chosen = np.zeros(block.size, bool)
                    chosen[only.get((ms[i], numbers[i]), [])] = True
                    active &= chosen
                if active.any():
                    query, place, score = heads[i].scores(block, active, ends, places, len(docs))
                    best.add(query, docs[place], score)
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.found], ["query", "doc", "score"])

    return index.mapInArrow(run, "query long, doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): distinct terms of each item; rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, _, text, terms, _ in _counts(batch.column(1), None):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + lo)), pa.array(terms.view(np.int64))], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term long").distinct()


def search(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the `k` documents of highest score above 0, ties by ascending doc_id.

    `documents` has (doc_id, text, ...), `items` (item_id, text, ...); other columns are not read. Rows of `documents` rank by
    themselves, also equal ones; a null doc_id comes last among equal scores. Rows of one item_id are one item with the terms
    of all of them, null ids are one item as well. Null and empty texts have no terms: such a document is not found, such an
    item finds nothing. Empty tables give no rows.
    """
    terms = stored(item_terms(items), "item_terms")
    index = build(documents, bitmap(terms.withColumnRenamed("term", "token")))
    groups = index.segments.select(F.explode(F.arrays_zip("terms", "ends", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("begins"))).alias("g"))
    df = groups.groupBy(F.col("g.terms").alias("term")).agg(F.sum(F.col("g.ends") - F.col("g.begins")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = stored(terms.join(df, "term").select("item_id", "term", weight.cast("long").alias("weight")), "weights")
    total = weighed.count()
    blocks = max(1, -(-total // BLOCK_TERMS))
    dealt = weighed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for number in range(blocks):  # the query set goes through in blocks of about BLOCK_TERMS terms; one is enough but for huge sets
        found = _answer(index, dealt.where(F.col("block") == number), k)
        out = found if out is None else out.unionByName(found)
    return out


def _answer(index: Index, weighed: DataFrame, k: int) -> DataFrame:
    rows: pd.DataFrame = weighed.select(F.coalesce("item_id", F.lit(NO_ID)).alias("item_id"), "term", "weight").toPandas()
    ids, query = np.unique(rows["item_id"].to_numpy(np.int64), return_inverse=True)
    terms, term = np.unique(rows["term"].to_numpy(np.int64), return_inverse=True)
    by = np.lexsort((term, query))
    block = Block(len(ids), terms, query[by], term[by], rows["weight"].to_numpy(np.int64)[by])
    segments, spark = index.segments, index.segments.sparkSession
    if not len(ids):
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    least, only = np.ones(len(ids), np.int64), {}
    for q, m, s in _first_segments(segments, block).toPandas().itertuples(index=False):
        only.setdefault((m, s), []).append(q)
    places = spark.createDataFrame([(int(m), int(s)) for m, s in only], "m long, segment int")
    # At most FIRST segments a query of the block.
    seen = _visit(segments.join(F.broadcast(places), ["m", "segment"], "left_semi").select(*segments.columns), block, k, least, only)
    for q, score in _ranked(seen, k).where(F.col("rank") == k).select("query", "score").toPandas().itertuples(index=False):
        least[q] = score
    names = spark.createDataFrame(pd.DataFrame({"query": np.arange(len(ids)), "item": ids}), "query long, item long")
    best = _ranked(_visit(segments, block, k, least), k).join(F.broadcast(names), "query")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return best.select(null("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), null("doc").alias("doc_id"), "score")
