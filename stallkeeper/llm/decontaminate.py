"""Benchmark decontamination: a prefix-filtered join of item windows with documents, confirmed word by word.

An item's windows are its runs of WINDOW words (the whole item if shorter). A window can only occur where all its shingles
do, so one necessary shingle is enough to find it: the rarest by the counts over all documents. Documents are joined on
these prefix shingles only; bounds on length and position and an exact comparison of the window's words follow.

Before the join, bitmaps drop document shingles that no window has. A bitmap has FILTER_BITS bits whatever the size of the
benchmark, so what is sent to the executors is bounded; a larger benchmark lets more shingles through to the join, which
stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm import words as W
from stallkeeper.llm.bitmap import bitmap, dense, has_bits
from stallkeeper.session import stored

WINDOW, SHINGLE = 10, 5


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, words, length, width, tokens): every window of every item, tokens being its shingle hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in W.slices(batch.column(1)):
                words = W.split(data, offsets, W.ALNUM)
                hashes, out = words.hashes(), []
                for i in range(hi - lo):
                    first, last = int(words.first[i]), int(words.first[i + 1])
                    length = min(window, last - first)
                    width = min(shingle, length)
                    if length:
                        runs, _ = W.shingles(hashes[first:last], np.array([0, last - first]), width)
                        for start in range(first, last - length + 1):
                            at = start - first
                            out.append((ids[lo + i], words.joined(start, start + length).decode(), length, width, runs[at : at + length - width + 1].view(np.int64)))
                if out:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["item_id", "words", "length", "width", "tokens"])

    source = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return source.mapInArrow(run, "item_id long, words string, length int, width int, tokens array<long>")


def _passing(words: W.Words, hashes: np.ndarray, width: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash) of the shingles that the bitmap has."""
    runs, at = W.shingles(hashes, words.first, width)
    hit = np.flatnonzero(has_bits(cells, runs))
    text = np.searchsorted(at, hit, "right") - 1
    return text, hit - at[text], runs[hit]


def shingle_counts(docs: DataFrame, sparse: tuple, widths: list[int]) -> DataFrame:
    """(token, n): how often each shingle that the bitmap has stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = dense(sparse)
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for _, _, data, offsets in W.slices(batch.column(0)):
                words = W.split(data, offsets, W.ALNUM)
                hashes = words.hashes()
                found += [_passing(words, hashes, w, cells)[2] for w in widths]
            tokens, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


PLACES = "array<struct<token:long,place:int,lead:int,around:string>>"


def marked(docs: DataFrame, sparse: tuple, widths: list[int], window: int) -> DataFrame:
    """(doc_id, digest, n_words, places) for each row of `docs`: the shingles that the bitmap has, with the words around them."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32()), ("lead", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = dense(sparse)
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column(2)):
                words = W.split(data, offsets, W.ALNUM)
                hashes, places = words.hashes(), [[] for _ in range(hi - lo)]
                for width in widths:
                    for i, place, token in zip(*_passing(words, hashes, width, cells), strict=True):
                        first, last = int(words.first[i]), int(words.first[i + 1])
                        lead = min(int(place), window - width)
                        at = first + int(place)
                        around = words.joined(at - lead, min(last, at + window)).decode()
                        places[i].append((int(token.view(np.int64)), int(place), lead, around))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(words.counts(), pa.int64()), pa.array([[dict(zip(("token", "place", "lead", "around"), p, strict=True)) for p in x] for x in places], kind)],
                    ["doc_id", "digest", "n_words", "places"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return source.mapInArrow(run, f"doc_id long, digest long, n_words long, places {PLACES}")


def _covered(spans: str) -> Column:
    """Number of words in the union of an array of (start, stop)."""
    return F.expr(f"""aggregate(array_sort({spans}), named_struct('n', 0L, 'top', 0L),
        (s, x) -> named_struct('n', s.n + greatest(0L, x.stop - greatest(s.top, x.start)), 'top', greatest(s.top, x.stop)), s -> s.n)""")


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, windows), written to the shared folder.

    documents: (doc_id, digest, n_words, places) per row; hits: (doc_id, digest, words, start, stop), each occurrence of a
    window as words [start, stop) of the document; windows: (item_id, words).
    """
    windows = stored(item_windows(items, window, shingle), "windows")
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())
    distinct = stored(windows.select("words", "length", "width", "tokens").dropDuplicates(["words"]), "distinct")
    tokens = distinct.select("words", "length", F.posexplode("tokens").alias("at", "token"))
    counts = stored(shingle_counts(docs, bitmap(tokens), widths), "counts")
    # A window with a shingle that no document has occurs nowhere.
    rarest = tokens.join(counts, "token", "left").groupBy("words", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("r"))
    prefixes = stored(rarest.where("r.n > 0").select("words", F.col("length").cast("long").alias("length"), F.col("r.token").alias("token"), F.col("r.at").alias("at")), "prefixes")
    documents = stored(marked(docs, bitmap(prefixes), widths, window), "marked")
    places = documents.select("doc_id", "digest", "n_words", F.explode("places").alias("p")).select("doc_id", "digest", "n_words", "p.*")
    start = F.col("place") - F.col("at")
    found = places.join(prefixes, "token").where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    found = found.where("array_join(slice(split(around, ' '), lead - at + 1, int(length)), ' ') = words")
    hits = found.select("doc_id", "digest", "words", start.cast("long").alias("start"), (start + F.col("length")).alias("stop"))
    return documents, stored(hits, "hits"), windows


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for each row of `docs` (doc_id, text, ...).

    n_hit counts document words inside any occurrence of an item's window, items are the distinct ids of items with a
    window there (null ids are left out). Null and empty texts have no words: such a document is clean, such an item has no
    windows. Repeated rows of a document each get the same result; a doc_id with several texts gets one for each text.
    Repeated items change nothing. Other columns are not read.
    """
    documents, hits, windows = window_hits(docs, items, window, shingle)
    key = ["doc_id", "digest"]
    spans = hits.groupBy(*key).agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(*key, _covered("spans").alias("n_hit"))
    named = hits.select(*key, "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
    named = named.groupBy(*key).agg(F.collect_set("item_id").alias("items"))
    found = spans.join(named, [spans["doc_id"].eqNullSafe(named["doc_id"]), spans["digest"] == named["digest"]], "left").select(spans["doc_id"].alias("id"), spans["digest"].alias("text"), "n_hit", "items")
    rows = documents.select("doc_id", "digest", "n_words")
    out = rows.join(found, [rows["doc_id"].eqNullSafe(found["id"]), rows["digest"] == found["text"]], "left")
    items_ = F.coalesce("items", F.array().cast("array<long>"))
    return out.select("doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
