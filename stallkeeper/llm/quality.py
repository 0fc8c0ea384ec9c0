"""Quality classifier: a sparse ensemble of rules over text statistics.

One pass turns each text into statistics. A random forest over all labelled rows proposes conjunctive rules (the paths to its
nodes); a lasso logistic regression keeps few of them; the kept rules become one Spark column expression for the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm import words as W
from stallkeeper.session import stored

STATS = (
    "log_bytes", "mean_word", "upper", "digits", "punctuation", "line_ends", "bare_symbols", "closing_symbols", "repeated_neighbours",
    "distinct_words", "distinct_runs", "longest_repeat",
)
TREES, DEPTH, LASSO, SEED = 20, 3, 0.002, 7

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])


def _share(marked: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    if marked.dtype == bool:
        total = np.searchsorted(np.flatnonzero(marked), at)
    else:
        total = np.concatenate([[0], np.cumsum(marked)])[at]
    return np.diff(total) / np.maximum(n, 1)


def _distinct(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Number of distinct values by text; 44 bits tell the values of a text apart."""
    found = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))
    return np.bincount((found >> np.uint64(44)).astype(np.intp), minlength=texts)


def text_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x STATS. Shares are of bytes or of words; an empty text has zeros, and full shares of distinct words and runs."""
    words = W.split(data, offsets, W.VISIBLE)
    size, n = np.diff(offsets), words.counts()
    hashes, owner = words.hashes(), words.texts()
    marks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_MARK[data], out=marks[1:])
    length = words.end - words.begin
    bare = (marks[words.end] - marks[words.begin]) == length
    closing = (length >= 3) & ((marks[words.end] - marks[np.maximum(words.end - 2, 0)]) == 2)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    runs, runs_at = W.shingles(hashes, words.first, 3)
    run_owner = np.repeat(np.arange(len(size)), np.diff(runs_at))
    # Longest stretch of equal neighbours, as a share of the words.
    place = np.arange(len(same))
    start = np.maximum.accumulate(np.where(same, 0, place)) if len(same) else place
    longest = np.zeros(len(size))
    np.maximum.at(longest, owner, place - start)
    distinct_words = np.where(n > 0, _distinct(hashes, owner, len(size)) / np.maximum(n, 1), 1.0)
    number = np.diff(runs_at)
    distinct_runs = np.where(number > 0, _distinct(runs, run_owner, len(size)) / np.maximum(number, 1), 1.0)
    columns = [
        np.log1p(size), _share(length, words.first, n), _share(_UPPER[data], offsets, size), _share(_DIGIT[data], offsets, size), _share(_MARK[data], offsets, size), _share(data == 10, offsets, size),
        _share(bare, words.first, n), _share(closing, words.first, n), _share(same, words.first, n), distinct_words, distinct_runs, longest / np.maximum(n, 1),
    ]
    return np.stack(columns, axis=1).astype(float)


def with_stats(docs: DataFrame, keep_text: bool) -> DataFrame:
    """`docs` with one double column for each of STATS; columns of those names are replaced."""
    rest = [c for c in docs.columns if c not in STATS and (keep_text or c != "text")]
    schema = docs.select(*rest).schema
    for name in STATS:
        schema = schema.add(name, "double")

    sent = rest if "text" in rest else [*rest, "text"]  # once, whether it is kept or not
    place = sent.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column(place)):
                found = text_stats(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(len(rest))), *(pa.array(found[:, k]) for k in range(len(STATS)))], [*rest, *STATS])

    return docs.select(*sent).mapInArrow(run, schema)


@dataclass
class Rules:
    """Kept rules as SQL conditions with weights, and the intercept of the log odds."""

    conditions: list[str]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        odds = F.lit(self.intercept)
        for condition, weight in zip(self.conditions, self.weights, strict=True):
            odds = odds + F.when(F.expr(condition), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def tree_paths(node, bounds: dict[int, tuple[float, float]] | None = None) -> Iterator[dict[int, tuple[float, float]]]:
    """For each node but the root the interval (above, up to) that its path sets for each statistic."""
    bounds = bounds or {}
    if bounds:
        yield bounds
    if node.subtreeDepth() > 0:
        split = node.split()
        k, cut = split.featureIndex(), split.threshold()
        low, high = bounds.get(k, (float("-inf"), float("inf")))
        yield from tree_paths(node.leftChild(), bounds | {k: (low, min(high, cut))})
        yield from tree_paths(node.rightChild(), bounds | {k: (max(low, cut), high)})


def condition(bounds: dict[int, tuple[float, float]]) -> str:
    parts = []
    for k, (low, high) in sorted(bounds.items()):
        parts += [f"{STATS[k]} > {low!r}D"] * (low > float("-inf")) + [f"{STATS[k]} <= {high!r}D"] * (high < float("inf"))
    return " AND ".join(parts)


def learn(labelled: DataFrame) -> Rules:
    """Rules from `labelled` (label 0 or 1, STATS): all its rows, over Spark. Without both labels the score is a constant."""
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Rules([], [], {0: -3.0, 1: 3.0}.get(next(iter(totals), None), 0.0))
    rows = VectorAssembler(inputCols=list(STATS), outputCol="stats").transform(labelled)
    # Whatever the shares of the labels, both weigh the same when rules are sought.
    weight = F.when(F.col("label") == 1, sum(totals.values()) / 2 / totals[1]).otherwise(sum(totals.values()) / 2 / totals[0])
    rows = rows.withColumn("weight", weight)
    forest = RandomForestClassifier(labelCol="label", featuresCol="stats", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=3, featureSubsetStrategy="onethird", seed=SEED).fit(rows)
    conditions = sorted({condition(b) for tree in forest.trees for b in tree_paths(tree._call_java("rootNode"))})
    if not conditions:
        return Rules([], [], float(np.log(totals[1] / totals[0])))
    ruled = rows.select("label", array_to_vector(F.array(*(F.expr(c).cast("double") for c in conditions))).alias("rules"))
    fit = LogisticRegression(labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(ruled)
    kept = [(c, float(w)) for c, w in zip(conditions, fit.coefficients.toArray(), strict=True) if w]
    return Rules([c for c, _ in kept], [w for _, w in kept], float(fit.intercept))


def fit(docs_with_stats: DataFrame, labels: DataFrame, name: str = "quality") -> Rules:
    """Rules from the rows of `docs_with_stats` (doc_id, STATS) that `labels` (doc_id, name) has.

    A document labelled several times counts once, with its smallest label; null labels and ids count for nothing.
    """
    marks = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(name).cast("double").alias("label"))
    rows = docs_with_stats.select("doc_id", *STATS).join(marks, "doc_id").select("label", *STATS)
    return learn(stored(rows, "labelled"))
