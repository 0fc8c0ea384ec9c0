"""Language identification with bit-sliced Bloom filters over byte n-grams.

Every language has a Bloom filter of the n-grams that are its own; the filters are stored across, so that row r holds bit r of
all of them as a bitmask. One look at HASHES rows, joined by AND, returns all languages that contain an n-gram. A text's
popcounts by language, less the share that false positives explain, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm import words as W
from stallkeeper.session import stored

GRAM, HASHES, ROWS = 4, 3, 1 << 20
#: An n-gram belongs to a language if its share there is at least this part of its largest share in any.
OWN = 0.25
#: Least part of the typical coverage of a language that a text in it has.
TYPICAL = 0.5

_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
#: Languages in each value of an eight-bit mask.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if _LETTER[b] else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams of texts, with all between words as one space, as integers; and their offsets by text.

    Capitals of ASCII and of the Latin-1 letters count as small letters; those of other scripts stand for themselves.
    """
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[firsts] = letter[firsts]
    ends = np.searchsorted(np.flatnonzero(keep), offsets)
    plain = _PLAIN[data[keep]]
    if len(plain) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    plain[1:] += ((plain[:-1] == 0xC3) & (plain[1:] >= 0x80) & (plain[1:] <= 0x9E)).astype(np.uint8) * np.uint8(32)
    wide = plain.astype(np.uint32)
    out = wide[: len(wide) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out |= wide[k : k + len(out)] << np.uint32(8 * k)
    whole = np.ones(len(plain), bool)
    for k in range(1, GRAM):
        whole[(ends[1:] - k)[ends[1:] - k >= ends[:-1]]] = False
    number = np.maximum(np.diff(ends) - GRAM + 1, 0)
    return out[whole[: len(out)]], np.concatenate([[0], np.cumsum(number)])


def places(values: np.ndarray) -> Iterator[np.ndarray]:
    """The filter rows of each n-gram, one array for each hash."""
    h = W.mix(values.astype(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for _ in range(HASHES):
        yield (h & np.uint64(ROWS - 1)).astype(np.intp)
        h += step


@dataclass
class Filters:
    """`masks`: for each eight languages ROWS bitmasks; `wrong`: chance of a false positive by language; `prior`: shares of training texts."""

    languages: list[str]
    masks: list[np.ndarray]
    wrong: np.ndarray
    prior: np.ndarray

    def popcounts(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts x languages: how many n-grams of each text are in each language's filter."""
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        rows = list(places(values))
        out = []
        for group in self.masks:
            found = group[rows[0]]
            for more in rows[1:]:
                found &= group[more]
            of = np.bincount(owner * 256 + found, minlength=256 * (len(at) - 1)).reshape(-1, 256)
            out.append(of @ _BITS)
        return np.concatenate(out, axis=1)[:, : len(self.languages)].astype(float)

    def decide(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, coverage) of each text: the score is the language's part of all corrected counts, the
        coverage that of the text's n-grams which its filter has, corrected too."""
        n = np.diff(at)[:, None]
        true = np.maximum(0.0, (self.popcounts(values, at) - n * self.wrong) / np.maximum(1e-9, 1 - self.wrong))
        total = true.sum(axis=1, keepdims=True)
        share = np.where(total > 0, true / np.where(total > 0, total, 1), self.prior)
        best = np.argmax(share + 1e-12 * self.prior, axis=1)
        each = np.arange(len(best))
        return best, np.clip(share[each, best], 0.0, 1.0), np.clip(true[each, best] / np.maximum(1, n[:, 0]), 0.0, 1.0)


def _counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for lo, hi, data, offsets in W.slices(batch.column(1)):
                values, at = grams(data, offsets)
                owner = np.repeat(np.arange(hi - lo), np.diff(at))
                for name in dict.fromkeys(lang[lo:hi]):
                    mine = np.array([x == name for x in lang[lo:hi]])
                    found, n = np.unique(values[mine[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def learn(docs: DataFrame) -> Filters | None:
    """Filters from all rows of `docs` (text, lang) with both; None without any. What reaches the driver is bounded by ROWS
    masks for each eight languages."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    texts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in texts]
    if not languages:
        return None
    counts = stored(_counts(rows).groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = docs.sparkSession.createDataFrame([(x, i, float(totals.get(x, 1))) for i, x in enumerate(languages)], "lang string, number int, total double")
    shares = counts.join(names, "lang").select("gram", "number", (F.col("n") / F.col("total")).alias("share"))
    by_gram = shares.groupBy("gram").agg(F.collect_list(F.struct("number", "share")).alias("of"), F.max("share").alias("most"))
    kept = by_gram.select("gram", F.explode("of").alias("x"), "most").where(F.col("x.share") >= OWN * F.col("most")).select("gram", F.col("x.number").alias("number"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in places(values):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(number // 8, pa.int32()), pa.array(1 << (number % 8), pa.int32())], ["row", "word", "mask"])

    found = kept.mapInArrow(bits, "row long, word int, mask int").groupBy("row", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    row, word, mask = (found[c].to_numpy() for c in ("row", "word", "mask"))
    masks = [np.zeros(ROWS, np.uint8) for _ in range((len(languages) - 1) // 8 + 1)]
    for k, group in enumerate(masks):
        group[row[word == k]] = mask[word == k]
    filled = np.array([np.count_nonzero(masks[i // 8] >> (i % 8) & 1) for i in range(len(languages))])
    n = np.array([r["n"] for r in texts], float)
    return Filters(languages, masks, (filled / ROWS) ** HASHES, n / n.sum())


def coverage_bounds(docs: DataFrame) -> dict[str, float]:
    """The least coverage of a text in each language, from all rows of `docs` (text, lang) with both.

    A quarter of the texts (by their hash, so that copies stay together) is held out; the bound of a language is TYPICAL of the
    median coverage of its held-out texts by filters learnt from the others, whatever other languages there are. A language
    without a held-out text has the bound 0.
    """
    marked = docs.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("__out", F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    found = identify(marked.where("__out").select("lang", "text"), learn(marked.where(~F.col("__out"))), coverage="coverage")
    rows = found.where("lang = lang_pred").groupBy("lang").agg(F.percentile_approx("coverage", 0.5, 1000).alias("median")).collect()
    return {r["lang"]: TYPICAL * r["median"] for r in rows}


def covered(bounds: dict[str, float], coverage: str) -> Column:
    """Whether the text's coverage is above 0 and not below the bound of lang_pred."""
    least = F.lit(0.0)
    for name, bound in bounds.items():
        least = F.when(F.col("lang_pred") == name, F.lit(bound)).otherwise(least)
    return (F.col(coverage) > 0) & (F.col(coverage) >= least)


def identify(docs: DataFrame, filters: Filters | None, coverage: str | None = None) -> DataFrame:
    """All columns of `docs` (text, ...) with lang_pred and score, and with the text's coverage in a column of that name.

    A null text, or one without a letter, is `und` with score 0, as is every text without filters. A text with letters whose
    n-grams no filter has gets the language most frequent in training, with its share as score. Ties go to the language more
    frequent there, then the first by name. The coverage is the part of the text's n-grams that the filter of lang_pred has,
    less what false positives explain: 0 where none is found. Columns of these names are replaced.
    """
    added = ["lang_pred", "score"] + ([coverage] if coverage else [])
    rest = [c for c in docs.columns if c not in added]
    place = rest.index("text")
    lettered = docs.select(*rest, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    schema = schema.add(coverage, "double") if coverage else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(rest)
            for lo, hi, data, offsets in W.slices(batch.column(place)):
                letters = np.array(batch.column(k).slice(lo, hi - lo).to_pylist(), bool)
                if filters is None:
                    names, score, part = ["und"] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo)
                else:
                    best, score, part = filters.decide(*grams(data, offsets))
                    names, score, part = [filters.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)], score * letters, part * letters
                found = [pa.array(names, pa.string()), pa.array(score), pa.array(part)][: len(added)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(k)), *found], [*rest, *added])

    return lettered.mapInArrow(run, schema)
