"""Hierarchical Pitman-Yor language model over words and their spelling, with a word baseline.

The top restaurant serves words: a token has the chance (c - d) / (N + s) of its c training occurrences, plus what the
restaurant leaves to its parent, (s + d V) / (N + s), times the probability of the word's spelling. (A kind of word has one
table: a spelling is so unlikely that a second table is rare.) Spelling is a hierarchy of byte restaurants: texts are
lower-cased words, each with a space behind, and a line end as the end token, and each byte is predicted from up to
ORDER - 1 bytes before it, across words. Every context is a restaurant whose customers are the bytes seen after it; each table there is
one customer in the restaurant of the context without its first byte, up to the empty context, whose tables are drawn evenly
from all 256 bytes. Seating is sampled by Gibbs sweeps, and predictive probabilities are averaged over the samples.

All training bytes are counted, and every kind of customer (context, byte) sits in the restaurant of its context, also one
seen once. Seated kinds stay in Spark tables. The kinds that the texts ask for are counted, and their probabilities are taken
level by level next to the seating of their sub-tree; those of the most frequent kinds (at most HEAD_KINDS) go to the
executors, those of all others are joined. The split changes no result.

Seating runs in Spark: contexts that end in the same two bytes form a sub-tree, sampled by one task given the probabilities of
the two shortest levels. Those (at most 256 x 256 kinds) are seated by the driver after each round from the tables gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm import words as W
from stallkeeper.session import stored

ORDER = 5
ROUNDS, BURN_IN, SWEEPS = 3, 1, 3
STRENGTH = 1.0
#: Customers seated one by one; beyond, in blocks that grow by half, each with one draw of its number of new tables.
SINGLY = 32
#: Words whose counts, and byte kinds whose probabilities, every executor gets; the others are joined.
HEAD_WORDS = HEAD_KINDS = 1 << 19
END = 10
U64 = np.uint64


class Table:
    """Sorted distinct 64-bit keys with a bucket index, for lookups of whole arrays."""

    def __init__(self, keys: np.ndarray):
        spread = W.mix(keys)
        self.order = np.argsort(spread)
        self.spread = spread[self.order]
        bits = max(1, len(keys).bit_length())
        self.shift = U64(64 - bits)
        self.start = np.searchsorted(self.spread, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        self.deepest = int(np.diff(np.append(self.start, len(keys))).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of `keys` in the array that the table was made of, -1 where missing."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.spread):
            return out
        want = W.mix(keys)
        at = self.start[(want >> self.shift).astype(np.int64)]
        open_ = np.arange(len(keys))
        for _ in range(self.deepest):
            there = at < len(self.spread)
            open_, at, want = open_[there], at[there], want[there]
            have = self.spread[at]
            hit = have == want
            out[open_[hit]] = self.order[at[hit]]
            more = have < want
            open_, at, want = open_[more], at[more] + 1, want[more]
            if not len(open_):
                break
        return out


def stream(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the model reads and their offsets by text; each text starts with ORDER - 1 zero bytes."""
    length = words.end - words.begin
    texts = len(words.offsets) - 1
    each = np.bincount(words.texts(), weights=length + 1, minlength=texts).astype(np.int64)
    size = each + ORDER  # the end, and the zero bytes before the text
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(offsets[-1]), 32, np.uint8)
    for k in range(ORDER - 1):
        out[offsets[:-1] + k] = 0
    out[offsets[1:] - 1] = END
    if len(length):
        before = np.concatenate([[0], np.cumsum(length + 1)])
        at = offsets[:-1][words.texts()] + ORDER - 1 + before[:-1] - before[words.first[:-1]][words.texts()]
        inside = np.repeat(at - words.begin, length)
        source = np.repeat(words.begin, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[source + inside] = W._LOWER[words.data[source]]
    return out, offsets


def keys_of(out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind, text) of each predicted byte: the byte in the low 8 bits, the bytes before it above, nearest lowest."""
    n = len(out) - ORDER + 1
    keys = np.zeros(n, np.uint64)
    for k in range(ORDER):
        keys |= out[k : k + n].astype(np.uint64) << U64(8 * (ORDER - 1 - k))
    whole = np.ones(n, bool)
    for k in range(1, ORDER):
        whole[offsets[1:-1] - k] = False
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) - ORDER + 1)
    return keys[whole], text


def shorten(keys: np.ndarray, level: int) -> np.ndarray:
    """Kinds with the nearest `level` context bytes only."""
    return keys & U64((1 << 8 * (level + 1)) - 1)


def seat(counts: np.ndarray, base: np.ndarray, tables: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Number of tables of each kind: customers of a kind arrive one after the other and open a new table with the chance
    that the restaurant (with `tables` tables in all) and the probability `base` of the kind in the shorter context give."""
    t = np.minimum(counts, 1).astype(np.float64)
    done, block = 1, 1
    new = (STRENGTH + discount * tables) * base
    active = np.flatnonzero(counts > 1)
    while len(active):
        size = np.minimum(block, counts[active] - done)
        sitting = np.maximum(done + (size - 1) / 2 - discount * t[active], 0)
        chance = new[active] / (new[active] + sitting)
        t[active] += rng.binomial(size, np.clip(chance, 0, 1))
        done += block
        block = 1 if done < SINGLY else done // 2
        active = active[counts[active] > done]
    return np.minimum(t, counts).astype(np.int64)


def gather(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=values, minlength=len(found)).astype(np.int64)


def predictive(keys: np.ndarray, c: np.ndarray, t: np.ndarray, base: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each kind, contexts, what a context leaves to the shorter one)."""
    contexts, at = np.unique(keys >> U64(8), return_inverse=True)
    customers = np.bincount(at, weights=c, minlength=len(contexts))
    left = (STRENGTH + discount * np.bincount(at, weights=t, minlength=len(contexts))) / (STRENGTH + customers)
    return (c - discount * t) / (STRENGTH + customers)[at] + left[at] * base, contexts, left


def lookup(keys: np.ndarray, probability: np.ndarray, contexts: np.ndarray, left: np.ndarray, wanted: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Probability of `wanted` kinds in a level, given `base`, theirs in the shorter context."""
    out = base.copy()
    if len(contexts):
        at = np.minimum(np.searchsorted(contexts, wanted >> U64(8)), len(contexts) - 1)
        out = np.where(contexts[at] == wanted >> U64(8), left[at] * base, base)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out = np.where(keys[at] == wanted, probability[at], out)
    return out


def sub_tree(keys: np.ndarray, counts: np.ndarray, discounts: list[float], top: np.ndarray, rng: np.random.Generator) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
    """Gibbs sweeps over the levels ORDER - 1 to 2 of one sub-tree; `top`: probabilities of kinds with one context byte.

    Returns (keys, customers, tables) of each level, longest contexts first, and the customers sent to level 1. The first
    sweep seats by `top` alone; each later one by the probabilities that the seating so far gives.
    """
    state: dict[int, tuple] = {}
    below: dict[int, tuple] = {}

    def shorter(k: np.ndarray, level: int) -> np.ndarray:
        """Probability of kinds in the next shorter context, by the seating so far."""
        base = top[shorten(k, 1).astype(np.int64)]
        for lower in range(2, level):
            if lower in below:
                base = lookup(state[lower][0], *below[lower], shorten(k, lower), base)
        return base

    for _ in range(SWEEPS):
        rising_keys, rising = keys, counts
        fresh: dict[int, tuple] = {}
        for level in range(ORDER - 1, 1, -1):
            k, c = rising_keys, rising
            contexts, at = np.unique(k >> U64(8), return_inverse=True)
            # Every kind has a table, so a level has the same kinds in each sweep.
            tables = np.bincount(at, weights=state[level][2] if level in state else None, minlength=len(contexts)).astype(np.float64)
            t = seat(c, shorter(k, level), tables[at], discounts[level], rng)
            fresh[level] = (k, c, t)
            rising_keys, rising = gather(shorten(k, level - 1), t)
        state, below = fresh, {}
        for level in range(2, ORDER):
            k, c, t = state[level]
            below[level] = predictive(k, c, t, shorter(k, level), discounts[level])
    return [(level, *state[level]) for level in range(ORDER - 1, 1, -1)], (rising_keys, rising)


def chances(wanted: np.ndarray, levels: dict[int, tuple], top: np.ndarray, discounts: list[float]) -> np.ndarray:
    """Probability of `wanted` kinds by the seating (kinds, customers, tables) of each level of their sub-tree."""
    out = top[shorten(wanted, 1).astype(np.int64)]
    below: list[tuple] = []
    for level in range(2, ORDER):
        k, c, t = levels[level]
        base = top[shorten(k, 1).astype(np.int64)]
        for lower, found in enumerate(below, 2):
            base = lookup(*found, shorten(k, lower), base)
        p, contexts, left = predictive(k, c, t, base, discounts[level])
        below.append((k, p, contexts, left))
        out = lookup(*below[-1], shorten(wanted, level), out)
    return out


BRANCH = "shiftright(kind, 8) & 65535 AS branch"


@dataclass
class Model:
    """`seated`: (sample, branch, level, kind, c, t) of the levels of at least two context bytes; `tops`: for each sample the
    probabilities of all kinds with one."""

    seated: DataFrame
    tops: list[np.ndarray]
    discounts: list[float]

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(kind, p) for each row of `wanted` (kind): the mean over the samples of its probability."""
        tops, discounts = self.tops, self.discounts

        def run(asked: pa.Table, seated: pa.Table) -> pa.Table:
            keys = asked["kind"].to_numpy().astype(np.uint64)
            sample, level, kind, c, t = (seated[x].to_numpy() for x in ("sample", "level", "kind", "c", "t"))
            total = np.zeros(len(keys))
            for s, top in enumerate(tops):
                levels = {}
                for k in range(2, ORDER):
                    at = np.flatnonzero((sample == s) & (level == k))
                    at = at[np.argsort(kind[at])]
                    levels[k] = (kind[at].astype(np.uint64), c[at], t[at])
                total += chances(keys, levels, top, discounts)
            return pa.table({"kind": asked["kind"], "p": pa.array(total / len(tops))})

        asked = wanted.select("kind", F.expr(BRANCH))
        return asked.groupBy("branch").cogroup(self.seated.groupBy("branch")).applyInArrow(run, "kind long, p double")

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each of a few kinds."""
        spark = self.seated.sparkSession
        found = self.probabilities(spark.createDataFrame([(int(k),) for k in np.unique(keys)], "kind long")).toArrow()
        kinds, p = found["kind"].to_numpy().astype(np.uint64), found["p"].to_numpy()
        return np.log10(p[np.argsort(kinds)][np.searchsorted(np.sort(kinds), keys)])


def kind_counts(texts: DataFrame) -> DataFrame:
    """(kind, n, asked) over all `texts` (train, text): occurrences in the texts where `train` is true, and in all. Summed
    within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            # Counts of the training texts and of the others.
            held: tuple[list, list] = ([], [])
            size = 0
            for lo, hi, data, offsets in W.slices(batch.column(1)):
                keys, text = keys_of(*stream(W.split(data, offsets, W.VISIBLE)))
                learnt = train[lo:hi][text]
                for part, mine in zip(held, (learnt, ~learnt), strict=True):
                    part.append(np.unique(keys[mine], return_counts=True))
                    size += len(part[-1][0])
                if size > 1 << 21:
                    held = tuple([gather(np.concatenate([k for k, _ in p]), np.concatenate([n for _, n in p]))] for p in held)
                    size = sum(len(p[0][0]) for p in held)
            for part, learnt in zip(held, (1, 0), strict=True):
                if part:
                    keys, n = gather(np.concatenate([k for k, _ in part]), np.concatenate([n for _, n in part]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n * learnt), pa.array(n)], ["kind", "n", "asked"])

    counted = texts.select("train", "text").mapInArrow(run, "kind long, n long, asked long")
    return counted.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))


def seat_top(keys: np.ndarray, customers: np.ndarray, tables: tuple | None, discounts: list[float], rng: np.random.Generator) -> tuple[np.ndarray, tuple]:
    """Seats the levels 1 and 0 and returns the probabilities of all 65,536 kinds with one context byte, and the state."""
    k1, c1 = keys, customers
    even = np.full(256, 1 / 256)
    p0 = tables[1] if tables else even
    contexts, at = np.unique(k1 >> U64(8), return_inverse=True)
    sitting = tables[0] if tables else np.bincount(at, minlength=len(contexts))
    seated = sitting if len(sitting) == len(contexts) else np.bincount(at, minlength=len(contexts))
    t1 = seat(c1, p0[shorten(k1, 0).astype(np.int64)], seated[at] if len(k1) else np.zeros(0), discounts[1], rng)
    c0 = np.bincount(shorten(k1, 0).astype(np.int64), weights=t1, minlength=256).astype(np.int64)
    t0 = seat(c0, even, np.full(256, max(1, np.count_nonzero(c0))), discounts[0], rng)
    p0 = ((c0 - discounts[0] * t0) + (STRENGTH + discounts[0] * t0.sum()) * even) / (STRENGTH + c0.sum())
    out = np.tile(p0, 256)
    if len(k1):
        p, ctx, left = predictive(k1, c1, t1, p0[shorten(k1, 0).astype(np.int64)], discounts[1])
        for context, share in zip(ctx.astype(int), left, strict=True):
            out[context * 256 : context * 256 + 256] = share * p0
        out[k1.astype(np.int64)] = p
    return out, (np.bincount(at, weights=t1, minlength=len(contexts)), p0)


SEATED = "level int, kind long, c long, t long"


def _sampler(discounts: list[float], top: np.ndarray, seed: int, turn: int):
    def sample(table: pa.Table) -> pa.Table:
        keys, n = table["kind"].to_numpy().astype(np.uint64), table["n"].to_numpy()
        order = np.argsort(keys)
        draws = np.random.default_rng([seed, turn, int(table["branch"][0].as_py())])
        levels, (up, customers) = sub_tree(keys[order], n[order], discounts, top, draws)
        parts = [(np.full(len(k), level), k, c, t) for level, k, c, t in levels] + [(np.ones(len(up), np.int64), up, customers, customers)]
        level, k, c, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"level": pa.array(level, pa.int32()), "kind": pa.array(k.astype(np.int64)), "c": pa.array(c, pa.int64()), "t": pa.array(t, pa.int64())})

    return sample


def learn(texts: DataFrame, seed: int = 1) -> Model:
    """The model of all `texts` (text). Without any, every byte has the same probability."""
    return learn_counts(stored(kind_counts(texts.select(F.lit(True).alias("train"), "text")), "kinds"), seed)


def learn_counts(kinds: DataFrame, seed: int = 1) -> Model:
    """The model of all `kinds` (kind, n, ...) with n above 0, a table that is read several times."""
    counts = kinds.where("n > 0").select("kind", "n", F.expr(BRANCH))
    ones, twos = counts.agg(F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    discount = min(0.9, max(0.1, (ones or 0) / max(1, (ones or 0) + 2 * (twos or 0))))
    discounts = [discount * (k + 1) / ORDER for k in range(ORDER)]
    rng = np.random.default_rng(seed)
    first = counts.groupBy(F.expr("kind & 65535").alias("kind")).agg(F.sum("n").alias("n")).orderBy("kind").toArrow()
    top, tables = seat_top(first["kind"].to_numpy().astype(np.uint64), first["n"].to_numpy(), None, discounts, rng)
    samples, tops = [], []
    for turn in range(ROUNDS):
        seated = stored(counts.groupBy("branch").applyInArrow(_sampler(discounts, top, seed, turn), SEATED), "seated")
        sent = seated.where("level = 1").groupBy("kind").agg(F.sum("c").alias("c")).orderBy("kind").toArrow()
        top, tables = seat_top(sent["kind"].to_numpy().astype(np.uint64), sent["c"].to_numpy(), tables, discounts, rng)
        if turn >= BURN_IN:
            samples.append(seated.where("level > 1").select(F.lit(len(samples)).alias("sample"), F.expr(BRANCH), "level", "kind", "c", "t"))
            tops.append(top)
    return Model(reduce(DataFrame.union, samples), tops, discounts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): 64-bit hashes of the words of all `texts` with their counts, summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(W.split(data, offsets, W.VISIBLE).hashes(), return_counts=True) for _, _, data, offsets in W.slices(batch.column(0))]
            if parts:
                words, n = gather(np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head(counts: DataFrame, most: int) -> tuple[pa.Table, float]:
    """(rows, least count): the rows of `counts` (n, ...) of largest n, at most `most`, cut at a count class; all others have less."""
    steps = F.floor(F.log2("n") * 8)
    least, held = float("inf"), 0
    for row in sorted(counts.groupBy(steps.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):
        held += row["rows"]
        if held > most:
            break
        least = float(row["least"])
    return counts.where(F.col("n") >= least).toArrow(), least


def score(docs: DataFrame, held_out: str, seed: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs` (doc_id, text, ...).

    Learns from the rows where the boolean column `held_out` is false, and from nothing where it is null. A text's tokens are
    its words and one end; a null or empty text is the end alone. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over
    the tokens; `score` is the model's log10 probability of the text as the module describes. Repeated rows count each.
    Words are told apart by 64-bit hashes. The counts of frequent words (at most HEAD_WORDS) and the probabilities of frequent
    byte kinds (at most HEAD_KINDS) go to the executors, those of all others are joined.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(held_out).alias("held_out"), "text")
    train = rows.where(~F.col("held_out"))
    ends = train.count()
    counts = stored(word_counts(train), "words")
    spoken, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = spoken + ends, distinct + (ends > 0)
    common, least = head(counts, HEAD_WORDS)
    words, known = common["word"].to_numpy().view(np.uint64), common["n"].to_numpy()
    ones, twos = counts.agg(F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    discount = min(0.9, max(0.1, (ones or 0) / max(1, (ones or 0) + 2 * (twos or 0))))
    seats, spare = STRENGTH + total, (STRENGTH + discount * kinds) / (STRENGTH + total)
    asked = stored(kind_counts(rows.select(F.coalesce(~F.col("held_out"), F.lit(False)).alias("train"), "text")), "kinds")
    found = learn_counts(asked, seed).probabilities(asked)
    spelt = stored(found.join(asked.select("kind", F.col("asked").alias("n")), "kind").select("kind", "n", F.log10("p").alias("p")), "spelt")
    usual, least_asked = head(spelt, HEAD_KINDS)
    kind, chance = usual["kind"].to_numpy().view(np.uint64), usual["p"].to_numpy()
    # Tokens that wait for a join: a rare word (n is null) or one with rare kinds, whose part of the spelling is still open.
    tail = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("spelling", pa.float64()), ("kinds", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, spelling_of = Table(words), Table(kind)
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column(2)):
                split = W.split(data, offsets, W.VISIBLE)
                hashes, owner, n = split.hashes(), split.texts(), hi - lo
                keys, _ = keys_of(*stream(split))
                # Bytes by token: the words of a text, each with its space, then its end.
                size = np.ones(len(hashes) + n, np.int64)
                word_at, end_at = np.arange(len(hashes)) + owner, split.first[1:] + np.arange(n)
                size[word_at] = split.end - split.begin + 1
                first = np.cumsum(size) - size
                place = spelling_of.find(keys)
                unspelt = place < 0
                logs = np.zeros(len(keys))
                logs[~unspelt] = chance[place[~unspelt]]
                spelling = np.add.reduceat(logs, first)
                missing = np.add.reduceat(unspelt.astype(np.int64), first)
                at = table.find(hashes)
                there = at >= 0
                # By token: its text, its training count (-1: not among the frequent words) and its word (0: an end).
                text, count, word = np.empty(len(size), np.int64), np.full(len(size), -1, np.int64), np.zeros(len(size), np.uint64)
                text[word_at], text[end_at], word[word_at] = owner, np.arange(n), hashes
                count[word_at[there]], count[end_at] = known[at[there]], ends
                base = np.bincount(owner[there], weights=np.log10(known[at[there]] + 0.1), minlength=n) + np.log10(ends + 0.1)
                heads = np.bincount(owner[there], minlength=n) + (ends > 0)
                ready = (count >= 0) & (missing == 0)
                whole = np.bincount(text[ready], weights=np.log10(np.maximum(0.0, count[ready] - discount) / seats + spare * 10.0 ** spelling[ready]), minlength=n).astype(float)
                rest = ~ready
                lists = np.concatenate([[0], np.cumsum(np.bincount(text[rest], minlength=n))])
                waiting = np.concatenate([[0], np.cumsum(missing[rest])])
                # Only tokens in `rest` have missing kinds, so these lie in the order of the tokens.
                kinds_of = pa.ListArray.from_arrays(pa.array(waiting, pa.int32()), pa.array(keys[unspelt].view(np.int64)))
                pairs = pa.StructArray.from_arrays([pa.array(word[rest].view(np.int64)), pa.array(count[rest], mask=count[rest] < 0), pa.array(spelling[rest]), kinds_of], ["word", "n", "spelling", "kinds"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(split.counts() + 1, pa.int64()), pa.array(heads, pa.int64()), pa.array(base), pa.array(whole), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pairs).cast(tail)],
                    ["doc_id", "held_out", "n_tokens", "heads", "base", "whole", "tail"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, heads long, base double, whole double, tail array<struct<word:long,n:long,spelling:double,kinds:array<long>>>"
    scored = stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    tokens = scored.select("row", F.posexplode("tail").alias("pos", "x")).select("row", "pos", "x.*").withColumnRenamed("n", "head")
    token = ["row", "pos"]
    pieces = tokens.select(*token, F.explode("kinds").alias("kind")).join(spelt.where(F.col("n") < least_asked), "kind").groupBy(*token).agg(F.sum("p").alias("rest"))
    open_ = tokens.where(F.size("kinds") > 0).join(pieces, token).withColumn("spelling", F.col("spelling") + F.col("rest"))
    columns = ["row", "head", "word", "spelling"]
    rare = counts.where(F.col("n") < least)
    # A token with a count needs no word; NULL joins nothing.
    found = tokens.where(F.size("kinds") == 0).select(*columns).union(open_.select(*columns)).withColumn("word", F.when(F.col("head").isNull(), F.col("word"))).join(rare, "word", "left")
    plain = F.when(F.col("head").isNull(), F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).otherwise(0.0)
    count = F.coalesce("head", "n", F.lit(0))
    own = F.greatest(F.lit(0.0), count - F.lit(float(discount))) / seats
    # The sum is taken in the logarithm's own scale where the word was never seen: a long spelling is below the least double.
    spelled = F.when(own == 0, F.lit(float(np.log10(spare))) + F.col("spelling")).otherwise(F.log10(own + F.lit(spare) * F.pow(F.lit(10.0), "spelling")))
    sums = found.groupBy("row").agg(F.sum(plain).alias("more"), F.sum(spelled).alias("spelled"), F.count("n").alias("rare"))
    out = scored.drop("tail").join(sums, "row", "left")
    each = float(np.log10(total + 0.1 * (kinds + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("heads") + F.coalesce("rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"), (F.col("whole") + F.coalesce("spelled", F.lit(0.0))).alias("score"),
    )
