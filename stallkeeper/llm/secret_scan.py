"""Secret scans over versions of files, with a ledger of the texts that were scanned before.

A text is addressed by the SHA-256 of its UTF-8 bytes, so a version that comes back under another path, branch or date is the
same blob. The ledger remembers, for every blob, the rules (kind and version) that it was scanned with, and what they found.
A scan of new versions

1. writes the manifest: key and address of every version,
2. elects one version of every blob that lacks a rule, by the ledger,
3. scans the elected versions with the rules they lack, and appends findings, then the scanned pairs, to the ledger,
4. joins the findings back to all versions through their addresses.

Texts are never shuffled: the elected versions are told to the tasks by a bitmap of one size. Its false positives cost a scan
and change nothing, as a blob and a rule version give the same findings each time; hence a scan that was cut short between the
two appends, or ran twice, leaves a right ledger as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm import words as W
from stallkeeper.llm.bitmap import bitmap, dense, has_bits
from stallkeeper.session import stored


class Rule(NamedTuple):
    """Spans of `kind` are the leftmost matches of `pattern` whose group `group` has `least` characters or more.

    A match has one of the `marks` (lower-case ASCII, compared in either case) or, without marks, a run of `least` bytes of
    `run`; texts without are not searched. Raise `version` whenever a rule changes: then all blobs are scanned with it again.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    marks: tuple[str, ...] = ()
    run: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


HEX = "0123456789abcdef"
#: The first three are fixed; no pattern looks at a byte more than a bounded number of times.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True, ("password", "passwd", "secret", "token", "api_key", "apikey")),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16, False, ("akia",)),
    Rule("hex", 1, "[0-9a-f]+", 0, 32, False, (), HEX),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, False, ("private key-----",)),
    Rule("forge", 1, "gh[oprsu]_[A-Za-z0-9]+", 0, 40, False, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat", 1, "xox[abprs]-[A-Za-z0-9-]+", 0, 20, False, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("pay", 1, "[rs]k_live_[A-Za-z0-9]+", 0, 24, False, ("k_live_",)),
    Rule("url", 1, r"://[^\x00-\x20:/@]{1,200}:[^\x00-\x20/@]{1,200}@", 0, 0, False, ("://",)),
)
#: Copies that make a blob hot, and its parts in the join that brings findings back.
HOT_ROWS, HOT_SHARE, SALTS = 1000, 1000, 64
#: Addresses that a task remembers so as not to scan a blob twice, and sets of missing rules that get bitmaps of their own.
REMEMBERED, RULE_SETS = 100_000, 8
SPANS = "array<struct<start:long,end:long>>"
SCANNED, FINDINGS = "blob binary, rules array<string>", f"blob binary, kind string, version int, spans {SPANS}"


@cache
def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def spans(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Code points [start, end) of the rule's matches."""
    found = _compiled(rule).finditer(text)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def candidates(rule: Rule, data: np.ndarray, lower: bytes, offsets: np.ndarray) -> list[int]:
    """Texts of a slice that may have a match: a text without the rule's marks or run has none."""
    rows: set[int] = set()
    for mark in rule.marks:
        wanted, at = mark.encode(), 0
        while (at := lower.find(wanted, at)) >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            rows.add(row)
            at = int(offsets[row + 1])  # one hit is enough for a text
    if rule.run:
        table = np.zeros(256, bool)
        table[list(rule.run.encode())] = True
        runs = W.split(data, offsets, table)
        long_ = np.flatnonzero(runs.end - runs.begin >= rule.least)
        rows.update((np.searchsorted(runs.first, long_, "right") - 1).tolist())
    return sorted(rows)


def address(text: Column) -> Column:
    """SHA-256 of the text's bytes; a null text counts as an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """Tables `scanned` (blob, rules) and `findings` (blob, kind, version, spans) below a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Ledger:
        """An empty ledger; one that is there stays as it is."""
        ledger = cls(spark, path)
        for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{ledger.path}/{name}")
        return ledger

    def scanned(self) -> DataFrame:
        """(blob, rules): all rules that a blob was scanned with."""
        rows = self.spark.read.schema(SCANNED).parquet(f"{self.path}/scanned")
        return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans array<struct<start, place, end, kind>>): findings of these rule versions by start, then rule."""
        rows = self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings").dropDuplicates(["blob", "kind", "version"])
        place = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)])
        rows = rows.withColumn("place", place).where("place IS NOT NULL")
        each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place"), s["end"].alias("end"), F.col("kind")))
        return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("spans"))

    def scan(self, versions: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
        """(keys, blob, spans) for every row of `versions`, after scanning the blobs that lack a rule.

        A null text is an empty blob, which has no spans. Rows with equal keys and texts stay as many as they are, null keys
        are keys. No versions give no rows and leave the ledger as it was. Columns besides `keys` and `text` are not read.
        """
        names = [f"key_{i}" for i in range(len(keys))]
        chosen = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
        source = versions.select(*chosen, F.col(text).alias("text")).withColumn("blob", address(F.col("text")))
        source = source.withColumn("token", F.xxhash64("blob", *names))
        manifest = stored(source.drop("text"), "manifest")
        blobs = stored(manifest.groupBy("blob").agg(F.min("token").alias("token"), F.count("*").alias("copies")), "blobs")
        self._scan_missing(source.select("blob", "token", "text"), blobs, rules)

        total = blobs.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).scalar()
        # Fewer than HOT_SHARE blobs can have more than 1 / HOT_SHARE of all rows, so this list of addresses is bounded.
        hot = F.broadcast(blobs.where((F.col("copies") > HOT_ROWS) & (F.col("copies") * HOT_SHARE > total)).select("blob", F.lit(SALTS).alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        # Any salt will do, as findings of a hot blob have all of them; rows of one blob and key share a token, so it is no help.
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
        left = manifest.join(hot, "blob", "left").withColumn("salt", salt)
        right = self.findings(rules).join(hot, "blob", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        joined = left.drop("salts").join(right.drop("salts"), ["blob", "salt"], "left")
        none = F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")
        back = [F.col(n).alias(k) for k, n in zip(keys, names, strict=True)]
        return joined.select(*back, "blob", F.coalesce("spans", none).alias("spans"))

    def _scan_missing(self, source: DataFrame, blobs: DataFrame, rules: tuple[Rule, ...]) -> None:
        wanted = F.array(*[F.lit(r.name) for r in rules])
        known = F.coalesce("rules", F.array().cast("array<string>"))
        pending = stored(blobs.join(self.scanned(), "blob", "left").select("blob", "token", F.array_except(wanted, known).alias("rules")).where(F.size("rules") > 0), "pending")
        # What a blob can lack is a set of rules, so few sets occur; beyond RULE_SETS all are scanned with all rules.
        sets = [tuple(r[0]) for r in pending.select("rules").distinct().limit(RULE_SETS + 1).collect()]
        if not sets:
            return
        if len(sets) > RULE_SETS:
            work = [(tuple(rules), bitmap(pending.select("token")))]
        else:
            work = [([r for r in rules if r.name in names], bitmap(pending.where(F.col("rules") == F.array(*map(F.lit, names))).select("token"))) for names in sets]
        found = source.mapInArrow(lambda batches: _search(batches, work), FINDINGS)
        found.write.mode("append").parquet(f"{self.path}/findings")
        pending.select("blob", "rules").write.mode("append").parquet(f"{self.path}/scanned")


def _search(batches: Iterator[pa.RecordBatch], work: list) -> Iterator[pa.RecordBatch]:
    filters = [(rules, dense(cells)) for rules, cells in work]
    every = {rule for rules, _ in filters for rule in rules}
    done: set[tuple[int, bytes]] = set()
    kinds = [pa.binary(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for batch in batches:
        tokens = batch.column(1).to_numpy().view(np.uint64)
        lacking = [(rules, has_bits(cells, tokens)) for rules, cells in filters]
        for lo, hi, data, offsets in W.slices(batch.column(2)):
            if not any(hit[lo:hi].any() for _, hit in lacking):
                continue
            lower = W._LOWER[data].tobytes()
            where = {rule: set(candidates(rule, data, lower, offsets)) for rule in every}
            out = []
            for number, (rules, hit) in enumerate(lacking):
                for row in sorted({r for rule in rules for r in where[rule] if hit[lo + r]}):
                    blob = batch.column(0)[lo + row].as_py()
                    if (number, blob) in done:
                        continue
                    if len(done) < REMEMBERED:
                        done.add((number, blob))
                    text = bytes(data[offsets[row] : offsets[row + 1]]).decode()
                    for rule in rules:
                        found = spans(rule, text) if row in where[rule] else []
                        if found:
                            out.append((blob, rule.kind, rule.version, [{"start": a, "end": b} for a, b in found]))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["blob", "kind", "version", "spans"])
