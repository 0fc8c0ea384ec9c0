"""Corpus pipeline: quality, language, near copies, benchmark passages, packing, one table after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. A stage's
result is written as Parquet and read again as the next one's docs. Rows count by themselves: one without a doc_id, or with
the doc_id of another row, stays or goes by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm import decontaminate, langid, near_dup, packing, quality
from stallkeeper.session import stored

#: Least quality score of a document that stays.
MIN_QUALITY = 0.5


def named(docs: DataFrame) -> DataFrame:
    """The columns of `docs` under names that no operator uses, but for the text: it goes to the Python workers once."""
    return docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"own_{i}") for i, c in enumerate(docs.columns)])


def renamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text" if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores every text by rules learned from all labelled documents; scores below MIN_QUALITY go.

    Rows are written with their statistics, which take most of the work, so that learning and scoring share them.
    """
    rows = stored(quality.with_stats(named(docs), keep_text=True), "stats")
    ids = F.col(f"own_{docs.columns.index('doc_id')}").alias("doc_id")
    rules = quality.fit(rows.select(ids, *quality.STATS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return renamed(rows.where(rules.score() >= MIN_QUALITY), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the labelled documents among `docs`. Texts in no language go: those without a letter, and those of
    whose n-grams the best language has none, or less than half of what is typical of its labelled texts."""
    found = langid.identify(named(docs), langid.learn(docs), coverage="coverage")
    return renamed(found.where((F.col("lang_pred") != "und") & langid.covered(langid.coverage_bounds(docs), "coverage")), docs)


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a number of its own for each row, written with the table so that every reader sees the same."""
    return stored(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by a similarity of 0.8 over five-word shingles one stays: that of the smallest doc_id (rows
    without one last; of equal ids by a hash of the row). A row in no group stays, whatever its doc_id."""
    rows = keyed(docs)
    found = near_dup.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"), width=5, similarity="0.8")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), "row_key")
    ranked = found.select(F.col("doc_id").alias("row_key"), "component_id").join(rows.select("row_key", rank.alias("rank")), "row_key")
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row_key")
    return rows.join(first, "row_key", "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (a shorter item: all its words) go."""
    rows = keyed(docs)
    _, hits, _ = decontaminate.window_hits(rows.select(F.col("row_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(hits.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths, each from one document."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier of the first stage cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one's sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
