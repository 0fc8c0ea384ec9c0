"""Session settings and scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "16g") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stallkeeper")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Larger generated methods are not compiled by the JVM and run interpreted; split them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of spark.checkpoint.dir; in local mode without one, below /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/stallkeeper/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (names without `spark.sql.`, `__` for a dot) that hold inside the block only."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read to the shared folder and read it back; survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tight(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table that may be as large as the input: compressed more, and the shuffles behind it are removed once it is written."""
    with settings(df.sparkSession, classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.mode(mode).option("compression", "zstd").parquet(path)


def stored_tight(df: DataFrame, name: str) -> DataFrame:
    """`stored` by `write_tight`."""
    path = scratch(df.sparkSession, name)
    write_tight(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
