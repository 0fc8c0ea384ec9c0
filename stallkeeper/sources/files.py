"""CSV and table input and output, schema profile and the clean load job."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


# Whole microseconds and blanks at either end of a text survive the round trip.
CSV = {
    "header": True, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


#: Partition of a table that holds one appended batch.
BATCH = "appended_batch"

# What a text must look like, from the narrowest type to the widest; a column has the first type that all its values fit.
READABLE = {
    "bigint": r"^[+-]?\d{1,18}$",
    "double": r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$|^(?i)[+-]?(nan|inf|infinity)$",
    "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$",
    "boolean": r"^(?i)(true|false)$",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header and a declared schema; large files are split by Spark."""
    return spark.read.schema(schema).options(**CSV).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV).csv(path)


def append(df: DataFrame, path: str, batch: str) -> None:
    """Append a named batch to a Parquet table in a folder, as its partition `batch`.

    A partition is replaced as a whole when its job commits, so a batch that is repeated after a failure adds nothing and a
    job that dies leaves the table as it was. An empty batch changes nothing. Read the table with `read_appended`.
    """
    rows = _batch(df, batch)
    if not df.isEmpty():  # Spark would write a file outside any partition
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def append_table(df: DataFrame, table: str, batch: str, path: str | None = None) -> None:
    """Append a named batch to a table of the session's catalog, which is made if it is missing; repeats as in `append`."""
    rows, spark = _batch(df, batch), df.sparkSession
    if not spark.catalog.tableExists(table):
        made = rows.limit(0).write.format("parquet").partitionBy(BATCH)
        (made.option("path", path) if path else made).saveAsTable(table)
    named = df.select(*(f"`{name}`" for name in spark.table(table).columns if name != BATCH))
    value = batch.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({BATCH} = '{value}') SELECT * FROM {{named}}", named=named)


def _batch(df: DataFrame, batch: str) -> DataFrame:
    if BATCH in (name.lower() for name in df.columns):
        raise ValueError(f"the column {BATCH} is the table's own")
    return df.withColumn(BATCH, F.lit(batch))


def read_appended(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of all batches of a table written by `append`."""
    columns = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(T.StructType([*columns.fields, T.StructField(BATCH, T.StringType())])).parquet(path).drop(BATCH)


def append_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **options: str) -> None:
    """Append to a database table, `batch` rows per statement and partition."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=str(batch), **options).save()


def list_tables(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Files with the suffix and their table names: the lower-cased base name. File contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length")
    base = F.element_at(F.split("path", "/"), -1)
    return files.select(F.lower(F.regexp_replace(base, re.escape(suffix) + "$", "")).alias("table_name"), F.col("length").alias("bytes"))


def clean_names(names: list[str]) -> list[str]:
    """Characters that are neither letters, digits nor underscores become underscores. Names that clash, also by case alone,
    are numbered in their order: `a-b`, `a.b` become `a_b`, `a_b_2`; a number that another name has is passed over.
    """
    plain = ["".join(ch if ch.isalnum() or ch == "_" else "_" for ch in name) for name in names]
    taken, out = {p.lower() for p in plain}, []
    seen: set[str] = set()
    for name in plain:
        if name.lower() in seen:
            name = next(f"{name}_{k}" for k in count(2) if f"{name}_{k}".lower() not in taken)
            taken.add(name.lower())
        seen.add(name.lower())
        out.append(name)
    return out


def clean_columns(df: DataFrame) -> DataFrame:
    """Rename all columns by clean_names."""
    return df.toDF(*clean_names(df.columns))


def infer_types(texts: DataFrame) -> dict[str, str]:
    """Types of all-text columns from one pass over all rows: for each column and type, how many values the type cannot read.

    Blank values count as missing; a column of missing values stays text. Times must exist (no 30 February). Only the
    counts, one row, come to the driver.
    """
    counts = []
    for i, name in enumerate(texts.columns):
        value = F.trim(F.col(f"`{name}`"))
        given = value != ""
        counts.append(F.count_if(given).alias(f"n{i}"))
        for kind, form in READABLE.items():
            fits = value.rlike(form)
            if kind == "timestamp_ntz":
                fits = fits & value.try_cast(kind).isNotNull()
            counts.append(F.count_if(given & ~fits).alias(f"{kind}{i}"))
    found = texts.agg(*counts).first()
    return {name: next((kind for kind in READABLE if found[f"n{i}"] and not found[f"{kind}{i}"]), "string") for i, name in enumerate(texts.columns)}


def typed(texts: DataFrame) -> DataFrame:
    """All-text columns in the types that infer_types finds; blank values of other types than text become NULL."""
    kinds = infer_types(texts)
    return texts.select(*(
        F.col(f"`{n}`") if k == "string" else F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")).cast(k).alias(n) for n, k in kinds.items()))


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header but without a declared schema: names from the header, types from all values."""
    return typed(spark.read.options(**CSV).csv(path))


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN to NULL in floating-point columns."""
    fixed = {f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in df.schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixed) if fixed else df


def _target(kind: T.DataType) -> str | None:
    if isinstance(kind, T.IntegralType):
        return "BIGINT"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.FractionalType):
        return "DOUBLE"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "DATETIME"
    return "BOOLEAN" if isinstance(kind, T.BooleanType) else None


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column from one pass over all rows: position, names, nulls, longest text, target SQL type."""
    aggs, rows, names = [], [], clean_names(df.columns)
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        aggs += [F.count_if(column.isNull()).alias(f"n{i}"), F.coalesce(F.max(F.length(column.cast("string"))), F.lit(0)).alias(f"l{i}")]
        wide = F.concat(F.lit("VARCHAR("), F.greatest(F.col(f"l{i}") * 2, F.lit(255)).cast("string"), F.lit(")"))
        target = _target(field.dataType)
        rows.append(F.struct(
            F.lit(i + 1).alias("position"), F.lit(field.name).alias("name"), F.lit(names[i]).alias("clean_name"),
            F.col(f"n{i}").alias("null_count"), (F.col(f"l{i}") if target is None else F.lit(None).cast("int")).alias("max_length"),
            (wide if target is None else F.lit(target)).alias("sql_type"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def clean_load(spark: SparkSession, csv_path: str, schema: T.StructType | str | None, target: str, batch: str = "load") -> DataFrame:
    """CSV scan, clean names, NaN to NULL, typed append as one batch; returns the table read back. Without a schema the types
    come from the texts."""
    raw = read_csv_typed(spark, csv_path) if schema is None else read_csv(spark, csv_path, schema)
    rows = normalize_nulls(clean_columns(raw))
    append(rows, target, batch)
    return read_appended(spark, target, rows.schema)
