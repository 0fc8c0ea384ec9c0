"""User callbacks over batches and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def batch_apply(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a function on Arrow-sized batches of each partition."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(over, schema)


def grouped_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """value -> count per group, counted before any list is formed."""
    counted = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    pairs: Column = F.sort_array(F.collect_list(F.struct(column, "n")))
    return counted.groupBy(*keys).agg(F.map_from_entries(pairs).alias(f"{column}_counts"))
