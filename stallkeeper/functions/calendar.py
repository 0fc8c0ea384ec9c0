"""Dates, sale windows and elapsed time. All expressions work on timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallkeeper import values as V


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Inclusive daily calendar."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("day"))


def days_between(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day of each row's inclusive range."""
    return df.select("*", F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("day"))


def promo_multiplier(day: str) -> Column:
    """Traffic multiplier of a date (SQL text) by month-day, else by weekend. 29 February is an ordinary day."""
    month_day = f"month({day}) * 100 + dayofmonth({day})"
    whens = " ".join(f"WHEN {month_day} BETWEEN {first} AND {last} THEN {factor}D" for first, last, factor in V.PROMO_WINDOWS)
    return F.expr(f"CASE {whens} WHEN weekday({day}) >= 5 THEN {V.WEEKEND_MULTIPLIER}D ELSE 1D END")


def is_promotional(day: str) -> Column:
    return promo_multiplier(day) > 1.0


def at_second(day: Column, second: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))


def add_interval(ts: Column, *, days: Column = None, minutes: Column = None, seconds: Column = None) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(
        zero if days is None else days.cast("int"),
        zero,
        zero if minutes is None else minutes.cast("int"),
        (zero if seconds is None else seconds).cast("decimal(18,6)"),
    )


def chunk_of(ts: str, seconds: int) -> Column:
    """Number of the stretch of `seconds` a wall-clock timestamp column falls into; no session zone involved."""
    clock = f"hour({ts}) * 3600 + minute({ts}) * 60 + second({ts})"
    return F.expr(f"floor((CAST(unix_date(to_date({ts})) AS BIGINT) * 86400 + {clock}) / {seconds})")


def whole_days(first: Column, last: Column) -> Column:
    """Elapsed whole days, not calendar-day difference."""
    return F.timestamp_diff("DAY", first, last)


def try_parse(text: Column) -> Column:
    return F.try_to_timestamp(text.cast("string"))


def midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")
