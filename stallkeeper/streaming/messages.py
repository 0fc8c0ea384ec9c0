"""Message streams: topic filters, classes, counts, duplicates and access verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper import values as V
from stallkeeper.functions.scalar import classify
from stallkeeper.operators.access import topic_matches
from stallkeeper.streaming.run import event_time


def subscribe(messages: DataFrame, filters: list[str] = V.MONITOR_TOPICS) -> DataFrame:
    """Messages whose topic matches one of the filters."""
    hits: list[Column] = [topic_matches(F.col("topic"), F.lit(f)) for f in filters]
    return messages.filter(reduce(lambda a, b: a | b, hits))


def classified(messages: DataFrame) -> DataFrame:
    return messages.withColumn("delivery_class", classify(F.col("payload")))


def periodic_counts(messages: DataFrame, every: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    window = F.window("timestamp", every)
    counted = event_time(messages, "timestamp", delay).groupBy(window).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "n")


def sliding_counts(messages: DataFrame, width: str = "1 day", step: str = "6 hours", delay: str = "1 day") -> DataFrame:
    counted = event_time(messages, "timestamp", delay).groupBy(F.window("timestamp", width, step)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "n")


def without_repeats(messages: DataFrame, key: str = "message_id", delay: str = "10 minutes") -> DataFrame:
    """At-least-once delivery repeats messages; a repeat within the watermark is dropped. State is bounded by the watermark."""
    return event_time(messages, "timestamp", delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str = "customer_id", delay: str = "1 hour") -> DataFrame:
    """Live sessions. session_window merges events exactly the gap apart, so the gap is one microsecond under 30 minutes."""
    gap = "29 minutes 59 seconds 999 milliseconds 999 microseconds"
    grouped = event_time(events, "timestamp", delay).groupBy(key, F.session_window("timestamp", gap))
    ended = grouped.agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("pages_viewed"))
    return ended.drop("session_window")
