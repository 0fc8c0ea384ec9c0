"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(x: Column, lo, hi) -> Column:
    """Bound x to [lo, hi]; NULL stays NULL although least/greatest skip NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def bound(x: Column, lo, hi) -> Column:
    """clip for an expression that is never NULL: it appears once, so a costly one is computed once."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def format_key(prefix: str, digits: int, number: Column) -> Column:
    """prefix and the number with at least `digits` digits; longer numbers are kept whole."""
    text = number.cast("long").cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0")))


def contains_at(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("@")), F.lit(False))


def keyword_match(text: Column, words: list[str]) -> Column:
    lowered = F.lower(text)
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit


def preview(text: Column, width: int = 30) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def payload_struct(payload: Column) -> Column:
    """Parse a message payload; malformed text gives NULL fields."""
    return F.from_json(payload, "test_id string, expected_delivery boolean, username string, data string")


def classify(payload: Column) -> Column:
    """EXPECTED / UNEXPECTED for test messages by their own flag, REGULAR for anything else."""
    fields = F.from_json(payload, "map<string,string>")
    tested = F.map_contains_key(fields, "test_id") & F.map_contains_key(fields, "expected_delivery")
    flag = F.try_element_at(fields, F.lit("expected_delivery"))
    falsy = flag.isNull() | flag.isin("false", "0", "0.0", "", "[]", "{}")
    return F.when(~F.coalesce(tested, F.lit(False)), "REGULAR").when(falsy, "UNEXPECTED").otherwise("EXPECTED")


def build_payload(fields: list[Column]) -> Column:
    return F.to_json(F.struct(*fields))
