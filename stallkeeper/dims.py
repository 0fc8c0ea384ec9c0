"""Small lookup tables as DataFrames.

They are VALUES relations, so the optimizer knows their exact size and broadcasts them by its own size check; a larger
table passed in their place is joined by shuffle without any change here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallkeeper import values as V


def _text(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, list):
        return "array(" + ", ".join(_text(item) for item in value) + ")"
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value!r}D" if isinstance(value, float) else str(value)


def values(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    body = ", ".join("(" + ", ".join(_text(value) for value in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def segments(spark: SparkSession) -> DataFrame:
    names = "segment, weight, price_sensitivity, cart_abandonment_rate, conversion_base, avg_items_per_cart, preferred_categories"
    return values(spark, names, V.SEGMENTS)


def age_bands(spark: SparkSession) -> DataFrame:
    return values(spark, "age_from, age_to, tech_affinity, price_sensitivity, social_influence, preferred_categories", V.AGE_BANDS)


def gender_weights(spark: SparkSession) -> DataFrame:
    rows = [(g, c, w) for g, weights in V.GENDER_WEIGHTS.items() for c, w in zip(V.CATEGORIES, weights)]
    return values(spark, "gender, category, gender_weight", rows)


def categories(spark: SparkSession) -> DataFrame:
    return values(spark, "category, subcategories", list(V.CATEGORIES.items()))


def attributes(spark: SparkSession) -> DataFrame:
    return values(spark, "subcategory, attributes", list(V.ATTRIBUTES.items()))


def oos_rates(spark: SparkSession) -> DataFrame:
    return values(spark, "category, oos_rate", V.OOS_RATES)


def reason_tree(spark: SparkSession) -> DataFrame:
    return values(spark, "reason_group, reasons", list(V.OOS_REASONS.items()))


def flat_reasons() -> list[str]:
    return [reason for group in V.OOS_REASONS.values() for reason in group]


def merchant_types(spark: SparkSession) -> DataFrame:
    names = "merchant_type, weight, price_strategy, stock_levels, fulfillment_speed, quality_score"
    return values(spark, names, V.MERCHANT_TYPES)


def session_types(spark: SparkSession) -> DataFrame:
    names = "session_type, weight, minutes_from, minutes_to, pages_from, pages_to, add_base, abandon_factor"
    return values(spark, names, V.SESSION_TYPES)


def scenarios(spark: SparkSession) -> DataFrame:
    return values(spark, "test_id, username, topic, expected_delivery", V.SCENARIOS)


def literal_array(items: list) -> Column:
    return F.expr(_text(items))


def pick(key: str, pairs: dict, default) -> Column:
    """CASE lookup of a column in a fixed dictionary."""
    whens = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in pairs.items())
    return F.expr(f"CASE {key} {whens} ELSE {_text(default)} END")
