"""Customer-behaviour and restock scores as column expressions.

`past_price` is the customer's mean past purchase price, NULL for a customer without history; `segment` is a column name.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stallkeeper import dims, values as V
from stallkeeper.functions.hashing import gate, int_inclusive, poisson, uniform
from stallkeeper.functions.scalar import bound


def price_ratio(price: Column, mean: Column) -> Column:
    """price / mean as doubles divide: a mean of 0 (all past purchases were free) gives infinity, or NaN for a price of 0."""
    return F.when(mean == 0, price * F.lit(float("inf"))).otherwise(price / mean)


def price_sensitivity(segment_base: Column, age_base: Column, draw: Column) -> Column:
    return bound(segment_base * age_base * uniform(0.8, 1.2, draw), 0.1, 1.0)


def category_preference(preferred: Column, gender_weight: Column, category: Column, tech: Column, draw: Column) -> Column:
    base = F.when(preferred, uniform(0.7, 1.0, draw)).otherwise(uniform(0.3, 0.7, draw))
    tech_weight = F.when(category == "Electronics", tech).otherwise(F.lit(1.0))
    return bound(base * gender_weight * tech_weight, 0.1, 2.0)


def view_probability(
    preference: Column, price: Column, sensitivity: Column, past_price: Column, category_purchases: Column
) -> Column:
    """0.5 for a visitor without profile (NULL sensitivity)."""
    penalty = F.pow(F.greatest(price_ratio(price, past_price), F.lit(1.0)), sensitivity)
    base = F.least(F.lit(0.8), F.coalesce(preference, F.lit(0.5)) * 0.4)
    score = bound(base / penalty * (1 + category_purchases * 0.1), 0.01, 0.9)
    return F.when(sensitivity.isNull(), F.lit(0.5)).otherwise(score)


def add_to_cart_probability(
    add_base: Column, segment: str, sensitivity: Column, price: Column, past_price: Column, purchases: Column
) -> Column:
    known = F.exp(-sensitivity * 0.5 * (price_ratio(price, past_price) - 1))
    expected = dims.pick(segment, V.CART_PRICE, V.CART_PRICE_DEFAULT)
    new = F.exp(-F.greatest(F.lit(0.0), sensitivity * 0.3 * (price / expected - 1)))
    factor = F.when(past_price.isNotNull(), known).otherwise(new)
    base = F.coalesce(add_base, F.lit(V.ADD_BASE_DEFAULT))
    return F.when(price.isNotNull(), bound(base * factor * (1 + purchases * 0.05), 0.01, 0.4))


def abandonment_probability(
    rate: Column, session_factor: Column, segment: str, sensitivity: Column, price: Column, past_price: Column
) -> Column:
    known = 1 + (price_ratio(price, past_price) - 1) * sensitivity * 0.2
    expected = dims.pick(segment, V.CART_PRICE, V.CART_PRICE_DEFAULT)
    excess = (price / expected - 1) * sensitivity * 0.3
    new = 1 + F.greatest(F.lit(0.0), F.least(excess, F.lit(2.0)))
    factor = F.when(past_price.isNotNull(), known).otherwise(new)
    return F.when(price.isNotNull(), bound(rate * factor * F.coalesce(session_factor, F.lit(1.0)), 0.10, 0.85))


def price_factor(segment: str, sensitivity: Column, price: Column, past_price: Column) -> Column:
    expected = F.coalesce(past_price, dims.pick(segment, V.SALE_PRICE, V.SALE_PRICE_DEFAULT))
    ratio = price_ratio(price, expected)
    return F.when(ratio <= 1, 1 + (1 - ratio) * (1 - sensitivity)).otherwise(F.exp(-(ratio - 1) * sensitivity))


def conversion_probability(base: Column, factor: Column, promotional: Column, purchases: Column) -> Column:
    """0.02 for a visitor without profile (NULL base). A NULL price gives NULL, which no gate passes."""
    boost = F.when(promotional, F.lit(1.8)).otherwise(F.lit(1.0))
    score = bound(base * factor * boost * (1 + purchases * 0.05), 0.001, 0.15)
    return F.when(base.isNull(), F.lit(0.02)).when(factor.isNotNull(), score)


def restock_probability(stock: Column, velocity: Column, reliability: Column) -> Column:
    """NULL above the high-stock mark of 50: no restock is considered."""
    speed = F.least(F.lit(2.0), F.coalesce(velocity, F.lit(0.0)) * 10)
    need = F.greatest(F.lit(0.1), (50 - stock) / F.lit(50.0))
    return F.when(stock <= 50, F.lit(0.15) * speed * need * F.coalesce(reliability, F.lit(0.8)))


def restock_quantity(velocity: Column, draw: Column) -> Column:
    weekly = F.greatest(F.lit(1.0), F.coalesce(velocity, F.lit(0.0)) * 7)
    return F.greatest(F.lit(10), (weekly * uniform(0.3, 2.0, draw)).cast("int"))


def damage_quantity(stock: Column, draw: Column) -> Column:
    return F.least(stock, F.greatest(F.lit(1), (stock * uniform(0.01, 0.10, draw)).cast("int")))


def initial_stock(inventory: Column, stock_level: Column, draw: Column) -> Column:
    spread = (
        F.when(stock_level == "high", uniform(1.2, 2.0, draw))
        .when(stock_level == "low", uniform(0.3, 0.8, draw))
        .otherwise(uniform(0.8, 1.2, draw))
    )
    return (inventory * spread).cast("int")


def cart_quantity(session_type: Column, avg_items: Column, draw: Column) -> Column:
    drawn = F.least(F.lit(5), F.greatest(F.lit(1), poisson(avg_items, 5, draw)))
    return F.when(session_type == "impulse_buy", F.lit(1)).otherwise(drawn)


def offer_price(base_price: Column, draw: Column) -> Column:
    """Base price times 0.7..1.2, rounded to cents on exact decimals."""
    return F.round(base_price.cast("decimal(12,2)") * uniform(0.7, 1.2, draw).cast("decimal(12,9)"), 2).cast("decimal(12,2)")


def session_minutes(lo: Column, hi: Column, draw: Column) -> Column:
    return int_inclusive(lo, hi, draw).cast("int")


def restock_gate(stock: Column, velocity: Column, reliability: Column, draw: Column) -> Column:
    return gate(restock_probability(stock, velocity, reliability), draw)
