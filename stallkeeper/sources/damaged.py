"""Model tables with defects put in by hash sampling, so that every data-quality rule has something to find."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper import values as V
from stallkeeper.functions.hashing import u, weighted_choice
from stallkeeper.sources.model import MONEY, Model


def _spoil(df: DataFrame, stream: str, keys: list[str], column: str, value: Column, share: float) -> DataFrame:
    return df.withColumn(column, F.when(u(f"bad_{stream}", *keys) < share, value).otherwise(F.col(column)))


def _repeat(df: DataFrame, stream: str, keys: list[str], share: float = 0.01) -> DataFrame:
    return df.unionByName(df.filter(u(f"twice_{stream}", *keys) < share))


def _money(value: int) -> Column:
    return F.lit(value).cast(MONEY)


def _customers(m: Model) -> DataFrame:
    k = ["customer_id"]
    df = m.customers().drop("c_mktsegment")
    df = _spoil(df, "age", k, "age", F.lit(150), 0.02)
    df = _spoil(df, "gender", k, "gender", F.lit("X"), 0.02)
    df = _spoil(df, "email", k, "email", F.replace("email", F.lit("@"), F.lit("#")), 0.02)
    return _repeat(df, "customers", k)


def _products(m: Model) -> DataFrame:
    k = ["sku"]
    df = _spoil(m.products(), "price", k, "base_price", _money(0), 0.02)
    df = _spoil(df, "high", k, "base_price", _money(2000000), 0.02)
    df = _spoil(df, "category", k, "category", F.lit("Toys"), 0.02)
    df = _spoil(df, "subcategory", k, "subcategory", F.lit("Mobiles"), 0.05)
    return _repeat(df, "products", k)


def _offers(m: Model) -> DataFrame:
    k = ["merchant_id", "sku"]
    df = _spoil(m.offers(), "inventory", k, "inventory", F.lit(-5), 0.02)
    df = _spoil(df, "offer_price", k, "offer_price", _money(0), 0.02)
    return _repeat(df, "offers", k)


def _views(m: Model) -> DataFrame:
    k = ["http_request_id"]
    df = m.views().withColumns({"timestamp": F.col("timestamp").cast("string"), "instock": F.col("instock").cast("string")})
    df = _spoil(df, "time", k, "timestamp", F.lit("not a time"), 0.02)
    df = _spoil(df, "instock", k, "instock", F.lit("maybe"), 0.02)
    df = _spoil(df, "shown", k, "price_viewed", F.lit(None).cast(MONEY), 0.02)
    df = _spoil(df, "visitor", k, "customer_id", F.lit(-1).cast("long"), 0.02)
    df = _spoil(df, "sku", k, "sku", F.lit("SKU-none"), 0.02)
    return _repeat(df, "views", k)


def _sales(m: Model) -> DataFrame:
    k = ["order_id"]
    status = weighted_choice([s for s, _ in V.FULFILMENT], [w for _, w in V.FULFILMENT], u("status", "order_id"))
    df = m.event_sales().withColumn("fulfilment_status", status)
    df = _spoil(df, "none", k, "quantity", F.lit(0), 0.02)
    df = _spoil(df, "many", k, "quantity", F.lit(150), 0.02)
    df = _spoil(df, "paid", k, "unit_price", _money(-1), 0.02)
    df = _spoil(df, "status", k, "fulfilment_status", F.lit("Lost"), 0.02)
    return _repeat(df, "sales", k)


def _inventory_events(m: Model) -> DataFrame:
    k = ["merchant_id", "sku", "order_id", "line_no"]
    df = _spoil(m.ledger(), "kind", k, "event_type", F.lit("teleport"), 0.02)
    return _spoil(df, "sign", k, "quantity", -F.col("quantity"), 0.02)


def _cart_events(m: Model) -> DataFrame:
    return _spoil(m.cart_events(), "cart", ["event_id"], "event_type", F.lit("lost"), 0.02)


BUILDERS = {
    "customers": _customers, "products": _products, "offers": _offers, "views": _views, "sales": _sales,
    "inventory_events": _inventory_events, "cart_events": _cart_events,
}


def tables(m: Model, names: Iterable[str] = tuple(BUILDERS)) -> dict[str, DataFrame]:
    """The named tables, all by default. Only these are built: the ledger of inventory_events starts jobs of its own."""
    wanted = set(names)
    return {name: build(m) for name, build in BUILDERS.items() if name in wanted}
