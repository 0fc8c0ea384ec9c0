"""The full marketplace data set as one chain of Spark jobs.

Tables that several later steps read are written first and read back, so no step recomputes another and a lost executor
costs only its own tasks. All draws are hash draws, so the same arguments give the same tables on any cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallkeeper import schemas
from stallkeeper.functions.calendar import date_range
from stallkeeper.operators import aggregates as A, behaviour, builders as B, windows as W
from stallkeeper.sources import files

c = F.col


def generate(
    spark: SparkSession, out: str, customers: int = 100_000, products: int = 50_000, merchants: int = 100, start: str = "2024-05-19",
    end: str = "2025-05-18", avg_views_per_day: float | None = None, as_csv: bool = False,
) -> dict[str, DataFrame]:
    """Write all tables below `out` and return them. Views per day default to half the number of customers."""
    per_day = customers * 0.5 if avg_views_per_day is None else avg_views_per_day
    made: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        path = f"{out.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        made[name] = spark.read.schema(df.schema).parquet(path)
        return made[name]

    people = behaviour.enrich_customers(B.customers(spark.range(1, customers + 1), "id"))
    profiles = keep("customers", people)
    catalog = keep("products", B.products(spark.range(1, products + 1), "id"))
    keep("product_descriptions", B.attributes(catalog))
    offers = keep("offers", B.enrich_offers(B.offers(catalog, F.lit(merchants), end)))
    stock = offers.select("merchant_id", "sku", c("initial_inventory").alias("stock"))

    days = A.calendar_total(date_range(spark, start, end), F.lit(float(per_day))).select("day", c("volume").alias("n_views"))
    views = keep("views", B.views(
        days, catalog.withColumn("product_index", c("product_id") - 1), profiles.withColumn("customer_index", c("customer_id") - 1), offers, stock))
    keep("instock_events", B.instock_events(views))

    sessioned = keep("session_views", W.sessionize(views.dropna(subset=["customer_id"])))
    starts = sessioned.groupBy("customer_id", "session_no").agg(F.min("timestamp").alias("start_time"))
    sessions = W.sequence_ids(B.sessions(starts, profiles), "session_id", ["start_time", "customer_id"])
    sessions = keep("browsing_sessions", sessions.withColumn("pages_viewed", c("pages_viewed").cast("int")))

    scored = behaviour.score_views(sessioned, profiles, catalog)
    carts = B.cart_events(scored).join(sessions.select("customer_id", "session_no", "session_id"), ["customer_id", "session_no"], "left")
    keep("cart_events", carts.drop("session_no"))
    sales = keep("sales", B.sales(B.candidate_sales(scored), stock))
    keep("ratings", B.ratings(sales))

    initial = B.initial_stock_events(offers, start).drop("new_balance").withColumns(
        {"order_id": F.lit(-1).cast("long"), "line_no": F.lit(0), "unit_price": F.lit(0).cast("decimal(12,2)")})
    sold = sales.select(
        c("order_timestamp").alias("timestamp"), "merchant_id", "sku", F.lit("sale").alias("event_type"), (-c("quantity")).alias("quantity"),
        F.concat(F.lit("Order "), c("order_id").cast("string")).alias("reason"), "order_id", F.lit(0).alias("line_no"), "unit_price")
    ledger = keep("inventory_events", W.running_balance(initial.unionByName(sold)))
    before = c("new_balance") - c("quantity")
    keep("stock_checks", ledger.filter("event_type = 'sale'").select(
        "merchant_id", "sku", (-c("quantity")).alias("requested_qty"), before.cast("int").alias("available_qty"), F.lit(True).alias("can_fulfill"),
        F.when(before < 10, "low_stock").otherwise("in_stock").alias("stock_status")))
    keep("customer_segments", A.segment_summary(profiles))
    if as_csv:
        export_csv(made, f"{out.rstrip('/')}/csv")
    return made


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables as CSV in the model's column order; arrays as comma-separated text."""
    for name, ddl in schemas.MODEL.items():
        if name in tables:
            columns = [part.split()[0] for part in ddl.replace("decimal(12,2)", "decimal").split(", ")]
            df = tables[name]
            flat = [F.array_join(x, ",").alias(x) if dict(df.dtypes)[x].startswith("array") else c(x) for x in columns if x in df.columns]
            files.write_csv(df.select(*flat), f"{folder}/{name}", "overwrite")
