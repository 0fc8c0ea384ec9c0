"""Tables derived by hash sampling from key tables. Every row depends on its own keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper import dims, values as V
from stallkeeper.functions import scores
from stallkeeper.functions.calendar import add_interval, at_second, is_promotional, promo_multiplier
from stallkeeper.functions.hashing import choice, gate, int_inclusive, sample_indexes, u, uniform, weighted_choice, weighted_sample
from stallkeeper.functions.scalar import format_key
from stallkeeper.operators import behaviour, inventory, windows
from stallkeeper.operators.relational import instock_reason

MONEY = "decimal(12,2)"
ROWS_PER_TASK = 2_000_000


def customers(keys: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return keys.select(
        k.alias("customer_id"),
        F.concat(F.lit("Customer "), k.cast("string")).alias("name"),
        F.concat(F.lit("customer"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("City "), int_inclusive(1, 500, u("city", key)).cast("string")).alias("city"),
        int_inclusive(18, 65, u("age", key)).cast("int").alias("age"),
        choice(V.GENDERS, u("gender", key)).alias("gender"),
    )


def products(keys: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    spot = (F.floor(u("category", key) * len(V.CATEGORIES)) + 1).cast("int")
    subs = F.element_at(dims.literal_array(list(V.CATEGORIES.values())), spot)
    return keys.select(
        format_key("SKU", 6, k).alias("sku"),
        k.alias("product_id"),
        F.element_at(dims.literal_array(list(V.CATEGORIES)), spot).alias("category"),
        F.element_at(subs, (F.floor(u("subcategory", key) * F.size(subs)) + 1).cast("int")).alias("subcategory"),
        uniform(100.0, 100000.0, u("base_price", key)).cast(MONEY).alias("base_price"),
    )


def attributes(products: DataFrame) -> DataFrame:
    """One row per product and attribute of its subcategory, `Brand` when the subcategory has none."""
    listed = products.join(dims.attributes(products.sparkSession), "subcategory", "left")
    names = F.coalesce(F.col("attributes"), dims.literal_array(V.ATTRIBUTES_DEFAULT))
    rows = listed.select("sku", F.explode(names).alias("description"))
    word = F.substring(F.md5(F.concat_ws("|", "sku", "description")), 1, 8)
    return rows.withColumn("value", F.initcap(F.concat(F.lit("v"), word)))


def merchant_type(key: str = "merchant_id") -> Column:
    return weighted_choice([t[0] for t in V.MERCHANT_TYPES], [t[1] for t in V.MERCHANT_TYPES], u("merchant_type", key))


def merchants(offers: DataFrame) -> DataFrame:
    """Profile of every merchant with an offer."""
    base = offers.select("merchant_id").distinct().withColumn("merchant_type", merchant_type())
    return base.join(dims.merchant_types(offers.sparkSession).drop("weight"), "merchant_type", "left").withColumns({
        "reliability": uniform(0.7, 0.98, u("reliability", "merchant_id")),
        "avg_restock_days": int_inclusive(3, 14, u("restock_days", "merchant_id")).cast("int"),
    })


def add_merchant_attributes(offers: DataFrame) -> DataFrame:
    """The type is a function of the merchant id, so no table of merchants is built or joined."""
    types = dims.merchant_types(offers.sparkSession).drop("weight")
    return offers.withColumn("merchant_type", merchant_type()).join(types, "merchant_type", "left")


def fan_out_offers(products: DataFrame, merchant_count: Column, most: int = 4) -> DataFrame:
    """Pair each product with 1..most distinct merchants numbered from 1, without listing the merchants per product."""
    counted = products.withColumn("_n", merchant_count)
    ranged = counted.withColumn("_k", int_inclusive(1, F.least(F.lit(most), F.col("_n")), u("fan_out", "sku")))
    picked = ranged.withColumn("_m", F.explode(sample_indexes(F.col("_k"), F.col("_n"), most, "merchant", "sku")))
    return picked.withColumn("merchant_id", format_key("MER", 4, F.col("_m"))).drop("_m", "_n", "_k")


def offers(products: DataFrame, merchant_count: Column, as_of: str) -> DataFrame:
    """1-4 offers per product: price 0.7..1.2 of base, stock 0..1000, listed within two years before as_of."""
    pairs = fan_out_offers(products, merchant_count)
    return pairs.select(
        "merchant_id", "sku",
        int_inclusive(0, 1000, u("inventory", "sku", "merchant_id")).cast("int").alias("inventory"),
        scores.offer_price(F.col("base_price"), u("offer_price", "sku", "merchant_id")).alias("offer_price"),
        F.date_sub(F.lit(as_of).cast("date"), int_inclusive(0, 730, u("listing", "sku", "merchant_id")).cast("int")).alias("listing_date"),
    )


def enrich_offers(offers: DataFrame) -> DataFrame:
    """Merchant attributes and the initial stock by stock level."""
    stock = scores.initial_stock(F.col("inventory"), F.col("stock_levels"), u("initial_stock", "merchant_id", "sku"))
    return add_merchant_attributes(offers).withColumn("initial_inventory", stock)


def initial_stock_events(offers: DataFrame, start: str) -> DataFrame:
    qty = F.col("initial_inventory")
    return offers.select(
        F.lit(start).cast("timestamp_ntz").alias("timestamp"), "merchant_id", "sku", F.lit("initial_stock").alias("event_type"),
        qty.alias("quantity"), F.lit("Initial listing").alias("reason"), qty.cast("long").alias("new_balance"),
    )


def weighted_date(df: DataFrame, days: DataFrame, draw: Column, bins: int = 4096) -> DataFrame:
    """Add a day drawn by its traffic multiplier. Days are cut into bins of [0, 1), so the range lookup is an equi-join."""
    weight = promo_multiplier("day").cast("decimal(9,3)")
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    total = days.agg(F.sum(weight)).scalar().cast("double")
    shares = days.withColumn("_hi", F.sum(weight).over(upto).cast("double") / total)
    spans = shares.withColumn("_lo", F.coalesce(F.lag("_hi").over(W.orderBy("day")), F.lit(0.0)))
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") * bins), F.floor(F.col("_hi") * bins))))
    drawn = df.withColumn("_draw", draw).withColumn("_bin", F.floor(F.col("_draw") * bins))
    inside = (F.col("_draw") >= F.col("_lo")) & (F.col("_draw") < F.col("_hi"))
    return drawn.join(binned, "_bin").filter(inside).drop("_bin", "_draw", "_lo", "_hi")


def candidate_views(days: DataFrame) -> DataFrame:
    """One row per planned view: (day, n_views) to contiguous http_request_id from 1.

    Ids come from a range, so Spark knows how many there are and never takes them for a small side to broadcast; exploding
    a calendar would hide that. The day is found by an equi-join on blocks of ids with at most 100,000 blocks.
    """
    spark = days.sparkSession
    total = days.agg(F.coalesce(F.sum("n_views"), F.lit(0))).first()[0]
    block = max(10_000, total // 100_000)
    before = F.sum("n_views").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    spans = days.withColumn("_first", F.coalesce(before, F.lit(0)) + 1).filter("n_views > 0").withColumn("_last", F.col("_first") + F.col("n_views") - 1)
    number = lambda c: F.expr(f"CAST(({c} - 1) DIV {block} AS BIGINT)")
    blocks = spans.select("day", "_first", "_last", F.explode(F.sequence(number("_first"), number("_last"))).alias("_block"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROWS_PER_TASK)
    ids = spark.range(1, total + 1, 1, parts).select(F.col("id").alias("http_request_id"), number("id").alias("_block"))
    found = ids.join(blocks, "_block").filter("http_request_id BETWEEN _first AND _last")
    return found.select("day", "http_request_id")


def views(days: DataFrame, products: DataFrame, profiles: DataFrame, offers: DataFrame, stock: DataFrame) -> DataFrame:
    """Planned views thinned by the behaviour score, with stock flag and price.

    `days` has (day, n_views), `products` a contiguous product_index from 0, `profiles` a contiguous customer_index
    from 0, `stock` one row per offer. Views come before any sale, so the score uses no purchase history.
    """
    spark = days.sparkSession
    vid = "http_request_id"
    n_products, n_customers = products.agg(F.count("*")).scalar(), profiles.agg(F.count("*")).scalar()
    base = candidate_views(days).select(
        "http_request_id",
        at_second(F.col("day"), int_inclusive(0, 86399, u("view_second", vid))).alias("timestamp"),
        F.floor(u("view_product", vid) * n_products).alias("product_index"),
        F.when(u("view_known", vid) < 0.8, F.floor(u("view_customer", vid) * n_customers)).alias("customer_index"),
    )
    prices = offers.groupBy("sku").agg(F.count("*").alias("num_offers"), (F.sum("offer_price").cast("double") / F.count("*")).alias("avg_price"))
    totals = stock.groupBy("sku").agg(F.sum("stock").alias("total_stock"))
    shelf = (
        products.select("product_index", "sku", "category").join(prices, "sku", "left").join(totals, "sku", "left")
        .join(dims.oos_rates(spark), "category", "left")
    )
    people = profiles.select("customer_index", "customer_id", "gender", "tech_affinity", "price_sensitivity", "preferred_categories")
    joined = base.join(shelf, "product_index").join(people, "customer_index", "left")
    joined = behaviour.with_preference(joined, "category", "_preference")
    chance = scores.view_probability(
        F.col("_preference"), F.coalesce(F.col("avg_price"), F.lit(1000.0)), F.col("price_sensitivity"),
        F.lit(None).cast("double"), F.lit(0),
    )
    kept = joined.filter(F.col("customer_index").isNull() | (u("view_gate", vid) <= chance))
    blocked = (F.col("total_stock") <= 0) | gate(F.coalesce(F.col("oos_rate"), F.lit(V.OOS_RATE_DEFAULT)), u("oos", vid))
    instock = F.col("total_stock").isNotNull() & ~F.coalesce(blocked, F.lit(False))
    pick = F.when(instock, 1 + F.floor(u("view_price", vid) * F.col("num_offers")))
    numbered = windows.number_in_key(offers.select("sku", "merchant_id", "offer_price"), ["sku"], "position", "merchant_id")
    shown = kept.withColumns({"instock": instock, "position": pick}).join(numbered.drop("merchant_id"), ["sku", "position"], "left")
    return shown.select(
        "http_request_id", "timestamp", "sku", F.coalesce("num_offers", F.lit(0)).cast("int").alias("num_offers"), "instock",
        F.col("offer_price").alias("price_viewed"), "customer_id",
    )


def flat_views(days: DataFrame, products: DataFrame, customer_count: Column, offers: DataFrame) -> DataFrame:
    """The simple form: no behaviour gate, stock flag by the category rate alone, price shown even when out of stock."""
    vid = "http_request_id"
    n_products = products.agg(F.count("*")).scalar()
    base = candidate_views(days).select(
        "http_request_id",
        at_second(F.col("day"), int_inclusive(0, 86399, u("view_second", vid))).alias("timestamp"),
        F.floor(u("view_product", vid) * n_products).alias("product_index"),
        F.when(u("view_known", vid) < 0.8, F.floor(u("view_customer", vid) * customer_count)).alias("customer_id"),
    )
    counts = offers.groupBy("sku").agg(F.count("*").alias("num_offers"))
    shelf = products.select("product_index", "sku", "category").join(counts, "sku", "left").join(dims.oos_rates(days.sparkSession), "category", "left")
    numbered = windows.number_in_key(offers.select("sku", "merchant_id", "offer_price"), ["sku"], "position", "merchant_id")
    shown = (
        base.join(shelf, "product_index")
        .withColumn("position", 1 + F.floor(u("view_price", vid) * F.col("num_offers")))
        .join(numbered.drop("merchant_id"), ["sku", "position"], "left")
    )
    instock = u("oos", vid) >= F.coalesce(F.col("oos_rate"), F.lit(V.OOS_RATE_DEFAULT))
    return shown.select(
        "http_request_id", "timestamp", "sku", F.coalesce("num_offers", F.lit(0)).cast("int").alias("num_offers"), instock.alias("instock"),
        F.col("offer_price").alias("price_viewed"), "customer_id",
    )


def instock_events(views: DataFrame) -> DataFrame:
    """One row per view: `Instock` or one of the out-of-stock reasons."""
    return views.select("http_request_id", "sku", instock_reason(F.col("instock"), u("reason", "http_request_id")).alias("reason"))


def cart_events(scored: DataFrame) -> DataFrame:
    """Scored views with a price that pass the gate add to a cart, which is then abandoned or ready to purchase."""
    vid = "http_request_id"
    added = scored.filter(gate(F.col("add_probability"), u("cart_add", vid))).withColumns(
        {"_quantity": u("cart_quantity", vid), "_abandoned": gate(F.col("abandon_probability"), u("cart_abandon", vid))})
    quantity = scores.cart_quantity(F.col("session_type"), F.col("avg_items_per_cart"), F.col("_quantity"))
    abandoned = F.col("_abandoned")
    at = add_interval(F.col("timestamp"), seconds=int_inclusive(10, 300, u("cart_delay", vid)))
    minutes = F.when(abandoned, int_inclusive(1, 60, u("cart_minutes", vid))).otherwise(int_inclusive(1, 30, u("cart_minutes", vid)))
    later = F.struct(
        add_interval(F.col("_at"), minutes=F.col("_minutes")).alias("timestamp"),
        F.when(F.col("_abandoned"), "cart_abandoned").otherwise("ready_to_purchase").alias("event_type"),
    )
    first = F.struct(F.col("_at").alias("timestamp"), F.lit("add_to_cart").alias("event_type"))
    prepared = added.select(
        F.col(vid).alias("cart_id"), "customer_id", "sku", quantity.alias("quantity"), F.col("price_viewed").alias("price"), "session_no",
        at.alias("_at"), minutes.alias("_minutes"), abandoned.alias("_abandoned"),
    )
    return prepared.select("cart_id", "customer_id", "sku", "quantity", "price", "session_no", F.inline(F.array(first, later)))


def candidate_sales(scored: DataFrame) -> DataFrame:
    """Views that convert, with quantity 1..3 and a fulfilment status. A view without price never converts."""
    vid = "http_request_id"
    status = weighted_choice([s for s, _ in V.FULFILMENT], [w for _, w in V.FULFILMENT], F.col("_draw"))
    passed = scored.filter(gate(F.col("conversion_probability"), u("sale_gate", vid))).withColumn("_draw", u("sale_status", vid))
    return passed.select(
        "http_request_id", "customer_id", "sku",
        int_inclusive(1, 3, u("sale_quantity", vid)).cast("int").alias("quantity"),
        F.col("price_viewed").alias("unit_price"), F.col("timestamp").alias("order_timestamp"), status.alias("fulfilment_status"),
    )


def sales(candidates: DataFrame, stocked_offers: DataFrame) -> DataFrame:
    """Candidates allocated to the first merchant with enough stock; contiguous order ids over the filled ones."""
    order = ["order_timestamp", "http_request_id"]
    filled = inventory.greedy_allocate(candidates, stocked_offers, order).filter("merchant_id IS NOT NULL")
    return windows.sequence_ids(filled, "order_id", order)


def flat_sales(views: DataFrame, offers: DataFrame) -> DataFrame:
    """The simple form: 2 % of customer views, 1.8 times that in sale periods, a random merchant, no stock check."""
    vid = "http_request_id"
    chance = F.lit(0.02) * F.when(is_promotional("to_date(timestamp)"), 1.8).otherwise(1.0)
    bought = views.dropna(subset=["customer_id"]).filter(u("flat_gate", vid) < chance)
    counts = offers.groupBy("sku").agg(F.count("*").alias("_n"))
    numbered = windows.number_in_key(offers.select("sku", "merchant_id"), ["sku"], "_position", "merchant_id")
    picked = bought.join(counts, "sku").withColumn("_position", 1 + F.floor(u("flat_merchant", vid) * F.col("_n"))).join(numbered, ["sku", "_position"])
    status = weighted_choice([s for s, _ in V.FULFILMENT], [w for _, w in V.FULFILMENT], u("sale_status", vid))
    return picked.select(
        "http_request_id", "customer_id", "merchant_id", "sku", int_inclusive(1, 3, u("sale_quantity", vid)).cast("int").alias("quantity"),
        F.col("price_viewed").alias("unit_price"), F.col("timestamp").alias("order_timestamp"), status.alias("fulfilment_status"),
    )


def ratings(sales: DataFrame, key: str = "order_id") -> DataFrame:
    """40 % of sales get 1..5 stars 1..30 days later; rating_id is the order id."""
    k = F.col(key)
    rated = sales.filter(gate(0.4, u("rating_gate", key)))
    return rated.select(
        k.alias("rating_id"), "customer_id", "sku", int_inclusive(1, 5, u("rating", key)).cast("int").alias("rating"),
        F.concat(F.lit("Review of "), F.col("sku"), F.lit(" for order "), k.cast("string")).alias("review"),
        add_interval(F.col("order_timestamp").cast("timestamp_ntz"), days=int_inclusive(1, 30, u("rating_delay", key))).alias("rating_timestamp"),
    )


def sessions(starts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Type, duration, pages and 1-3 categories by preference for sessions (customer_id, session_no, start_time)."""
    keys = ["customer_id", "session_no"]
    kinds, weights = [s[0] for s in V.SESSION_TYPES], [s[1] for s in V.SESSION_TYPES]
    names = dims.literal_array(list(V.CATEGORIES))
    typed = starts.withColumn("_draw", u("session_type", *keys)).withColumn("session_type", weighted_choice(kinds, weights, F.col("_draw")))
    people = behaviour.preference_array(profiles, "_scores").select("customer_id", "_scores")
    joined = typed.join(dims.session_types(starts.sparkSession), "session_type", "left").join(people, "customer_id")
    minutes = int_inclusive(F.col("minutes_from"), F.col("minutes_to"), u("session_minutes", *keys))
    pages = int_inclusive(F.col("pages_from"), F.col("pages_to"), u("session_pages", *keys))
    k = int_inclusive(1, 3, u("session_categories", *keys))
    return joined.select(
        "customer_id", "session_no", "session_type", "start_time", add_interval(F.col("start_time"), minutes=minutes).alias("end_time"),
        pages.alias("pages_viewed"), weighted_sample(names, F.col("_scores"), k, "session_category", *keys).alias("categories_browsed"),
    )
