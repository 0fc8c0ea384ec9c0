"""Customer profiles and the scored view table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper import dims, values as V
from stallkeeper.functions import scores
from stallkeeper.functions.calendar import is_promotional
from stallkeeper.functions.hashing import u, weighted_choice
from stallkeeper.operators.history import Level, as_of


def assign_segment(customers: DataFrame) -> DataFrame:
    names, weights = [s[0] for s in V.SEGMENTS], [s[1] for s in V.SEGMENTS]
    drawn = customers.withColumn("_draw", u("segment", "customer_id"))
    return drawn.withColumn("segment", weighted_choice(names, weights, F.col("_draw"))).drop("_draw")


def age_behaviour(customers: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Attach the age band's attributes, or the defaults. Bands become one row per age, so the join is an equi-join."""
    bands = dims.age_bands(customers.sparkSession) if bands is None else bands
    by_age = bands.select(
        F.explode(F.sequence("age_from", "age_to")).alias("age"),
        "tech_affinity", F.col("price_sensitivity").alias("age_sensitivity"), "social_influence",
    )
    tech, sensitivity, social, _ = V.AGE_DEFAULT
    joined = customers.join(by_age, "age", "left")
    return joined.fillna({"tech_affinity": tech, "age_sensitivity": sensitivity, "social_influence": social})


def enrich_customers(customers: DataFrame) -> DataFrame:
    """Segment, price sensitivity and the segment's rates for every customer."""
    segments = dims.segments(customers.sparkSession).select(
        "segment", F.col("price_sensitivity").alias("seg_sensitivity"), "cart_abandonment_rate", "conversion_base",
        "avg_items_per_cart", "preferred_categories",
    )
    base = age_behaviour(assign_segment(customers)).join(segments, "segment", "left")
    score = scores.price_sensitivity(F.col("seg_sensitivity"), F.col("age_sensitivity"), F.col("_draw"))
    scored = base.withColumn("_draw", u("sensitivity", "customer_id")).withColumn("price_sensitivity", score)
    return scored.drop("seg_sensitivity", "age_sensitivity", "social_influence", "_draw")


def gender_weight(gender: str, category: str) -> Column:
    """Two-key lookup with default 1.0."""
    pairs = {f"{g}/{c}": w for g, weights in V.GENDER_WEIGHTS.items() for c, w in zip(V.CATEGORIES, weights)}
    return dims.pick(f"concat({gender}, '/', {category})", pairs, 1.0)


def with_preference(df: DataFrame, category: str, name: str) -> DataFrame:
    """Preference score of a profile row for a category (SQL text); NULL for a category that is not known."""
    drawn = df.withColumn("_draw", u("preference", "customer_id", category))
    weight, category = gender_weight("gender", category), F.expr(category)
    score = scores.category_preference(
        F.array_contains(F.col("preferred_categories"), category),
        weight,
        category,
        F.col("tech_affinity"),
        F.col("_draw"),
    )
    return drawn.withColumn(name, F.when(category.isin(list(V.CATEGORIES)), score)).drop("_draw")


def preferences(profiles: DataFrame) -> DataFrame:
    """One row per customer and category."""
    names = dims.literal_array(list(V.CATEGORIES))
    rows = profiles.select("customer_id", "preferred_categories", "gender", "tech_affinity", F.explode(names).alias("category"))
    return with_preference(rows, "category", "preference").select("customer_id", "category", "preference")


def preference_array(profiles: DataFrame, name: str) -> DataFrame:
    """Scores of all categories, in the order of the category list."""
    df = profiles
    for i, category in enumerate(V.CATEGORIES):
        df = with_preference(df, f"'{category}'", f"_p{i}")
    parts = [f"_p{i}" for i in range(len(V.CATEGORIES))]
    return df.withColumn(name, F.array(*parts)).drop(*parts)


def preference_map(profiles: DataFrame) -> DataFrame:
    keys = dims.literal_array(list(V.CATEGORIES))
    scored = preference_array(profiles, "_scores")
    return scored.withColumn("category_preferences", F.map_from_arrays(keys, F.col("_scores"))).drop("_scores")


def lookup(score_map: Column, key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(score_map, key), F.lit(default))


def with_history(views: DataFrame, sales: DataFrame, products: DataFrame) -> DataFrame:
    """Views with their category and, of the customer's sales strictly before the view: number, mean price (NULL without any)
    and number in that category. A view without customer has no history."""
    category = products.select("sku", "category")
    sold = sales.select("customer_id", "sku", "unit_price", "order_timestamp").join(category, "sku", "left").fillna({"category": "Unknown"})
    seen = views.join(category, "sku", "left").fillna({"category": "Unknown"})
    one = F.lit(1).cast("long")
    overall = Level([], {"purchases": one, "_priced": F.when(F.col("unit_price").isNotNull(), one), "_spend": F.col("unit_price")})
    counted = as_of(seen, sold, ["customer_id"], [overall, Level(["category"], {"category_purchases": one})], "timestamp", "order_timestamp")
    mean = F.when(F.col("_priced") > 0, F.col("_spend").cast("double") / F.col("_priced"))
    return counted.withColumn("past_price", mean).drop("_priced", "_spend")


def category_purchases(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Purchases per (customer, category)."""
    return (
        sales.join(products.select("sku", "category"), "sku", "left")
        .fillna({"category": "Unknown"})
        .groupBy("customer_id", "category")
        .agg(F.count("*").alias("category_purchases"))
    )


def score_views(views: DataFrame, profiles: DataFrame, products: DataFrame, promo_day: str = "to_date(timestamp)") -> DataFrame:
    """Customer views with profile and all behaviour scores.

    `views` needs session_no. With the columns of `with_history` scores see each customer's past, without them all customers
    are new. Views of customers without profile keep NULL scores and the default probabilities.
    """
    spark = views.sparkSession
    kinds = [s[0] for s in V.SESSION_TYPES]
    session_type = weighted_choice(kinds, [s[1] for s in V.SESSION_TYPES], F.col("_draw"))
    if "category_purchases" not in views.columns:
        views = views.join(products.select("sku", "category"), "sku", "left").fillna({"category": "Unknown"})
        views = views.withColumns({"purchases": F.lit(0).cast("long"), "past_price": F.lit(None).cast("double"), "category_purchases": F.lit(0).cast("long")})
    base = (
        views.withColumn("_draw", u("session_type", "customer_id", "session_no")).withColumn("session_type", session_type).drop("_draw")
        .join(dims.session_types(spark).select("session_type", "add_base", "abandon_factor"), "session_type", "left")
        .join(profiles.select("customer_id", "segment", "gender", "tech_affinity", "price_sensitivity", "cart_abandonment_rate",
                              "conversion_base", "avg_items_per_cart", "preferred_categories"), "customer_id", "left")
    )
    price, sens, past = F.col("price_viewed").cast("double"), F.col("price_sensitivity"), F.col("past_price")
    segment, n = "segment", F.col("purchases")
    promotional = is_promotional(promo_day)
    return with_preference(base, "category", "preference").withColumns({
        "view_probability": scores.view_probability(F.col("preference"), price, sens, past, F.col("category_purchases")),
        "add_probability": scores.add_to_cart_probability(F.col("add_base"), segment, sens, price, past, n),
        "abandon_probability": scores.abandonment_probability(F.col("cart_abandonment_rate"), F.col("abandon_factor"), segment, sens, price, past),
        "price_factor": scores.price_factor(segment, sens, price, past),
    }).withColumn("conversion_probability", scores.conversion_probability(F.col("conversion_base"), F.col("price_factor"), promotional, n))
