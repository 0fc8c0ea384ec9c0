"""Data-quality rules over the seven checked tables.

All row rules of a table run in one aggregate pass. Each rule gives one row: rule_id, table_name, issue, violations,
measure (for rates and averages) and the smallest violating key as example. A rule fires when violations > 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper import dims, values as V
from stallkeeper.functions.scalar import contains_at, keyword_match
from stallkeeper.operators import aggregates as A, relational as R

Tables = dict[str, DataFrame]
c = F.col

REQUIRED = {
    "DQ02": ("customers", ["customer_id", "name", "email", "city", "age", "gender"]),
    "DQ08": ("products", ["sku", "product_id", "category", "subcategory", "base_price"]),
    "DQ14": ("offers", ["merchant_id", "sku", "inventory", "offer_price"]),
    "DQ18": ("views", ["http_request_id", "timestamp", "sku", "instock"]),
    "DQ23": ("sales", ["order_id", "customer_id", "merchant_id", "sku", "quantity", "unit_price"]),
    "DQ29": ("inventory_events", ["timestamp", "merchant_id", "sku", "event_type", "quantity"]),
    "DQ33": ("cart_events", ["cart_id", "customer_id", "sku", "event_type", "timestamp"]),
}
DUPLICATES = {
    "DQ03": ("customers", ["customer_id"], V.ISSUES["DQ03"]),
    "DQ09": ("products", ["sku"], V.ISSUES["DQ09"]),
    "DQ17": ("offers", ["merchant_id", "sku"], V.ISSUES["DQ17"]),
    "DQ19": ("views", ["http_request_id"], V.ISSUES["DQ19"]),
    "DQ24": ("sales", ["order_id"], V.ISSUES["DQ24"]),
}
EXAMPLE = {
    "customers": ["customer_id"], "products": ["sku"], "offers": ["merchant_id", "sku"], "views": ["http_request_id"],
    "sales": ["order_id"], "inventory_events": ["merchant_id", "sku"], "cart_events": ["cart_id"],
}


class RowRule(NamedTuple):
    rule_id: str
    table: str
    issue: str
    needs: list[str]
    bad: Callable[[dict[str, str]], Column]


def _outside(column: str, allowed: list[str]) -> Callable[[dict[str, str]], Column]:
    return lambda types: ~F.coalesce(c(column).isin(allowed), F.lit(False))


def _known_subcategory(types: dict[str, str]) -> Column:
    pairs = [f"{category}/{sub}" for category, subs in V.CATEGORIES.items() for sub in subs]
    return ~F.coalesce(F.concat_ws("/", "category", "subcategory").isin(pairs), F.lit(False))


def _unparsable(types: dict[str, str]) -> Column:
    if types["timestamp"].startswith("timestamp"):
        return F.lit(False)
    return c("timestamp").isNotNull() & F.try_to_timestamp("timestamp").isNull()


def _not_boolean(types: dict[str, str]) -> Column:
    if types["instock"] == "boolean":
        return F.lit(False)
    return ~F.coalesce(F.lower(c("instock").cast("string")).isin("true", "false", "0", "1"), F.lit(False))


def in_stock(types: dict[str, str]) -> Column:
    return c("instock") if types["instock"] == "boolean" else c("instock").try_cast("boolean")


def view_time(types: dict[str, str]) -> Column:
    return c("timestamp") if types["timestamp"] == "timestamp_ntz" else c("timestamp").try_cast("timestamp_ntz")


def _signed(kind: str, positive: bool) -> Callable[[dict[str, str]], Column]:
    return lambda types: (c("event_type") == kind) & ((c("quantity") < 0) if positive else (c("quantity") > 0))


ROW_RULES = [
    RowRule("DQ04", "customers", V.ISSUES["DQ04"], ["customer_id"], lambda t: c("customer_id") < 1),
    RowRule("DQ05", "customers", V.ISSUES["DQ05"], ["age"], lambda t: ~c("age").between(18, 100)),
    RowRule("DQ06", "customers", V.ISSUES["DQ06"], ["gender"], _outside("gender", V.GENDERS)),
    RowRule("DQ07", "customers", V.ISSUES["DQ07"], ["email"], lambda t: ~contains_at(c("email"))),
    RowRule("DQ10", "products", V.ISSUES["DQ10"], ["category"], _outside("category", list(V.CATEGORIES))),
    RowRule("DQ11", "products", V.ISSUES["DQ11"], ["base_price"], lambda t: c("base_price") <= 0),
    RowRule("DQ12", "products", V.ISSUES["DQ12"], ["base_price"], lambda t: c("base_price") > 1_000_000),
    RowRule("DQ13", "products", V.ISSUES["DQ13"], ["category", "subcategory"], _known_subcategory),
    RowRule("DQ15", "offers", V.ISSUES["DQ15"], ["inventory"], lambda t: c("inventory") < 0),
    RowRule("DQ16", "offers", V.ISSUES["DQ16"], ["offer_price"], lambda t: c("offer_price") <= 0),
    RowRule("DQ20", "views", V.ISSUES["DQ20"], ["timestamp"], _unparsable),
    RowRule("DQ21", "views", V.ISSUES["DQ21"], ["instock"], _not_boolean),
    RowRule("DQ22", "views", V.ISSUES["DQ22"], ["instock", "price_viewed"], lambda t: in_stock(t) & c("price_viewed").isNull()),
    RowRule("DQ25", "sales", V.ISSUES["DQ25"], ["quantity"], lambda t: c("quantity") <= 0),
    RowRule("DQ26", "sales", V.ISSUES["DQ26"], ["quantity"], lambda t: c("quantity") > 100),
    RowRule("DQ27", "sales", V.ISSUES["DQ27"], ["unit_price"], lambda t: c("unit_price") <= 0),
    RowRule("DQ28", "sales", V.ISSUES["DQ28"], ["fulfilment_status"], _outside("fulfilment_status", [s for s, _ in V.FULFILMENT])),
    RowRule("DQ30", "inventory_events", V.ISSUES["DQ30"], ["event_type"], _outside("event_type", V.INVENTORY_EVENTS)),
    *[RowRule("DQ31", "inventory_events", V.ISSUES["DQ31"].format(k), ["event_type", "quantity"], _signed(k, True))
      for k in ("initial_stock", "restock", "adjustment")],
    *[RowRule("DQ32", "inventory_events", V.ISSUES["DQ32"].format(k), ["event_type", "quantity"], _signed(k, False))
      for k in ("sale", "damage")],
    RowRule("DQ34", "cart_events", V.ISSUES["DQ34"], ["event_type"], _outside("event_type", V.CART_EVENTS)),
    RowRule("DQ40", "inventory_events", V.ISSUES["DQ40"], ["new_balance"], lambda t: c("new_balance") < 0),
]


def _result(df: DataFrame, rule_id: str, table: str, issue: str, violations: Column, example: Column = None, measure: Column = None) -> DataFrame:
    return df.select(
        F.lit(rule_id).alias("rule_id"), F.lit(table).alias("table_name"), F.lit(issue).alias("issue"),
        violations.cast("long").alias("violations"),
        (F.lit(None) if measure is None else measure).cast("double").alias("measure"),
        (F.lit(None) if example is None else example).cast("string").alias("example"),
    )


def _key(table: str) -> Column:
    keys = EXAMPLE[table]
    return c(keys[0]) if len(keys) == 1 else F.concat_ws("/", *keys)


def row_rules(table: str, df: DataFrame, wanted: set[str]) -> DataFrame | None:
    """One pass over the table for all its wanted row rules."""
    types = dict(df.dtypes)
    rules = [r for r in ROW_RULES if r.table == table and r.rule_id in wanted and all(n in types for n in r.needs)]
    if not rules:
        return None
    aggs = []
    for i, rule in enumerate(rules):
        bad = F.coalesce(rule.bad(types), F.lit(False))
        aggs += [F.count_if(bad).alias(f"v{i}"), F.min(F.when(bad, _key(table))).cast("string").alias(f"e{i}")]
    rows = [
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(table).alias("table_name"), F.lit(r.issue).alias("issue"), c(f"v{i}").alias("violations"),
                 F.lit(None).cast("double").alias("measure"), c(f"e{i}").alias("example"))
        for i, r in enumerate(rules)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def empty_table(table: str, df: DataFrame) -> DataFrame:
    return _result(df.agg(F.count("*").alias("n")), "DQ01", table, "Table is empty", (c("n") == 0).cast("int"))


def required_columns(rule_id: str, tables: Tables) -> DataFrame:
    """Missing columns; not reported for an empty table."""
    table, needed = REQUIRED[rule_id]
    missing = len([n for n in needed if n not in tables[table].columns])
    counted = tables[table].agg(F.count("*").alias("n"))
    return _result(counted, rule_id, table, V.ISSUES["missing"], F.when(c("n") > 0, F.lit(missing)).otherwise(0))


def duplicate_keys(rule_id: str, tables: Tables) -> DataFrame:
    table, keys, issue = DUPLICATES[rule_id]
    repeats = R.repeated_keys(tables[table], keys)
    found = repeats.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("n"), F.min(_key(table)).alias("e"))
    return _result(found, rule_id, table, issue, c("n"), c("e"))


def _count(df: DataFrame, rule_id: str, table: str, issue: str, key: Column = None) -> DataFrame:
    found = df.agg(F.count("*").alias("n"), (F.lit(None) if key is None else F.min(key)).alias("e"))
    return _result(found, rule_id, table, issue, c("n"), c("e"))


def _views(tables: Tables) -> DataFrame:
    """Views with time and stock flag in their proper types."""
    views = tables["views"]
    types = dict(views.dtypes)
    return views.withColumns({"timestamp": view_time(types), "instock": in_stock(types)})


def _range_rule(df: DataFrame, rule_id: str, table: str, issue: str, measure: Column, lo: float | None, hi: float) -> DataFrame:
    bad = measure > hi if lo is None else (measure < lo) | (measure > hi)
    return _result(df, rule_id, table, issue, F.coalesce(bad, F.lit(False)).cast("int"), measure=measure)


def price_mismatches(tables: Tables) -> DataFrame:
    """Sales at a price the customer never saw, where a price was seen."""
    return R.price_in_history(tables["sales"], tables["views"]).filter("has_price AND NOT price_seen")


def _dq39(tables: Tables) -> DataFrame:
    """Share of all sales at a price never seen; above one in twenty the rule fires."""
    flagged = R.price_in_history(tables["sales"], tables["views"])
    share = flagged.agg(A.rate(F.count_if(c("has_price") & ~c("price_seen")), F.count("*")).alias("n"))
    return _result(share, "DQ39", "sales", V.ISSUES["DQ39"], F.coalesce(c("n") > 0.05, F.lit(False)).cast("int"), measure=c("n"))


def _dq42(tables: Tables) -> DataFrame:
    rate = A.ratio_of_counts(tables["sales"], tables["views"].filter("customer_id IS NOT NULL"), "r")
    return _range_rule(rate, "DQ42", "sales", V.ISSUES["DQ42"], c("r"), *V.CONVERSION_RANGE)


def sold_out_of_stock(tables: Tables) -> DataFrame:
    """Sales near a view that showed the sku as out of stock."""
    sold = R.views_near_sales(tables["sales"], _views(tables).filter("instock IS NOT NULL AND timestamp IS NOT NULL"))
    return sold.filter("has_out_of_stock_view")


def _dq38(tables: Tables) -> DataFrame:
    return _count(sold_out_of_stock(tables), "DQ38", "sales", V.ISSUES["DQ38"], c("order_id"))


def _dq41(tables: Tables) -> DataFrame:
    events = tables["inventory_events"]
    has_sales = events.filter("event_type = 'sale'").agg(F.count("*") > 0).scalar()
    wrong = R.reconcile(tables["sales"], events).filter(has_sales)
    return _count(wrong, "DQ41", "inventory_events", V.ISSUES["DQ41"], _key("inventory_events"))


CROSS: dict[str, tuple[list[str], Callable[[Tables], DataFrame]]] = {
    "DQ35": (["views", "customers"], lambda t: _count(
        R.orphan_keys(t["views"], t["customers"], ["customer_id"]), "DQ35", "views", V.ISSUES["DQ35"], c("customer_id"))),
    "DQ36": (["views", "products"], lambda t: _count(
        R.orphan_keys(t["views"], t["products"], ["sku"]), "DQ36", "views", V.ISSUES["DQ36"], c("sku"))),
    "DQ37": (["sales", "offers"], lambda t: _count(
        R.orphan_keys(t["sales"], t["offers"], ["merchant_id", "sku"]), "DQ37", "sales", V.ISSUES["DQ37"], _key("offers"))),
    "DQ38": (["sales", "views"], _dq38),
    "DQ39": (["sales", "views"], _dq39),
    "DQ41": (["sales", "inventory_events"], _dq41),
    "DQ42": (["sales", "views"], _dq42),
    "DQ43": (["cart_events"], lambda t: _range_rule(
        A.abandonment_rate(t["cart_events"]), "DQ43", "cart_events", V.ISSUES["DQ43"], c("abandonment_rate"), *V.ABANDONMENT_RANGE)),
    "DQ44": (["customers"], lambda t: _range_rule(
        t["customers"].agg(A.exact_mean(c("age")).alias("m")), "DQ44", "customers", V.ISSUES["DQ44"], c("m"), 25, 50)),
    "DQ45": (["products"], lambda t: _range_rule(
        A.exact_median(t["products"], "base_price"), "DQ45", "products", V.ISSUES["DQ45"], c("median"), 1000, 80000)),
    "DQ46": (["views"], lambda t: _range_rule(
        A.daily_cv(_views(t).dropna(subset=["timestamp"]), "timestamp"), "DQ46", "views", V.ISSUES["DQ46"], c("cv"), None, 2.0)),
}


def tables_of(rule_id: str) -> set[str]:
    """The tables that a rule reads; the check for empty tables reads all."""
    if rule_id == "DQ01":
        return set(EXAMPLE)
    if rule_id in CROSS:
        return set(CROSS[rule_id][0])
    single = REQUIRED.get(rule_id) or DUPLICATES.get(rule_id)
    return {single[0]} if single else {r.table for r in ROW_RULES if r.rule_id == rule_id}


def rules(tables: Tables, wanted: Iterable[str] | None = None) -> DataFrame:
    """Results of the wanted rules (all by default) that apply to the tables given."""
    ids = set(wanted) if wanted is not None else {f"DQ{i:02d}" for i in range(1, 47)}
    parts = [empty_table(t, df) for t, df in tables.items() if "DQ01" in ids]
    parts += [required_columns(r, tables) for r in REQUIRED if r in ids and REQUIRED[r][0] in tables]
    parts += [duplicate_keys(r, tables) for r in DUPLICATES if r in ids and DUPLICATES[r][0] in tables and set(DUPLICATES[r][1]) <= set(tables[DUPLICATES[r][0]].columns)]
    parts += [p for t, df in tables.items() if (p := row_rules(t, df, ids)) is not None]
    parts += [make(tables) for r, (needs, make) in CROSS.items() if r in ids and all(n in tables for n in needs)]
    return reduce(DataFrame.unionByName, parts)


STRUCTURE = [f"DQ{i:02d}" for i in range(1, 35)]


def issue_text() -> Column:
    """Table rules carry the table name in front."""
    return F.when(c("rule_id").isin(STRUCTURE), F.concat(c("table_name"), F.lit(".csv: "), c("issue"))).otherwise(c("issue"))


def issues(results: DataFrame) -> DataFrame:
    """The fired rules with their issue texts."""
    return results.filter("violations > 0").withColumn("issue_text", issue_text())


def scores(text: Column) -> list[Column]:
    """Aggregates of issue texts (NULL: none) to scores by keyword, each at least 0."""
    score = lambda hits, scale: F.greatest(F.lit(0.0), 1 - hits / F.lit(float(scale)))
    return [
        score(F.count_if(keyword_match(text, ["reference"])), 100).alias("referential_integrity"),
        score(F.count_if(keyword_match(text, ["price", "stock", "inventory"])), 10).alias("business_logic_compliance"),
        score(F.count(text), 50).alias("overall_quality_score"),
        F.count(text).alias("total_issues"),
    ]


def quality_scores(found: DataFrame) -> DataFrame:
    return found.agg(*scores(c("issue_text")))


def first_issues(found: DataFrame, n: int = 20) -> DataFrame:
    """First n issues in rule order and how many more there are. There is one row per rule at most."""
    order = W.orderBy("rule_id", "table_name", "issue")
    numbered = found.withColumns({"_at": F.row_number().over(order), "_all": F.count("*").over(W.partitionBy())})
    return numbered.filter(c("_at") <= n).select("rule_id", "issue_text", F.greatest(F.lit(0).cast("long"), c("_all") - n).alias("more"))
