"""All data-quality rules in one run over the tables.

Every row becomes a few narrow facts, each with a key in one of the spaces below; facts are summed by (space, key) before and
after one shuffle, and a last aggregate reads every rule off those sums:

- a space per table keyed by a 128-bit digest of the row: row rules as a bit mask, nulls, repeated rows;
- customers, skus, (merchant, sku) pairs, request, order and cart ids: repeated and unknown keys, sold and depleted quantities;
- days and prices: variation and median; (customer, sku) and (customer, sku, price): prices paid but never seen.

A sale at a price never seen, but with some price seen, is counted as the difference of two sums: sales whose (customer, sku)
has a seen price, less sales whose (customer, sku, price) was seen. Only the rule on views near sales needs rows to meet, and
keeps its own two scans. So each table is read once, sales and views twice, and prices once more for the bounds of the median.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper import values as V
from stallkeeper.operators import aggregates as A, quality as Q
from stallkeeper.session import stored

c = F.col
#: Spaces of keys that several tables share; each table has one of its own from TABLE on.
CUSTOMER, SKU, PAIR, REQUEST, ORDER, CART, DAY, PRICE, SHOWN, SHOWN_PRICE = range(10)
TABLE = 100
WHOLE = ("tinyint", "smallint", "int", "bigint")
NUMBER = "DECIMAL(28,9)"
KEY = {"k1": "BIGINT", "k2": "BIGINT", "k3": "STRING", "k4": "STRING", "k5": "DOUBLE"}
SUMS = {"a": "BIGINT", "b": "BIGINT", "n": "BIGINT", "x": NUMBER, "y": NUMBER}
MORE = {"mask": "BIGINT", "whole": "BIGINT"}


def _fact(space: int, when: str = "", **values: str) -> str:
    """A fact as SQL text; without the condition it is NULL."""
    fields = [f"'{n}', CAST({values.get(n, 'NULL')} AS {t})" for n, t in (KEY | SUMS | MORE).items()]
    packed = f"named_struct('space', {space}, {', '.join(fields)})"
    return f"CASE WHEN {when} THEN {packed} END" if when else packed


def _at(types: dict[str, str], *names: str) -> dict[str, str]:
    """Key columns for the named columns: whole numbers as they are, others as text."""
    numbers, texts, out = ["k1", "k2"], ["k3", "k4"], {}
    for name in names:
        out[(numbers if types[name] in WHOLE else texts).pop(0)] = name
    return out


def _there(*names: str) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in names)


def _rate(part: str, whole: str) -> str:
    return f"try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE))"


class Run:
    """Facts of the tables, and the expressions that read rules off their sums. Expressions are SQL text: there are hundreds."""

    def __init__(self, tables: Q.Tables):
        self.tables = tables
        self.types = {t: dict(df.dtypes) for t, df in tables.items()}
        self.places = {t: TABLE + i for i, t in enumerate(tables)}
        self.row_rules = {t: [r for r in Q.ROW_RULES if r.table == t and all(n in types for n in r.needs)] for t, types in self.types.items()}
        self.middle = A.median_bounds(tables["products"], "base_price") if self.has("products", "base_price") else None

    def has(self, table: str, *columns: str) -> bool:
        return table in self.types and set(columns) <= set(self.types[table])

    # -- facts

    def facts(self) -> DataFrame:
        return reduce(DataFrame.union, [self._table(t) for t in self.tables])

    def _table(self, table: str) -> DataFrame:
        df, types = self.tables[table], self.types[table]
        h1, h2 = A.row_digest(df)
        bits = [F.shiftleft(F.coalesce(r.bad(types), F.lit(False)).cast("long"), i) for i, r in enumerate(self.row_rules[table])]
        keys = Q.EXAMPLE[table]
        example = ", ".join(f"CAST({k} AS STRING)" for k in keys) if self.has(table, *keys) else ""
        # Rows of one digest have one example. As a key it costs nothing; as an aggregate, text would have all facts sorted.
        named = {"whole": keys[0]} if example and len(keys) == 1 and types[keys[0]] in WHOLE else {"k3": f"CASE WHEN _mask <> 0 THEN concat_ws('/', {example}) END"} if example else {}
        aged = {"b": "CAST(age IS NOT NULL AS INT)", "x": "age"} if self.has("customers", "age") and table == "customers" else {}
        out = [_fact(self.places[table], a="1", n="_nulls", k1="_h1", k2="_h2", mask="_mask", **named, **aged), *getattr(self, f"_{table}")(types)]
        marked = df.select("*", h1.alias("_h1"), h2.alias("_h2"), A.null_cells(df).alias("_nulls"), reduce(lambda a, b: a + b, bits, F.lit(0).cast("long")).alias("_mask"))
        return marked.selectExpr(f"inline(array({', '.join(out)}))").where("space IS NOT NULL")

    def _customers(self, types: dict) -> list[str]:
        return [_fact(CUSTOMER, a="1", **_at(types, "customer_id"))] if "customer_id" in types else []

    def _products(self, types: dict) -> list[str]:
        out = [_fact(SKU, a="1", **_at(types, "sku"))] if "sku" in types else []
        if self.middle:
            lo, hi = (f"{x!r}D" for x in self.middle)
            price = "CAST(base_price AS DOUBLE)"
            out.append(_fact(PRICE, _there("base_price"), a="1", k5=f"CASE WHEN {price} BETWEEN {lo} AND {hi} THEN {price} END", b=f"CAST({price} < {lo} AS INT)"))
        return out

    def _offers(self, types: dict) -> list[str]:
        return [_fact(PAIR, a="1", **_at(types, "merchant_id", "sku"))] if {"merchant_id", "sku"} <= set(types) else []

    def _views(self, types: dict) -> list[str]:
        out = [_fact(space, _there(name), b="1", **_at(types, name)) for space, name in ((CUSTOMER, "customer_id"), (SKU, "sku")) if name in types]
        if "http_request_id" in types:
            out.append(_fact(REQUEST, a="1", **_at(types, "http_request_id")))
        if "timestamp" in types:
            day = "to_date(timestamp)" if types["timestamp"] == "timestamp_ntz" else "to_date(try_cast(timestamp AS TIMESTAMP_NTZ))"
            out.append(_fact(DAY, f"{day} IS NOT NULL", a="1", k3=day))
        if {"customer_id", "sku", "price_viewed"} <= set(types):
            shown, at = _there("customer_id", "sku", "price_viewed"), _at(types, "customer_id", "sku")
            out += [_fact(SHOWN, shown, a="1", **at), _fact(SHOWN_PRICE, shown, a="1", k5="price_viewed", **at)]
        return out

    def _sales(self, types: dict) -> list[str]:
        out = []
        if "customer_id" in types:
            out.append(_fact(CUSTOMER, _there("customer_id"), n="1", **_at(types, "customer_id")))
        if {"merchant_id", "sku"} <= set(types):
            out.append(_fact(PAIR, b="1", x="quantity" if "quantity" in types else "NULL", **_at(types, "merchant_id", "sku")))
        if "order_id" in types:
            out.append(_fact(ORDER, a="1", **_at(types, "order_id")))
        if {"customer_id", "sku", "unit_price"} <= set(types):
            at = _at(types, "customer_id", "sku")
            out += [_fact(SHOWN, _there("customer_id", "sku"), b="1", **at), _fact(SHOWN_PRICE, _there("customer_id", "sku", "unit_price"), b="1", k5="unit_price", **at)]
        return out

    def _inventory_events(self, types: dict) -> list[str]:
        if not {"merchant_id", "sku", "event_type", "quantity"} <= set(types):
            return []
        return [_fact(PAIR, "event_type = 'sale'", n="1", y="quantity", **_at(types, "merchant_id", "sku"))]

    def _cart_events(self, types: dict) -> list[str]:
        if not {"cart_id", "event_type"} <= set(types):
            return []
        return [_fact(CART, a="CAST(event_type = 'add_to_cart' AS INT)", b="CAST(event_type = 'cart_abandoned' AS INT)", **_at(types, "cart_id"))]

    # -- rules

    def result(self) -> DataFrame:
        """One row: `results`, an array of rule rows; `summary`, an array of table rows; the metrics of the run."""
        self.aggs: list[str] = []
        rules = [r for t in self.tables for r in self._own_rules(t)] + self._key_rules() + self._rates()
        summary = [
            f"named_struct('table_name', '{t}', 'row_count', {self._rows(t)}, 'column_count', {len(df.columns)}L, "
            f"'null_values', {self._sum('n', self._of(t))}, 'duplicate_rows', {self._sum('a - 1', self._of(t))})"
            for t, df in self.tables.items()
        ]
        buyers = self._sum("1", f"space = {CUSTOMER} AND n > 0")
        metrics = [f"{_rate(buyers, self._rows('customers'))} AS customer_purchase_rate", f"{_rate(self._rows('sales'), self._rows('views'))} AS overall_conversion_rate"]
        sums = [*[f"sum({n}) AS {n}" for n in SUMS], "bit_or(mask) AS mask", "min(whole) AS whole"]
        keyed = self.facts().groupBy("space", *KEY).agg(*[F.expr(x) for x in sums])
        row = self._merged(keyed).selectExpr(*self.aggs)
        if self.middle:
            row = row.withColumn("_median", A.middle_of(c("_prices"), c("_priced"), c("_below")))
        near = {name: x.alias(name) for name, x in self._near().items()}
        return row.select("*", *near.values()).selectExpr(f"array({', '.join(rules)}) AS results", f"array({', '.join(summary)}) AS summary", *metrics)

    def _merged(self, keyed: DataFrame) -> DataFrame:
        """Keys whose names no rule asks for, merged by equal sums into one row with their number `w`: of tens of millions, a few
        hundred are left beside those that may be an example. Days, prices and customers are summed by themselves and stay."""
        alone = [DAY, PRICE, *([self.places["customers"]] if "customers" in self.places else [])]
        named = (f"CASE WHEN space IN ({', '.join(map(str, alone))}) THEN true WHEN space >= {TABLE} THEN mask <> 0 WHEN space = {PAIR} THEN a > 1 OR b > 0 OR n > 0 "
                 f"ELSE space IN ({CUSTOMER}, {SKU}, {REQUEST}, {ORDER}) AND (a > 1 OR coalesce(a, 0) = 0) END")  # fmt: skip
        kept = [f"CASE WHEN _named THEN {k} END AS {k}" for k in (*KEY, "whole")]
        narrow = keyed.withColumn("_named", F.expr(named)).selectExpr("space", *kept, *SUMS, "mask")
        return narrow.groupBy(*narrow.columns).agg(F.count("*").alias("w"))

    def _add(self, agg: str, name: str = "") -> str:
        name = name or f"v{len(self.aggs)}"
        self.aggs.append(f"{agg} AS {name}")
        return name

    def _sum(self, value: str, where: str) -> str:
        return self._add(f"CAST(coalesce(sum(CASE WHEN {where} THEN ({value}) * w END), 0) AS BIGINT)")

    def _first(self, where: str, *values: str) -> str:
        return f"coalesce({', '.join(self._add(f'CAST(min(CASE WHEN {where} THEN {v} END) AS STRING)') for v in values)}, CAST(NULL AS STRING))"

    def _of(self, table: str) -> str:
        return f"space = {self.places[table]}"

    def _rows(self, table: str) -> str:
        return self._sum("a", self._of(table)) if table in self.places else "0L"

    def _rule(self, rule_id: str, table: str, issue: str, violations: str, example: str = "NULL", measure: str = "NULL") -> str:
        said = issue.replace("'", "\\'")
        return (f"named_struct('rule_id', '{rule_id}', 'table_name', '{table}', 'issue', '{said}', 'violations', CAST({violations} AS BIGINT), "
                f"'measure', CAST({measure} AS DOUBLE), 'example', CAST({example} AS STRING))")  # fmt: skip

    def _own_rules(self, table: str) -> list[str]:
        rows = self._rows(table)
        out = [self._rule("DQ01", table, "Table is empty", f"{rows} = 0")]
        for rule_id, (name, needed) in Q.REQUIRED.items():
            if name == table:
                missing = len([n for n in needed if not self.has(table, n)])
                out.append(self._rule(rule_id, table, V.ISSUES["missing"], f"CASE WHEN {rows} > 0 THEN {missing} ELSE 0 END"))
        for i, r in enumerate(self.row_rules[table]):
            bad = f"{self._of(table)} AND (mask & {1 << i}) <> 0"
            out.append(self._rule(r.rule_id, table, r.issue, self._sum("a", bad), self._first(bad, "whole", "k3")))
        return out

    def _key_rules(self) -> list[str]:
        out, pair = [], "concat_ws('/', k3, k4, CAST(k1 AS STRING), CAST(k2 AS STRING))"
        for rule_id, space in (("DQ03", CUSTOMER), ("DQ09", SKU), ("DQ17", PAIR), ("DQ19", REQUEST), ("DQ24", ORDER)):
            table, keys, issue = Q.DUPLICATES[rule_id]
            if self.has(table, *keys):
                bad = f"space = {space} AND a > 1"
                out.append(self._rule(rule_id, table, issue, self._sum("a - 1", bad), self._first(bad, *((pair,) if space == PAIR else ("k1", "k3")))))
        for rule_id, child, parent, keys, space in (("DQ35", "views", "customers", ["customer_id"], CUSTOMER), ("DQ36", "views", "products", ["sku"], SKU), ("DQ37", "sales", "offers", ["merchant_id", "sku"], PAIR)):
            if self.has(child, *keys) and self.has(parent, *keys):
                bad = f"space = {space} AND b > 0 AND coalesce(a, 0) = 0 AND {_there(*_at(self.types[child], *keys))}"
                out.append(self._rule(rule_id, child, V.ISSUES[rule_id], self._sum("1", bad), self._first(bad, *((pair,) if space == PAIR else ("k1", "k3")))))
        if self.has("sales", "merchant_id", "sku", "quantity") and self.has("inventory_events", "merchant_id", "sku", "event_type", "quantity"):
            out.append(self._depletion(pair))
        return out

    def _depletion(self, pair: str) -> str:
        """Pairs whose sold and depleted quantities differ by more than 1; without any recorded sale there is nothing to compare."""
        sold, gone = "coalesce(x, 0)", "abs(coalesce(y, 0))"
        whole = _there(*_at(self.types["sales"], "merchant_id", "sku"))
        # A pair with a NULL matches nothing, so both sides stand alone.
        wrong = f"(CASE WHEN {whole} THEN CAST(abs({sold} - {gone}) > 1 AS INT) ELSE CAST(abs({sold}) > 1 AS INT) + CAST({gone} > 1 AS INT) END)"
        bad = f"space = {PAIR} AND (b > 0 OR n > 0) AND {wrong} > 0"
        recorded = f"{self._sum('n', f'space = {PAIR}')} > 0"
        return self._rule("DQ41", "inventory_events", V.ISSUES["DQ41"], f"CASE WHEN {recorded} THEN {self._sum(wrong, bad)} ELSE 0 END", f"CASE WHEN {recorded} THEN {self._first(bad, pair)} END")

    def _range(self, rule_id: str, table: str, measure: str, lo: float | None, hi: float) -> str:
        bad = f"{measure} > {hi}D" if lo is None else f"({measure} < {lo}D OR {measure} > {hi}D)"
        return self._rule(rule_id, table, V.ISSUES[rule_id], f"CAST(coalesce({bad}, false) AS INT)", measure=measure)

    def _near(self) -> dict[str, Column]:
        if not (self.has("sales", "customer_id", "sku", "order_timestamp", "order_id") and self.has("views", "customer_id", "sku", "timestamp", "instock")):
            return {}
        return {"_near": Q.sold_out_of_stock(self.tables).agg(F.struct(F.count("*").alias("n"), F.min("order_id").cast("string").alias("e"))).scalar()}

    def _rates(self) -> list[str]:
        out, sales = [], self._rows("sales")
        if self._near():
            out.append(self._rule("DQ38", "sales", V.ISSUES["DQ38"], "_near.n", "_near.e"))
        if self.has("sales", "customer_id", "sku", "unit_price") and self.has("views", "customer_id", "sku", "price_viewed"):
            unseen = f"({self._sum('b', f'space = {SHOWN} AND a > 0')} - {self._sum('b', f'space = {SHOWN_PRICE} AND a > 0')})"
            out.append(self._range("DQ39", "sales", _rate(unseen, sales), None, 0.05))
        if "sales" in self.types and self.has("views", "customer_id"):
            out.append(self._range("DQ42", "sales", _rate(sales, self._sum("b", f"space = {CUSTOMER}")), *V.CONVERSION_RANGE))
        if self.has("cart_events", "cart_id", "event_type"):
            left, added = (self._sum("1", f"space = {CART} AND {n} > 0") for n in ("b", "a"))
            out.append(self._range("DQ43", "cart_events", _rate(left, added), *V.ABANDONMENT_RANGE))
        if self.has("customers", "age"):
            total, counted = self._add(f"sum(CASE WHEN {self._of('customers')} THEN x END)"), self._sum("b", self._of("customers"))
            out.append(self._range("DQ44", "customers", _rate(total, counted), 25, 50))
        if self.has("products", "base_price"):
            if self.middle:
                self._add(f"array_sort(collect_list(CASE WHEN space = {PRICE} AND k5 IS NOT NULL THEN named_struct('v', k5, 'n', a) END))", "_prices")
                self._add(f"sum(CASE WHEN space = {PRICE} THEN a END)", "_priced")
                self._add(f"sum(CASE WHEN space = {PRICE} THEN b END)", "_below")
            out.append(self._range("DQ45", "products", "_median" if self.middle else "CAST(NULL AS DOUBLE)", 1000, 80000))
        if self.has("views", "timestamp"):
            here = f"space = {DAY}"
            days, total = self._sum("1", here), f"CAST({self._sum('a', here)} AS DOUBLE)"
            squares = f"CAST({self._add(f'sum(CASE WHEN {here} THEN CAST(a AS DECIMAL(19,0)) * a END)')} AS DOUBLE)"
            spread = f"CASE WHEN {days} > 1 THEN sqrt(({squares} - {total} * {total} / CAST({days} AS DOUBLE)) / (CAST({days} AS DOUBLE) - 1)) / ({total} / CAST({days} AS DOUBLE)) END"
            out.append(self._range("DQ46", "views", spread, None, 2.0))
        return out


def run(tables: Q.Tables) -> DataFrame:
    """The run's one row, written: what is read off it several times is not planned again with all its expressions."""
    return stored(Run(tables).result(), "validation")


def rules(tables: Q.Tables) -> DataFrame:
    """All rules that apply to the tables given, as `quality.rules` gives them."""
    return run(tables).select(F.inline("results"))


def _flat(tables: Q.Tables) -> DataFrame:
    """One row per rule beside the summary and metrics of the run; issue_text is NULL where the rule is silent."""
    rows = run(tables).select("summary", "customer_purchase_rate", "overall_conversion_rate", F.inline("results"))
    return rows.withColumn("issue_text", F.when(c("violations") > 0, Q.issue_text()))


def quality_scores(tables: Q.Tables) -> DataFrame:
    return _flat(tables).agg(*Q.scores(c("issue_text")))


def _complete(summary: Column) -> Column:
    total = lambda f: F.aggregate(summary, F.lit(0).cast("long"), lambda s, t: s + f(t))
    return F.coalesce(1 - A.rate(total(lambda t: t["null_values"]), total(lambda t: t["row_count"] * t["column_count"])), F.lit(0.0))


ITEMS = ["total_issues", "is_valid", "data_completeness", "referential_integrity", "business_logic_compliance", "overall_quality_score", "customer_purchase_rate", "overall_conversion_rate"]


def _totals(rows: DataFrame, *more: Column) -> DataFrame:
    kept = [F.any_value(n).alias(n) for n in ("summary", "customer_purchase_rate", "overall_conversion_rate")]
    return rows.agg(*Q.scores(c("issue_text")), *kept, *more).withColumns({"is_valid": (c("total_issues") == 0).cast("double"), "data_completeness": _complete(c("summary"))})


def validation_run(tables: Q.Tables) -> DataFrame:
    """Full run as (item, value): issue total, validity, completeness, scores, purchase and conversion rate."""
    return _totals(_flat(tables)).select(F.inline(F.array(*[F.struct(F.lit(n).alias("item"), c(n).cast("double").alias("value")) for n in ITEMS])))


def report_lines(tables: Q.Tables, first: int = 20) -> DataFrame:
    """The run as (section, line): status, totals, metrics, row counts, the `first` issues and how many more there are."""
    issue = F.struct("rule_id", "table_name", "issue", "issue_text")
    row = _totals(_flat(tables), F.array_sort(F.collect_list(F.when(c("issue_text").isNotNull(), issue))).alias("found"))
    line = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("line"))
    percent = lambda name: F.format_string(f"  {name}: %.1f%%", c(name) * 100)
    head = [
        F.when(c("total_issues") == 0, F.lit("Overall Status: PASSED")).otherwise(F.lit("Overall Status: FAILED")), F.format_string("Total Issues Found: %d", c("total_issues")),
        percent("referential_integrity"), percent("business_logic_compliance"), percent("overall_quality_score"),
    ]
    parts = [
        F.array(*[line(i, text) for i, text in enumerate(head)]),
        F.transform("summary", lambda t: line(10, F.format_string("  %s: %d rows, %d columns, %d null values", t["table_name"], t["row_count"], t["column_count"], t["null_values"]))),
        F.transform(F.slice("found", 1, first), lambda i: line(20, F.concat(i["rule_id"], F.lit(" "), i["issue_text"]))),
        F.when(F.size("found") > first, F.array(line(30, F.format_string("  ... and %d more issues", F.size("found") - first)))).otherwise(F.array().cast("array<struct<section:int,line:string>>")),
    ]
    return row.select(F.inline(F.concat(*parts))).orderBy("section", "line")
