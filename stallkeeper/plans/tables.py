"""Sources, sinks, schema operators and callbacks."""

from pyspark.sql import functions as F

from stallkeeper.operators import callbacks
from stallkeeper.plans.base import query
from stallkeeper.session import scratch
from stallkeeper.sources import files

c = F.col
VIEWS = 'SELECT http_request_id, CAST("timestamp" AS VARCHAR) AS "timestamp", sku, instock, CAST(price_viewed AS DOUBLE) AS price_viewed, customer_id FROM views'


def _round_trip(m, df, name):
    path = scratch(m.spark, name)
    files.write_csv(df, path)
    return files.read_csv(m.spark, path, df.schema)


@query("src01_csv_scan", VIEWS)
def src01(m):
    return _round_trip(m, m.views(), "views")


@query("src02_partitioned_scan", "SELECT sku, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM line_sales GROUP BY 1")
def src02(m):
    lines = _round_trip(m, m.line_sales(), "line_sales")
    return lines.groupBy("sku").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("src03_file_select")
def src03(m):
    return files.list_tables(m.spark, m.folder, ".parquet")


@query("snk01_csv_sink", "SELECT message_id, topic, payload, username FROM messages")
def snk01(m):
    return _round_trip(m, m.messages().select("message_id", "topic", "payload", "username"), "messages")


@query("snk02_table_append", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1")
def snk02(m):
    path, lines = scratch(m.spark, "appended"), m.table("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    for status in ("O", "F", "O"):  # the repeated batch adds nothing
        files.append(lines.filter(c("l_linestatus") == status), path, status)
    stored = files.read_appended(m.spark, path, lines.schema)
    return stored.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def _profile_sql() -> str:
    columns = [("c_custkey", "BIGINT"), ("c_name", None), ("c_nationkey", "BIGINT"), ("c_acctbal", "DOUBLE"), ("c_mktsegment", None)]
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS name, '{n}' AS clean_name, count(*) - count({n}) AS null_count, "
        + ("CAST(NULL AS BIGINT)" if t else f"max(length({n}))") + " AS max_length, "
        + (f"'{t}'" if t else f"'VARCHAR(' || greatest(max(length({n})) * 2, 255) || ')'") + " AS sql_type FROM customer"
        for i, (n, t) in enumerate(columns, 1))


@query("sch01_schema_profile", _profile_sql())
def sch01(m):
    return files.schema_profile(m.table("customer"))


@query("sch01_document_profile", """
    SELECT 1 AS position, 'doc id' AS name, 'doc_id' AS clean_name, 0 AS null_count, CAST(NULL AS BIGINT) AS max_length, 'BIGINT' AS sql_type
    UNION ALL SELECT 2, 'full-text', 'full_text', count(*) - count(text), max(length(text)), 'VARCHAR(' || greatest(max(length(text)) * 2, 255) || ')' FROM documents""")
def sch01_documents(m):
    return files.schema_profile(m.table("documents").select(c("doc_id").cast("long").alias("doc id"), c("text").alias("full-text")))


def _inferred_sql() -> str:
    readable = {
        "BIGINT": "regexp_full_match({0}, '[+-]?[0-9]{{1,18}}')", "DOUBLE": "TRY_CAST({0} AS DOUBLE) IS NOT NULL",
        "DATETIME": "TRY_CAST({0} AS TIMESTAMP) IS NOT NULL", "BOOLEAN": "lower({0}) IN ('true', 'false')",
    }
    columns = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    parts = []
    for i, name in enumerate(columns, 1):
        text = f"CAST({name} AS VARCHAR)"
        whens = " ".join(f"WHEN bool_and({test.format(text)}) THEN '{kind}'" for kind, test in readable.items())
        parts.append(f"SELECT {i} AS position, '{name}' AS name, count(*) - count({name}) AS null_count, max(length({text})) AS longest, CASE {whens} END AS kind FROM events")
    return f"""SELECT position, name, name AS clean_name, null_count, CASE WHEN kind IS NULL THEN longest END AS max_length,
        coalesce(kind, 'VARCHAR(' || greatest(longest * 2, 255) || ')') AS sql_type FROM ({" UNION ALL ".join(parts)})"""


@query("sch01_inferred_profile", _inferred_sql())
def sch01_inferred(m):
    path = scratch(m.spark, "untyped")
    files.write_csv(m.table("events"), path)
    return files.schema_profile(files.read_csv_typed(m.spark, path))


@query("sch03_inferred_load", 'SELECT event_id, CAST(ts AS VARCHAR) AS "ts", CASE WHEN event_type <> \'error\' THEN value END AS unit_value, event_type AS unit_value_2 FROM events')
def sch03_inferred(m):
    """No schema is declared; two names clean to the same one."""
    spoiled = F.when(c("event_type") == "error", float("nan")).otherwise(c("value"))
    path = scratch(m.spark, "untyped")
    files.write_csv(m.table("events").select("event_id", "ts", spoiled.alias("unit value"), c("event_type").alias("unit-value")), path)
    return files.clean_load(m.spark, path, None, scratch(m.spark, "loaded"))


@query("sch02_normalize_nulls", "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def sch02(m):
    spoiled = m.table("events").select("event_id", F.when(c("event_type") == "error", float("nan")).otherwise(c("value")).alias("value"))
    return files.normalize_nulls(spoiled)


@query("sch03_clean_load", "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS unit_value FROM events")
def sch03(m):
    spoiled = m.table("events").select("event_id", F.when(c("event_type") == "error", float("nan")).otherwise(c("value")).alias("unit value"))
    path = scratch(m.spark, "raw")
    files.write_csv(spoiled, path)
    return files.clean_load(m.spark, path, spoiled.schema, scratch(m.spark, "loaded"))


@query("ud01_batch_callback", "SELECT event_id, value * 2 + 1 AS scaled FROM events")
def ud01(m):
    events = m.table("events").select("event_id", "value")
    return callbacks.batch_apply(events, lambda b: b.assign(scaled=b["value"] * 2 + 1)[["event_id", "scaled"]], "event_id long, scaled double")


@query("ud02_grouped_callback", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ud02(m):
    counted = callbacks.grouped_counts(m.table("events"), ["user_id"], "event_type")
    return counted.select("user_id", F.explode("event_type_counts").alias("event_type", "n"))
