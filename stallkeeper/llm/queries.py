"""Registered queries of this subpackage and their DuckDB oracles, where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm import centroids, decontaminate, html_text, langid, licenses, lm, near_dup, packing, quality, ranked, secret_scan, token_files, topk
from stallkeeper.session import scratch, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op7_minhash_near_dedup",
    rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)""",
)
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, similarity="0.85", table="visible")


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("expressions")


@query(
    "op2_decontaminate",
    rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS x
    FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
p AS MATERIALIZED (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v))),
h AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, k, n FROM p JOIN v USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.ids_crc32(token_files.read_tokens(spark, path))


@query(
    "op9_exact_topk",
    """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.r AS q, c.r AS c, q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5""",
)
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a doc_id counts as held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(_remainder(4) == 2, F.lit(True)).alias("held_out"))
    filters = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a doc_id counts as held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(True)).alias("held_out"), "text")
    rows = stored(quality.with_stats(docs, keep_text=False), "stats")
    rules = quality.fit(rows.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = rows.select("doc_id", "held_out", rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a doc_id counts as held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(_remainder(10) == 0, F.lit(True)).alias("held_out"))
    return lm.score(docs, "held_out")


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The patterns of `secret_scan.RULES` for DuckDB, with both cases spelled out, the group that is measured, and its least length.
_SECRETS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("forge", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("pay", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    ("url", r"://[^\x00-\x20:/@]{1,200}:[^\x00-\x20/@]{1,200}@", 0, 0),
]


def _secret_spans() -> str:
    """Matches and the pieces between them give the places: a match starts after all pieces and matches before it."""
    parts = []
    for place, (kind, pattern, group, least) in enumerate(_SECRETS):
        pattern = pattern.replace("'", "''")
        parts.append(f"""SELECT id, '{kind}' AS kind, {place} AS place, list_sum([len(x) FOR x IN cut[1:i]]) + coalesce(list_sum([len(x) FOR x IN hit[1:i - 1]]), 0) AS a, len(hit[i]) AS n
    FROM (SELECT id, hit, cut, part, unnest(range(1, len(hit) + 1)) AS i FROM (SELECT id, regexp_extract_all(t, '{pattern}') AS hit, regexp_extract_all(t, '{pattern}', {group}) AS part,
        string_split_regex(t, '{pattern}') AS cut FROM d)) WHERE len(part[i]) >= {least}""")
    return " UNION ALL ".join(parts)


@query(
    "op11_secret_scan",
    f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({_secret_spans()}),
g AS (SELECT id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(concat_ws(':', kind, CAST(a AS BIGINT), CAST(a + n AS BIGINT)), ',' ORDER BY a, place) FILTER (place < 3) AS base,
    string_agg(concat_ws(':', kind, CAST(a AS BIGINT), CAST(a + n AS BIGINT)), ',' ORDER BY a, place) AS spans FROM s GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (id)""",
)
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_scan.Ledger.create(spark, scratch(spark, "ledger"))
    found = ledger.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["place"] < 3)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(written(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, written("spans").alias("spans"))


@query(
    "op12_ranked_search",
    rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS MATERIALIZED (SELECT r, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
a AS MATERIALIZED (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM k),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM k) SEMI JOIN (SELECT DISTINCT t FROM q) USING (t) GROUP BY r, t),
f AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln((2 * a.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, a GROUP BY t, a.n),
m AS MATERIALIZED (SELECT r, doc_id, 50 + (50 * k.n * a.n) // a.l AS m FROM k, a),
s AS (SELECT q.item_id, m.r, m.doc_id, CAST(sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS BIGINT) AS score
    FROM q JOIN f USING (t) JOIN p USING (t) JOIN m ON p.r = m.r GROUP BY q.item_id, m.r, m.doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 50""",
)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _rounds(rounds: int = 3, k: int = 16) -> str:
    """One step of assignment and centroids after the other; the last one's assignment is the result."""
    nearest = "SELECT v.r, arg_min(c.i, (list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.v, c.v)]), c.i)) AS i, min(CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.v, c.v)]) AS BIGINT)) AS d FROM v, c{} c GROUP BY v.r"
    steps = [f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS i, v FROM v QUALIFY i < {k})"]
    for j in range(rounds + 1):
        steps.append(f"a{j} AS MATERIALIZED ({nearest.format(j)})")
        if j < rounds:
            steps.append(f"""c{j + 1} AS MATERIALIZED (SELECT c.i, coalesce(g.v, c.v) AS v FROM c{j} c LEFT JOIN (SELECT i, list(x ORDER BY p) AS v FROM
    (SELECT i, p, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM (SELECT a.i, unnest(v.v) AS x, unnest(range(1, 65)) AS p FROM a{j} a JOIN v USING (r)) GROUP BY i, p) GROUP BY i) g USING (i))""")
    return ",\n".join(steps)


@query(
    "op13_centroid_clusters",
    f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
{_rounds()}
SELECT v.vec_id, a.i AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.i) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM v JOIN a3 a USING (r) JOIN c3 c USING (i)""",
)
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))
