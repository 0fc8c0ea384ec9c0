"""The training-data operators on small tables: brute force, round trips, and the cases that every operator must take."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallkeeper.llm import decontaminate, graph, html_text, langid, licenses, lm, near_dup, packing, quality, queries, token_files, topk
from stallkeeper.llm import words as W

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
VISIBLE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
#: Null, empty, blank, short, repeated, tied and very long texts, with columns named like the operators' own.
EDGES = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "One", "en"), (5, "one two", "de"), (6, "one two", "de"), (6, "one two", "de"),
    (7, LONG, "en"), (8, LONG, "en"), (9, "¡ÉCOLE! été — ñandú 12", "fr"), (None, "a row without an id", "en"), (10, "... !!! ---", None),
]


def words(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, lang, "s", 0.5, ["x"], 7) for i, t, lang in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, items array<string>, n_words int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_words_match_the_patterns():
    import pyarrow as pa

    texts = [t for _, t, _ in EDGES]
    for table, pattern in ((W.ALNUM, ALNUM), (W.VISIBLE, VISIBLE)):
        for lo, hi, data, offsets in W.slices(pa.array(texts), 100):
            split = W.split(data, offsets, table)
            for i in range(hi - lo):
                own = [split.joined(k, k + 1).decode() for k in range(split.first[i], split.first[i + 1])]
                assert own == words(texts[lo + i], pattern)
    split = W.split(np.frombuffer(b"Ab ab aB b", np.uint8), np.array([0, 6, 10]), W.VISIBLE)
    h = split.hashes()
    assert h[0] == h[1] == h[2] != h[3]


def test_license_scan(spark, edges):
    notices = ["CC-BY 4.0, cc by", "GNU General\nPublic License. All rights reserved", "/* SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0 */", "spdx-license-identifier: (MIT"]
    rows = edges.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(notices)], "doc_id long, text string"))
    out = {(r["doc_id"], r["n_words"]): r for r in licenses.license_scan(rows).collect()}
    for doc_id, text in [(i, t) for i, t, _ in EDGES] + [(100 + i, t) for i, t in enumerate(notices)]:
        own = words(text, ALNUM)
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split()]
        r = out[doc_id, len(own)]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert out[102, len(words(notices[2], ALNUM))]["restriction"] == "permissive"
    assert not out[103, 4]["expressions"]


@pytest.mark.parametrize(
    ("text", "postfix"),
    [("MIT", "mit"), ("MIT OR Apache-2.0 AND BSD", "mit apache-2.0 bsd and or"), ("(MIT OR X) AND Y", "mit x or y and"), ("A WITH B AND C */", "a b with c and"), ("", None), ("OR MIT", None), ("(MIT", None), ("MIT AND", None)],
)
def test_expressions(text, postfix):
    assert licenses.parse(text) == (postfix and postfix.split())


def brute_contamination(text, items):
    own, hit, found = words(text, ALNUM), set(), set()
    for item, body in items:
        w = words(body, ALNUM)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    found.add(item)
    return len(own), len(hit), found


def test_contamination(spark, edges):
    items = [(1, "One two"), (2, None), (3, ""), (4, LONG[3000:3200]), (4, LONG[3000:3200]), (5, "nobody has these words at all in any text of this table"), (6, "one")]
    out = decontaminate.contamination(edges, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(out) == len(EDGES)
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(sorted(r["items"])), r["contaminated"]) for r in out)
    want = []
    for i, t, _ in EDGES:
        n, hit, which = brute_contamination(t, items)
        want.append((i or 0, n, hit, tuple(sorted(which)), hit > 0))
    assert found == sorted(want)
    none = decontaminate.contamination(edges, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(EDGES) and not any(r["contaminated"] for r in none)


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(50)] + [(2000, 2000), (None, 3)]
    out = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}


def jaccard_components(sets, num, den):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_near_duplicates_with_large_groups(spark):
    """A cloud of near copies around the threshold, larger than a block, so pivots and the comparison of the rest are used."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        text = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            text[k] = f"e{i}x{k}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(20)]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, similarity="0.85", block=16).collect()
    sets = {}
    for i, t in rows:
        w = words(t, VISIBLE)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    assert {r["doc_id"]: r["component_id"] for r in out} == jaccard_components(sets, 85, 100)


def test_near_duplicates_edges(edges):
    out = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(edges, width=3, similarity="0.85").collect())
    assert [x for x in out if x[0] in (1, 2, 3)] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [x[2:] for x in out if x[0] in (5, 6)] == [(5, True), (5, False), (5, False)]
    assert [x[2:] for x in out if x[0] in (7, 8)] == [(7, True), (7, False)]
    assert [x[3] for x in out if x[0] == 0] == [False]
    assert not near_dup.near_duplicates(edges.limit(0)).collect()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    found = near_dup.superminhash(np.concatenate([values[:600], values[300:]]), np.array([0, 600, 1200, 1200]))
    assert abs((found[0] == found[1]).mean() - 1 / 3) < 0.1
    assert (found[2] == np.iinfo(np.int64).max).all()
    for j in (0, 5):
        assert len(set(int(near_dup.ranks(values[j : j + 1], k)[0]) for k in range(near_dup.SLOTS))) == near_dup.SLOTS


def test_language(spark, edges):
    out = {(r["doc_id"], r["text"]): r for r in langid.identify(edges, langid.learn(edges)).collect()}
    assert len(out[1, None].asDict()) == len(edges.columns) + 1
    assert [out[k]["lang_pred"] for k in ((1, None), (2, ""), (3, " \t\n"), (10, "... !!! ---"))] == ["und"] * 4
    assert out[5, "one two"]["lang_pred"] in ("de", "en", "fr") and all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in langid.identify(edges, langid.learn(edges.where("lang IS NULL"))).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_grams_never_cross_texts():
    data, at = langid.grams(np.frombuffer("abcdeÉX fg12hij".encode(), np.uint8), np.array([0, 5, 10, 16]))
    alone = [langid.grams(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].tolist() for x in (b"abcde", "ÉX f".encode(), b"g12hij")]
    assert [data[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == alone
    assert alone[1] == langid.grams(np.frombuffer("éx f".encode(), np.uint8), np.array([0, 5]))[0].tolist()


def test_quality_held_out(spark, edges):
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = queries.QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(marks, "doc_id")
    assert found.where("predicted = quality").count() >= 0.95 * found.count()
    stats = quality.with_stats(edges.select("doc_id", "text"), keep_text=False)
    assert not stats.where(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in quality.STATS)).count()
    for label in (None, 0, 1):
        rules = quality.fit(stats, spark.createDataFrame([(4, label), (5, label)], "doc_id long, quality int"))
        assert len(stats.select(rules.score().alias("s")).where("s BETWEEN 0 AND 1").collect()) == len(EDGES)


def test_packing(edges):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    out = packing.pack(edges, path, 2).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    for doc_id, text, _ in {e[:2]: e for e in EDGES}.values():
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted((r for r in out if r["doc_id"] == doc_id), key=lambda r: (r["start"], r["sequence_id"]))
        pieces = [p for k, p in enumerate(pieces) if not k or p["start"] != pieces[k - 1]["start"]]  # of a repeated row
        assert b"".join(p["ids"] for p in pieces) == np.array(ids, "<u4").tobytes()
        assert all(p["length"] == 1 << p["bucket"] <= 4096 and p["doc_tokens"] == len(ids) and not p["offset"] for p in pieces)


def test_elias_fano():
    rng = np.random.default_rng(5)
    for values, universe in (([], 1), ([0], 1), ([3, 3, 3], 4), (np.sort(rng.integers(0, 10**9, 500)), 10**9), (np.arange(1000), 1000)):
        coded = token_files.EliasFano.encode(values, universe)
        again = token_files.EliasFano(len(values), universe, coded.low, coded.high)
        assert again.decode().tolist() == list(values) == [again.select(i) for i in range(len(values))]
    assert coded.size() < 1000
    with pytest.raises(IndexError):
        coded.select(1000)


def test_token_files(spark, edges, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    token_files.write_tokens(edges, str(tmp_path / "t"), path, 0)
    out = sorted(token_files.ids_crc32(token_files.read_tokens(spark, str(tmp_path / "t"))).collect(), key=lambda r: r["start"])
    start = 0
    for r, (doc_id, text, _) in zip(out, sorted(EDGES, key=lambda e: e[0] or 0), strict=True):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write_tokens(edges.limit(0), str(tmp_path / "e"), path, 0)
    assert not token_files.read_tokens(spark, str(tmp_path / "e")).collect()


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piecewise_encoding_equals_whole_texts(name, spaced):
    from stallkeeper.llm.encode import Encoder

    texts = ["a  b", " lead", "trail ", "x \n y", "it's  don't stop", "É é́ ñ", "tab\tand \ttab", "<|endoftext|> a", "1 234 5", "　wide 　", "", " ", "a\n b c"]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for text, got in zip(texts, Encoder(public_tokenizers.path(name), spaced, 4).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_language_model_baseline(spark, edges):
    rows = edges.select("doc_id", "text", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)).alias("held"))
    out = lm.score(rows, "held").collect()
    train = [t for i, t, _ in EDGES if i and i % 2]
    counts: dict[str, int] = {}
    for t in train:
        for w in [*words(t, VISIBLE), "\n"]:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    want = []
    for i, t, _ in EDGES:
        own = [*words(t, VISIBLE), "\n"]
        want.append((i or 0, len(own), sum(w in counts for w in own), total, round(sum(np.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own), 4)))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == sorted(want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_spelling_model_is_a_distribution(docs):
    model = lm.learn(docs.select("text"))
    for context in (b"\0\0\0\0", b"the ", b"zzqx", b"\xc3\xa9s "):
        keys = np.array([sum(b << 8 * (4 - k) for k, b in enumerate(context)) + w for w in range(256)], np.uint64)
        assert abs((10 ** model.log10(keys)).sum() - 1) < 1e-3
    even = lm.learn(docs.limit(0).select("text"))
    assert np.allclose(10 ** even.log10(keys), 1 / 256)


def brute_top(vectors, query, k):
    scored = sorted(((-sum(a * b for a, b in zip(vectors[query], v, strict=True)), i) for i, v in vectors.items() if i != query and len(v) == len(vectors[query])))
    return [(i, -s) for s, i in scored[:k]]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)] + [(300 + i, [0.5] * 6) for i in range(20)] + [(400, [0.0] * 6), (500, None), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (650, [float("inf")] * 6)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=64).collect()
    vectors = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and i < 500}
    for query in (0, 50, 100, 150, 300, 400):
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in out if r["query_id"] == query), key=lambda r: r["rank"])] == brute_top(vectors, query, 5)
    assert {r["query_id"] for r in out} == {0, 50, 100, 150, 300, 400}
    assert not topk.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_topk_rows_of_one_id(spark):
    """Every row but the query's own is a candidate: other vectors of one id, repeated rows, clashing columns."""
    rows = [(0, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [9.0, 0.0]), (2, [1.0, 1.0]), (0, [2.0, 0.0]), (3, [9.0, 0.0]), (3, [9.0, 0.0]), (0, [1.0, 0.0]), (None, [99.0, 0.0]), (4, []), (0, [])]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, row int, score int, n int").repartition(3)
    out = topk.top_k(table, F.col("vec_id") == 0, k=4)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())
    usable = [(i, [int(256 * x) for x in v], k) for k, (i, v) in enumerate(rows) if i is not None]
    want = []
    for i, v, k in usable:
        if i == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, w, m in usable if m != k and len(w) == len(v))
            want += [(0, at + 1, j, -s) for at, (s, j, _) in enumerate(scored[:4])]
    assert found == sorted(want)
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p><article>";</script></head><body class="has-sidebar">
<nav><p>Menu with a long text that must not win anything at all in here</p></nav><div class="cookie-notice">We use cookies</div>
<main><div class="post-12 entry"><h1>A &amp; B</h1><p>First   line<br>goes <b>on.<p>Second &eacute; &lt;b&gt;.<!-- <p>no</p> --></p><ul><li>one<li>two</ul><div class="ad">Buy</div>
<form><p>Name</p></form></div><section id="comments"><p>A reader wrote a comment that is long enough to count as text, more than the article.</p></section></main><footer>&copy; end</footer></body></html>"""


def test_html(spark):
    short = PAGE.replace("post-12", "post-9")
    odd = "<p>loose &am text <a href='x'>and link</a>"
    rows = [(1, "http://a.example/x", PAGE), (2, "https://www.a.example/y", short), (3, None, None), (4, "", ""), (5, "http://b.example", odd), (5, "http://b.example", odd), (6, "http://a.example/z", odd), (7, "x", "<script>unclosed <p>no"), (8, "x", "a < b &#x41; <")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))).collect()
    want = "A & B\nFirst line goes on.\nSecond é <b>.\none\ntwo"
    got = {r["page_id"]: r["text"] for r in out}
    assert got == {1: want, 2: want, 3: "", 4: "", 5: "loose &am text and link", 6: "loose &am text and link", 7: "", 8: "a < b A <"}
    assert len(out) == len(rows)


def test_queries_against_their_oracles(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, folder)
        columns = sorted(found.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want), name


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, folder)
    assert good.columns == docs.columns
    assert good.join(marks, "doc_id").where("quality = 0").count() <= 3
    assert docs.join(marks, "doc_id").where("quality = 1").count() - good.join(marks, "doc_id").where("quality = 1").count() <= 3
    assert corpus_pipeline.run(spark, folder).count()


def test_spelling_model_keeps_rare_kinds(spark, monkeypatch):
    """A kind seen once is learnt however long the corpus; what is sent to executors and what is joined give the same scores."""
    bulk = [(i, "aaaa " * 20_000, False) for i in range(1, 9)]
    rows = spark.createDataFrame([*bulk, (19, "zaaab", False), (20, "qxzj vkwy", False), (21, "qxzj", True), (22, None, True), (None, "aaaa jzxq", True)], "doc_id long, text string, held boolean")
    key = np.array([int.from_bytes(b"zaaa", "big") << 8 | ord("b")], np.uint64)
    assert 10 ** lm.learn(rows.where("NOT held").select("text")).log10(key)[0] > 0.01
    every = {r["doc_id"]: r for r in lm.score(rows, "held").collect()}
    monkeypatch.setattr(lm, "HEAD_KINDS", 5)
    monkeypatch.setattr(lm, "HEAD_WORDS", 1)
    for r in lm.score(rows, "held").collect():
        assert r[:6] == every[r["doc_id"]][:6] and abs(r["score"] - every[r["doc_id"]]["score"]) < 1e-6 * abs(r["score"])


def test_pipeline_keeps_rows_without_their_own_id(spark):
    """Rows with a null or repeated doc_id go only for their own text: as copies, or with a benchmark passage."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    item = max((r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()), key=len)
    rows = [(None, text("a")), (None, text("b")), (1, text("c")), (1, text("d")), (None, text("e")), (5, text("e")), (4, text("e")), (None, text("f")), (None, text("f")), (2, item), (2, text("g")), (None, item + " x " * 3 + text("h"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dup_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"][:2]) for r in kept.where(f"text NOT LIKE '%{item[:8]}%'").collect()]
    assert sorted(found, key=str) == sorted([(None, "a0"), (None, "b0"), (1, "c0"), (1, "d0"), (4, "e0"), (None, "f0"), (2, "g0")], key=str)
    clean = corpus_pipeline.decontamination_stage(spark, kept, folder)
    assert sorted(((r["doc_id"], r["text"][:2]) for r in clean.collect()), key=str) == sorted(found, key=str)


def test_language_stage_takes_out_texts_in_no_language(spark, monkeypatch):
    """Scripts never learnt, letter salad and an unknown language go, however few languages there are; labelled texts stay."""
    import corpus_pipeline

    rng = np.random.default_rng(5)
    letters = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n))
    odd = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "すべての人間は生まれながらにして自由であり", letters(300), "1234 5678"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200").select("doc_id", "text", "lang")
    most = [r["lang"] for r in docs.groupBy("lang").count().orderBy(F.desc("count")).collect()]
    for languages in (most, most[:2]):
        known = docs.where(F.col("lang").isin(languages))
        extra = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
        kept = corpus_pipeline.language_stage(spark, known.union(extra), "")
        assert kept.columns == docs.columns
        assert not kept.where("doc_id < 0").count()
        assert kept.count() >= 0.99 * known.count()


def test_pieces_are_forgotten_by_bytes_without_changing_ids(monkeypatch):
    from stallkeeper.llm import encode

    monkeypatch.setattr(encode, "CACHE_BYTES", 20_000)
    texts = [" ".join(f"word{k * j % 97} Term{k}, x" for k in range(60)) + " the end" for j in range(40)] + ["", "  two  blanks ", "a"]
    for name, spaced, width in (("byte_bpe_50k.json", True, 2), ("word_bpe_49k.json", False, 4)):
        made = encode.Encoder(public_tokenizers.path(name), spaced, width)
        plain = [np.array(e.ids, f"<u{width}").tobytes() for e in made.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [made.encode([text])[0] for text in texts] == plain
        assert made.before and made.size <= 20_000
        held = sum(encode.PIECE_BYTES + len(p) + len(x) for p, x in [*made.known.items(), *made.before.items()])
        assert held <= 30_000
