"""Hand-computed cases of the engine's operators."""

import collections
import datetime as dt
import hashlib
import json
import math
import random
import re
import struct
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanquery import inputs, oracles, queries, schema
from spanquery.functions import scalars, stats
from spanquery.operators import chunking, evals, labels, marts, metrics, quality, retrieval, staging, tools, trace, upsert
from spanquery.plans import probe, registry, verify
from spanquery.sources import cdc, ddl, documents
from spanquery.sources import golden as golden_files
from spanquery.sources import spans as sources
from spanquery.streaming import jobs

T0 = dt.datetime(2026, 1, 1)
COLUMNS = "trace_id string, span_id string, parent_span_id string, status string, ts timestamp_ntz, event_type string, latency_ms double, prompt_tokens long, completion_tokens long, cost_usd double"


def span(spark, *rows):
    """Spans (trace, id, parent, status, seconds, cost)."""
    made = [(t, i, p, s, T0 + dt.timedelta(seconds=sec), "AGENT_STEP", 1.0, 1, 2, c) for t, i, p, s, sec, c in rows]
    return spark.createDataFrame(made, COLUMNS)


def test_contract_has_thirteen_fields_in_order():
    assert [f.name for f in schema.SPAN] == [
        "trace_id", "span_id", "parent_span_id", "session_id", "event_type", "model", "prompt_tokens", "completion_tokens", "latency_ms", "cost_usd", "status", "ts_epoch_ms", "attributes",
    ]


def test_schema_compatibility():
    old = {"fields": [{"name": "a", "type": "int"}, {"name": "b", "type": {"type": "enum", "symbols": ["X"]}}]}
    fine = {"fields": [{"name": "a", "type": ["null", "long"]}, {"name": "b", "type": {"type": "enum", "symbols": ["X", "Y"]}}, {"name": "c", "type": "int", "default": 0}]}
    assert schema.backward_incompatibilities(old, fine) == []
    bad = {"fields": [{"name": "a", "type": "string"}, {"name": "b", "type": {"type": "enum", "symbols": ["Y"]}}, {"name": "c", "type": "int"}]}
    assert len(schema.backward_incompatibilities(old, bad)) == 3


@pytest.mark.parametrize("q,want", [(0.5, 30), (0.95, 50)])
def test_index_percentile(spark, q, want):
    df = spark.createDataFrame([(x,) for x in (10, 20, 30, 40, 50)], "x int")
    assert df.agg(stats.index_percentile("x", q).alias("p")).first().p == want
    assert df.where("x > 99").agg(stats.index_percentile("x", q).alias("p")).first().p is None


def test_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0), (4.0, 9.0), (None, 1.0)], "a double, b double")
    row = df.agg(stats.pearson("a", "b").alias("r"), stats.pearson("a", F.lit(1.0)).alias("c")).first()
    assert row.r == pytest.approx(11 / math.sqrt(130)) and row.c is None


def test_agreement_and_kappa(spark):
    df = spark.createDataFrame([(4, 4), (4, 5), (3, 5), (1, 4)], "judge int, human int")
    row = evals.agreement(df).first()
    assert (row.exact, row.within_one, row.mean_diff) == (0.25, 0.5, -1.5)
    same = spark.createDataFrame([(4, 4), (5, 5), (3, 3), (4, 4)], "a int, b int")
    assert stats.kappa(same, "a", "b").first().kappa == 1.0
    assert stats.kappa(same.where("a = 4"), "a", "b").first().kappa is None
    assert stats.kappa(same.where("a = 9"), "a", "b").first().kappa is None


def test_rate_counts_missing_as_asked(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert df.agg(stats.rate("b").alias("r")).first().r == pytest.approx(1 / 3)
    assert df.agg(stats.rate("b", True).alias("r")).first().r == pytest.approx(2 / 3)
    assert df.agg(stats.rate("b", None).alias("r")).first().r == 0.5


def test_rank_fusion(spark):
    lists = {"dense": "abc", "bm25": "cad"}
    d, b = (spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(lists[m])], "query_id int, doc_id string, rank int") for m in lists)
    got = [(r.doc_id, r.score) for r in retrieval.rrf(d, b, 4).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["a", "c", "b", "d"]
    assert [g[1] for g in got] == pytest.approx([1 / 61 + 1 / 62, 1 / 63 + 1 / 61, 1 / 62, 1 / 63])


def test_bm25_finds_the_matching_text(spark):
    chunks = spark.createDataFrame([(1, "the cat sleeps on a warm roof"), (2, "ships leave the harbour at dawn"), (3, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "a warm roof"), (8, "dawn at a harbour"), (9, "nothing known")], "query_id int, query string")
    best = {r.query_id: r.doc_id for r in retrieval.bm25_search(asked, chunks, 1).collect()}
    assert best == {7: 1, 8: 2, 9: 1}
    # chunks that share no term score 0 and come by key
    assert [(r.query_id, r.doc_id, r.score) for r in retrieval.bm25_search(asked.where("query_id = 9"), chunks, 2).orderBy("rank").collect()] == [(9, 1, 0.0), (9, 2, 0.0)]
    assert {(r.doc_id, r.score) for r in retrieval.bm25_search(asked, chunks, 5, project=F.col("doc_id") == 3).collect()} == {(3, 0.0)}


def bm25_by_hand(chunks, asked, k):
    """Scores in billionths, as the search rounds them."""
    docs = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in chunks}
    df = collections.Counter(w for t in docs.values() for w in set(t))
    mean = sum(map(len, docs.values())) / len(docs)
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    out = []
    for q, text in asked:
        scores = {i: 0 for i in docs}
        for w, times in collections.Counter(re.findall("[a-z0-9]+", (text or "").lower())).items():
            for i, t in docs.items():
                if w in t:
                    tf = t.count(w)
                    scores[i] += round(times * idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean)) * 1e9)
        out += [(q, i, x, n + 1) for n, (i, x) in enumerate(sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_bm25_by_hand(spark, monkeypatch, small):
    """Awkward texts, ties, queries without a known word; and the same in many blocks of queries, chunks and scores."""
    if small:
        for name, value in {"QUERY_ROWS": 2, "QUERY_TERMS": 3, "INDEX_ROWS": 5, "SCORES": 7, "BROADCAST_ROWS": 4}.items():
            monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(1)
    chunks = [(i, " ".join(rng.choice(["the", "Cat", "a-b", "x1", "É", "zebra", "log_line", "K"]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    chunks += [(100, None), (101, ""), (102, "!?"), (103, chunks[3][1]), (-5, chunks[3][1]), (104, "rare")]
    asked = [(1, "the cat"), (2, "rare rare zebra"), (3, "unknown"), (4, None), (5, ""), (6, "log line x1 a b k"), (7, "the cat")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in chunks], "doc_id long, text string, dl int, terms int").repartition(3)
    got = retrieval.bm25_search(spark.createDataFrame(asked, "query_id int, query string"), frame, 4)
    assert got.columns == ["query_id", "doc_id", "score", "rank"]
    assert sorted((r.query_id, r.doc_id, round(r.score * 1e9), r.rank) for r in got.collect()) == bm25_by_hand(chunks, asked, 4)
    assert retrieval.bm25_search(spark.createDataFrame(asked, "query_id int, query string").where("false"), frame, 4).isEmpty() and retrieval.bm25_search(spark.createDataFrame(asked, "query_id int, query string"), frame.where("false"), 4).isEmpty()


def test_bm25_shuffles_no_postings(spark):
    """One index for many searches, by ids that are strings, too; a search exchanges only what tasks have found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.format_string("c%05d", "doc_id"))
    index = retrieval.BM25Index(docs, keep=["lang"])
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = index.search(asked, 3)
    assert found.count() == 3 * asked.count() and found._jdf.queryExecution().toString().count("Join") == 0
    some = index.search(asked, 3, F.col("lang") == "en").join(docs, "doc_id")
    assert {r.lang for r in some.collect()} == {"en"}
    index.drop()


def test_dense_search_in_blocks(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    read = lambda: sorted(map(tuple, retrieval.dense_search(asked, vectors, 3).collect()))
    whole = read()
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(retrieval, "SCORES", 50)
    assert read() == whole and len(whole) == 3 * asked.where("embedding is not null").count()
    assert retrieval.dense_search(asked.where("false"), vectors, 3).isEmpty()


def test_retrieval_filters(spark):
    rows = [(i, f"word{i % 3} common", ["a", "b"][i % 2], "now" if i < 8 else "old") for i in range(10)]
    chunks = spark.createDataFrame(rows, "doc_id long, text string, project string, corpus_version string").withColumn("embedding", retrieval.hash_vector(F.col("text")))
    asked = spark.createDataFrame([(1, "word1 common")], "query_id long, query string").withColumn("embedding", retrieval.hash_vector(F.col("query")))
    for mode in retrieval.MODES:
        got = retrieval.retrieve(asked, chunks, 10, mode, project="a", corpus_version="now" if mode == "dense" else None).collect()
        assert {r.doc_id for r in got} == ({0, 2, 4, 6} if mode == "dense" else {0, 2, 4, 6, 8})
    assert retrieval.retrieve(asked, chunks, 2, "dense", corpus_version="next").isEmpty()
    one, two = (retrieval.retrieve(asked, chunks, 1, "hybrid", rrf_k=c).first().score for c in (60, 1))
    assert one < two


def test_expected_hits_by_mode_and_type(spark):
    ranked = spark.createDataFrame([(m, q, q if m == "dense" else 99, 1) for m in retrieval.MODES for q in (1, 2)], "mode string, query_id long, doc long, rank int")
    expected = spark.createDataFrame([(1, 1, "x"), (2, None, "y")], "query_id long, doc long, type string")
    assert {(r.mode, r.type, r.queries, r.hits) for r in retrieval.hit_rates(ranked, expected, 5, ("type",)).collect()} == {(m, t, 1, int(m == "dense" and t == "x")) for m in retrieval.MODES for t in "xy"}
    assert [(r.query_id, r.hit_by) for r in retrieval.disagreements(ranked, expected, 5).collect()] == [(1, ["dense"])]


def test_dense_search_and_bad_mode(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "vec_id long, embedding array<double>")
    got = retrieval.dense_search(v.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), v, 3).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    with pytest.raises(ValueError):
        retrieval.retrieve(v, v, mode="psychic")


def test_terms_of_many_queries_meet_them_in_parts():
    chunks, queries, per_chunk, known = 1000, 200, 40, 50
    rng = np.random.default_rng(5)
    owner, term = np.repeat(np.arange(chunks), per_chunk), rng.integers(0, known, chunks * per_chunk)
    share, bounds = rng.random(len(term)) * 2, np.arange(known + 1) * queries  # each term is in every query
    query, weight = np.tile(np.arange(queries), known), rng.random(known * queries) * 8
    tracemalloc.start()
    got = retrieval.summed_points(chunks, queries, owner, term, share, bounds, query, weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # eight million meetings; a column of them would be 64 MB
    want, table = np.zeros((chunks, queries)), weight.reshape(known, queries)
    np.add.at(want, owner, np.rint(table[term] * share[:, None] * 1e9))
    assert (got == want).all()
    nothing = np.zeros(0, dtype=int)
    assert (retrieval.summed_points(2, 3, nothing, nothing, np.zeros(0), np.zeros(1, dtype=int), nothing, np.zeros(0)) == 0).all()


def test_bm25_is_the_same_in_any_parts(spark, monkeypatch):
    words = "a b c d e f".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 6] for j in range(1, 4 + i % 3))) for i in range(60)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(q, " ".join(words[q % 3 :])) for q in range(7)], "query_id long, query string")
    found = lambda: sorted(map(tuple, retrieval.bm25_search(asked, docs, 4).collect()))
    want = found()
    monkeypatch.setattr(retrieval, "HITS", 5)
    monkeypatch.setattr(retrieval, "SCORES", 30)
    assert found() == want and len(want) == 28


def test_windows_and_sections(spark):
    df = spark.createDataFrame([(1, "x" * 3500), (2, "y" * 1600), (3, ""), (4, None)], "doc_id int, text string")
    got = {(r.doc_id, r.chunk_index): len(r.text) for r in chunking.chunk_windows(df).collect()}
    assert got == {(1, 0): 1600, (1, 1): 1600, (1, 2): 700, (2, 0): 1600}
    assert chunking.markdown_sections("intro\n# A\nx\n### B\ny\n### C\nz\n## D\nw") == [("(intro)", "intro"), ("A", "x"), ("A > B", "y"), ("A > B > C", "z"), ("A > D", "w")]
    page = "<h1>T</h1><p>a &amp; b</p><h2>S</h2><table><tr><td>cell</td></tr></table>"
    assert chunking.html_sections(page) == [("T", "a & b"), ("T > S", "cell")]


def test_html_sections():
    # an unclosed paragraph ends where the next block begins, also inside an inline element
    assert chunking.html_sections("<h1>A</h1><p>one<p><b>two<p>three<ul><li>x<li>y</ul>") == [("A", "one two three x y")]
    # pieces are stripped and put together; elements inside others count again, the outer one first
    assert chunking.html_sections("<h2> a <b> b </b></h2><ul><li>x <p>y</p></li></ul><pre> <code>z</code> </pre>") == [("ab", "xy y z z")]
    # a template in a script stands for the page, the first one alone; other scripts, styles and comments say nothing
    page = '<body><p>shell</p><script>var p = "<p>no</p>";</script><script type="text/x-handlebars-template"><h1>T</h1><p>real<!-- c --> text</p></script><script type="text/x-handlebars-template"><p>second</p></script></body>'
    assert chunking.html_sections(page) == [("T", "realtext")]
    assert chunking.html_sections("<style>p{}</style><div>loose</div>") == [] and chunking.html_sections("") == []
    assert chunking.html_sections("<h1>A</h1><h3>C</h3><p>x</p><h2>B</h2><p>1 < 2 &amp; y</p>") == [("A > C", "x"), ("A > B", "1 < 2 & y")]
    sample = "<html>\n<body>\n<h1>Manual</h1>\n<p>About it.</p>\n<h2>Parts</h2>\n<p>First.</p>\n<li>Second.</li>\n<h2>Use</h2>\n<h3>daily.limit</h3>\n<p>Hours.</p>\n</body>\n</html>"
    assert chunking.html_sections(sample) == [("Manual", "About it."), ("Manual > Parts", "First. Second."), ("Manual > Use > daily.limit", "Hours.")]


def test_references_without_a_semicolon(spark):
    page = "<h1>a &amp;&amp</h1><p>b &lt;&l</p><p>&ampx; &#38; &#38 &</p>"
    assert chunking.html_sections(page) == [("a &&", "b <&l &x; & & &")]
    assert chunking.html_sections(page, open_references=False) == [("a &&amp", "b <&l &ampx; & &#38 &")]
    template = f'<script type="text/x-handlebars-template">{page}</script>'
    assert chunking.html_sections(template, open_references=False) == [("a &&amp", "b <&l &ampx; & &#38 &")]


@pytest.mark.parametrize("name", ["html_sections", "html_chunks"])
def test_pages_cut_off_in_a_reference(spark, tmp_path, name):
    page = "<html><head><title>x</title></head><body><ul><li>Home</li></ul><article><h1>{}</h1><p>b &amp; c</p></article></body></html>"
    rows = [(1, page.format("a &amp;&amp")), (2, page.format("a &amp;&lt")), (3, page.format("a &amp;&am")), (4, page.format("a &amp; b"))]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(oracles.ORACLES[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got


def test_trace_tree(spark):
    df = span(spark, ("t", "child", "root", "ok", 2, 0.5), ("t", "root", None, "ok", 1, None), ("t", "leaf", "child", "degraded", 3, 0.25), ("t", "lost", "gone", "error", 4, 0.0), ("t", "leaf", "child", "degraded", 3, 0.25))
    got = trace.get_trace(df, "t")
    assert (got["span_count"], got["root_count"], got["orphan_count"], got["error_count"]) == (4, 2, 1, 2)
    assert got["total_cost_usd"] == 0.75 and got["duration_ms"] == 3000.0 and not got["truncated"]
    assert got["spans"][0]["children"][0]["children"][0]["span_id"] == "leaf"
    assert trace.tree_lines(got)[1].startswith("  AGENT_STEP child")
    assert "error" in trace.get_trace(df, "nothing")
    totals = trace.trace_totals(df).first()
    assert (totals.span_count, totals.root_count, totals.orphan_count, totals.total_cost_usd) == (4, 2, 1, 0.75)
    assert {(r.span_id, r.depth) for r in trace.depths(df).collect()} == {("root", 0), ("child", 1), ("leaf", 2), ("lost", 0)}
    assert trace.get_trace(df, "t", cap=2)["truncated"]


def test_only_get_trace_is_capped(spark):
    # the parent of the 600 others is the last by time
    df = span(spark, *(("t", f"s{i}", "root", "ok", i, 0.5) for i in range(600)), ("t", "root", None, "ok", 700, None), ("u", "one", None, "ok", 1, 1.0))
    totals = {r.trace_id: r for r in trace.trace_totals(df).collect()}
    assert (totals["t"].span_count, totals["t"].root_count, totals["t"].orphan_count, totals["t"].total_cost_usd) == (601, 1, 0, 300.0)
    assert totals["t"].truncated and not totals["u"].truncated
    assert trace.placed(df).where("is_orphan").isEmpty()
    depth = {r.span_id: r.depth for r in trace.depths(df).collect()}
    assert len(depth) == 602 and sum(depth.values()) == 600
    assert trace.get_trace(df, "t")["span_count"] == trace.SPAN_CAP


def test_trace_depth_has_no_limit(spark):
    chain = [("t", f"s{i}", f"s{i - 1}" if i else None, "ok", i, None) for i in range(81)]
    circle = [("u", "x", "y", "ok", 1, None), ("u", "y", "x", "ok", 2, None)]
    assert {r.span_id: r.depth for r in trace.depths(span(spark, *chain, *circle)).collect()} == {f"s{i}": i for i in range(81)}
    assert trace.depths(span(spark, *chain).where("false")).isEmpty()


def test_quantiles(spark):
    values = [0.0, -3.5, 2.0, 2.0, 1e9, 7.25, 3.0, 3.1, 0.1, None, -0.25]
    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in values] + [("b", None), ("c", 5.0)], "g string, v double")
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        got = {r.g: r.p for r in stats.quantiles(df, ["g"], "v", {"p": q}).collect()}
        want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", q).alias("p")).collect() if r.p is not None}
        assert got == pytest.approx(want) and set(got) == {"a", None, "c"}
        exact = {r.g: r.p for r in df.groupBy("g").agg(stats.nearest_rank("v", q).alias("p")).collect() if r.p is not None}
        assert {r.g: r.p for r in stats.quantiles(df, ["g"], "v", {"p": q}, stats.NEAREST_RANK).collect()} == exact
        index = {r.g: r.p for r in df.groupBy("g").agg(stats.index_percentile("v", q).alias("p")).collect() if r.p is not None}
        assert {r.g: r.p for r in stats.quantiles(df, ["g"], "v", {"p": q}, stats.INDEX).collect()} == index
    assert stats.with_quantiles(df.where("g = 'b'").agg(F.count(F.lit(1)).alias("n")), stats.quantiles(df.where("g = 'b'"), [], "v", {"p": 0.5}), []).first().p is None


def test_metric_sql_runs_and_says_the_same(spark):
    df = span(spark, *(("t", f"s{i}", None, "ok" if i % 3 else "error", i, 0.5) for i in range(40))).withColumns({"model": F.lit("m"), "latency_ms": F.col("span_id").substr(2, 3).cast("double")})
    now = T0 + dt.timedelta(seconds=60)
    for name in metrics.METRICS:
        sql = metrics.build_metric_sql(name, "5m", spans="{spans}")
        assert [r.asDict() for r in spark.sql(sql, args={"as_of": now}, spans=df).collect()] == [r.asDict() for r in metrics.metric_frame(df, name, "5m", as_of=now).collect()]


def test_metrics_vocabulary_is_closed(spark):
    df = span(spark, ("t", "a", None, "ok", 1, 0.5), ("t", "a", None, "ok", 1, 0.5), ("t", "b", "a", "error", 2, None))
    now = T0 + dt.timedelta(seconds=60)
    got = metrics.query_metrics(df, "error_rate", "5m", "status", now)
    assert got["row_count"] == 2 and got["rows"][1] == {"status": "ok", "spans": 1, "errors": 0, "error_rate_pct": 0.0} and "spans" in got["sql"]
    for bad in (("rows", "5m", "none"), ("error_rate", "9m", "none"), ("error_rate", "5m", "trace_id; drop"), (None, "5m", "none")):
        assert "error" in metrics.query_metrics(None, *bad)
    assert metrics.metric_frame(df, "request_rate", "5m", as_of=now + dt.timedelta(days=9)).first().spans == 0


def test_latest_versions(spark):
    got = {r.prompt_version_id: r for r in staging.latest_versions(cdc.seed_changes(spark)).collect()}
    assert {i: r.last_op for i, r in got.items()} == {1: "d", 2: "u", 3: "r", 4: "u", 5: "c"}
    assert got[1].is_deleted and not got[2].is_deleted
    dim = {r.version: r.prompt_version_id for r in marts.prompt_dimension(staging.latest_versions(cdc.seed_changes(spark))).collect()}
    assert dim["v2"] == 5


def test_envelopes(spark):
    row = {"id": 1, "name": "n", "version": "v1", "created_at": "2026-01-01T02:00:00+02:00"}
    source = {"lsn": 10, "txId": 3, "snapshot": "true", "ts_ms": 1000}
    values = [
        json.dumps({"op": "r", "before": None, "after": row, "source": source, "ts_ms": 2000}), json.dumps({"op": "d", "before": row, "after": None, "source": source}),
        None, "not json", json.dumps({"op": "t"}), json.dumps({"op": "u", "after": None}),
    ]
    values.append(json.dumps({"op": "c", "after": row | {"created_at": "soon"}, "source": source}))
    raw = spark.createDataFrame([(v, 0, i) for i, v in enumerate(values)], "value string, kafka_partition int, kafka_offset long").withColumn("ingest_ts", F.current_timestamp())
    got = cdc.parse_envelopes(raw).orderBy("kafka_offset").collect()
    assert [r.skipped for r in got] == [None, None, "tombstone", "malformed", "op t", "no row image", "bad timestamp"]
    assert got[1].id == 1 and got[0].created_at == dt.datetime(2026, 1, 1)


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "x"), (4, "d")], "k int, v string")
    assert {(r.k, r.change) for r in upsert.classify(old, new, ["k"], ["v"]).collect()} == {(1, "orphan"), (2, "unchanged"), (3, "updated"), (4, "inserted")}
    assert {tuple(r) for r in upsert.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, None), (3, "x"), (4, "d")}


def test_quality_goes_red_on_an_impossible_row(spark):
    good = sources.spans_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    made = registry.build({"spans": good, "prompt_versions": cdc.seed_changes(spark)})
    floor = dt.datetime(2024, 1, 1)
    report = quality.gate(made, floor)
    assert quality.passed(report) and report.count() == 33 and report.where("severity = 'warn'").count() == 3
    bad = good.withColumn("cost_usd", F.when(F.col("event_type") == "LLM_CALL", -1.0))
    red = quality.gate(registry.build({"spans": bad, "prompt_versions": cdc.seed_changes(spark)}), floor)
    assert not quality.passed(red)
    assert {r.check for r in red.where("not ok and severity = 'blocking'").collect()} == {"total_cost_usd in [0, ]", "cost_usd in [0, ]"}


def test_hit_at_k_states(spark):
    golden = spark.createDataFrame([("a", ["docs/x"]), ("b", ["docs/y"]), ("c", ["docs/z"])], "key string, expected_sources array<string>")
    calls = spark.createDataFrame([("a", 0, ["other"]), ("a", 1, ["docs/x/1"]), ("b", 0, [])], "key string, call_index int, paths array<string>")
    got = {r.key: (r.hit_at_k, r.any_call_hit) for r in evals.hit_at_k(calls, golden).collect()}
    assert got == {"a": (False, True), "b": (False, False), "c": (None, None)}


def test_gate_and_baseline(spark):
    table = lambda rows: spark.createDataFrame(rows, "run int, metric string, value double")
    base = evals.baseline(table([(1, "hit_at_5_rate", 0.8), (2, "hit_at_5_rate", 0.9), (1, "faithfulness_mean", 4.0), (2, "faithfulness_mean", 4.0), (1, "citation_ok_rate", 0.5), (2, "citation_ok_rate", None), (1, "p50_latency_ms", 5.0)]))
    rows = {r.metric: r for r in base.collect()}
    assert rows["hit_at_5_rate"].sigma == pytest.approx(0.1 / math.sqrt(2)) and rows["hit_at_5_rate"].threshold == pytest.approx(2 * rows["hit_at_5_rate"].sigma)
    assert rows["faithfulness_mean"].threshold == 0.20 and rows["citation_ok_rate"].sigma is None and rows["p50_latency_ms"].threshold is None

    def verdicts(base, **values):
        run = spark.createDataFrame(list(values.items()), "metric string, value double")
        return {r.metric: r.verdict for r in evals.gate(base, run).collect()}

    assert verdicts(base, hit_at_5_rate=1.0, faithfulness_mean=3.85, citation_ok_rate=0.5) == {"hit_at_5_rate": "ok", "faithfulness_mean": "ok", "citation_ok_rate": "ok"}
    assert verdicts(base, hit_at_5_rate=0.5, faithfulness_mean=3.75, citation_ok_rate=0.45) == {"hit_at_5_rate": "regressed", "faithfulness_mean": "regressed", "citation_ok_rate": "regressed"}
    single = evals.baseline(table([(1, "hit_at_5_rate", 0.8), (1, "faithfulness_mean", 4.0), (1, "citation_ok_rate", 1.0)]))
    assert {r.metric: (r.sigma, r.threshold) for r in single.collect()} == {"hit_at_5_rate": (None, 0.10), "faithfulness_mean": (None, 0.30), "citation_ok_rate": (None, 0.0)}
    assert verdicts(single, hit_at_5_rate=0.71, faithfulness_mean=3.6) == {"hit_at_5_rate": "ok", "faithfulness_mean": "regressed", "citation_ok_rate": "missing"}


def graded(spark, *rows):
    names = "hit_at_k boolean, citation_ok boolean, faithfulness int, answer_quality int, answer_len_tokens int, latency_ms double, cost_usd double, hit_source string, error string, judge_parse_ok boolean"
    return spark.createDataFrame(list(rows), names)


def test_run_metrics(spark):
    rows = graded(
        spark, (True, True, 5, 4, 10, 1.0, 0.2, "trace", None, True), (None, None, 3, None, 0, 2.0, None, "trace", None, True), (False, False, 4, 2, 30, 3.0, 0.4, None, None, True),
        (True, True, 1, 1, 5, 9.0, 9.0, "n/a", None, True), (True, True, 1, 1, 5, 9.0, 1.0, "trace", "timeout", False),
    )
    m = evals.run_metrics(rows).first()
    assert (m.rows, m.errors, m.parse_failures) == (5, 1, 1)
    assert (m.faithfulness_mean, m.citation_ok_rate, m.hit_at_5_given_search) == (3.25, 0.5, 0.5) and m.hit_at_5_rate == pytest.approx(1 / 3)
    assert m.mean_cost_usd == pytest.approx(3.2) and (m.p50_latency_ms, m.p95_latency_ms) == (3.0, 9.0) and m.total_cost_usd == pytest.approx(10.6)
    none = evals.run_metrics(rows.where("false")).first()
    assert none.rows == 0 and none.hit_at_5_rate is None and none.p50_latency_ms is None


def test_exit_codes_and_drift(spark):
    fine, bad = graded(spark, (True, True, 5, 5, 10, 1.0, 0.1, "t", None, True)), graded(spark, (True, True, 5, 5, 10, 1.0, 0.1, "t", "x", True))
    run = evals.long_metrics(evals.run_metrics(fine)).withColumn("run", F.lit(1))
    same = evals.gate(evals.baseline(run), run)
    worse = evals.gate(evals.baseline(run), run.withColumn("value", F.col("value") - 1))
    drift = evals.config_drift(*[spark.createDataFrame([("n", str(n)), ("notes", str(n))], "name string, value string") for n in (25, 17)])
    assert [(r.name, r.baseline, r.current) for r in drift.collect()] == [("n", "25", "17")]
    m = evals.run_metrics(fine)
    codes = [evals.exit_code(same, m), evals.exit_code(worse, m), evals.exit_code(same, m, drift), evals.exit_code(same, m, drift, True), evals.exit_code(None, m), evals.exit_code(worse, evals.run_metrics(bad)), evals.exit_code(same, evals.run_metrics(fine.where("false")))]
    assert codes == [0, 1, 1, 0, 2, 3, 2]


def test_stored_runs(spark):
    runs = spark.createDataFrame([(1, 2, "j", None, None), (2, 2, "j", T0, T0), (3, 9, "j", None, None)], "id long, prompt_version_id long, judge_model string, started_at timestamp_ntz, finished_at timestamp_ntz")
    results = graded(spark, (True, True, 5, 5, 10, 1.0, 0.1, "t", None, True)).withColumn("eval_run_id", F.lit(2))
    versions = staging.latest_versions(cdc.seed_changes(spark))
    config, m = evals.stored_run(runs, results, versions)
    assert {r.name: r.value for r in config.collect()} == {"id": "2", "judge_model": "j", "prompt_version": "v2", "n": "1"} and m.first().rows == 1
    for run in (3, 7):
        with pytest.raises(LookupError):
            evals.stored_run(runs, results, versions, run)
    with pytest.raises(LookupError):
        evals.stored_run(runs.where("id = 1"), results, versions)


def test_label_sheet(spark, tmp_path):
    rows = [(i, f"k{i}", f"q, \"{i}\"\nmore", "docs/a", f"answer {i}", 1 + i % 5, "ab"[i % 2]) for i in range(10)]
    results = spark.createDataFrame(rows, "eval_result_id long, example_key string, question string, retrieved_sources string, answer string, faithfulness int, kind string")
    sheet = labels.label_sheet(results, "kind", 4, 7)
    assert sheet.columns == list(labels.COLUMNS) and sheet.count() == 4
    path = str(tmp_path / "run-7")
    manifest = labels.write_sheet(sheet, path, 7)
    assert manifest["n"] == 4 and labels.read_labels(spark, path).isEmpty()
    graded_sheet = sheet.withColumn("human_faithfulness", F.when(F.col("eval_result_id") != manifest["ids"][0], "4"))
    labels.write_sheet(graded_sheet, path, 7)
    pairs = labels.judged_pairs(spark, path, results)
    assert pairs.count() == 3 and {r.human for r in pairs.collect()} == {4}
    with pytest.raises(ValueError):
        labels.judged_pairs(spark, path, results.withColumn("answer", F.lit("other")))
    labels.write_sheet(sheet.withColumn("human_faithfulness", F.lit("6")), path, 7)
    with pytest.raises(ValueError):
        labels.read_labels(spark, path)


def test_golden_files(spark, tmp_path):
    example = {"key": "sea-tide-001", "question": " When? ", "expected_answer": "At noon.", "expected_sources": ["docs/tide"], "written_from": "docs/tide.md#noon", "difficulty": "easy", "type": "fact", "ci": True}
    (tmp_path / "sea.json").write_text(json.dumps({"project": "sea", "dataset_version": 1, "examples": [example, example | {"key": "sea-x", "answerable": False}]}))
    golden = golden_files.load_golden(spark, str(tmp_path), "1")
    assert golden.count() == 2 and golden.first().question == "When?" and golden.where("answerable").count() == 1
    found = {(r.key, r.rule) for r in evals.golden_violations(golden, ("sea",), ("fact",), ("easy",)).collect()}
    assert found == {("sea-x", "key"), ("sea-x", "answerable"), ("sea-x", "unanswerable")}
    corpus = spark.createDataFrame([("docs/tide.md",), ("docs/x.md",)], "source_path string")
    assert evals.unwritten_sources(golden, corpus).isEmpty() and [r.key for r in evals.unwritten_sources(golden, corpus.where("source_path = 'docs/x.md'")).collect()] == ["sea-tide-001"]
    assert evals.ci_subset_problem(golden, 2) is None and "exactly 25" in evals.ci_subset_problem(golden)
    with pytest.raises(ValueError):
        golden_files.load_golden(spark, str(tmp_path), "2")


def test_golden_rules(spark):
    rows = [
        ("kafka-x-001", "kafka", "q?", ["docs/a"], "docs/a/b", "easy", "fact", True, True), ("bad key", "kafka", " ", [], None, "easy", "fact", True, False),
    ]
    golden = spark.createDataFrame(rows, "key string, project string, question string, expected_sources array<string>, written_from string, difficulty string, type string, answerable boolean, ci boolean")
    got = {(r.key, r.rule) for r in evals.golden_violations(golden, ("kafka",), ("fact",), ("easy",)).collect()}
    assert got == {("bad key", r) for r in ("key", "key of another project", "answerable", "blank question", "blank written_from")}
    corpus = spark.createDataFrame([("docs/a/b.md",), ("docs/c.md",)], "source_path string")
    assert evals.unresolved_sources(golden, corpus).count() == 0
    assert evals.unresolved_sources(golden.withColumn("expected_sources", F.array(F.lit("docs/zz"))), corpus).count() == 2
    assert evals.unresolved_sources(golden.withColumn("expected_sources", F.array(F.lit("docs/a/b"), F.lit("docs/"))), corpus).count() == 0


def test_judge_reply(spark):
    good = 'Say {"score": 1, "rationale": "draft"} first.\n```json\n{"score": 4.0, "rationale": " fine  text "}\n```'
    assert scalars.parse_judge_reply(good) == (4, "fine  text")
    assert scalars.parse_judge_reply('{"score": 2, "rationale": "a"} and {"score": 3, "rationale": "{b}"}') == (3, "{b}")
    assert scalars.parse_judge_reply('{"score": 2, "rationale": "' + "x" * 500 + '"}') == (2, "x" * 400)
    bad = [None, "", "no json", '{"score": 6, "rationale": "x"}', '{"score": 3.5, "rationale": "x"}', '{"score": true, "rationale": "x"}', '{"score": 4, "rationale": " "}', '{"rationale": "x"}', '{"score": "4", "rationale": "x"}']
    assert all(scalars.parse_judge_reply(b) == (None, None) for b in bad)
    assert scalars.parse_judge_reply('{not json {"score": 2, "rationale": "in {braces}"} } {') == (2, "in {braces}")
    assert scalars.parse_judge_reply('```json\n{"score": 5, "rationale": "a"}\n``` then {"score": 1, "rationale": "b"}') == (5, "a")
    assert scalars.last_object("[] {} {") == {} and scalars.parse_judge_reply('{"score": NaN, "rationale": "x"}') == (None, None)
    df = spark.createDataFrame([(good,), (None,)], "reply string")
    assert [tuple(r.judge) for r in scalars.judge_scores(df).collect()] == [(4, "fine  text"), (None, None)]
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert [r.c for r in keys.select(scalars.reference_first(7, F.col("k")).alias("c")).collect()] == [random.Random(f"7:{k}").random() < 0.5 for k in "abc"]


def test_passages(spark):
    rows = [([("docs/a.md", "A > B", "  text  "), ("docs/b.md", None, "y" * 1300)],), ([],), ([(f"d{i}", "", "t") for i in range(10)],)]
    df = spark.createDataFrame(rows, "c array<struct<source_path: string, section_path: string, text: string>>")
    two, none, ten = (r.t for r in df.select(scalars.render_passages(F.col("c")).alias("t")).collect())
    assert two.startswith("<passage 1: docs/a.md \u2014 A > B>\ntext\n</passage 1>\n\n<passage 2: docs/b.md>\n") and two.endswith("y\n[passage truncated]\n</passage 2>") and two.count("y") == 1200
    assert none == "(no passages were retrieved)" and ten.count("<passage ") == 8 and "(2 more" in ten


def test_scalars(spark):
    df = spark.createDataFrame([("a/b/Some-Long_guide.html", '{"x":1,"y":{"z":[1,null]}}', '{"y":true}')], "p string, l string, r string")
    named = evals.citation_tokens(F.col("p"), F.lit("Docs > Tidal Flats"))
    row = df.select(scalars.stem(F.col("p")).alias("stem"), named.alias("t"), scalars.merge_json(F.col("l"), F.col("r")).alias("j"), scalars.merge_json(F.col("l"), F.lit(None).cast("string")).alias("n")).first()
    assert row.stem == "Some-Long_guide" and row.t == ["some-long_guide.html", "some-long_guide", "some", "long", "guide", "tidal flats"]
    assert json.loads(row.j) == {"x": 1, "y": True} and json.loads(row.n) == {"x": 1, "y": {"z": [1, None]}}
    assert df.select(scalars.canonical_json(F.lit('{"b": 1, "a": [1, {"d": 1, "c": null}]}')).alias("j")).first().j == '{"a":[1,{"c":null,"d":1}],"b":1}'
    cited = F.array(F.struct(F.col("p").alias("source_path"), F.lit(None).cast("string").alias("section_path")))
    ok = lambda answer: df.select(evals.citation_ok(F.lit(answer), cited).alias("x")).first().x
    assert ok("see the GUIDE\nthere") and not ok("see the docs") and not df.select(evals.citation_ok(F.lit("guide"), F.slice(cited, 1, 0)).alias("x")).first().x


def test_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\n" + "word " * 400)
    (tmp_path / "sub" / "b.html").write_text("<h1>B</h1><p>text</p>")
    (tmp_path / "c.png").write_text("x")
    fetched = documents.fetch(spark, str(tmp_path), "p", "1")
    assert {r.source_path for r in fetched.collect()} == {"a.md", "sub/b.html"}
    assert {r.content_hash for r in fetched.collect()} == {hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.md", "sub/b.html")}
    none = spark.createDataFrame([], documents.DOCUMENT)
    empty = documents.chunks_of(fetched).where("false")
    first = documents.ingest(fetched, none, empty)
    held = {n: t.persist() for n, t in first.items()}
    assert held["documents"].count() == 2 and held["chunks"].count() == held["embed"].count() == 3 and held["stale"].isEmpty()
    again = documents.ingest(fetched, held["documents"], held["chunks"])
    assert again["embed"].isEmpty() and again["documents"].count() == 2
    # a run that broke off: no document row, one of its chunks missing; and a document that got shorter
    broken = documents.ingest(fetched, held["documents"].where("source_path <> 'a.md'"), held["chunks"].where("not (source_path = 'a.md' and chunk_index = 1)"))
    assert [(r.source_path, r.chunk_index) for r in broken["embed"].collect()] == [("a.md", 1)]
    shorter = fetched.withColumns({"text": F.lit("# A\nshort"), "content_hash": F.lit("other")}).where("source_path = 'a.md'")
    changed = documents.ingest(shorter, held["documents"], held["chunks"])
    assert changed["stale"].count() == 1 and changed["documents"].count() == 2
    for t in held.values():
        t.unpersist()


def test_avro_messages(spark):
    def long(n):
        n, out = n << 1 if n >= 0 else (-n << 1) - 1, b""
        while n >= 0x80:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    text = lambda s: long(len(s.encode())) + s.encode()
    fields = [
        {"name": n, "type": t} for n, t in (
            ("trace_id", "string"), ("span_id", "string"), ("parent_span_id", ["null", "string"]), ("session_id", "string"), ("event_type", {"type": "enum", "name": "Kind", "symbols": ["LLM_CALL", "ERROR"]}),
            ("model", ["null", "string"]), ("prompt_tokens", ["null", "long"]), ("completion_tokens", ["null", "long"]), ("latency_ms", "double"), ("cost_usd", ["null", "double"]), ("status", "string"),
            ("ts_epoch_ms", {"type": "long", "logicalType": "timestamp-millis"}), ("attributes", {"type": "map", "values": "string"}),
        )
    ]
    record = b"".join([
        text("t"), text("s"), long(0), text("x"), long(0), long(1) + text("m"), long(1) + long(300), long(1) + long(-5), struct.pack("<d", 1.5), long(0), text("ok"), long(1_767_225_600_000),
        long(1) + text("k") + text("v") + long(0),
    ])
    header = b"\0" + struct.pack(">I", 9)
    rows = [(header + record, 0), (header + record[:-4], 1), (b"\1" + record, 2), (None, 3), (header + record + b"x", 4)]
    raw = spark.createDataFrame(rows, "value binary, offset long").withColumns({"topic": F.lit("t"), "partition": F.lit(0)})
    got = {r.offset: r for r in jobs.decode_avro(raw, {"type": "record", "name": "Span", "fields": fields}).collect()}
    one = got[0]
    assert one.error is None and (one.trace_id, one.parent_span_id, one.event_type, one.prompt_tokens, one.completion_tokens, one.latency_ms, one.cost_usd, one.attributes) == ("t", None, "LLM_CALL", 300, -5, 1.5, None, {"k": "v"})
    assert one.ts == T0 and [got[i].error for i in (1, 2, 3, 4)] == ["malformed JSON", "malformed JSON", "empty message", "malformed JSON"]


def test_tables_are_created(spark):
    told = ddl.create_tables(spark, "ddl_test", dry_run=True)
    assert [n for n, _ in told] == [t.name for t in ddl.TABLES] and all(s.startswith("create table if not exists ddl_test.") for _, s in told)
    try:
        assert {o for _, o in ddl.create_tables(spark, "ddl_test")} == {"created"}
        assert {o for _, o in ddl.create_tables(spark, "ddl_test")} == {"exists"}
        assert {o for _, o in ddl.create_tables(spark, "ddl_test", recreate=True)} == {"recreated"}
        assert spark.table("ddl_test.trace_events").columns == [f.name for f in schema.SPAN] + ["ts_day"]
        registry.save({"m": spark.range(3)}, "ddl_test")
        assert spark.table("ddl_test.m").count() == 3
    finally:
        spark.sql("drop database if exists ddl_test cascade")


def test_freshness_probe():
    seen, clock = set(), iter(range(10_000))
    good = probe.freshness(seen.add, seen.__contains__, 5, clock=lambda: next(clock) / 1000)
    assert good["ok"] and good["timeouts"] == 0 and good["min_ms"] <= good["p50_ms"] <= good["max_ms"]
    lost = probe.freshness(lambda m: None, lambda m: False, 2, 0.02, 0.001)
    assert not lost["ok"] and lost["timeouts"] == 2 and lost["p95_ms"] is None


def test_tool_calls(spark):
    for tool, arguments in (("nothing", {}), ("search_docs", {}), ("search_docs", {"query": "x", "k": 51}), ("search_docs", {"query": "x", "k": True}), ("search_docs", {"query": "x", "mode": "psychic"}), ("search_docs", {"query": ""}), ("get_trace", {"trace_id": "t", "more": 1}), ("query_metrics", {"metric": "error_rate"}), ("query_metrics", {"metric": "error_rate", "window": "9m"})):
        assert "error" in tools.dispatch(tool, arguments, None, None, None)
    chunks = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "g h i")], "doc_id long, text string")  # of two chunks, a term of one has an idf of 0.withColumn("embedding", retrieval.hash_vector(F.col("text")))
    got = tools.dispatch("search_docs", {"query": "d e f", "k": 1, "mode": "bm25"}, spark, None, chunks)
    assert [r["doc_id"] for r in got["results"]] == [2] and got["k"] == 1
    df = span(spark, ("t'; --", "a", None, "ok", 1, 0.5))
    assert tools.dispatch("get_trace", {"trace_id": "t'; --"}, spark, df, None)["span_count"] == 1 and "error" in tools.dispatch("get_trace", {"trace_id": "t"}, spark, df, None)


def test_writes_that_return(spark):
    runs = spark.createDataFrame([(4, "old", T0, 1.0)], "id long, name string, finished_at timestamp_ntz, total_cost_usd double")
    new = spark.createDataFrame([("b",), ("a",)], "name string").withColumns({"finished_at": F.lit(None).cast("timestamp_ntz"), "total_cost_usd": F.lit(None).cast("double")})
    table, made = upsert.insert_returning(runs, new, "name")
    assert {(r.id, r.name) for r in made.collect()} == {(5, "a"), (6, "b")} and table.count() == 3
    done = {r.id: r for r in upsert.finish(table, 5, 2.5, F.lit(T0)).collect()}
    assert done[5].finished_at == T0 and done[5].total_cost_usd == 2.5 and done[6].finished_at is None and done[4].total_cost_usd == 1.0
    old, incoming = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "k int, v string, note string"), spark.createDataFrame([(1, "a", "y"), (2, "c", "y"), (3, "d", "y")], "k int, v string, note string")
    merged, written = upsert.upsert_changed(old, incoming, ["k"], ["v"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a", "x"), (2, "c", "y"), (3, "d", "y")} and {tuple(r) for r in written.collect()} == {(2, "updated"), (3, "inserted")}


def test_supervised_query_restarts(spark):
    tried = []

    class Query:
        def awaitTermination(self):  # noqa: N802
            tried.append(1)
            if len(tried) < 3:
                raise RuntimeError("lost")

    assert isinstance(jobs.supervise(Query, 5, 0), Query) and len(tried) == 3
    with pytest.raises(RuntimeError):
        tried.clear()
        jobs.supervise(Query, 2, 0)


def test_live_trees(spark, tmp_path):
    span(spark, ("t", "child", "root", "ok", 2, None), ("t", "root", None, "ok", 1, None), ("u", "lone", "gone", "error", 3, None)).coalesce(1).write.parquet(str(tmp_path / "in"))
    said = []
    source = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
    jobs.print_trees(source, str(tmp_path / "a"), said.append, trigger={"availableNow": True}).awaitTermination()
    assert [line.split(" ms")[0] for line in said] == ["AGENT_STEP root ok 1.0", "  AGENT_STEP child ok 1.0", "AGENT_STEP lone error 1.0"]
    said.clear()
    jobs.print_trees(source, str(tmp_path / "b"), said.append, 1, {"availableNow": True}).awaitTermination()
    assert said[0].startswith("AGENT_STEP lone") and said[1:] == ["... and 2 more"]


def test_empty_sink_with_progress_is_refused(spark, tmp_path):
    for name in ("offsets", "commits"):
        (tmp_path / "ckpt" / name).mkdir(parents=True)
        (tmp_path / "ckpt" / name / "0").write_text("x")
    with pytest.raises(RuntimeError):
        jobs.refuse_unsafe_start(spark, str(tmp_path / "none"), str(tmp_path / "ckpt"))
    jobs.refuse_unsafe_start(spark, str(tmp_path / "none"), str(tmp_path / "ckpt"), force=True)


def test_panels_read_days_that_they_need(spark):
    path = inputs.archive(spark, "/root/testdata/sf0.001")[0]
    frame = metrics.panel_frame(queries.spans(spark, "/root/testdata/sf0.001"), "spans", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4))
    plan = frame._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ts_day" in plan and "PushedFilters: [IsNotNull(ts)" in plan and "ReadSchema: struct<span_id:string,ts:timestamp_ntz>" in plan and path


def test_budget_counts_from_the_first_look():
    budget = evals.Budget(1.0)
    assert budget.check(5.0) and budget.check(5.5, 0.5) and not budget.check(5.5, 0.6)


def test_expressions_and_pairs_of_columns_as_checks(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 2, 3)], "a int, b int, c int")
    report = {r.check: (r.observed, r.ok) for r in quality.run_suite(df, "s", [quality.unique("a", "b"), quality.expression("c above b", "c > b"), quality.unique("c")]).collect()}
    assert report == {"unique a, b": (1, False), "c above b": (1, False), "unique c": (0, True)}


def test_registry(spark):
    names = registry.order()
    assert names.index("agg_model_5m") < names.index("stg_agg_model_5m") and names.index("stg_prompt_versions") < names.index("fct_cost_by_prompt")
    event = registry.run_event("fct_cost_by_prompt")
    assert [i["name"] for i in event["inputs"]] == ["spans", "stg_prompt_versions"]
    with pytest.raises(KeyError):
        registry.build({}, ["fct_sessions"])


def test_archive_prunes_and_expires(spark, tmp_path):
    made = sources.synthetic(spark, 30_000, start="2026-01-01 00:00:00")
    path = str(tmp_path / "archive")
    sources.write_archive(made, path)
    day = sources.read_archive(spark, path, dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 3))
    assert "PartitionFilters: [isnotnull(ts_day" in day._jdf.queryExecution().toString()
    assert day.count() == made.where("ts_epoch_ms >= '2026-01-02' and ts_epoch_ms < '2026-01-03'").count() > 0
    assert sources.expire(spark, path, dt.date(2026, 1, 9)) == ["2026-01-01"]
    assert verify.same_counts(spark.read.parquet(path), made.where("ts_epoch_ms >= '2026-01-02'")).first().verdict == "MATCH"


def test_streaming_restart_late_rows_and_guard(spark, tmp_path):
    def write(name, rows):
        made = [("t", f"{name}{i}", None, "s", "LLM_CALL", "m", 1, 1, 1.0, 0.1, "ok", T0 + dt.timedelta(seconds=x)) for i, x in enumerate(rows)]
        kinds = "trace_id string, span_id string, parent_span_id string, session_id string, event_type string, model string, prompt_tokens long, completion_tokens long, latency_ms double, cost_usd double, status string, ts timestamp"
        spark.createDataFrame(made, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write("a", [0, 10, 400])
    schema_ = spark.read.parquet(str(tmp_path / "in")).schema
    read = lambda: spark.readStream.schema(schema_).parquet(str(tmp_path / "in"))
    now = {"availableNow": True}
    out, ckpt = str(tmp_path / "raw"), str(tmp_path / "raw_ckpt")
    jobs.raw_archive(read(), out, ckpt, now).awaitTermination()
    agg = lambda: jobs.window_aggregates(read(), str(tmp_path / "agg"), str(tmp_path / "agg_ckpt"), now)
    agg().awaitTermination()
    write("b", [5, 1000])
    jobs.raw_archive(read(), out, ckpt, now).awaitTermination()
    query = agg()
    query.awaitTermination()
    assert jobs.late_rows(query) == 1
    raw = spark.read.parquet(out)
    assert raw.count() == 5 == raw.select("span_id").distinct().count()
    assert [r.event_count for r in spark.read.parquet(str(tmp_path / "agg")).orderBy("window_start").collect()] == [2, 1]
    with pytest.raises(RuntimeError):
        jobs.raw_archive(read(), out, str(tmp_path / "other"), now)


def test_empty_spans_give_empty_marts(spark):
    none = sources.spans_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("false"))
    made = registry.build({"spans": none, "prompt_versions": cdc.seed_changes(spark)})
    assert all(f.isEmpty() for n, f in made.items() if n != "stg_prompt_versions")
    assert not quality.passed(quality.gate(made, T0))


def test_quantiles_of_infinite_values_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", v) for v in (1.0, 2.0, inf, -inf, 5e-324, -1e308)] + [("b", v) for v in (1.0, nan, 2.0)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in stats.quantiles(df, ["g"], "v", {"low": 0.0, "mid": 0.5, "high": 1.0}, stats.NEAREST_RANK).collect()}
    assert set(got) == {"a", "b"} and (got["a"].low, got["a"].mid, got["a"].high) == (-inf, 5e-324, inf)
    assert got["b"].low == 1.0 and got["b"].mid == 2.0 and math.isnan(got["b"].high)
    between = stats.quantiles(df.where("g = 'a'"), [], "v", {"p": 0.9}, stats.INTERPOLATED).select("p", stats.rounded(F.col("p"), 3).alias("r")).first()
    assert between.p == between.r == inf
    slow = span(spark, ("t", "a", None, "ok", 1, 0.5)).withColumn("latency_ms", F.lit(inf)).withColumns({"model": F.lit("m"), "ts_day": F.to_date("ts")})
    assert metrics.metric_frame(slow, "p95_latency", "1h", "none", T0 + dt.timedelta(minutes=1)).first().p95_ms == inf


def test_run_metrics_without_rows(spark):
    rows = spark.createDataFrame([], "hit_at_k boolean, citation_ok boolean, faithfulness int, answer_quality int, answer_len_tokens int, latency_ms double, cost_usd double, hit_source string, error string, judge_parse_ok boolean")
    row = evals.run_metrics(rows).first()
    assert (row.rows, row.p50_latency_ms, row.total_cost_usd) == (0, None, 0.0)


def test_ids_are_dealt_out_by_many_tasks(spark):
    new = spark.range(5000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("name")).repartition(6)
    table, made = upsert.insert_returning(spark.createDataFrame([(41, "x")], "id long, name string"), new, "name")
    assert [r.id for r in made.orderBy("name").collect()] == list(range(42, 5042)) and table.count() == 5001
    assert upsert.insert_returning(spark.createDataFrame([(41, "x")], "id long, name string"), new.where("false"), "name")[1].isEmpty()


def test_lines_of_large_files_have_offsets(spark, tmp_path):
    """Files cut into splits, with empty lines: every line once, offsets in the order of the lines."""
    for f in ("a", "b"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f).write_text("\n".join("" if i % 50 == 49 else f"{f}{i:05d}" for i in range(3000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        query = jobs.file_source(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({(r.topic, r.offset) for r in rows}) == len(rows) == 6000
    for f in ("a", "b"):
        told = [r.value for r in sorted(rows, key=lambda r: r.offset) if r.topic == f]
        assert told == ["" if i % 50 == 49 else f"{f}{i:05d}" for i in range(3000)]


class Reader:
    """Stands in for a reader of a connector that is absent: what it was told."""

    def __init__(self):
        self.told = {}

    def format(self, name):
        self.told["format"] = name
        return self

    def option(self, name, value):
        self.told[name] = value
        return self

    def options(self, **values):
        self.told |= values
        return self

    def load(self):
        return self.told


def test_connectors_are_told_their_bounds(spark):
    class Session:
        read, readStream = Reader(), Reader()

    assert jobs.kafka_source(Session, "b:1", "t", 500) == {"format": "kafka", "kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "earliest", "maxOffsetsPerTrigger": 500}
    told = documents.read_jdbc(Session, "jdbc:x", "runs", "id", 1, 900, 4, user="u")
    assert told == {"format": "jdbc", "url": "jdbc:x", "dbtable": "runs", "partitionColumn": "id", "lowerBound": 1, "upperBound": 900, "numPartitions": 4, "user": "u"}
