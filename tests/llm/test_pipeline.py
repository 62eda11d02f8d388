"""The pipeline's stages: what goes, what stays, and that nothing else changes."""

import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from spanquery.llm import decontam, jaccard, langid, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        left = spark.read.parquet(f"{tmp_path}/{name}")
        assert left.columns == columns and left.exceptAll(docs).isEmpty() and not left.isEmpty()
        gone = {r.doc_id for r in docs.join(left, "doc_id", "left_anti").collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
            assert gone == {r.doc_id for r in toxicity.predictions(docs, labels).where("predicted = 1").collect()}
        elif name == "language":
            assert gone == {r.doc_id for r in langid.predictions(docs).where("lang_pred = 'und' or ambiguous").collect()}
        elif name == "near duplicates":
            assert gone == {r.doc_id for r in jaccard.link_components(docs).where("doc_id <> component_id").collect()}
        else:
            assert gone == {r.doc_id for r in decontam.search(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
        docs = left
    out = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_stages_take_awkward_documents(spark, tmp_path):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    rows = [(1, None, None, None, None), (None, "the and of", "en", "s", 3), (2, "", "en", "s", 0), (3, "der und die " * 9, "de", "s", 9), (3, "der und die " * 9, "de", "s", 9), (4, "the and of " * 9, "en", "s", 9), (5, "the and with this that " * 60_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit(1), "__toxic": F.lit(2), "toxic": F.lit(3), "in_text": F.lit(4), "lang_pred": F.lit("x")})
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    assert {r.doc_id for r in docs.collect()} <= {None, 3, 4, 5} and docs.count() >= 2
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
        assert stage(spark, empty, FOLDER).isEmpty()


def test_stages_decide_by_row(spark):
    long = [" ".join(f"{c}{j}" for j in range(40)) for c in "abcdefg"]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("text is not null").first().text
    near = long[3] + " more"
    rows = [
        (7, long[0]), (7, long[1]), (7, long[1].upper()), (8, long[2]), (9, long[2]), (9, long[3]), (9, near), (9, long[4]), (9, long[4]), (None, long[4]), (None, long[5]), (None, long[5]),
        (None, long[6]), (10, ""), (10, None), (None, None), (None, " "), (11, item), (12, f"{item} {long[0]}"), (12, f"{item} " + " ".join(f"z{j}" for j in range(99))), (12, "plain words " * 9), (None, item), (None, long[2] + " more"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert left.columns == docs.columns
    kept = {r.n_chars for r in left.collect()}
    assert len(kept) == left.count() and kept - {1, 2, 5, 6, 7, 8, 10, 11} == {0, 3, 12, 13, 14, 15, 16, 17, 18, 19, 20}
    assert all(len(kept & pair) == 1 for pair in ({1, 2}, {5, 6}, {7, 8}, {10, 11}))
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs, FOLDER)
    assert clean.columns == docs.columns and sorted(r.n_chars for r in clean.collect()) == [k for k in range(len(rows)) if k not in (17, 18, 19, 21)]


def test_stages_keep_columns_of_any_name(spark):
    long = [" ".join(f"{c}{j}" for j in range(40)) for c in "abcd"]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("text is not null").first().text
    rows = [(1, long[0]), (1, long[1]), (2, long[0]), (None, long[2]), (None, f"{long[2]} more"), (3, None), (3, item), (4, f"{item} {long[3]}")]
    names = ["__id", "__node", "__first", "__own", "__text", "node", "root", "h", "at", "kind", "n", "w", "t", "in_0", "in_1", "item_id", "component_id", "most", "part", "a.b"]
    docs = spark.createDataFrame([(i, t, "en", "s", k, *[f"{c} {k}" for c in names]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for stage, gone in ((corpus_pipeline.drop_near_duplicates, [{0, 2}, {3, 4}]), (corpus_pipeline.drop_benchmark_leaks, [{6}, {7}])):
        left = stage(spark, docs, FOLDER)
        assert left.columns == docs.columns
        kept = {r.n_chars: r for r in left.collect()}
        assert all(r[c] == f"{c} {k}" for k, r in kept.items() for c in names)
        assert {0, 1, 2, 3, 4, 5, 6, 7} - set(kept) <= set().union(*gone) and all(len(set(kept) & g) == len(g) - 1 for g in gone)
