"""Hard negatives, repeated spans and whitening against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanquery.llm import mining, repeats, textkit, whitening
from spanquery.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def rows_of(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


# 11


def mined_by_hand(rows, scale=256, k=5, low=80, high=100):
    """rows: id, label, vector, anchor."""
    kept = [(i, l, [math.floor(scale * x) for x in v], a) for i, l, v, a in rows if None not in (i, l, v) and v and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if sum(x * x for x in r[2]) < 2**62]
    out = []
    for n, (i, l, v, a) in enumerate(kept):
        if not a:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, m, t) for t, (j, m, w, _) in enumerate(kept) if len(w) == len(v))
        for p, j, m, t in [s for s in scored if s[2] == l and s[3] != n][:k]:
            inside = [s for s in scored if s[2] != l and low * -p <= 100 * -s[0] <= high * -p][:k]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(inside)]
    return sorted(out)


def by_operator(spark, rows, **settings):
    frame = spark.createDataFrame([(i, l, v, a, "x", 1) for i, l, v, a in rows], "vec_id long, label int, embedding array<double>, anchor boolean, raw string, at int")
    return sorted(map(tuple, mining.mine(frame, F.col("anchor"), F.col("label"), **settings).collect()))


def test_mining_by_hand(spark):
    rng = random.Random(3)
    near = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, i % 3, [x + rng.gauss(0, 0.3) for x in near], i % 11 == 0) for i in range(150)]
    rows += [(200 + i, i % 3, [0.5] * 6, i == 0) for i in range(40)]  # equal vectors: the smaller ids
    rows += [(300, None, near, True), (301, 1, None, True), (302, 1, [], True), (303, 1, [NAN] + near[1:], True), (304, 1, [INF] + near[1:], True), (305, 1, [None, *near[1:]], True), (None, 1, near, True)]
    rows += [(306, 1, [0.0] * 6, True), (307, 0, [0.0] * 6, False), (308, 9, near, True), (309, 1, [1e300] * 6, True), (310, 1, [7e6] + near[1:], True), (311, 1, [-x for x in near], True)]
    rows += [(312, 1, [1.0, 2.0], True), (313, 1, [1.0, 2.1], False), (314, 2, [1.0, 1.9], False), (315, None, [1.0], True)]
    rows += [(5, 2, [x * 1.1 for x in near], True), (0, 0, rows[0][2], True), (316, 4, near, None)]
    want = mined_by_hand(rows)
    assert by_operator(spark, rows) == want and len(want) > 100
    assert by_operator(spark, rows, positives=2, negatives=7) != want
    assert by_operator(spark, [r for r in rows if not r[3]]) == [] and by_operator(spark, [(1, 1, [1.0], True)]) == []


def test_mining_in_many_parts_and_turns(spark, monkeypatch):
    for name, value in {"PART_ROWS": 1, "PARTS": 5, "TURN_BYTES": 400, "ANCHOR_BLOCK": 2, "ROW_BLOCK": 16, "PAIR_BLOCK": 8}.items():
        monkeypatch.setattr(mining, name, value)
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 3), [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(5)], i % 9 == 0) for i in range(120)]
    assert by_operator(spark, rows) == mined_by_hand(rows)


def test_mining_prunes_and_its_bounds_hold():
    rng = np.random.default_rng(5)
    spread = np.exp(-np.arange(32) / 4)
    x = np.floor(256 * rng.normal(size=(3000, 32)) * spread @ np.linalg.qr(rng.normal(size=(32, 32)))[0]).astype(np.int64)
    _, axes = np.linalg.eigh(np.cov(x.T))
    turn = axes[:, ::-1]
    side, share = mining.Side(x, turn, [8, 32]), mining.slack(turn)
    exact = x[:50] @ x.T
    lead = side.y[:50, :8] @ side.y[:, :8].T
    rest = np.outer(side.rest[8][:50], side.rest[8])
    error = share * np.outer(side.norm[:50], side.norm)
    assert (np.abs(exact - lead) <= rest + error).all() and (np.abs(side.y[:50] @ side.y.T - exact) <= error).all()
    out = (lead + rest + error) < np.sort(exact, axis=1)[:, -6][:, None]
    assert out.mean() > 0.5  # a quarter of the components leaves out most pairs of such vectors


def test_mining_of_the_table(spark):
    frame = rows_of(spark, "embeddings")
    got = sorted(map(tuple, registered.queries()["op11_pca_negatives"](spark, FOLDER).collect()))
    rows = [(r.vec_id, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10, r.embedding, r.vec_id % 100 == 0) for r in frame.collect()]
    assert got == mined_by_hand(rows) and got


# 12


def removed_by_hand(docs, width=20):
    out, seen = {}, set()
    for n, (_, text) in enumerate(docs):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            window = b" ".join(words[p : p + width])
            if window in seen:
                gone[p : p + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[n] = (len(words), sum(gone), kept.decode())
    return out


def awkward_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["É", "straße"]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [plain(n) for n in (20, 25, 60, 90)]
    texts = [None, "", " \t\n", "one", plain(19), plain(20), "a " * 100, "a b " * 70, plain(30_000)]
    for _ in range(60):
        texts.append(f"{plain(rng.randint(0, 30))} {rng.choice(passages)} {plain(rng.randint(0, 30))}\n{rng.choice(passages)}")
    whole = plain(120)
    cut = whole.split()
    texts += [whole, whole, whole.upper(), whole.replace(" ", "\t \n"), " ".join(cut[:60] + ["other"] + cut[61:]), " ".join(cut[30:]), " ".join(cut[:50]), " ".join(cut[10:40] + cut[:25] + cut[10:40]), "a " * 45]
    return texts


def test_repeats_by_hand(spark):
    texts = awkward_texts()
    ids = random.Random(9).sample(range(-500, 1000), len(texts))
    docs = sorted(zip(ids, texts, strict=True))
    frame = spark.createDataFrame([(i, t, "k", 0, 1) for i, t in docs], "doc_id long, text string, key string, start int, n int").repartition(7)
    want = removed_by_hand(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(frame).collect()}
    assert got == {docs[n][0]: v for n, v in want.items()} and sum(v[1] for v in want.values()) > 2000
    short = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(frame, width=3).collect()}
    assert short == {docs[n][0]: v for n, v in removed_by_hand(docs, 3).items()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    found = repeats.spans(frame).collect()
    assert found and all(words[s.doc_id][s.start : s.start + s.n_words] == words[s.source_id][s.source_start : s.source_start + s.n_words] and (s.source_id, s.source_start) < (s.doc_id, s.start) for s in found)
    assert repeats.without_repeats(frame.where("false")).isEmpty()


def test_long_spans_are_whole_and_verified(spark):
    """A passage that two others cut into paths is one span again; copies below the bound are none."""
    line = lambda c, n: [f"{c}{i}" for i in range(n)]
    long = line("p", 90)
    rows = [(1, line("a", 30) + long + line("b", 5)), (2, line("c", 7) + long), (3, line("d", 4) + long[20:50] + line("e", 30)), (4, long[:40] + line("f", 9)), (5, line("g", 60) + line("g", 60)), (6, line("p", 3)), (7, None)]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.n_words, r.source_id, r.source_start, r.same) for r in repeats.long_spans(docs, 40).collect()}
    assert got == {(2, 7, 90, 1, 30, True), (4, 0, 40, 1, 30, True), (5, 60, 60, 5, 0, True)}
    assert {(r.doc_id, r.n_words) for r in repeats.long_spans(docs, 20).collect()} == {(2, 90), (3, 30), (4, 40), (5, 60)}
    assert repeats.spans(docs).where("doc_id = 2").count() > 1  # as paths


def test_repeats_with_full_bitmaps(spark, monkeypatch):
    """A bitmap that holds everything makes more paths, and the same result."""
    texts = awkward_texts()[4:30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(repeats, "bitmap", lambda hashes: np.full(1024, 2**64 - 1, dtype=np.uint64))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(frame).collect()}
    assert got == removed_by_hand(list(enumerate(texts)))


def test_repeats_of_repeated_and_null_ids(spark):
    line = " ".join(f"x{i}" for i in range(30))
    rows = [(4, line), (4, line), (4, f"{line} end"), (None, line), (None, None), (7, f"start {line}"), (1, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.without_repeats(frame).collect())
    assert got == [(False, 1, 1, 0), (False, 4, 30, 0), (False, 4, 30, 30), (False, 4, 31, 30), (False, 7, 31, 30), (True, 0, 0, 0), (True, 0, 30, 30)]


def test_repeats_of_the_table(spark):
    docs = sorted((r.doc_id, r.text) for r in rows_of(spark, "documents").collect())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registered.queries()["op12_debruijn_dedup"](spark, FOLDER).collect()}
    assert got == {docs[n][0]: (a, b, hashlib.sha256(c.encode()).hexdigest()) for n, (a, b, c) in removed_by_hand(docs).items()}


def test_least_is_leftmost():
    values = np.random.default_rng(1).integers(0, 4, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 11):
        low, at = repeats.least(values, width)
        assert [(v, p) for v, p in zip(low, at, strict=True)] == [(values[i : i + width].min(), i + int(values[i : i + width].argmin())) for i in range(200 - width + 1)]


def test_joined_words():
    data = np.frombuffer(b" ab\t\tc  def ", dtype=np.uint8)
    starts, ends, _ = textkit.word_spans(data, np.array([0, len(data)]))
    out, at = textkit.joined_words(data, starts, ends)
    assert out.tobytes() == b"ab c def " and at.tolist() == [0, 3, 5, 9]
    assert textkit.joined_words(data, starts[:0], ends[:0])[0].tobytes() == b""


# 13


def whitened_by_hand(x):
    """x: Python integers.  deviations, covariance"""
    n, dims = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dims)]
    c = [[n * r[i] - sums[i] for i in range(dims)] for r in x]
    cov = [[sum(r[i] * r[j] for r in c) / n**3 for j in range(dims)] for i in range(dims)]
    return [sum(v * v for v in r) for r in c], np.array(cov), np.array([[v / n for v in r] for r in c])


def check_whitened(got, vectors, components):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors.values()]
    deviation, cov, centred = whitened_by_hand(x)
    values = np.linalg.eigvalsh(cov)[::-1]
    for key, d, c in zip(vectors, deviation, centred, strict=True):
        own = sorted((r for r in got if r.vec_id == key), key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, components + 1))
        assert all(r.n == len(x) and r.deviation == d for r in own)
        assert [r.explained for r in own] == pytest.approx(list(values[:components] / values.sum()), rel=1e-9)
        assert all(r.identity_error < 1e-9 for r in own) and sum(r.whitened**2 * v for r, v in zip(own, values, strict=False)) <= float(c @ c) * (1 + 1e-9)
    w = np.array([[r.whitened for r in sorted((r for r in got if r.vec_id == k), key=lambda r: r.component)] for k in vectors])
    axes = np.linalg.lstsq(centred, w * np.sqrt(values[:components]), rcond=None)[0]
    assert np.abs(cov @ axes - axes * values[:components]).max() < 1e-6 * values[0] and np.abs(axes.T @ axes - np.eye(components)).max() < 1e-6


def test_whitening_by_hand(spark):
    rng = random.Random(6)
    vectors = {i: [rng.gauss(m, 1 + m) for m in range(10)] for i in range(60)}
    odd = [(100, None), (101, []), (102, [NAN] * 10), (103, [INF, *[0.0] * 9]), (104, [None, *[0.0] * 9]), (105, [1e300] * 10)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in [*vectors.items(), *odd]], "vec_id long, embedding array<double>, v string, n int").repartition(5)
    got = whitening.whitened_rows(frame).collect()
    assert {r.vec_id for r in got} == set(vectors) and dict(whitening.whitened_rows(frame).dtypes)["deviation"] == "bigint"
    check_whitened(got, vectors, 8)
    assert len(whitening.whiten(frame, components=3).collect()) == 180


def test_whitening_of_large_few_and_equal_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    large = {i: [float(v) for v in np.random.default_rng(i).normal(size=3) * 1e14] for i in range(20)}
    got = whitening.whiten(frame(list(large.items()))).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in large.values()]
    assert {r.vec_id: int(r.deviation) for r in got if r.deviation is not None} == {k: d for k, d in zip(large, whitened_by_hand(x)[0], strict=True) if d < 10**38}
    assert all(r.deviation is None for r in whitening.whitened_rows(frame(list(large.items()))).collect()) and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).isEmpty() and whitening.whiten(frame([(1, [1.0])])).isEmpty() and whitening.whiten(frame([])).isEmpty()
    flat = whitening.whiten(frame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (None, [3.0, 5.0]), (2, [2.0, 5.0]), (9, [4.0]), (9, [5.0])])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in flat) == [(0, 1, 4), (1, 1, 4), (2, 1, 4), (2, 1, 4), (9, 1, 2), (9, 1, 2)]


def test_residues_are_exact():
    x = np.random.default_rng(2).integers(-(2**50), 2**50, size=(40_000, 3))
    moduli = whitening.primes(len(x) * 2**100)
    found = [np.concatenate([t, s.ravel()]) for t, s in (whitening.scatter_residues(x, p) for p in moduli)]
    exact = whitening.remainders(np.array(found), moduli)
    big = x.astype(object)
    assert list(exact) == [*big.sum(axis=0), *(big.T @ big).ravel()]
    assert list(whitening.squares(x[:50])) == [sum(int(v) ** 2 for v in r) for r in x[:50]]


def test_whitening_of_the_table(spark):
    vectors = {r.vec_id: r.embedding for r in rows_of(spark, "embeddings").collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)}
    check_whitened(registered.queries()["op13_residue_whitening"](spark, FOLDER).collect(), vectors, 8)
