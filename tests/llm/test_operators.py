"""Each operator against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanquery.llm import bytebpe, components, decontam, jaccard, langid, neighbours, ngramlm, sharding, toxicity, unigram, urlfilter
from spanquery.llm import queries as registered

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w.decode("utf-8", "replace") for w in (text or "").encode().lower().split()]


def make_docs(spark, texts, extra=()):
    rows = [(i, t, ["en", "fr"][i % 2] if i % 5 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "don't", "  "]
    long = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 60))) for _ in range(40)]
    near = []
    for t in long[:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near += [" ".join(w), t.upper(), t + "\n"]
    return [None, "", " \t\n", "one", "One", "a b c", "a b c d e", "x" * 200_000, *long, *near, *long[:3]]


def test_registered_queries_have_contract_columns(spark):
    wanted = {
        "op1_": "doc_id held_out n_tokens n_known train_tokens base_score score", "op2_": "doc_id held_out score predicted", "op3_": "doc_id held_out lang_pred score",
        "op4_": "doc_id size text_crc32 law shard slot grown_shard", "op5_": "doc_id n_tokens", "op6_": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7_": "query_id rank vec_id score", "op8_": "page_id host path rule verdict", "op9_": "doc_id item_id containment", "op10_": "doc_id n_shingles component_id",
    }
    names = registered.queries()
    for prefix, columns in wanted.items():
        (name,) = [n for n in names if n.startswith(prefix)]
        frame = names[name](spark, FOLDER)
        assert set(columns.split()) <= set(frame.columns), name
        assert not frame.isEmpty()


# 1


@pytest.mark.parametrize("limit", [160 << 20, 2_000])
def test_lm_scores(spark, texts, limit):
    docs = make_docs(spark, texts, [(None, "one", None, None, 0), (3, "one", None, None, 0)])
    got = ngramlm.scores(docs, ngramlm.remainder("doc_id", 10) != 0, broadcast_bytes=limit).collect()
    assert len(got) == docs.count()
    tokens = [(r.doc_id, [*words(r.text), None]) for r in docs.collect()]
    learn = [t for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 10]
    one, two = collections.Counter(w for t in learn for w in t), collections.Counter(p for t in learn for p in zip([0, *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    want = []
    for i, t in tokens:
        first = [(one[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        full = 0.0
        for before, w, p in zip([0, *t[:-1]], t, first, strict=True):
            c = two[before, w]
            full += math.log10(((2 ** math.floor(math.log2(c)) if c else 0) + ngramlm.MU * p) / ((len(learn) if before == 0 else one[before]) + ngramlm.MU))
        want.append((i is None, i or 0, len(t), sum(one[w] > 0 for w in t), sum(map(math.log10, first)), full))
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    for h, w in zip(have, sorted(want), strict=True):
        assert h[:4] == w[:4] and h[4] == pytest.approx(w[4]) and w[5] - 1e-6 <= h[5] <= w[5] + 0.05 * w[2]
    assert {r.train_tokens for r in got} == {n}


def test_lm_without_training_rows(spark):
    docs = make_docs(spark, ["a", None])
    assert [r.n_known for r in ngramlm.scores(docs, F.lit(False)).collect()] == [0, 0]
    assert ngramlm.document_scores(docs.where("false")).isEmpty()


# 2 and 3


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [" ".join(rng.choice(["good", "day", "sun", "tree", "river", "stone"]) for _ in range(20)) for _ in range(300)]
    rows = [t + " scumbags" if i % 4 == 0 else t for i, t in enumerate(rows)]
    docs = make_docs(spark, rows, [(None, "x", None, None, 0), (900, None, None, None, 0), (901, "", None, None, 0)]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(7, 1, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    assert len(got) == 303 and got[900].score == got[901].score
    assert all(got[i].predicted == int(i % 4 == 0) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    kept = toxicity.score(docs, toxicity.fit(docs, labels))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"] and dict(kept.dtypes)["score"] == "double"
    assert [r.score for r in toxicity.predictions(docs, labels.where("false")).select("score").distinct().collect()] == pytest.approx([1 / (1 + math.exp(40))], rel=1e-12)
    assert toxicity.predictions(docs.where("false"), labels).isEmpty()


def test_toxicity_learns_a_pair():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(4000):
        a, b = (bool(x) for x in rng.random(2) < 0.5)
        rows.append(np.array([1] * a + [2] * b + [int(x) for x in rng.integers(3, 50, 5)]))
        labels.append(float(a and b))
    model = toxicity.fit_rows(8, rows, np.array(labels), min_z=3, epochs=30)
    p = model.scores(np.array([1, 2, 1, 2], dtype=np.uint64), np.array([0, 1, 2, 2]), 3)
    assert p[0] < 0.5 and p[1] < 0.5 and p[2] > 0.5


def test_toxicity_learns_a_pair_without_marginal_effect():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(4000):
        a, b = (bool(x) for x in rng.random(2) < 0.5)
        rows.append(np.array([1] * a + [2] * b + sorted({int(x) for x in rng.integers(3, 50, 5)})))
        labels.append(float(a != b))
    model = toxicity.fit_rows(8, rows, np.array(labels), epochs=30)
    assert model.terms.tolist() == [1, 2]
    p = model.scores(np.array([1, 2, 1, 2], dtype=np.uint64), np.array([0, 1, 2, 2]), 4)
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < 0.1 and p[3] < 0.1
    # the sum over pairs, term by term
    f = model.factors
    plain = model.bias + model.linear.sum() + f[0] @ f[1]
    assert p[2] == pytest.approx(1 / (1 + math.exp(-plain)))


def test_terms_are_words_and_prefixes():
    data = np.frombuffer(b"Aa abcdefgh abcdefgh", dtype=np.uint8)
    found, rows = toxicity.terms(data, np.array([0, 2, 2, 20]), 22)
    assert np.bincount(rows, minlength=3).tolist() == [1, 0, 4]
    again, _ = toxicity.terms(np.frombuffer(b"aA", dtype=np.uint8), np.array([0, 2]), 22)
    assert found[0] == again[0]


@pytest.mark.parametrize("repeated", [0, 200])
def test_fits_are_bounded_on_repeated_keys(spark, monkeypatch, repeated):
    rows = [(1, f"some words {i}", "en", "s", 0) for i in range(repeated)] + [(i, f"other words {i}", "fr", "s", 0) for i in range(2, 90)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 1)] * 200 + [(i, 1, 0) for i in range(2, 90)], "doc_id long, quality int, toxic int")
    sizes = []
    fit = toxicity.fit_rows
    monkeypatch.setattr(toxicity, "fit_rows", lambda bits, rows, y, **k: (sizes.append(len(y)), fit(bits, rows, y, **k))[1])
    toxicity.fit(docs, labels, max_fit_rows=50)
    learn = langid.fit_rows
    monkeypatch.setattr(langid, "fit_rows", lambda x, names, **k: (sizes.append(len(names)), learn(x, names, **k))[1])
    langid.fit(docs, max_fit_rows=50)
    assert sizes == [50, 50]


def _peak_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_language_fit_keeps_counts_that_are_not_zero(spark):
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 4, (40, langid.BINS)) * (rng.random((40, langid.BINS)) < 0.05)
    counts[7] = 0
    column = pa.chunked_array([pa.array([langid.packed(c) for c in part], type=pa.binary()) for part in (counts[:9], counts[9:])])
    order = rng.permutation(40).tolist()
    rows = langid.PackedRows.read(column, order)
    dense = langid.features(counts[order])
    pick = np.arange(40) % 3 == 0
    assert len(rows) == 40 and (rows[np.arange(40)] == dense).all() and (rows.part(pick)[np.array([2, 0])] == dense[pick][[2, 0]]).all()
    names = ["a", "b"] * 20
    a, b = langid.fit_rows(rows, names), langid.fit_rows(dense, names)
    assert (a.weights == b.weights).all() and (a.bias == b.bias).all() and (a.trust == b.trust).all()
    # 2,000 dense rows are 33 MB, held several times over before
    docs = spark.createDataFrame([(i, f"the and {i}" if i % 2 else f"der und {i}", "en" if i % 2 else "de", "s", 9) for i in range(2_000)], DOCS)
    model, peak = _peak_mb(lambda: langid.fit(docs))
    assert model.languages == ["de", "en"] and peak < 16


def test_toxicity_fit_looks_at_blocks_of_rows():
    rng = np.random.default_rng(6)
    n, bits = 6_000, 9
    present = rng.random((n, 1 << bits)) < 0.9
    labels = (rng.random(n) < 0.3).astype(float)
    present[:, 3] = labels > 0
    flat, bounds = np.nonzero(present)[1].astype(np.int32), np.concatenate([[0], np.cumsum(present.sum(axis=1))])
    # 11 MB of terms, and beside them several times as much before
    model, peak = _peak_mb(lambda: toxicity.fit_rows(bits, (flat, bounds), labels, epochs=1))
    assert 3 in model.terms and peak < 25
    known, seen, positive = toxicity._occurrences(flat, bounds, labels, bits)
    counts = present.sum(axis=0)
    assert (known == np.flatnonzero(counts >= 3)).all() and (seen == counts[known]).all() and (positive == present[labels > 0].sum(axis=0)[known]).all()
    where = np.full(1 << bits, -1, dtype=np.int32)
    where[[3, 9]] = [0, 1]
    term, ends = toxicity._only(flat, bounds, where)
    assert (term == np.nonzero(present[:, [3, 9]])[1]).all() and (np.diff(ends) == present[:, [3, 9]].sum(axis=1)).all()
    lists = [pa.array([[1, 2], [], [3]], type=pa.list_(pa.int32())), pa.array([[9], [4], [5, 6]], type=pa.list_(pa.int32())).slice(1)]
    flat, ends = toxicity.in_order(lists, np.array([4, 1, 0, 3, 2]))
    assert flat.tolist() == [5, 6, 1, 2, 4, 3] and ends.tolist() == [0, 2, 2, 4, 5, 6] and not lists


def test_language_by_hand():
    text = "Ab ab".encode()
    counts = langid.gram_counts(np.frombuffer(text, dtype=np.uint8), np.array([0, 0, 5]))
    want = np.zeros(langid.BINS, dtype=int)
    for width, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        for i in range(5 - width + 1):
            code = width
            for byte in b"ab ab"[i : i + width]:
                code = (code << 8 | byte) & 0xFFFFFFFF
            want[(code * factor & 0xFFFFFFFF) >> 20] += 1
    assert counts[0].sum() == 0 and (counts[1] == want).all()
    # decoding: the codeword of least weighted loss, and its lead
    code = langid.code_matrix(3)
    weights = np.array([[0.5, 0.3, 0.2], [0.2, 0.2, 0.6], [0.4, 0.4, 0.2]])
    model = langid.CodeModel(["a", "b", "c"], code, np.eye(3), np.zeros(3), weights)
    f = np.array([[2.0, -1.0, 0.5], [-1.0, -2.0, 3.0]])
    best, share, lead = model.decode(f)
    for row in range(2):
        losses = [sum(weights[c, b] * math.log(1 + math.exp(-f[row, b] * code[c, b])) for b in range(3)) for c in range(3)]
        order = sorted(range(3), key=losses.__getitem__)
        assert best[row] == order[0] and lead[row] == pytest.approx(losses[order[1]] - losses[order[0]])
        assert share[row] == pytest.approx(1 / sum(math.exp(-4 * (x - min(losses))) for x in losses))


def test_loss_weights_come_from_rows_kept_out():
    y = np.array([0] * 10 + [1] * 10)
    right = np.ones((20, 2))
    right[:5, 0] = 0  # the first bit is a coin about language 0
    w = langid.loss_weights(right, y, 2)
    assert w.sum(axis=1) == pytest.approx([1, 1]) and w[0, 0] < 0.1 < w[0, 1] and w[1, 0] == pytest.approx(0.5)
    x = np.repeat(np.eye(2, 4, dtype=np.float32), 20, axis=0)
    kept = []
    fit = langid._classifiers
    try:
        langid._classifiers = lambda x, *a: (kept.append(len(x)), fit(x, *a))[1]
        langid.fit_rows(x, ["a"] * 20 + ["b"] * 20)
    finally:
        langid._classifiers = fit
    assert kept == [32]


def test_language_of_long_texts_and_the_empty_name(spark):
    rows = [(i, ("the and with " if i % 2 else "der und nicht ") * (1 if i % 7 else 30_000 if i == 7 else 50), "" if i % 2 else "de", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("clash"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {i: "" if i % 2 else "de" for i in range(60)}


def test_language(spark):
    rng = random.Random(3)
    stock = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "nicht", "straße"], "fr": ["le", "été", "dans", "que"]}
    rows = [(i, " ".join(rng.choice(stock[g]) for _ in range(12)), g, "s", 0) for i, g in enumerate(rng.choice(list(stock)) for _ in range(300))]
    odd = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 !!", "en", "s", 0), (903, "中文", None, "s", 0), (None, "the and", "en", "s", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = {r.doc_id: r for r in langid.predictions(docs).collect()}
    assert all(got[i].lang_pred == g and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, g, _, _ in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in stock and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.predictions(docs.withColumn("lang", F.lit("en"))).collect()} == {"und", "en"}
    assert langid.predictions(docs.where("false")).isEmpty()


@pytest.mark.parametrize("k", [1, 2, 4, 6, 9, 40])
def test_codewords_differ(k):
    code = langid.code_matrix(k)
    assert len(np.unique(code, axis=0)) == k if k > 1 else code.shape == (1, 0)
    assert all(0 < (c > 0).sum() < k for c in code.T)


# 4


@pytest.mark.parametrize("shards", [3, 40])
def test_sharding(spark, texts, shards):
    docs = make_docs(spark, [*texts, *["same"] * 60], [(None, "one", None, None, 0), (3, "one", None, None, 0)])
    got = sharding.shard(docs, shards).collect()
    assert len(got) == docs.count()
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    text = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    groups = collections.defaultdict(set)
    for r in got:
        if r.doc_id is not None and text[r.doc_id] is not None:
            groups[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for t, s in groups.items() if t != "same") <= shards - 1
    if shards == 3:
        assert len(groups["same"]) <= 2
    assert sharding.shard(docs.where("false"), shards).isEmpty()


def test_sharding_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    docs = make_docs(spark, ["same"] * 900 + [None] * 300 + ["x" * 100_000, ""] * 3 + [f"text {i}" for i in range(100)]).withColumns({"row": F.lit("clash"), "g": F.lit(1), "members": F.lit(2), "deal": F.lit(3)})
    got = sharding.shard(docs, 7).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == docs.count() and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 7
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert 5 <= len({r.shard for r in got if r.linked == 900}) <= 6  # 187 a shard


# 5


def test_token_counts(spark, texts):
    scores = unigram.load_scores(unigram.default_model_file())
    low, longest = min(scores.values()) - 10, max(map(len, scores))

    def brute(text):
        t = unigram.SPACE + text.replace(" ", unigram.SPACE) if text else ""
        best = [(0.0, 0)]
        for e in range(1, len(t) + 1):
            options = [(best[e - 1][0] + low, best[e - 1][1] - len(t[e - 1].encode()))]
            options += [(best[j][0] + scores[t[j:e]], best[j][1] - 1) for j in range(max(0, e - longest), e) if t[j:e] in scores]
            best.append(max(options))
        return -best[-1][1]

    some = [t for t in texts if t is None or len(t) < 2000] + ["中文 🙂 tail  double  space ", "▁x"]
    docs = make_docs(spark, some).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(docs).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(some)}
    with pytest.raises(ValueError):
        unigram.PrefixTrie({"a▁": -1.0})


def test_pretokens_are_walked_once(monkeypatch):
    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -3.0, "abb": -3.0, "▁": -1.5, "▁a": -2.0, "éa": -2.0}
    rng, walked = random.Random(3), []
    texts = ["".join(rng.choice("aabbé ") for _ in range(rng.choice((3, 8, 200)))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
    count = unigram.PrefixTrie.count
    monkeypatch.setattr(unigram.PrefixTrie, "count", lambda self, p: walked.append(p) or count(self, p))
    trie = unigram.PrefixTrie(scores)
    got = unigram.chunk_counts(trie, data, offsets)
    first = len(walked)
    assert (unigram.chunk_counts(trie, data, offsets) == got).all()
    assert all(len(p.encode()) > unigram.KNOWN_BYTES for p in walked[first:])  # only the longest again
    monkeypatch.setattr(unigram, "MAX_KNOWN", 5)
    monkeypatch.setattr(unigram, "MAX_NODES", 40)
    assert (unigram.chunk_counts(unigram.PrefixTrie(scores), data, offsets) == got).all()
    for p in set(walked):  # each in a walk of its own
        best = [(0.0, 0)]
        for i in range(1, len(p) + 1):
            ways = [(best[i - 1][0] + min(scores.values()) - 10, -best[i - 1][1] - len(p[i - 1].encode()))]
            ways += [(best[j][0] + scores[p[j:i]], -best[j][1] - 1) for j in range(max(0, i - 3), i) if p[j:i] in scores]
            score, n = max(ways)
            best.append((score, -n))
        assert count(trie, p) == best[-1][1]


def test_token_counts_of_a_very_long_pretoken(monkeypatch):
    monkeypatch.setattr(unigram, "MAX_NODES", 500)
    scores = {"a": -1.0, "b": -1.5, "ab": -1.2, "aba": -2.0, "bb": -2.9}
    trie = unigram.PrefixTrie(scores)
    rng = random.Random(2)
    for text in ("".join(rng.choice("abx") for _ in range(5000)), "ab" * 40, "".join(rng.choice("ab") for _ in range(3000))):
        best = [(0.0, 0)]
        for e in range(1, len(text) + 1):
            options = [(best[e - 1][0] + trie.spelled, best[e - 1][1] - 1)] + [(best[e - n][0] + scores[text[e - n : e]], best[e - n][1] - 1) for n in (1, 2, 3) if n <= e and text[e - n : e] in scores]
            best.append(max(options))
        assert trie.count(text) == -best[-1][1] and len(trie.best) <= 500


# 6


def test_byte_bpe_round_trip(spark, texts):
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = bytebpe.load_ranks(bytebpe.default_rank_file())
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    alphabet = [*"  \n\t'srevlmdt''aaAb12²,.!-é中🙂", "\x1c", "\x85", "​", "　", "́", "\xa0"]
    some = [*texts, "<|endoftext|>", "ab" * 5000, " " * 3000, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000))]
    docs = make_docs(spark, some).withColumn("ids", F.lit("clash"))
    encoded = bytebpe.encode(docs)
    assert encoded.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    for r in bytebpe.decode(encoded).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    digest = {r.doc_id: r for r in bytebpe.token_digests(docs).collect()}
    ids = library.encode_ordinary(some[10])
    assert digest[10].n_tokens == len(ids) and digest[10].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digest[0].n_tokens == 0 and digest[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bytebpe.decode(none).first().decoded) == b""
    assert bytebpe.token_digests(docs.where("false")).isEmpty()


# 7


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 24), (1060, [float("nan")] * 24), (1080, [1.0] * 23), (None, [1.0] * 24), (1100, [None] * 24)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=20, tables=24, probes=10).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 20))
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:20]
        assert len(found) == 20 and q not in dict(found) and all(score == pytest.approx(s[i]) for i, score in found)
        hits += len(set(want) & {i for i, _ in found})
    assert hits >= 0.9 * 20 * len(by)
    assert [i for i, _ in by[100]] [:19] == list(range(101, 120)) or by[100][0][1] > x[100] @ x[100]
    assert neighbours.search(vectors.where("vec_id >= 1000"), F.lit(True)).isEmpty()
    few = neighbours.search(vectors.where("vec_id < 3"), F.lit(True), tables=64, probes=64)
    assert few.count() == 6


@pytest.mark.parametrize("case", ["lognormal", "one long", "two lengths", "equal", "tiny", "no head"])
def test_neighbours_of_unequal_lengths(spark, monkeypatch, case):
    """Recall with the parameters of the query, with and without the longest entries, and nobody short."""
    rng = np.random.default_rng(8)
    n = 30 if case.startswith("tiny") else 2000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if case in ("lognormal", "no head"):
        x *= np.exp(rng.normal(size=(n, 1)))
    if case == "one long":
        x[7] *= 100
    if case == "two lengths":
        x[::2] *= 2
    if case == "no head":
        monkeypatch.setattr(neighbours, "HEAD", 0)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = collections.defaultdict(set)
    for r in neighbours.search(vectors, F.col("vec_id") % (n // 15) == 0).collect():
        by[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, n, n // 15):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(by[q]) == 20
        hits += len(by[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(range(0, n, n // 15))


def test_neighbours_of_each_size(spark):
    rows = [(i, [1.0, float(i)]) for i in range(5)] + [(10 + i, [1.0, 2.0, float(i)]) for i in range(3)] + [(20, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(neighbours.search(vectors, F.lit(True), k=2).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert got == {0: [1, 2], 1: [4, 3], 2: [4, 3], 3: [4, 2], 4: [3, 2], 10: [11, 12], 11: [12, 10], 12: [11, 10]}


@pytest.mark.parametrize("head", [True, False])
def test_recall_of_the_registered_search(spark, monkeypatch, head):
    """The buckets answer: vectors of one length have no longest entries, and without them the recall is the same."""
    folder = "/root/testdata/sf0.1"
    if not head:
        monkeypatch.setattr(neighbours, "HEAD", 0)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    by = collections.defaultdict(set)
    for r in registered.op7_cross_polytope(spark, folder).collect():
        by[r.query_id].add(r.vec_id)
    hits = 0
    asked = [i for i in ids if i % 20 == 0]
    for q in asked:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hits += len(by[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert 0.95 * 20 * len(asked) <= hits < 20 * len(asked)  # below 1: not by comparing everything


@pytest.mark.parametrize("dims", [64, 128, 256])
def test_probes_follow_the_dimensions(dims):
    """Random directions, the worst there is: what the sample asks for holds in the table."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, dims))
    signs = neighbours.rotations(dims, neighbours.TABLES)
    probes = neighbours.fitted_probes(x[:2000], x[:100], np.zeros(2000, dtype=bool), signs, 20)
    y = neighbours.directions(x)
    buckets = np.stack([neighbours.axes(neighbours.rotate(y, s), 1)[:, 0] for s in signs], axis=1)
    asked = np.stack([neighbours.axes(neighbours.rotate(y[:100], s), probes) for s in signs], axis=1)
    query, entry, score = neighbours.bucket_search(x, buckets, x[:100], asked, 20)
    exact = x[:100] @ x.T
    assert np.allclose(score, exact[query, entry])
    best = np.argsort(-exact, axis=1)[:, :20]
    hits = sum(len(set(entry[query == i]) & set(best[i])) for i in range(100))
    assert hits >= 0.95 * 2000 and probes < 2 * dims


def test_few_probes_do_for_data_with_structure():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 1, 64)) + rng.normal(size=(40, 50, 64)) * 0.2).reshape(-1, 64)
    assert neighbours.fitted_probes(x, x[::20], np.zeros(len(x), dtype=bool), neighbours.rotations(64, neighbours.TABLES), 20) <= 2


def test_neighbours_under_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in neighbours.search(vectors, F.lit(True), k=5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


# 8


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://EXAMPLE.com/en/x", "http://www.example.com/en/x", "http://a.www.example.com/en/", "http://example.com", "http://example.com/?q=/en/", "http://x.net/es/1",
        "http://net/fr/", "http://net/fr/", "http://" + "a." * 5000 + "net/es/" + "x" * 50_000, "http://x.org/en/", "http://badexample.com/en/", "http:///path", "http://a.com#/x", "ftp://u@h.com:21/", "http://example.com/en", "://",
    ]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    rules = urlfilter.rule_table(spark, urlfilter.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
        fit = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fit)[1:]) if fit else (host, path, None, "allow")

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.where("false"), rules).isEmpty()
    assert {r.verdict for r in urlfilter.judge(pages, rules.where("false")).collect()} == {"allow"}


@pytest.mark.parametrize("share", [2, 5, 300])
def test_cascade_is_exact(spark, share):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(f"pmod(xxhash64(key), {share}) = 0")
    cascade = urlfilter.build_cascade(listed, keys)
    assert len(cascade.levels) > 2
    told = keys.where(cascade.listed(F.col("key")))
    assert told.exceptAll(listed).isEmpty() and listed.exceptAll(told).isEmpty()
    assert urlfilter.build_cascade(keys.where("false"), keys).levels == [] and len(urlfilter.build_cascade(listed, listed).levels) == 1


def test_cascades_of_the_registered_query(spark, monkeypatch):
    """Levels after the first take part on the given tables."""
    built, build = [], urlfilter.build_cascade
    monkeypatch.setattr(urlfilter, "build_cascade", lambda *a, **k: built.append(build(*a, **k)) or built[-1])
    registered.op8_url_filter(spark, "/root/testdata/sf0.01")
    assert len(built) == 2 and sum(len(c.levels) for c in built) > 2


# 9 and 10


def test_decontamination(spark, texts):
    items = [(1, " ".join(texts[9].split()[:20])), (2, "a b c"), (3, None), (4, ""), (5, "one"), (6, texts[9].upper()), (6, "nothing like it at all here"), (7, "p q r s t u v w")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = make_docs(spark, [*texts, "before " + texts[9] + " after " + "filler " * 300, "p q r s t u v w x", "p q r s t u z w"], [(None, "one", None, None, 0)])

    def runs(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    want = {}
    for r in docs.where("doc_id is not null").collect():
        for i, t in items:
            w = words(t)
            if w:
                s = runs(w, min(5, len(w)))
                shared = len(s & runs(words(r.text), min(5, len(w))))
                if shared * 100 >= 80 * len(s):
                    want[r.doc_id, i] = max(want.get((r.doc_id, i), 0), shared / len(s))
    got = {(r.doc_id, r.item_id): r.containment for r in decontam.search(docs, bench).collect()}
    assert got == pytest.approx(want) and len(got) > 5
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in want})
    assert decontam.search(docs, bench.where("false")).isEmpty() and decontam.search(docs.where("false"), bench).isEmpty()


def test_decontamination_beside_names_of_its_own(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item, "x")], "item_id int, text string, doc_id string")
    docs = spark.createDataFrame([(1, "a " * 50_000 + item, 1, "h"), (2, item.rsplit(" ", 1)[0], 1, "h"), (3, " ".join(item.split()[:20]), 1, "h")], "doc_id long, text string, n_shingles int, h string").withColumns({"w": F.lit(1), "least": F.lit(2), "item_id": F.lit("y")})
    assert {(r.doc_id, r.item_id, r.n_shared) for r in decontam.search(docs, bench).collect()} == {(1, 1, 26), (2, 1, 25)}
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [3]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17, 33])
def test_size_classes_lose_nothing(spark, n):
    """A document with just as much of an item as it takes, and no more words than that."""
    item = [f"w{i}" for i in range(n + 4)]
    need = (n * 80 + 99) // 100
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    docs = spark.createDataFrame([(1, " ".join(item[: need + 4])), (2, " ".join(item[: need + 3]))], "doc_id long, text string")
    assert {r.doc_id for r in decontam.search(docs, bench).collect()} == {1}


def test_jaccard_links_across_rows_without_a_key(spark):
    run = lambda at: " ".join(f"w{i}" for i in range(at, at + 60))
    docs = spark.createDataFrame([(1, run(0)), (None, run(5)), (2, run(10)), (3, run(100)), (None, run(200)), (None, run(203))], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.link_components(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (3, 3)]


def test_ranks_tell_frequent_shingles_from_many_rare_ones():
    rng = np.random.default_rng(1)
    counts = rng.poisson(5000, 1 << 12).astype(float)
    counts[:3] += (700, 3000, 60_000)
    rank, ways = jaccard.ranks(counts, float(np.median(counts)))
    assert rank[3:].max() < rank[0] < rank[1] < rank[2] and ways[rank[0]] == 1 and 10 <= ways[rank[2]] <= 20


def test_jaccard_with_every_shingle_hot(spark, monkeypatch, texts):
    docs = make_docs(spark, [*texts, *["same old words in here again"] * 30])
    want = sorted(map(tuple, jaccard.link_components(docs).collect()))
    ranks = jaccard.ranks
    monkeypatch.setattr(jaccard, "ranks", lambda counts, usual: (ranks(counts, usual)[0], np.full(256, 3)))
    assert sorted(map(tuple, jaccard.link_components(docs).collect())) == want


def test_jaccard_sketch_follows_the_text():
    assert [jaccard.sketch_bits(n) for n in (0, 500 << 20, 2 << 30, 8 << 30, 1 << 47)] == [20, 20, 23, 24, 24]
    for most, bytes_each in ((255, 1), (256, 2), (1 << 16, 4)):
        counts = np.zeros(jaccard._SKETCH_ROWS, dtype=np.uint32)
        counts[5] = most
        raw = jaccard._narrow(counts)
        assert len(raw) == bytes_each * len(counts) and (jaccard._wide(raw) == counts).all()


@pytest.mark.parametrize("bits", [14, 22])
def test_jaccard_under_sketches_of_other_sizes(spark, monkeypatch, texts, bits):
    chain = [" ".join(f"c{j}" for j in range(i, i + 60)) for i in range(0, 40, 4)]
    docs = make_docs(spark, [*texts, *chain, *["same old words in here again"] * 30])
    want = sorted(map(tuple, jaccard.link_components(docs).collect()))
    monkeypatch.setattr(jaccard, "sketch_bits", lambda size: bits)
    assert sorted(map(tuple, jaccard.link_components(docs).collect())) == want


def test_jaccard_order_is_that_of_the_counts(spark):
    docs = make_docs(spark, [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(200)]).repartition(5)
    source, kept = jaccard._text_column(docs, "doc_id", "text"), []
    rank, _ = jaccard._order(jaccard._scan(source, 1, 0, 14), 14, jaccard._keeper(kept))
    counts = np.zeros(1 << 14)
    for r in docs.collect():
        data = np.frombuffer(r.text.encode(), dtype=np.uint8)
        found, _ = jaccard.chunk_sets(data, np.array([0, len(data)]), 1)
        np.add.at(counts, (found >> np.uint64(50)).astype(np.int64), 1)
    assert (rank == jaccard.ranks(counts, float(np.median(counts)))[0]).all() and rank.max() > 0
    for path in kept:
        jaccard.drop(spark, path)


def test_jaccard(spark, texts):
    chain = [" ".join(f"c{j}" for j in range(i, i + 60)) for i in range(0, 40, 4)]
    docs = make_docs(spark, [*texts, *chain, *["same old words in here again"] * 30], [(None, "lonely words", None, None, 0), (8, texts[8], None, None, 0)])
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()]
    assert len(got) == docs.count()
    assert {g for g in got if g[0] is not None} == {(i, len(s), find(i)) for i, s in sets.items()}
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({find(i) for i in sets})
    assert jaccard.link_components(docs.where("false")).isEmpty()


def test_jaccard_pairs_and_counts(spark, texts):
    chain = [" ".join(f"c{j}" for j in range(i, i + 60)) for i in range(0, 40, 2)]
    docs = make_docs(spark, [*texts, *chain, *["same old words in here again"] * 30])
    sets = {}
    for r in docs.collect():
        w = words(r.text)
        sets[r.doc_id] = frozenset({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    linked = {(a, b) for a in sets for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    got = [(r.doc_a, r.doc_b) for r in jaccard.linked_pairs(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in linked if a < b and sets[a] != sets[b] and first[sets[a]] == a and first[sets[b]] == b}
    assert {r.doc_id: r.n_links for r in jaccard.link_counts(docs).collect()} == {i: sum(a == i for a, _ in linked) for i in sets}


def test_components(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    frame = spark.createDataFrame(links, "a long, b long")
    for limit in (10**6, 10):
        monkeypatch.setattr(components, "LOCAL_LINKS", limit)
        assert {r.node: r.root for r in components.components(frame).collect()} == {i: find(i) for i in root}
    assert components.components(frame.where("false")).isEmpty()


@pytest.mark.parametrize("limit", [450, 700, 1000])
def test_components_when_rounds_fall_below_the_limit(spark, monkeypatch, limit):
    rng = random.Random(6)
    name = rng.sample(range(10**6), 400)
    # ten tasks that each hold most of one long path, so that their stars repeat each other
    links = [(name[i], name[i + 1]) for _ in range(10) for i in range(399) if rng.random() < 0.7]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(links, 10), "a long, b long")
    monkeypatch.setattr(components, "LOCAL_LINKS", limit)
    assert {(r.node, r.root) for r in components.components(frame).collect()} == {(i, min(name)) for i in name}
