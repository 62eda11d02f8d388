"""Retrieval: BM25, cosine nearest neighbours, rank fusion, and comparisons of modes.

All searches take a set of queries at once and compare each with all rows.  The queries go to every task in blocks of
bounded size, one scan a block; a task keeps the k best of each query, so only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import tokens
from ..tables import drop, stored

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
MODES = ("dense", "bm25", "hybrid")
BLOCK_BYTES = 32 << 20  # of the query vectors that one scan compares with
BROADCAST_ROWS = 500_000  # of query terms that the driver reads at once, about 100 bytes each
QUERY_ROWS, QUERY_TERMS = 4096, 250_000  # of the queries that one scan of the index answers
INDEX_ROWS = 1024  # chunks that are tokenised at a time
SCORES = 1 << 18  # scores that a task has in hand
HITS = 1 << 18  # terms of chunks met with queries at a time, some tens of bytes each


def _decimal_sum(c: Column) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(c.cast("decimal(28,9)")).cast("double")


def _in_blocks(spark: SparkSession, blocks: Iterator, scan: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """The union of ``scan`` over blocks of queries, each sent to every task.  If there are several, what a block
    has found is stored and its broadcast given up before the next, so that one at a time is held."""
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return scan(spark.sparkContext.broadcast(first))
    out = None
    for block in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(block)
        part = stored(scan(shared), "found")[0]
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


class Best:
    """The k best ids of each query over the batches of a task; ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.queries = k, queries
        self.held: tuple[np.ndarray, ...] | None = None  # query, score, id
        self.last = np.full(queries, -np.inf)  # the k-th score

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row an id, a column a query."""
        row, query = np.nonzero(scores >= self.last)
        new = [query, scores[row, query], ids[row]]
        if len(row) > 4 * self.k * self.queries:  # first leave what a column's k best leave behind
            kth = min(self.k, len(scores))
            floor = np.partition(scores, len(scores) - kth, axis=0)[len(scores) - kth]
            kept = new[1] >= floor[query]
            new = [c[kept] for c in new]
        held = [np.concatenate(c) for c in zip(self.held, new, strict=True)] if self.held else new
        _, place = np.unique(held[2], return_inverse=True)
        order = np.lexsort((place, -held[1], held[0]))
        begins = np.searchsorted(held[0][order], held[0][order], side="left")
        order = order[np.arange(len(order)) - begins < self.k]
        self.held = tuple(c[order] for c in held)
        full = np.bincount(self.held[0], minlength=self.queries) == self.k
        ends = np.searchsorted(self.held[0], np.arange(self.queries), side="right") - 1
        self.last[full] = self.held[1][ends[full]]


def indexed(chunks: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """A row a chunk: key, ``keep``, dl (all its tokens) and its distinct terms with their counts, by one scan
    that shuffles nothing."""
    rows = chunks.select(F.col(key), *keep, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string("dl long, terms array<string>, tfs array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_ROWS):
                part = batch.slice(at, INDEX_ROWS)
                lists = pc.split_pattern_regex(part.column(part.num_columns - 1), "[^a-z0-9]+")
                owner, words = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
                some = pc.not_equal(words, "")
                owner, words = owner[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
                size = max(1, len(words.dictionary))
                pairs, counts = np.unique(owner.astype(np.int64) * size + words.indices.to_numpy(), return_counts=True)
                bounds = pa.array(np.searchsorted(pairs, np.arange(part.num_rows + 1) * size).astype(np.int32))
                terms = pa.ListArray.from_arrays(bounds, words.dictionary.take(pa.array(pairs % size)))
                tfs = pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int32)))
                dl = pa.array(np.bincount(owner, minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], dl, terms, tfs], names=schema.names)

    return rows.mapInArrow(run, schema)


def summed_points(chunks: int, queries: int, owner: np.ndarray, term: np.ndarray, share: np.ndarray, bounds: np.ndarray, query: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Billionths of score, a row a chunk and a column a query, from the chunks' known terms (``owner``, ``term``, ``share``)
    and the queries of each term (``bounds``, ``query``, ``weight``).  Sums of whole numbers are exact in doubles, so terms
    meet their queries ``HITS`` at a time, however many queries have them."""
    cells = np.zeros(chunks * queries)
    ends = np.cumsum(bounds[term + 1] - bounds[term])
    cuts = np.searchsorted(ends, np.arange(HITS, int(ends[-1]) if len(ends) else 0, HITS), side="right")
    for a, b in pairwise([0, *np.unique(cuts).tolist(), len(term)]):
        times = bounds[term[a:b] + 1] - bounds[term[a:b]]
        hit = np.repeat(np.arange(a, b), times)
        place = np.repeat(bounds[term[a:b]] - np.cumsum(times) + times, times) + np.arange(len(hit))
        cells += np.bincount(owner[hit] * queries + query[place], weights=np.rint(weight[place] * share[hit] * 1e9), minlength=len(cells))
    return cells.reshape(chunks, queries)


class BM25Index:
    """Term counts of each chunk and the table of terms, stored; built by one scan of the texts, for any number of searches.

    Lengths count all tokens and chunks without tokens are part of the average.  A negative idf
    becomes EPSILON times the mean idf of all terms.  ``keep`` are columns that a search may filter by.
    """

    def __init__(self, chunks: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()):
        self.key, self.spark = key, chunks.sparkSession
        self.rows, path = stored(indexed(chunks, key, text, keep), "index")
        self.paths = [path]
        facts = self.rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        self.n, self.avgdl = facts.n, facts.tokens / max(facts.n, 1)
        terms = self.rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        raw, path = stored(terms.withColumn("raw", F.ln(F.lit(self.n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)), "terms")
        self.paths.append(path)
        mean = raw.agg((_decimal_sum(F.col("raw")) / F.count(F.lit(1))).alias("mean")).first().mean
        self.terms = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))

    def drop(self) -> None:
        for path in self.paths:
            drop(self.spark, path)

    def wanted(self, queries: DataFrame, query_key: str = "query_id", query_text: str = "query") -> DataFrame:
        """query_id, term and weight of the queries' terms, null where the corpus does not have it; repeated terms count repeatedly."""
        asked = queries.select(F.col(query_key).alias("query_id"), F.explode_outer(tokens(F.col(query_text))).alias("term"))
        asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).join(self.terms, "term", "left")
        return asked.select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))

    def _blocks(self, queries: DataFrame) -> Iterator[tuple]:
        """ids of queries and, for their known terms, the term, the queries that have it and its weight in them."""
        rows = self.wanted(queries).orderBy("query_id")
        some = rows.limit(BROADCAST_ROWS + 1).collect()
        source = iter(some) if len(some) <= BROADCAST_ROWS else rows.toLocalIterator()
        ids: list = []
        terms: list[tuple] = []

        def block() -> tuple:
            names = sorted({t for _, t, _ in terms})
            place = {t: i for i, t in enumerate(names)}
            ordered = sorted((place[t], q, w) for q, t, w in terms)
            which = np.array([o[0] for o in ordered], dtype=np.int64)
            return list(ids), names, np.searchsorted(which, np.arange(len(names) + 1)), np.array([o[1] for o in ordered], dtype=np.int64), np.array([o[2] for o in ordered], dtype=float)

        for r in source:
            if not ids or r.query_id != ids[-1]:
                if len(ids) >= QUERY_ROWS or len(terms) >= QUERY_TERMS:
                    yield block()
                    ids, terms = [], []
                ids.append(r.query_id)
            if r.weight is not None:
                terms.append((len(ids) - 1, r.term, r.weight))
        yield block()

    def search(self, queries: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
        """The k best of each query with their rank; chunks that share no term score 0 and come by key.

        ``allowed``, by columns that the index keeps, filters what is ranked; the statistics stay global.  Every task adds up
        its chunks' scores, in integers so that no order matters, and emits the k best of each query once: one scan, whatever the
        queries have in common with the corpus, and no shuffle but of k rows a query and task.
        """
        rows = self.rows if allowed is None else self.rows.where(allowed)
        kinds = {"query_id": queries.schema["query_id"].dataType, self.key: self.rows.schema[self.key].dataType, "score": T.DoubleType()}
        schema, avgdl = T.StructType([T.StructField(n, t) for n, t in kinds.items()]), self.avgdl

        def scan(shared: Broadcast) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                asked, names, bounds, query, weight = shared.value
                terms, best = pa.array(names, type=pa.string()), Best(len(asked), k)
                step = min(INDEX_ROWS, max(1, SCORES // max(1, len(asked))))
                for batch in batches:
                    for at in range(0, batch.num_rows, step):
                        part = batch.slice(at, step)
                        found = pc.index_in(part.column(2).flatten(), value_set=terms)
                        known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                        term = pc.fill_null(found, 0).to_numpy()[known]
                        owner = pc.list_parent_indices(part.column(2)).to_numpy()[known]
                        tf, dl = part.column(3).flatten().to_numpy()[known].astype(float), part.column(1).to_numpy()[owner]
                        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or 1.0)))
                        cells = summed_points(part.num_rows, len(asked), owner, term, share, bounds, query, weight)
                        best.add(cells, part.column(0).to_numpy(zero_copy_only=False))
                if best.held:
                    columns = [pa.array([asked[i] for i in best.held[0]]), pa.array(best.held[2]), pa.array(best.held[1] / 1e9)]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, to_arrow_schema(schema).types, strict=True)], names=schema.names)

            return rows.select(self.key, "dl", "terms", "tfs").mapInArrow(run, schema)

        return top_k(_in_blocks(self.spark, self._blocks(queries.where("query_id is not null")), scan), k, self.key)


def top_k(scores: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """The k best of each query with their rank; ties to the smaller key."""
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int, key: str = "doc_id", project: Column | None = None, text: str = "text") -> DataFrame:
    """Top k by BM25 of queries (query_id, query); a project filter applies after scoring.  For more than one search, keep a ``BM25Index``."""
    marked = chunks.withColumn("__allowed", F.lit(True) if project is None else F.coalesce(project, F.lit(False)))
    index = BM25Index(marked, key, text, ["__allowed"])
    found, _ = stored(index.search(queries, k, F.col("__allowed")), "best")
    index.drop()
    return found


def dense_search(
    queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "embedding", allowed: Column | None = None
) -> DataFrame:
    """Top k by cosine similarity, rounded to nine decimals; a zero vector is as far from all.

    ``allowed`` filters before the search.  Exact search of a query set against all vectors, in blocks of at most ``BLOCK_BYTES`` of queries.
    """
    wanted = queries.select(F.col(query_key).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null").orderBy("q")
    schema = "query_id long, id long, score double"
    rows = vectors if allowed is None else vectors.where(allowed)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm == 0, 1, norm)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block, held = [], 0
        for row in wanted.toLocalIterator():
            block.append(row)
            held += 8 * len(row.v) + 100
            if held >= BLOCK_BYTES:
                yield np.array([r.q for r in block]), unit(np.array([r.v for r in block], dtype=float))
                block, held = [], 0
        yield np.array([r.q for r in block], dtype=np.int64), unit(np.array([r.v for r in block], dtype=float).reshape(len(block), len(block[0].v) if block else 0))

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(len(ids), k)
            step = max(1, SCORES // max(1, len(ids)))
            for batch in batches if len(ids) else ():
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    x = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                    best.add(np.round(x @ q.T, 9) + 0.0, part.column(0).to_numpy())
            if best.held:
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.held[0]]), pa.array(best.held[2]), pa.array(best.held[1])], names=["query_id", "id", "score"])

        return rows.mapInArrow(run, schema)

    return top_k(_in_blocks(vectors.sparkSession, blocks(), scan).withColumnRenamed("id", key), k, key)


def rrf(dense: DataFrame, bm25: DataFrame, k: int, key: str = "doc_id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; ties in the order of the dense list, then of the other."""
    both = dense.select("query_id", key, F.col("rank").alias("d"), F.lit(None).cast("int").alias("b"))
    both = both.unionByName(bm25.select("query_id", key, F.lit(None).cast("int").alias("d"), F.col("rank").alias("b")))
    part = F.coalesce(1 / (constant + F.col("d")), F.lit(0.0)) + F.coalesce(1 / (constant + F.col("b")), F.lit(0.0))
    fused = both.groupBy("query_id", key).agg(F.round(F.sum(part), 12).alias("score"), F.min("d").alias("d"), F.min("b").alias("b"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("d"), F.asc_nulls_last("b"), key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def pool_size(k: int) -> int:
    return max(20, 5 * k)


def retrieve(
    queries: DataFrame, chunks: DataFrame, k: int = 4, mode: str = "hybrid", key: str = "doc_id", vector: str = "embedding", text: str = "text",
    project: str | None = None, corpus_version: str | None = None, rrf_k: int = RRF_K, index: BM25Index | None = None,
) -> DataFrame:
    """Top k chunks of each query in a mode; queries have query_id, query and a vector.

    ``project`` filters the vectors before their search and the BM25 scores after it;
    ``corpus_version`` keeps vectors of another version out, so that a stale table shows as
    missing answers instead of wrong ones.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    pool = k if mode != "hybrid" else pool_size(k)
    own = F.lit(True) if project is None else F.col("project") == project
    current = own if corpus_version is None else own & (F.col("corpus_version") == corpus_version)
    dense = dense_search(queries, chunks, pool, key, vector, query_vector=vector, allowed=current) if mode != "bm25" else None
    if mode == "dense":
        return dense
    made = index or BM25Index(chunks, key, text, [] if project is None else ["project"])
    lexical = made.search(queries, pool, None if project is None else own)
    if index is None:
        lexical, _ = stored(lexical, "best")
        made.drop()
    return lexical if mode == "bm25" else rrf(dense, lexical, k, key, rrf_k)


def retrieve_modes(queries: DataFrame, chunks: DataFrame, k: int, key: str = "doc_id", vector: str = "embedding", text: str = "text", index: BM25Index | None = None) -> DataFrame:
    """mode, query_id, key and rank of the top k in every mode, each list of candidates made once."""
    pool = pool_size(k)
    dense, _ = stored(dense_search(queries, chunks, pool, key, vector, query_vector=vector), "dense")
    lexical, _ = stored((index or BM25Index(chunks, key, text)).search(queries, pool), "lexical")
    lists = {"dense": dense.where(F.col("rank") <= k), "bm25": lexical.where(F.col("rank") <= k), "hybrid": rrf(dense, lexical, k, key)}
    parts = [lists[m].select(F.lit(m).alias("mode"), "query_id", key, "rank") for m in MODES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body has it."""
    return F.transform(F.array(value), body)[0]


def hash_vector(text: Column, width: int = 8) -> Column:
    """A stand-in embedding without a model: the first bytes of the SHA-256 of the text, of length 1, as floats."""

    def unit(raw: Column) -> Column:
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x)).cast("float").cast("double")
        return _let(norm, lambda n: F.transform(raw, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float")))

    def numbers(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double"))

    return _let(_let(F.sha2(text.cast("binary"), 256), numbers), unit)


def hit_rates(ranked: DataFrame, expected: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Hit rate at k by mode, and by columns of the questions such as project and type: ranked (mode,
    query_id, doc, rank) against expected (query_id, doc and those columns); a question without a hit is a miss."""
    found = ranked.where(F.col("rank") <= k).join(expected, ["query_id", "doc"], "left_semi").select("mode", "query_id").distinct().withColumn("hit", F.lit(1))
    asked = expected.select("query_id", *by).distinct().join(F.broadcast(ranked.select("mode").distinct()), F.lit(True))  # three modes
    both = asked.join(found, ["mode", "query_id"], "left").groupBy("mode", *by)
    hits = F.coalesce(F.sum("hit"), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("queries"), hits.alias("hits"), (hits / F.count(F.lit(1))).alias("hit_rate"))


def disagreements(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Questions that some modes hit and others miss, with the modes that hit, in order."""
    found = ranked.where(F.col("rank") <= k).join(expected, ["query_id", "doc"], "left_semi").groupBy("query_id")
    return found.agg(F.array_sort(F.collect_set("mode")).alias("hit_by")).where(F.size("hit_by") < len(MODES))


def mode_table(ranked: DataFrame) -> DataFrame:
    """One row a query with the ordered ids of each mode, and whether two modes agree throughout."""
    lists = ranked.groupBy("query_id", "mode").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("ids"))
    wide = lists.groupBy("query_id").pivot("mode", list(MODES)).agg(F.first("ids"))
    return wide.withColumn("hybrid_is_bm25", F.col("hybrid").eqNullSafe(F.col("bm25")))


def diagnose(ranked: DataFrame) -> DataFrame:
    """One row: whether dense search came back empty, or hybrid equals BM25, on every query."""
    wide = mode_table(ranked)
    return wide.agg(F.every(F.col("dense").isNull()).alias("dense_empty"), F.every("hybrid_is_bm25").alias("hybrid_is_bm25")).withColumn(
        "ok", ~(F.coalesce("dense_empty", F.lit(True)) | F.coalesce("hybrid_is_bm25", F.lit(True)))
    )
