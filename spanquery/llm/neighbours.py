"""Approximate nearest neighbours by cross-polytope hashing (operator 7).

A table turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a
Hadamard transform) and puts each on the nearest signed axis, so a table has twice as many
buckets as dimensions.  A query probes, in every table, the axes nearest to it; what it meets is
ranked by the exact inner product in double precision on the original vectors.

How many axes a query probes is fitted: on a sample of at most ``SAMPLE`` entries and ``SAMPLE_QUERIES`` queries, the
least number that finds ``TARGET`` of their true neighbours.  (All entries are indexed and searched; in a sample
the neighbours are further away than in the table, so the table's recall is higher.)  Data with structure ask for few
probes, random ones and many dimensions for many.

Entries are dealt out in parts and queries in turns of bounded bytes; each part has its own tables, and each pair of
a part and a turn is one group, so no bucket, however full, is a task of its own.  Equal vectors are one entry with
their k + 1 smallest ids, which is all that can reach a top k under the tie rule.

Directions are hashed, whatever the lengths.  As a long vector can be near by inner product and far by direction,
every query is also compared with the entries that are longer than all but a twentieth, at most ``HEAD`` and whole bands of length only;
where lengths are equal there are none.  A query that has found fewer than there are is compared with all entries.

Defined cases: null, empty and zero vectors, vectors with null or non-finite components, and rows
with a null id take no part, neither as queries; vectors of different size are searched apart; a
query gets k neighbours or, if there are fewer other ids of its size, all; rows that share an id never find
each other; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stored
from .workers import released

TABLES = 16
TARGET = 0.97  # share of the sample's neighbours that the probes find
SAMPLE, SAMPLE_BYTES, SAMPLE_QUERIES = 4096, 8 << 20, 256
PARTS, PART_ROWS, PART_BYTES, TURN_BYTES = 24, 4096, 16 << 20, 8 << 20  # of a small table, so many parts of at least PART_ROWS
HEAD, HEAD_SHARE = 4096, 20
HEAD_BYTES = 32 << 20  # of the vectors that all queries are compared with
BANDS = 32  # of length, for each doubling of its square


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(width: int, tables: int, seed: int = 5) -> np.ndarray:
    """Signs of the three rounds of each table."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(tables, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors padded to a power of two."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, _width(x.shape[1]) - x.shape[1])))


def _width(dims: int) -> int:
    return 1 << max(1, int(np.ceil(np.log2(dims))))


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first."""
    both = np.hstack([y, -y])
    probes = min(probes, both.shape[1])
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), axis=1, kind="stable"), 1)


def fitted_probes(entries: np.ndarray, queries: np.ndarray, met: np.ndarray, signs: np.ndarray, k: int, target: float = TARGET) -> int:
    """The least number of probes with which the queries find ``target`` of their k nearest entries; those in
    ``met`` are found anyway."""
    nearness = queries @ entries.T
    nearness[(queries[:, None, :1] == entries[None, :, :1])[:, :, 0] & np.isclose(nearness, (queries * queries).sum(axis=1)[:, None], rtol=1e-12)] = -np.inf  # the query itself
    k = min(k, len(entries))
    near = np.argpartition(-nearness, k - 1, axis=1)[:, :k]
    row = np.arange(len(queries))[:, None]
    first = np.full(near.shape, np.iinfo(np.int64).max)
    d, e = directions(queries), directions(entries)
    for s in signs:
        order = axes(rotate(d, s), 2 * signs.shape[2])
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        first = np.minimum(first, place[row, axes(rotate(e, s), 1)[:, 0][near]])
    first[met[near]] = 0
    needed = np.sort(first[np.isfinite(np.take_along_axis(nearness, near, 1))])
    return int(needed[min(len(needed), int(np.ceil(target * len(needed)))) - 1]) + 1 if len(needed) else 1


class Best:
    """The best entries of each query of a group, a few more than k + 1, as matrix products round differently from plain sums."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.last = k + 9, np.full(queries, -np.inf)
        self.held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]  # query, entry, score

    def add(self, new: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        query, entry, score = (np.concatenate([h, *[n[i] for n in new]]) for i, h in enumerate(self.held))
        _, once = np.unique(query * (1 << 32) + entry, return_index=True)  # an entry is met in several tables
        query, entry, score = query[once], entry[once], score[once]
        order = np.lexsort((entry, -score, query))
        begins = np.searchsorted(query[order], query[order], side="left")
        order = order[np.arange(len(order)) - begins < self.k]
        self.held = [query[order], entry[order], score[order]]
        n = np.bincount(self.held[0], minlength=len(self.last))
        ends = np.cumsum(n) - 1
        self.last[n == self.k] = self.held[2][ends[n == self.k]]


def bucket_search(e: np.ndarray, buckets: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, entry and score of the best that share a bucket: buckets (entries x tables) against probes (queries x tables x probes)."""
    best = Best(len(q), k)
    for t in range(buckets.shape[1]):
        order = np.argsort(buckets[:, t], kind="stable")
        names, begins = np.unique(buckets[order, t], return_index=True)
        ends = np.append(begins[1:], len(order))
        asked = probes[:, t].ravel()
        turn = np.argsort(asked, kind="stable")
        first, last = np.searchsorted(asked[turn], names), np.searchsorted(asked[turn], names, side="right")
        new = []
        for a, b, c, d in zip(begins, ends, first, last, strict=True):
            for at in range(c, d, 512):
                who, inside = turn[at : min(at + 512, d)] // probes.shape[2], order[a:b]
                score = q[who] @ e[inside].T
                i, j = np.nonzero(score >= best.last[who][:, None])
                new.append((who[i], inside[j], score[i, j]))
            if sum(len(n[0]) for n in new) > 1 << 20:
                best.add(new)
                new = []
        best.add(new)
    query, entry, _ = best.held
    return query, entry, (q[query] * e[entry]).sum(axis=1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row that ``is_query`` picks; ``probes`` are fitted unless given."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(sound)
    # -0.0 and 0.0 are equal components
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count_distinct("id").alias("n"), F.max("q").alias("q")).collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sizes:
        if r.q and r.n > 1:
            out = out.unionByName(_search(rows.where(F.size("v") == r.dims), r.dims, r.n - 1, k, tables, probes))
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], type=pa.binary())


def _rows(column: pd.Series, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=kind).reshape(len(column), *shape)


def _search(rows: DataFrame, dims: int, others: int, k: int, tables: int, probes: int | None) -> DataFrame:
    """The same for rows of id, v and q with ``dims`` components, where a query has so many other ids."""
    spark = rows.sparkSession
    # equal vectors are one entry; of its ids, the k + 1 smallest can be in an answer
    part = F.pmod(F.xxhash64("id"), F.lit(32))
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    ids = rows.groupBy("v", part.alias("part")).agg(F.collect_set("id").alias("ids"))
    ids = ids.select("v", "part", least("ids").alias("ids")).groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        paths.append(path)
        return out

    entries = keep(ids.select(F.array_min("ids").alias("entry"), "v", least("ids").alias("ids")), "entries")
    queries = keep(rows.where("q").select("id", "v").distinct(), "queries")
    n_index, n_query = entries.count(), queries.count()
    signs = rotations(_width(dims), tables)

    # entries that are longer than the bulk, in whole bands
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    band = F.floor(F.coalesce(F.log2(F.least(square, F.lit(1e308))), F.lit(-1100.0)) * BANDS + 0.5)
    taken, lowest = 0, None
    for r in entries.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("band")).collect():
        taken += r.n
        if taken * HEAD_SHARE > n_index or taken > min(HEAD, HEAD_BYTES // (8 * dims)):
            break
        lowest = r.band
    is_long = F.lit(False) if lowest is None else band >= lowest

    if probes is None:
        pick = lambda df, key, n: df.orderBy(F.xxhash64(key), key).limit(min(n, max(1, SAMPLE_BYTES // (8 * dims))))
        some = pick(entries.select("entry", "v", is_long.alias("long")), "entry", SAMPLE).collect()
        asked = pick(queries, "id", SAMPLE_QUERIES).collect()
        probes = fitted_probes(np.array([r.v for r in some]), np.array([r.v for r in asked]), np.array([r.long for r in some]), signs, k)

    def hashed(width: int) -> callable:
        """Rows of id and vector with the ``width`` axes nearest to it in each table."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    x = _matrix(piece.column(1), dims)
                    y = directions(x)
                    near = np.stack([axes(rotate(y, s), width) for s in signs], axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([piece.column(0), _raw(near), _raw(x)], names=["id", "axes", "raw"])

        return run

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All in one bucket of one table."""
        for batch in batches:
            zero = np.zeros((batch.num_rows, 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), _raw(zero), _raw(_matrix(batch.column(1), dims))], names=["id", "axes", "raw"])

    def meet(index: callable, probe: callable, asked: DataFrame, n_asked: int, n_tables: int, width: int) -> DataFrame:
        """query, entry and score of what is found among all entries, in parts of the entries and turns of the queries."""
        parts = max(1, -(-n_index // min(max(PART_ROWS, n_index // PARTS), max(1, PART_BYTES // (8 * dims)))))
        turns = max(1, -(-n_asked * (8 * dims + 4 * n_tables * width) // TURN_BYTES))
        kinds = "id long, axes binary, raw binary"
        left = entries.select("entry", "v").mapInArrow(released(index), kinds)
        left = left.select("*", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
        right = asked.select("id", "v").mapInArrow(released(probe), kinds)
        right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int").alias("turn"))

        def group(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(found) or not len(wanted):
                return pd.DataFrame({"query": pd.Series(dtype="int64"), "entry": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
            query, entry, score = bucket_search(
                _rows(found["raw"], np.float64, dims), _rows(found["axes"], np.int32, n_tables), _rows(wanted["raw"], np.float64, dims), _rows(wanted["axes"], np.int32, n_tables, width), k
            )
            return pd.DataFrame({"query": wanted["id"].to_numpy()[query], "entry": found["id"].to_numpy()[entry], "score": score})

        return left.groupBy("part", "turn").cogroup(right.groupBy("part", "turn")).applyInPandas(group, "query long, entry long, score double")

    def answers(met: DataFrame) -> DataFrame:
        met = met.groupBy("query", "entry").agg(F.max("score").alias("score"))
        by_score = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
        # an entry may hold the query alone, so k + 1 entries give k other rows
        met = met.withColumn("turn", F.row_number().over(by_score)).where(F.col("turn") <= k + 1)
        found = met.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return found.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")

    width = min(probes, 2 * signs.shape[2])
    met = meet(hashed(1), hashed(width), queries, n_query, tables, width)
    if lowest is not None:
        long = entries.where(is_long).select("entry", "v").collect()
        head = spark.sparkContext.broadcast((np.array([r.entry for r in long]), np.array([r.v for r in long])))

        def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    names, e = head.value
                    q, one = _matrix(batch.column(1), dims), np.zeros((batch.num_rows, 1, 1), dtype=np.int32)
                    query, entry, score = bucket_search(e, np.zeros((len(e), 1), dtype=np.int32), q, one, k)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(query)), pa.array(names[entry]), pa.array(score)], names=["query", "entry", "score"])

        met = met.unionByName(queries.mapInArrow(released(with_head), "query long, entry long, score double"))

    found, _ = stored(answers(met), "found")
    # those whose buckets held fewer than there are
    have = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("have"))
    short = keep(queries.join(have, "id", "left").where(F.coalesce("have", F.lit(0)) < min(k, others)).select("id", "v"), "short")
    n_short = short.count()
    if n_short:
        rest, _ = stored(answers(meet(whole, whole, short, n_short, 1, 1)), "rest")
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(found.columns).unionByName(rest)
        paths = [p for p in paths if "/short-" not in p]
    for path in paths:
        drop(spark, path)
    return found
