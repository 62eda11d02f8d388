"""Hard negatives by an orthogonal PCA rotation (operator 11).

Vectors become integers floor(scale * x).  For each anchor the ``positives`` rows of its label with the largest
integer inner products are found, and for each of those the best ``negatives`` rows of other labels whose product
lies between ``low`` and ``high`` percent of the positive's.

An orthogonal rotation keeps inner products and puts the directions of largest variance first.  The product of an
anchor and a row is that of their leading components, plus at most the product of the norms of what remains,
plus a slack for rounding.  So after a part of the components most pairs are out: they cannot reach the
anchor's least score so far, or its band.  What survives is decided by integer products, so the rotation (of
all rows, to double precision) only decides how early a pair is left.

Rows and anchors are dealt out in parts and turns of bounded bytes, and each pair of a part and a turn is one
group: every anchor meets every row in blocks, and an anchor brings at most ``negatives`` rows a band from
each part.  Equal vectors of a label are, within a part, their first few ids, which is all that can be returned under the
rule for ties.

Defined cases: null, empty and non-finite vectors, null labels and null ids take no part, nor do vectors
whose integers have a squared norm of 2^62 or more, as their scores need not fit a long; vectors of
different size never meet; rows that share an id are rows of their own; ties go to the smaller id; an anchor
without another row of its label, or a positive without a row in its band, gives no rows; a positive with a negative score
has an empty band; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stored
from .vectors import by_size, scaled
from .workers import released

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
LARGEST = 1 << 62  # of a squared norm
PARTS = 48  # parts of a small table, of at least PART_ROWS
PART_ROWS, PART_BYTES, TURN_BYTES = 2048, 32 << 20, 8 << 20
ANCHOR_BLOCK, ROW_BLOCK, PAIR_BLOCK = 256, 4096, 1 << 14
STAGES = 4  # in which the components are taken
SPARSE = 16  # a stage with a survivor in so many pairs or fewer goes to integer products

FOUND = "anchor long, band int, id long, score long"


def read_rows(vectors: DataFrame, is_anchor: Column, label: Column, key: str, vector: str, scale: float) -> DataFrame:
    """Rows that take part: at (a number of the row), id, label, anchor, dims and the integers as bytes."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null").withColumn("at", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, v in by_size(batch.column(3)):
                with np.errstate(over="ignore"):
                    y = np.floor(v * scale)
                    fits = (y * y).sum(axis=1) < LARGEST
                if fits.any():
                    x, kept = scaled(v[fits], scale), batch.take(pa.array(found[fits]))
                    x = x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x
                    dims = pa.array(np.full(len(x), x.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([kept.column(4), *kept.columns[:3], dims, pa.array([r.tobytes() for r in x], type=pa.binary())], names=["at", "id", "label", "anchor", "dims", "raw"])

    return rows.mapInArrow(released(run), "at long, id long, label long, anchor boolean, dims int, raw binary")


def integers(raw: pd.Series, dims: int) -> np.ndarray:
    """The integers of rows of 4 or 8 bytes a component."""
    out, short = np.empty((len(raw), dims), dtype=np.int64), raw.map(len).to_numpy() == 4 * dims
    for rows, kind in ((np.flatnonzero(short), np.int32), (np.flatnonzero(~short), np.int64)):
        out[rows] = np.frombuffer(b"".join(map(bytes, raw.iloc[rows])), dtype=kind).reshape(-1, dims)
    return out


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors (columns) of the covariance of all rows, largest variance first; d^2 numbers reach the driver."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dims + 2, dims))
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(0).to_pandas(), dims).astype(np.float64)
                sums[:dims] += x.T @ x
                sums[dims] += x.sum(axis=0)
                sums[dims + 1, 0] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["cell", "value"])

    got = rows.select("raw").mapInArrow(released(cells), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros((dims + 2) * dims)
    sums[got.column("cell").to_numpy()] = got.column("value").to_numpy()
    sums = sums.reshape(dims + 2, dims) / sums[(dims + 1) * dims]
    _, axes = np.linalg.eigh(sums[:dims] - np.outer(sums[dims], sums[dims]))
    return axes[:, ::-1]


class Side:
    """Rows in the rotated basis, with the norms of what remains after each stage."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, cuts: list[int]) -> None:
        self.x = x
        self.y = x.astype(np.float64) @ turn
        tails = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        self.rest = {c: np.sqrt(tails[:, c]) if c < x.shape[1] else np.zeros(len(x)) for c in cuts}
        self.norm = np.sqrt(tails[:, 0])


def slack(turn: np.ndarray) -> float:
    """Bound of the error of a rotated product, as a share of both norms: what the rotation lacks of being
    orthogonal, and rounding in the rotation, the products and the norms."""
    d = len(turn)
    return float(np.linalg.norm(turn.T @ turn - np.eye(d))) + 8 * (d**1.5 + d) * np.finfo(float).eps


class Bands:
    """The best ``k`` rows found for each anchor and band [floor, cap] of scores."""

    def __init__(self, floors: np.ndarray, caps: np.ndarray, k: int) -> None:
        self.k, self.floors, self.caps = k, floors, caps
        self.least = floors.astype(np.float64)  # a row below it is not among the best k
        self.held = [np.zeros(0, dtype=np.int64)] * 4  # query (anchor * bands + band), score, id, number of the row

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        bands = self.floors.shape[1]
        new = [self.held]
        for b in range(bands):
            ok = (scores >= self.floors[anchors, b]) & (scores <= self.caps[anchors, b]) & (scores >= self.least[anchors, b])
            new.append([anchors[ok] * bands + b, scores[ok], ids[ok], at[ok]])
        query, score, id_, row = (np.concatenate([n[i] for n in new]) for i in range(4))
        order = np.lexsort((row, id_, -score, query))
        first = np.searchsorted(query[order], query[order], side="left")
        order = order[np.arange(len(order)) - first < self.k]
        self.held = [c[order] for c in (query, score, id_, row)]
        full, n = np.unique(self.held[0], return_counts=True)
        last = np.cumsum(n)[n == self.k] - 1
        full = full[n == self.k]
        self.least.ravel()[full] = np.maximum(self.least.ravel()[full], self.held[1][last])


def compare(anchors: Side, own: np.ndarray, rows: Side, ids: np.ndarray, at: np.ndarray, barred: np.ndarray | None, bands: Bands, which: np.ndarray, cuts: list[int], share: float) -> None:
    """Put into ``bands`` what a block of rows holds for the anchors ``which``; ``own`` are the anchors' row numbers, ``barred`` pairs are out."""
    left, right = which, np.arange(len(rows.x))
    sum_, before = np.zeros((len(left), len(right))), 0
    floor, cap = bands.least[which].min(axis=1), bands.caps[which].max(axis=1).astype(np.float64)
    out = own[left][:, None] == at[None, :]
    if barred is not None:
        out |= barred
    for cut in cuts:
        sum_ += anchors.y[left, before:cut] @ rows.y[right, before:cut].T
        before = cut
        margin = np.multiply.outer(anchors.rest[cut][left], rows.rest[cut][right]) + share * np.multiply.outer(anchors.norm[left], rows.norm[right])
        alive = (sum_ + margin >= floor[:, None]) & (sum_ - margin <= cap[:, None]) & ~out
        n = int(np.count_nonzero(alive))
        if n * SPARSE <= alive.size:
            break
        a, b = alive.any(axis=1), alive.any(axis=0)
        if cut < cuts[-1] and (a.mean() < 0.5 or b.mean() < 0.5):
            left, right, sum_, out, floor, cap = left[a], right[b], sum_[np.ix_(a, b)], out[np.ix_(a, b)], floor[a], cap[a]
    if not n:
        return
    if n > 4 * bands.k * len(left) and before == cuts[-1] and len(right) > bands.k:
        # many rows may do: the k-th largest lower bound in a band is a score that k rows reach
        alive[:] = False
        for b in range(bands.floors.shape[1]):
            low, high = bands.least[left, b][:, None], bands.caps[left, b].astype(np.float64)[:, None]
            sure = (sum_ + margin <= high) & (sum_ - margin >= bands.floors[left, b].astype(np.float64)[:, None]) & ~out
            reached = np.partition(np.where(sure, sum_ - margin, -np.inf), len(right) - bands.k, axis=1)[:, len(right) - bands.k]
            bands.least[left, b] = np.maximum(bands.least[left, b], np.floor(reached))
            low = bands.least[left, b][:, None]
            alive |= (sum_ + margin >= low) & (sum_ - margin <= high) & ~out
    i, j = np.nonzero(alive)
    for s in range(0, len(i), PAIR_BLOCK):
        a, b = left[i[s : s + PAIR_BLOCK]], right[j[s : s + PAIR_BLOCK]]
        bands.add(a, np.einsum("ij,ij->i", anchors.x[a], rows.x[b]), ids[b], at[b])


def first_of_equal(x: np.ndarray, label: np.ndarray, id_: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the first ``k`` by id of those with the same label and vector."""
    odd = np.random.default_rng(7).integers(1 << 62, size=x.shape[1] + 1) * 2 + 1
    with np.errstate(over="ignore"):
        hashed = x @ odd[1:] + label * odd[0]
    order = np.lexsort((at, id_, label, hashed))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (hashed[order[1:]] == hashed[order[:-1]]) & (label[order[1:]] == label[order[:-1]])
    pairs = np.flatnonzero(same)
    for s in range(0, len(pairs), PAIR_BLOCK):
        p = pairs[s : s + PAIR_BLOCK]
        same[p] = (x[order[p]] == x[order[p - 1]]).all(axis=1)
    begins = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return np.sort(order[np.arange(len(order)) - begins < k])


def search(entries: pd.DataFrame, queries: pd.DataFrame, dims: int, turn: np.ndarray, share: float, k: int, same: bool) -> pd.DataFrame:
    """The best ``k`` entries for each query and band, of the query's label or of all others."""
    empty = pd.DataFrame({c.split(" ")[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})
    if not len(entries) or not len(queries):
        return empty
    cuts = sorted({max(1, dims * (s + 1) // STAGES) for s in range(STAGES)})
    x, label, ids, at = integers(entries["raw"], dims), *(entries[c].to_numpy() for c in ("label", "id", "at"))
    kept = first_of_equal(x, label, ids, at, k + 1)
    kept = kept[np.argsort(label[kept], kind="stable")]
    x, label, ids, at = x[kept], label[kept], ids[kept], at[kept]
    queries = queries.sort_values("own_label", kind="stable")
    own, own_label = queries["own_at"].to_numpy(), queries["own_label"].to_numpy()
    anchors = Side(integers(queries["own_raw"], dims), turn, cuts)
    width = max(map(len, queries["floors"]))
    floors, caps = np.full((len(own), width), LARGEST), np.full((len(own), width), -LARGEST)  # no score is in such a band
    for i, (f, c) in enumerate(zip(queries["floors"], queries["caps"], strict=True)):
        floors[i, : len(f)], caps[i, : len(c)] = f, c
    bands = Bands(floors, caps, k)
    # both are in order of label: a label's anchors meet its rows alone, or all anchors all rows
    names = np.unique(own_label) if same else [None]
    edges = [(*np.searchsorted(own_label, [n, n + 1]), *np.searchsorted(label, [n, n + 1])) if same else (0, len(own), 0, len(x)) for n in names]
    for first, last, begin, end in edges:
        for s in range(begin, end, ROW_BLOCK):
            part = slice(s, min(s + ROW_BLOCK, end))
            rows = Side(x[part], turn, cuts)
            for a in range(first, last, ANCHOR_BLOCK):
                which = np.arange(a, min(a + ANCHOR_BLOCK, last))
                barred = None if same else own_label[which][:, None] == label[part][None, :]
                compare(anchors, own, rows, ids[part], at[part], barred, bands, which, cuts, share)
    query, score, id_, _ = bands.held
    return pd.DataFrame({"anchor": own[query // width], "band": query % width, "id": id_, "score": score})


def _meet(rows: DataFrame, queries: DataFrame, dims: int, parts: int, turns: int, turn: np.ndarray, k: int, same: bool) -> DataFrame:
    """``search`` over all parts of the rows and turns of the queries."""
    share = slack(turn)
    index = rows.select("at", "id", "label", "raw", F.pmod(F.xxhash64("at"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    asked = [F.col(c).alias(f"own_{c}") for c in ("at", "label", "raw")]  # both sides come from one table: no column may be the same
    probe = queries.select(*asked, "floors", "caps", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("at"), F.lit(turns)).cast("int").alias("turn"))

    def group(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return search(entries, asked, dims, turn, share, k, same)

    return index.groupBy("part", "turn").cogroup(probe.groupBy("part", "turn")).applyInPandas(group, FOUND)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding",
    scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows that ``is_anchor`` picks."""
    spark = vectors.sparkSession
    items, path = stored(read_rows(vectors, is_anchor, label, key, vector, scale), "items")
    sizes = items.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors")).where("anchors > 0").collect()
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for r in sizes:
        out = out.unionByName(_mine(items.where(F.col("dims") == r.dims), r.dims, r.n, r.anchors, positives, negatives, low, high))
    drop(spark, path)
    return out


def _mine(rows: DataFrame, dims: int, n: int, n_anchors: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The same for items of one size, stored."""
    spark = rows.sparkSession
    turn = rotation(rows, dims)
    parts = max(1, -(-n // min(max(PART_ROWS, n // PARTS), max(1, PART_BYTES // (8 * dims)))))
    turns = max(1, -(-n_anchors * 8 * dims // TURN_BYTES))
    anchors = rows.where("anchor")

    everything = anchors.withColumn("floors", F.array(F.lit(-LARGEST))).withColumn("caps", F.array(F.lit(LARGEST)))
    found = _meet(rows, everything, dims, parts, turns, turn, positives, True)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = found.select("anchor", "id", "score", F.row_number().over(best).alias("turn")).where(F.col("turn") <= positives)
    # low * score / 100, rounded up, and high * score / 100, rounded down, without overflow
    rest, whole = F.pmod("score", F.lit(100)), F.expr("(score - pmod(score, 100)) div 100")
    share = {"floor": whole * low + F.ceil(rest * low / 100).cast("long"), "cap": whole * high + F.floor(rest * high / 100).cast("long")}
    pairs, pairs_path = stored(found.select("anchor", F.col("turn").alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), *[c.alias(name) for name, c in share.items()]), "positives")

    asked = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("band", "floor", "cap"))).alias("asked"))
    asked = anchors.join(asked, anchors["at"] == asked["anchor"]).select("at", "label", "raw", F.col("asked.floor").alias("floors"), F.col("asked.cap").alias("caps"))
    found = _meet(rows, asked, dims, parts, turns, turn, negatives, False)
    best = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    found = found.select("anchor", (F.col("band") + 1).alias("band"), "id", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= negatives)
    ids = anchors.select(F.col("at").alias("anchor"), F.col("id").alias("anchor_id"))
    found = found.join(pairs, ["anchor", "band"]).join(ids, "anchor")
    out, _ = stored(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    drop(spark, pairs_path)
    return out


def embedding_negatives(vectors: DataFrame) -> DataFrame:
    """The registered search: anchors are the ids divisible by 100; rows of ids divisible by 7 get the next label."""
    key = F.col("vec_id").cast("long")
    label = F.col("label").cast("long")
    label = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(vectors, key % 100 == 0, label)
