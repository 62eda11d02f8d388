"""Toxicity scoring by a factorization machine over hashed terms (operator 2).

Terms are the distinct words of a text and the prefixes of their words, hashed into
``2**bits`` buckets.  The machine

    s(x) = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

learns pairwise interactions next to linear weights.  It is fitted on the driver from at most
``max_fit_rows`` labelled rows (those of smallest ``xxhash64(doc_id)``), of which only hashed
terms are fetched, and restricted to the ``max_terms`` terms whose class difference among them is
most significant and to those that matter in pairs (``paired_terms``); everything else runs over
all rows in one pass without a shuffle.

Defined cases: a null or empty text has no terms and gets the score of the bias alone; labels
other than 0 and 1, null labels and labels without document are not learned from; several
labels of one document count as several rows, as do rows that share a doc_id (each is learned
from and scored by itself; of a key at the bound as many rows are learned from as are left); a very
long text is one set of terms, taken whole; without any label of one class the score is the
share of label 1 among the rows learned from, or 0 without rows; an empty table gives an empty
result; an input column named as the new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import list_array, map_text
from .sampling import first_keys, remainder
from .textkit import _WORD_VALUES, distinct_per_row, lowered, span_hashes, word_spans
from .workers import release, settle

PREFIXES = (4, 5, 6)
MAX_FIT_ROWS = 20_000
BLOCK_ROWS = 1024  # of the fit, looked at together
PAIR_TERMS, PAIR_Z, MAX_PAIRED = 1024, 12.0, 256  # half a million pairs are looked at


def terms(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each row: (bucket, row), ordered by row."""
    starts, ends, bounds = word_spans(data, offsets)
    values = _WORD_VALUES[lowered(data)]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    found, rows = [span_hashes(values, starts, ends)], [owner]
    for width in PREFIXES:
        long = ends - starts > width
        # another salt than that of whole words of the same bytes
        found.append(span_hashes(values, starts[long], starts[long] + width) * np.uint64(0x9E3779B97F4A7C15))
        rows.append(owner[long])
    buckets = np.concatenate(found) >> np.uint64(64 - bits)
    return distinct_per_row(buckets, np.concatenate(rows))


@dataclass(frozen=True)
class FactorizationMachine:
    """A fitted machine; ``terms`` are the sorted buckets that have weights."""

    bits: int
    bias: float
    terms: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, buckets: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for rows 0..n-1."""
        s = np.full(n, self.bias)
        if len(self.terms) and len(buckets):
            at = np.minimum(np.searchsorted(self.terms, buckets), len(self.terms) - 1)
            hit = self.terms[at] == buckets
            at, rows = at[hit], rows[hit]
            s += np.bincount(rows, self.linear[at], minlength=n)
            for f in range(self.factors.shape[1]):
                v = self.factors[at, f]
                s += 0.5 * (np.bincount(rows, v, minlength=n) ** 2 - np.bincount(rows, v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _blocks(bounds: np.ndarray) -> Iterator[tuple[int, int, slice, np.ndarray]]:
    """First row and end of each block of rows, where its terms are, and how many each row has: what is made
    of terms beside the terms themselves is of one block."""
    n = len(bounds) - 1
    for at in range(0, n, BLOCK_ROWS):
        to = min(at + BLOCK_ROWS, n)
        yield at, to, slice(bounds[at], bounds[to]), np.diff(bounds[at : to + 1])


def _occurrences(flat: np.ndarray, bounds: np.ndarray, labels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms that occur in three rows or more, in how many, and in how many of label 1."""
    seen, positive = np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
    for at, to, where, sizes in _blocks(bounds):
        block = flat[where]
        seen += np.bincount(block, minlength=1 << bits)
        positive += np.bincount(block[np.repeat(labels[at:to] > 0, sizes)], minlength=1 << bits)
    known = np.flatnonzero(seen >= 3)
    return known, seen[known].astype(np.float64), positive[known]


def _only(flat: np.ndarray, bounds: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``where`` of the terms that have one, and where each row's begin and the last end."""
    parts, counts = [np.zeros(0, dtype=where.dtype)], [np.zeros(1, dtype=np.int64)]
    for at, to, inside, sizes in _blocks(bounds):
        term = where[flat[inside]]
        hit = term >= 0
        parts.append(term[hit])
        counts.append(np.bincount(np.repeat(np.arange(to - at), sizes)[hit], minlength=to - at))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def paired_terms(
    flat: np.ndarray, bounds: np.ndarray, labels: np.ndarray, known: np.ndarray, seen: np.ndarray, bits: int, candidates: int = PAIR_TERMS, min_z: float = PAIR_Z
) -> np.ndarray:
    """Terms that tell labels apart only together with another: those of pairs, among the ``candidates`` terms
    of most variance, whose joint rows depart from what the two terms' own shares of label 1 let expect."""
    n, share = len(labels), float(labels.mean())
    variance = seen * (n - seen)
    few = np.flatnonzero(seen <= n - 3)
    few = np.sort(known[few[np.lexsort((few, -variance[few]))[:candidates]]])
    where = np.full(1 << bits, -1, dtype=np.int16)
    where[few] = np.arange(len(few))
    m = len(few)
    both, positive = np.zeros((m, m), dtype=np.float32), np.zeros((m, m), dtype=np.float32)
    for at, to, inside, sizes in _blocks(bounds):
        term = where[flat[inside]]
        hit = term >= 0
        x = np.zeros((to - at, m), dtype=np.float32)
        x[np.repeat(np.arange(to - at), sizes)[hit], term[hit]] = 1
        both += x.T @ x
        positive += x.T @ (x * labels[at:to, None].astype(np.float32))
    alone = np.diag(positive) / np.maximum(np.diag(both), 1)
    # log odds of two terms add up where they act apart
    odds = np.log(np.clip(alone, 1e-3, 1 - 1e-3) / (1 - np.clip(alone, 1e-3, 1 - 1e-3)))
    expected = 1 / (1 + np.exp(-(odds[:, None] + odds[None, :] - np.log(share / (1 - share)))))
    z = np.abs(positive - both * expected) / np.sqrt(both * expected * (1 - expected) + 0.5)
    # a term is no pair with itself, nor with one that nearly always comes along
    least = np.minimum(np.diag(both)[:, None], np.diag(both)[None, :])
    z[(both < 5) | (both > 0.9 * least)] = 0
    best = z.max(axis=1, initial=0)
    order = np.lexsort((few, -best))
    return few[order[best[order] >= min_z]]


def fit_rows(
    bits: int,
    rows: list[np.ndarray] | tuple[np.ndarray, np.ndarray],
    labels: np.ndarray,
    max_terms: int = 8192,
    min_z: float = 3.0,
    rank: int = 4,
    epochs: int = 12,
    batch: int = 256,
    rate: float = 0.05,
    decay: float = 1e-4,
    seed: int = 7,
) -> FactorizationMachine:
    """Fit by mini-batch Adam on the log loss; deterministic for given rows in given order.  ``rows``: the
    terms of each row, or all of them with the place where each row's begin and the last end."""
    n = len(labels)
    none = np.zeros(0, dtype=np.uint64)
    share = float(labels.mean()) if n else 0.0
    if not 0 < share < 1:
        return FactorizationMachine(bits, 40.0 if share else -40.0, none, np.zeros(0), np.zeros((0, rank)))
    flat, bounds = rows if isinstance(rows, tuple) else (np.concatenate(rows).astype(np.int32, copy=False), np.cumsum([0, *map(len, rows)]))
    # tables of all buckets are large: what is kept is of the terms that occur at least three times
    known, seen, positive = _occurrences(flat, bounds, labels, bits)
    expected = seen * share
    z = np.abs(positive - expected) / np.sqrt(expected * (1 - share) + 0.5)
    picked = np.flatnonzero(z >= min_z)
    picked = picked[np.lexsort((picked, -z[picked]))[:max_terms]]
    chosen = np.union1d(known[picked], paired_terms(flat, bounds, labels, known, seen, bits)[:MAX_PAIRED]).astype(np.int64)
    where = np.full(1 << bits, -1, dtype=np.int32)
    where[chosen] = np.arange(len(chosen))
    term, bounds = _only(flat, bounds, where)
    del where
    rng = np.random.default_rng(seed)
    m = len(chosen)
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(m), rng.normal(0, 0.01, (m, rank))]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            sizes = bounds[pick + 1] - bounds[pick]
            local = np.repeat(np.arange(len(pick)), sizes)
            index = term[np.repeat(bounds[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            k = len(pick)
            v = theta[2][index]
            sums = np.stack([np.bincount(local, v[:, f], minlength=k) for f in range(rank)], axis=1)
            squares = np.bincount(local, (v * v).sum(axis=1), minlength=k)
            s = theta[0][0] + np.bincount(local, theta[1][index], minlength=k) + 0.5 * ((sums**2).sum(axis=1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - labels[pick]) / k
            per = slope[local]
            gradient = [
                np.array([slope.sum()]),
                np.bincount(index, per, minlength=m) + decay * theta[1],
                np.stack([np.bincount(index, per * (sums[local, f] - v[:, f]), minlength=m) for f in range(rank)], axis=1) + decay * theta[2],
            ]
            step += 1
            for x, g, a, b in zip(theta, gradient, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(bits, float(theta[0][0]), chosen.astype(np.uint64), theta[1], theta[2])


def in_order(lists: list[pa.ListArray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all rows in the order given, and where each row's begin and the last end; the lists are
    taken out one by one, so that each can go when it has been copied."""
    sizes = np.concatenate([np.zeros(0, dtype=np.int64), *(np.diff(part.offsets.to_numpy()) for part in lists)])
    bounds = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
    to = np.empty(len(order), dtype=np.int64)
    to[order] = bounds[:-1]
    flat, row = np.empty(bounds[-1], dtype=np.int32), 0
    while lists:
        part = lists.pop(0)
        values, offsets = part.values.to_numpy(), part.offsets.to_numpy()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            flat[to[row] : to[row] + b - a] = values[a:b]
            row += 1
    return flat, bounds


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    learn: Column | None = None,
    bits: int = 22,
    max_fit_rows: int = MAX_FIT_ROWS,
) -> FactorizationMachine:
    """Fit on labelled documents for which ``learn`` (a condition on ``key``) holds."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).where(F.lit(True) if learn is None else learn)
    # which rows to learn from is settled on the keys alone; the texts then come by a join
    whole, last, taken = first_keys(rows.select("k").join(known, "k"), max_fit_rows)
    # both sides of this join are bounded: max_fit_rows keys, and fewer labels than rows learned from
    sample = rows.join(F.broadcast(known.join(F.broadcast(whole), "k")), "k").select("k", "y", "text")
    if last is not None:
        cut = rows.where(F.col("k") == F.lit(last)).join(known.where(F.col("k") == F.lit(last)), "k").select("k", "y", "text")
        sample = sample.unionByName(cut.orderBy(F.xxhash64("text"), "y").limit(taken))
    sample = sample.withColumn("print", F.xxhash64("text"))

    def start():
        def chunk(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            buckets, owner = terms(data, offsets, bits)
            return [list_array(buckets.astype(np.int32), np.searchsorted(owner, np.arange(len(offsets))), pa.int32())]

        return chunk

    settle()
    got = map_text(sample, "text", start, [T.StructField("terms", T.ArrayType(T.IntegerType(), False), False)], keep=["k", "y", "print"]).toArrow()
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort((got["print"].to_numpy(), y, got["k"].to_numpy()))
    lists = got["terms"].chunks
    del got
    rows = in_order(lists, order)
    release()
    model = fit_rows(bits, rows, y[order])
    release()
    return model


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Append the probability of label 1 for every row; the model has a few hundred KB at most."""

    def start():
        def chunk(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            buckets, rows = terms(data, offsets, model.bits)
            return [pa.array(model.scores(buckets, rows, len(offsets) - 1))]

        return chunk

    return map_text(docs, text, start, [T.StructField(out, T.DoubleType(), False)], keep)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents; fold 0 of 5 is held out."""
    model = fit(docs, labels, learn=remainder("k", 5) != 0)
    scored = score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
