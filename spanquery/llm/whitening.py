"""Whitening by an exact scatter in residues (operator 13).

Each component c becomes the long x = floor(scale * c) + offset.  Every task reduces its rows modulo several primes
below 2^20 and multiplies them there: residues in (-p/2, p/2) keep a product of 2^14 rows below 2^53, so that
a double matrix product is exact.  Spark adds up the residues, and Chinese remaindering gives sums and
scatter as exact integers, with as many primes as count and largest entry ask for.  n * scatter - sums * sums' is the
covariance times n^2, again exact, and is rounded once to double for ``eigh``.

The driver holds matrices of the vectors' size squared, never rows.  The rows are read three more times
(scatter, check, result) and never shuffled.

Defined cases: null and empty vectors, and vectors with null or non-finite components or with an x beyond
2^62, take no part; vectors of different size are whitened apart, each size by its own fit; null and repeated
ids are rows like others; a component without variance (to double precision) cannot be whitened and is left
out, so that equal vectors or a single one give no rows; equal eigenvalues leave the choice of their
components open, but it is one choice for all rows; other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import by_size, scaled
from .workers import released

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
BLOCK = 1 << 14  # rows of a product: 2^14 * 2^19 * 2^19 < 2^53
LONGEST = 1 << 62


def primes(bound: int) -> list[int]:
    """The largest primes below 2^20 whose product exceeds twice the bound."""
    out, product, p = [], 1, (1 << 20) - 1
    while product <= 2 * bound:
        if all(p % q for q in range(3, 1 << 10, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p in (-p/2, p/2), as doubles."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def scatter_residues(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and x'x modulo p."""
    total, scatter = np.zeros(x.shape[1], dtype=np.int64), np.zeros((x.shape[1],) * 2, dtype=np.int64)
    for at in range(0, len(x), BLOCK):
        r = residues(x[at : at + BLOCK], p)
        total = (total + r.sum(axis=0).astype(np.int64)) % p
        scatter = (scatter + (r.T @ r).astype(np.int64)) % p
    return total, scatter


def remainders(found: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The integers of least size with these residues (a row for each prime), as Python integers."""
    product = int(np.prod(np.array(moduli, dtype=object)))
    out = np.zeros(found.shape[1], dtype=object)
    for r, p in zip(found, moduli, strict=True):
        rest = product // p
        out = (out + r.astype(object) % p * (rest * pow(rest, -1, p))) % product
    return np.where(out > product // 2, out - product, out)


@dataclass
class Fit:
    """n, the exact sums, the components (columns) over the root of their eigenvalues, and the share that each explains."""

    n: int
    sums: np.ndarray
    maps: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs, or Python integers where those could overflow."""
        if 2 * self.n * max(1, int(np.abs(x).max(initial=0)), -(-max(map(abs, self.sums), default=0) // self.n)) < LONGEST:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.maps


def squares(d: np.ndarray) -> np.ndarray:
    """Sum of the squares of each row, exact: longs, or Python integers where those could overflow."""
    if d.dtype == object:
        return (d * d).sum(axis=1)
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < LONGEST:
        return (d * d).sum(axis=1)
    limbs = [d >> 42, (d >> 21) & 0x1FFFFF, d & 0x1FFFFF]
    out = np.zeros(len(d), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a * b).sum(axis=1).astype(object) << (21 * (4 - i - j))
    return out


def _matrices(batch: pa.RecordBatch, scale: float, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and x of the vectors that take part, by size."""
    for rows, v in by_size(batch.column(1)):
        fits = np.abs(v).max(axis=1) < (LONGEST - offset) / scale
        if fits.any():
            yield rows[fits], scaled(v[fits], scale, offset)


def fit(rows: DataFrame, scale: float = SCALE, offset: int = OFFSET, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each size of the vectors (column v of id and v)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = defaultdict(int), defaultdict(int)
        for batch in batches:
            for found, x in _matrices(batch, scale, offset):
                n[x.shape[1]] += len(found)
                most[x.shape[1]] = max(most[x.shape[1]], int(np.abs(x).max()))
        yield pa.RecordBatch.from_pydict({"dims": pa.array(list(n), pa.int32()), "n": pa.array(list(n.values()), pa.int64()), "most": pa.array([most[d] for d in n], pa.int64())})

    known = {r.dims: r for r in rows.mapInArrow(released(sizes), "dims int, n long, most long").groupBy("dims").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect()}
    moduli = {d: primes(r.n * max(1, r.most) ** 2) for d, r in known.items()}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for _, x in _matrices(batch, scale, offset):
                for p in moduli[x.shape[1]]:
                    new = scatter_residues(x, p)
                    old = held.get((x.shape[1], p))
                    held[x.shape[1], p] = [(a + b) % p for a, b in zip(old, new, strict=True)] if old else list(new)
        for (dims, p), (total, scatter) in held.items():
            values = np.concatenate([total, scatter[np.triu_indices(dims)]])
            kind = [pa.array(np.full(len(values), v, dtype=np.int32)) for v in (dims, p)]
            yield pa.RecordBatch.from_arrays([*kind, pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["dims", "prime", "cell", "value"])

    added = rows.mapInArrow(released(cells), "dims int, prime int, cell int, value long").groupBy("dims", "prime", "cell").agg(F.sum("value").alias("value")).toArrow()
    dims, prime, cell, value = (added.column(c).to_numpy() for c in ("dims", "prime", "cell", "value"))
    out = {}
    for d, r in known.items():
        found = np.zeros((len(moduli[d]), d + d * (d + 1) // 2), dtype=np.int64)
        for i, p in enumerate(moduli[d]):
            own = (dims == d) & (prime == p)
            found[i, cell[own]] = value[own]
        exact = remainders(found, moduli[d])
        sums, scatter = exact[:d], np.zeros((d, d), dtype=object)
        upper = np.triu_indices(d)
        scatter[upper] = exact[d:]
        scatter.T[upper] = exact[d:]
        spread = r.n * scatter - np.multiply.outer(sums, sums)  # n^2 times the covariance
        trace = sum(spread[i, i] for i in range(d)) / r.n**2
        values, axes = np.linalg.eigh((spread / r.n**2).astype(np.float64))
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > values.max() * d * np.finfo(float).eps * 4] if trace else order[:0]
        out[d] = Fit(r.n, sums, axes[:, order] / np.sqrt(values[order]), values[order] / trace if trace else values[:0])
    return out


def identity_errors(rows: DataFrame, fits: dict[int, Fit], scale: float = SCALE, offset: int = OFFSET) -> dict[int, float]:
    """Largest absolute entry of the covariance of what is whitened minus the identity, over all rows, for each size."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch, scale, offset):
                w = fits[x.shape[1]].whitened(fits[x.shape[1]].centred(x))
                held[x.shape[1]] = held.get(x.shape[1], 0) + np.vstack([w.sum(axis=0), w.T @ w])
        for dims, sums in held.items():
            flat = sums.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dims, dtype=np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["dims", "cell", "value"])

    out = {}
    added = rows.mapInArrow(released(cells), "dims int, cell int, value double").groupBy("dims", "cell").agg(F.sum("value").alias("value")).collect()
    for d, f in fits.items():
        k = f.maps.shape[1]
        sums = np.zeros((k + 1) * k)
        for r in added:
            if r.dims == d:
                sums[r.cell] = r.value
        mean, product = sums[:k] / f.n, sums[k:].reshape(k, k) / f.n
        out[d] = float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE, offset: int = OFFSET, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (exact, null beyond 38 digits), whitened, explained and
    identity_error of each vector and leading component."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fits = fit(rows, scale, offset, components)
    errors = identity_errors(rows, fits, scale, offset)

    def exact(values: np.ndarray) -> pa.Array:
        if values.dtype != object:
            return pa.array(values).cast(pa.decimal128(38, 0))
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in values], type=pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, x in _matrices(batch, scale, offset):
                f, error = fits[x.shape[1]], errors[x.shape[1]]
                k = f.maps.shape[1]
                d = f.centred(x)
                rows = np.repeat(np.arange(len(found)), k)
                columns = [batch.column(0).take(pa.array(found[rows])), np.tile(np.arange(1, k + 1, dtype=np.int32), len(found)), np.full(len(rows), f.n), exact(squares(d)).take(pa.array(rows))]
                columns += [f.whitened(d).ravel(), np.tile(f.explained, len(found)), np.full(len(rows), error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(released(run), "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whitened_rows(vectors: DataFrame) -> DataFrame:
    """``whiten`` with the deviation as a long (null where it does not fit)."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
