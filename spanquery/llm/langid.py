"""Language identification by error-correcting output codes (operator 3).

Each language has a codeword of ``bits`` signs.  One linear classifier a bit, over hashed byte
2- and 3-grams of the lower-cased text, predicts whether the text's language has that bit set.
Every fifth row of a language is kept out of the fit and tells how often each bit is right about
that language; the codeword of least loss decides, each bit's loss weighted by the log odds of
that.  A text whose second-best codeword is within ``margin`` of the best is flagged as ambiguous.
Up to six languages get the exhaustive code of 2^(k-1)-1 bits, more get pseudo-random balanced columns.

The classifiers are fitted on the driver from at most ``max_fit_rows`` rows (those of smallest
``xxhash64(doc_id)``), of which only the n-gram counts that are not zero are fetched and kept; scoring is one
pass without a shuffle and without any other input than the text.

Defined cases: null, empty and letterless texts get ``und`` with score 0; nothing learned means
``und`` for all; one language learned means that language with score 1; null languages are not
learned from, any other value is a language, the empty string included; rows that share a doc_id
are learned from and told one by one; a very long text is counted whole; an empty table gives an
empty result; an input column named as a new one is replaced.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import map_text
from .sampling import first_keys, remainder
from .textkit import lowered
from .workers import release, settle

BINS = 4096
MAX_FIT_ROWS = 5_000
MARGIN = 0.05
KEEP_OUT = 5


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams: one row of ``BINS`` a text."""
    n = len(offsets) - 1
    low = lowered(data).astype(np.uint32)
    out = np.zeros(n * BINS, dtype=np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    for width, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        m = len(low) - width + 1
        if m <= 0:
            continue
        code = np.full(m, width, dtype=np.uint32)
        for j in range(width):
            code = code << np.uint32(8) | low[j : j + m]
        inside = owner[:m] == owner[width - 1 :]
        bin_ = (code * np.uint32(factor)) >> np.uint32(20)
        out += np.bincount((owner[:m] * BINS + bin_)[inside], minlength=n * BINS)
    return out.reshape(n, BINS)


def features(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(counts / total, dtype=np.float32, casting="unsafe")


def packed(counts: np.ndarray) -> bytes:
    """The bins of a row that are not zero, two bytes each, and then their counts, four bytes each."""
    bins = np.flatnonzero(counts)
    return bins.astype("<u2").tobytes() + counts[bins].astype("<u4").tobytes()


class PackedRows:
    """Features of rows of ``packed`` counts, kept as those that are not zero; an index gives dense rows."""

    def __init__(self, bins: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.bins, self.values, self.starts, self.ends = bins, values, starts, ends
        self.shape = (len(starts), BINS)

    @classmethod
    def read(cls, column: pa.ChunkedArray, order: np.ndarray) -> PackedRows:
        ends = np.cumsum([column[i].as_buffer().size // 6 for i in order])
        starts = np.concatenate([[0], ends[:-1]])
        bins, values = np.empty(ends[-1], dtype=np.uint16), np.empty(ends[-1], dtype=np.float32)
        for i, a, b in zip(order, starts, ends, strict=True):
            raw = column[i].as_buffer().to_pybytes()
            bins[a:b] = np.frombuffer(raw, dtype="<u2", count=b - a)
            values[a:b] = features(np.frombuffer(raw[2 * (b - a) :], dtype="<u4")[None])[0]
        return cls(bins, values, starts, ends)

    def __len__(self) -> int:
        return len(self.starts)

    def part(self, pick: np.ndarray) -> PackedRows:
        return PackedRows(self.bins, self.values, self.starts[pick], self.ends[pick])

    def __getitem__(self, pick: np.ndarray) -> np.ndarray:
        starts, ends = self.starts[pick], self.ends[pick]
        out = np.zeros((len(starts), BINS), dtype=np.float32)
        for row, a, b in zip(out, starts, ends, strict=True):
            row[self.bins[a:b]] = self.values[a:b]
        return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = data | 0x20
    letter = (low >= 97) & (low <= 122) & (data < 128)
    count = np.concatenate([[0], np.cumsum(letter)])
    out = count[offsets[1:]] > count[offsets[:-1]]
    doubtful = np.flatnonzero(~out & (np.diff(offsets) > 0))
    if len(doubtful):
        import regex

        find = regex.compile(r"\p{L}").search
        for i in doubtful:
            out[i] = find(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) is not None
    return out


def code_matrix(k: int) -> np.ndarray:
    """Codewords of k languages as rows of -1 and 1; rows differ, columns split the languages."""
    if k < 2:
        return np.ones((k, 0), dtype=np.int8)
    if k <= 6:
        columns = [(1, *rest) for rest in itertools.product((-1, 1), repeat=k - 1) if -1 in rest]
        return np.array(columns, dtype=np.int8).T
    rng = np.random.default_rng(k)
    bits = max(31, 10 * int(np.ceil(np.log2(k))))
    while True:
        columns = [np.where(rng.permutation(k) < k // 2, 1, -1) for _ in range(bits)]
        out = np.array(columns, dtype=np.int8).T
        if len(np.unique(out, axis=0)) == k:
            return out


@dataclass(frozen=True)
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share (0 to 1), and its lead over the next."""
        n, k = len(x), len(self.languages)
        if k == 1:
            return np.zeros(n, dtype=int), np.ones(n), np.full(n, np.inf)
        f = x @ self.weights + self.bias
        loss = np.empty((n, k))
        for c in range(k):
            loss[:, c] = np.logaddexp(0, -f * self.code[c]) @ self.trust[c]
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        lead = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss[np.arange(n), best]
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 4)
        return best, 1 / share.sum(axis=1), lead


def _classifiers(x: np.ndarray | PackedRows, y: np.ndarray, code: np.ndarray, epochs: int, batch: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic classifier a bit, all bits at once, by mini-batch Adam; languages count alike."""
    k, bits = code.shape
    w, b = np.zeros((x.shape[1], bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
    target = code[y].astype(np.float32)
    share = np.maximum(np.bincount(y, minlength=k), 1)
    weight = (len(y) / (k * share))[y].astype(np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    rng, step = np.random.default_rng(11), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            rows, t = x[pick], target[pick]
            slope = -t / (1 + np.exp(np.clip((rows @ w + b) * t, -40, 40))) * weight[pick, None] / len(pick)
            step += 1
            for p, g, m, v in ((w, rows.T @ slope + 1e-5 * w, *state[:2]), (b, slope.sum(axis=0), *state[2:])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, b


def loss_weights(right: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Weight of each bit's loss for each language: the log odds, smoothed, that the bit's classifier is
    right about that language, from rows it was not fitted on; no bit counts against itself."""
    hits = np.stack([right[y == c].sum(axis=0) for c in range(k)])
    rows = np.bincount(y, minlength=k)[:, None]
    odds = np.maximum(np.log((hits + 1) / (rows - hits + 1)), 0.05)
    return odds / odds.sum(axis=1, keepdims=True)


def fit_rows(x: np.ndarray | PackedRows, languages: list[str], epochs: int = 25, batch: int = 128, rate: float = 0.03) -> CodeModel | None:
    """Fit the classifiers on all rows but every ``KEEP_OUT``-th of each language, which tell how far each
    bit is to be trusted about each language."""
    if not len(languages):
        return None
    names = sorted(set(languages))
    y = np.searchsorted(names, languages)
    code = code_matrix(len(names))
    bits = code.shape[1]
    if not bits:
        return CodeModel(names, code, np.zeros((x.shape[1], 0), dtype=np.float32), np.zeros(0, dtype=np.float32), np.ones((1, 0)))
    turn = np.empty(len(y), dtype=np.int64)
    for c in range(len(names)):
        turn[y == c] = np.arange((y == c).sum())
    kept = turn % KEEP_OUT == KEEP_OUT - 1
    fitted = x.part(~kept) if isinstance(x, PackedRows) else x[~kept]
    w, b = _classifiers(fitted, y[~kept], code, epochs, batch, rate)
    right = ((x[kept] @ w + b) * code[y[kept]] > 0).astype(float)
    return CodeModel(names, code, w, b, loss_weights(right, y[kept], len(names)))


def fit(
    docs: DataFrame,
    label: str = "lang",
    key: str = "doc_id",
    text: str = "text",
    learn: Column | None = None,
    max_fit_rows: int = MAX_FIT_ROWS,
) -> CodeModel | None:
    """Fit on documents with a language for which ``learn`` (a condition on ``k``, the key) holds."""
    rows = docs.select(F.col(key).alias("k"), F.col(label).alias("lang"), F.col(text).alias("text"))
    rows = rows.where("k is not null and lang is not null").where(F.lit(True) if learn is None else learn)
    whole, last, taken = first_keys(rows, max_fit_rows)
    sample = rows.join(F.broadcast(whole), "k").select("k", "lang", "text")  # at most max_fit_rows keys
    if last is not None:
        cut = rows.where(F.col("k") == F.lit(last)).select("k", "lang", "text")
        sample = sample.unionByName(cut.orderBy("lang", F.xxhash64("text")).limit(taken))

    def start():
        def chunk(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            out = []
            for at in range(0, len(offsets) - 1, 64):
                part = offsets[at : at + 65]
                out += [packed(row) for row in gram_counts(data[part[0] : part[-1]], part - part[0])]
            return [pa.array(out, type=pa.binary())]

        return chunk

    settle()
    got = map_text(sample, "text", start, [T.StructField("counts", T.BinaryType(), False)], keep=["k", "lang"]).toArrow()
    if not got.num_rows:
        return None
    order = pc.sort_indices(got, sort_keys=[(c, "ascending") for c in ("k", "lang", "counts")]).to_pylist()
    names = got["lang"].take(order).to_pylist()
    x = PackedRows.read(got["counts"], order)
    del got
    release()
    model = fit_rows(x, names)
    release()
    return model


def predict(docs: DataFrame, model: CodeModel | None, text: str = "text", keep: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """Append lang_pred, score and ambiguous to every row."""

    def start():
        def chunk(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            n = len(offsets) - 1
            letters = has_letter(data, offsets) if model else np.zeros(n, dtype=bool)
            names, score, doubt = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
            for at in range(0, n, 64):
                rows = slice(at, min(at + 64, n))
                pick = np.flatnonzero(letters[rows]) + at
                if not len(pick):
                    continue
                a, b = offsets[rows.start], offsets[rows.stop]
                x = features(gram_counts(data[a:b], offsets[at : rows.stop + 1] - a)[pick - at])
                best, share, lead = model.decode(x)
                names[pick] = np.array(model.languages, dtype=object)[best]
                score[pick], doubt[pick] = share, lead < margin
            return [pa.array(names, type=pa.string()), pa.array(score), pa.array(doubt)]

        return chunk

    new = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("ambiguous", T.BooleanType(), False)]
    return map_text(docs, text, start, new, keep)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of all documents; fold 2 of 4 is held out."""
    model = fit(docs, learn=remainder("k", 4) != 2)
    return predict(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
