"""Language-model scoring with a log-frequency Bloom filter (operator 1).

A bigram model with a Dirichlet prior on the add-0.1 unigram distribution P1:

    P(w | v) = (c'(v, w) + MU * P1(w)) / (c(v) + MU)

Bigram counts live in a log-frequency Bloom filter: a bigram of count c enters it once for each
level 1 .. 1 + floor(log2 c), and a query probes level after level until one is absent; c' is
the least count of the last level found, so that P sums to at most one but for the filter's
false positives (about one bigram in a hundred, each a level too high).  Unigram counts are
exact.

Words and bigrams are dealt out by their hashes to blocks of ``BLOCK_BYTES`` of text each, so no
block grows with the corpus or with a frequent word, whose entry is one for each flush of a task.

A model of at most ``BROADCAST_BYTES`` (its size is known before) is broadcast, and the texts are
scored in one pass.  A larger one stays where it is: chunks of texts send their distinct words and
bigrams to the blocks, which answer with counts and with the level that the probes find, and the
answers meet the chunks again.  Either way a text's terms are the same, and the work is in
proportion to the texts.  A chunk goes by a number made of its tokens; should the scan deal out
the rows differently the second time, which is noticed, the texts are stored first.

Words are told apart by 64-bit hashes, bigrams by 40 bits within a block.  Defined cases: null and
empty texts are one end token; a null key is scored but not learned from; rows that share a key are
scored one by one; a very long text is scored whole, as one chunk; with nothing to learn from, N
and V are 0 and every token gets log10(0.1 / 0.1) = 0; an empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import small_batches
from .sampling import remainder
from .storage import drop, stored
from .textkit import chunks, mix64, word_hashes, word_spans
from .workers import released

BLOCK_BYTES = 8 << 20  # text bytes for each block of words and each block of bigrams
LEAST_BLOCKS = 64
BROADCAST_BYTES = 160 << 20
FLUSH = 1_000_000  # tokens counted, or asked for, at a time
BITS_PER_ENTRY = 10
HASHES = 6
LEVELS = 40
MU = 500.0
ALPHA = 0.1

_U = np.uint64
_END = mix64(np.array([0xE0D], dtype=_U))[0]
_START = mix64(np.array([0x57A], dtype=_U))[0]
_MASK40 = _U((1 << 40) - 1)
_MOVED = "the rows of a chunk have moved between two scans"


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end), of the tokens before them, and row ranges."""
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    rows = len(offsets) - 1
    marks = bounds[1:] + np.arange(rows)
    tokens = np.empty(len(words) + rows, dtype=_U)
    inner = np.ones(len(tokens), dtype=bool)
    inner[marks] = False
    tokens[inner] = words
    tokens[marks] = _END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    ranges = np.concatenate([[0], marks + 1])
    before[ranges[:-1]] = _START
    return tokens, before, ranges


def bigrams(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix64(before * _U(0x9E3779B97F4A7C15) + tokens)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each hash; ordered hashes have ordered blocks."""
    return ((hashes >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)


def _five(hashes: np.ndarray) -> np.ndarray:
    """The low 40 bits, as rows of five bytes."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _unfive(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 8), dtype=np.uint8)
    wide[:, :5] = rows
    return wide.view("<u8").ravel().astype(_U)


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """40-bit hashes and one-byte counts; a larger count is several entries."""
    times = (counts + 253) // 254
    hashes = np.repeat(hashes, times)
    small = np.full(len(hashes), 254, dtype=np.uint8)
    small[np.cumsum(times) - 1] = counts - 254 * (times - 1)
    return np.hstack([_five(hashes), small[:, None]]).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return _unfive(rows[:, :5]), rows[:, 5].astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _cuts(hashes: np.ndarray, blocks: int) -> Iterator[tuple[int, slice]]:
    """Each block that ordered hashes have something in, and which of them."""
    bounds = np.searchsorted(block_of(hashes, blocks), np.arange(blocks + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, slice(bounds[b], bounds[b + 1])


class _Chunk:
    """Texts of one task that are handled together."""

    def __init__(self, parts: list[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]):
        self.rows = [rows for rows, _ in parts]
        self.tokens = np.concatenate([t for _, (t, _, _) in parts])
        self.pairs = bigrams(self.tokens, np.concatenate([b for _, (_, b, _) in parts]))
        ends = np.cumsum([0] + [len(t) for _, (t, _, _) in parts])
        self.ranges = np.concatenate([[0]] + [r[1:] + e for (_, (_, _, r)), e in zip(parts, ends, strict=False)])
        place = np.arange(len(self.pairs), dtype=_U) * _U(0xD1342543DE82EF95)
        self.number = int(mix64(np.array([mix64(self.pairs + place).sum()], dtype=_U)).view(np.int64)[0])


def _text_chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[_Chunk]:
    """The rows of a task in chunks of about ``FLUSH`` tokens; column ``text`` holds the texts."""
    parts, have = [], 0
    for batch in batches:
        for at, data, offsets in chunks(batch.column(text)):
            parts.append((batch.slice(at, len(offsets) - 1), token_stream(data, offsets)))
            have += len(parts[-1][1][0])
            if have >= FLUSH:
                yield _Chunk(parts)
                parts, have = [], 0
    if parts:
        yield _Chunk(parts)


def counted(docs: DataFrame, blocks: int) -> DataFrame:
    """Packed counts of each task: block (of bigrams; -1 - block of words) and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text_chunks(batches, 0):
            block, packed = [], []
            words, counts = np.unique(chunk.tokens, return_counts=True)
            for b, some in _cuts(words, blocks):
                block.append(-1 - b)
                packed.append(words[some].tobytes() + counts[some].tobytes())
            pairs, counts = np.unique(chunk.pairs, return_counts=True)
            for b, some in _cuts(pairs, blocks):
                block.append(b)
                packed.append(_pack(pairs[some], counts[some]))
            yield pa.RecordBatch.from_arrays([pa.array(block, type=pa.int32()), pa.array(packed, type=pa.binary())], names=["block", "packed"])

    return docs.select("text").mapInArrow(released(run), "block int, packed binary")


def probe(pairs: np.ndarray, level: int, j: int, bits: np.ndarray) -> np.ndarray:
    """Bit position of probe ``j`` at a level, in a block of ``bits`` bits."""
    return mix64(pairs * _U(2 * j + 3) + _U((level * 64 + j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % bits


def build_block(pairs: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Bit count and bits of the filter of distinct 40-bit hashes with their counts."""
    levels = np.floor(np.log2(counts)).astype(np.int64) + 1
    bits = 8 * (int(levels.sum()) * BITS_PER_ENTRY // 8 + 8)
    flags = np.zeros(bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = pairs[levels >= level]
        for j in range(HASHES):
            flags[probe(some, level, j, _U(bits)).astype(np.int64)] = True
    return bits, np.packbits(flags, bitorder="little").tobytes()


def model_blocks(packed: DataFrame) -> DataFrame:
    """block, size (words of a vocabulary block, bits of a filter block), total (tokens) and raw."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        if block < 0:
            words = np.concatenate([np.frombuffer(x, dtype=_U, count=len(x) // 16) for x in rows["packed"]])
            counts = np.concatenate([np.frombuffer(x, dtype=np.int64, offset=len(x) // 2) for x in rows["packed"]])
            words, counts = _summed(words, counts)
            size, total, raw = len(words), int(counts.sum()), words.tobytes() + counts.tobytes()
        else:
            read = [_unpack(x) for x in rows["packed"]]
            pairs, counts = _summed(np.concatenate([x for x, _ in read]), np.concatenate([x for _, x in read]))
            size, raw = build_block(pairs, counts)
            total = int(counts.sum())
        return pd.DataFrame({"block": [block], "size": [size], "total": [total], "raw": [raw]})

    return packed.groupBy("block").applyInPandas(build, "block int, size long, total long, raw binary")


def found_levels(pairs: np.ndarray, bits: np.ndarray, starts: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Last level at which each bigram is found, 0 for none; each has the bits and the first bit of its block."""
    out = np.zeros(len(pairs), dtype=np.int64)
    alive = np.flatnonzero(bits > 0)
    low, bits, starts = pairs[alive] & _MASK40, bits[alive], starts[alive]
    for level in range(1, LEVELS + 1):
        for j in range(HASHES):
            at = starts + probe(low, level, j, bits).astype(np.int64)
            hit = (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive, low, bits, starts = alive[hit], low[hit], bits[hit], starts[hit]
            if not len(alive):
                return out
        out[alive] = level
    return out


def word_counts(wanted: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Training count of each wanted word among ordered words; 0 where unseen."""
    if not len(words):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
    return np.where(words[at] == wanted, counts[at], 0)


class Model:
    """Vocabulary and filter in one piece, from the rows of ``model_blocks`` one at a time in any order."""

    def __init__(self, rows: Iterator, sizes: dict[int, tuple[int, int]], blocks: int):
        """``sizes`` has the size and the bytes of each block."""
        ends = np.cumsum([sizes.get(-1 - b, (0, 0))[0] for b in range(blocks)])
        self.words, self.counts = np.zeros(ends[-1], dtype=_U), np.zeros(ends[-1], dtype=np.int64)
        self.bits, self.starts = np.zeros(blocks, dtype=_U), np.zeros(blocks, dtype=np.int64)
        self.filter = np.zeros(sum(b for block, (_, b) in sizes.items() if block >= 0), dtype=np.uint8)
        at = 0
        for r in rows:
            if r.block < 0:
                here = slice(ends[-1 - r.block] - r.size, ends[-1 - r.block])
                self.words[here] = np.frombuffer(r.raw, dtype=_U, count=r.size)
                self.counts[here] = np.frombuffer(r.raw, dtype=np.int64, offset=8 * r.size)
            else:
                self.bits[r.block], self.starts[r.block] = r.size, at * 8
                self.filter[at : at + len(r.raw)] = np.frombuffer(r.raw, dtype=np.uint8)
                at += len(r.raw)

    def look_up(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and levels of bigrams."""
        block = block_of(pairs, len(self.bits))
        return word_counts(words, self.words, self.counts), found_levels(pairs, self.bits[block], self.starts[block], self.filter)


def sums(tokens: np.ndarray, ranges: np.ndarray, c: np.ndarray, level: np.ndarray, facts: tuple[int, int, int]) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each row; facts: N, V and texts learned from."""
    n, v, texts = facts
    first = (c + ALPHA) / (n + ALPHA * (v + 1))
    seen = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    # a token counts as the context of the next, its text's start as that of the first
    term = np.log10(seen + MU * first) - np.where(tokens != _END, np.log10(c + MU), np.log10(texts + MU))
    at = ranges[:-1]
    return [np.diff(ranges).astype(np.int64), np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(np.log10(first), at), np.add.reduceat(term, at)]


_SCORES = ["n_tokens", "n_known", "base_score", "score"]
_SCORE_TYPES = "n_tokens long, n_known long, base_score double, score double"


def _broadcast_scores(rows: DataFrame, key: str, blocks: DataFrame, sizes: dict[int, tuple[int, int]], count: int, facts: tuple[int, int, int]) -> DataFrame:
    """The scores of rows (key, text) by a model that every worker gets; it is fetched piece by piece."""
    shared = rows.sparkSession.sparkContext.broadcast(Model(blocks.select("block", "size", "raw").toLocalIterator(), sizes, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1)):
                tokens, before, ranges = token_stream(data, offsets)
                words, which = np.unique(tokens, return_inverse=True)
                c, level = model.look_up(words, bigrams(tokens, before))
                out = sums(tokens, ranges, c[which], level, facts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offsets) - 1), *map(pa.array, out)], names=[key, *_SCORES])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(released(run), f"`{key}` {kind}, {_SCORE_TYPES}")


def _answers(rows: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """chunk, block and raw: for the distinct words or bigrams of a chunk that fall in a block, in order, their counts or levels."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _text_chunks(batches, 1):
            block, wanted = [], []
            words, pairs = np.unique(chunk.tokens), np.unique(chunk.pairs)
            for b, some in _cuts(words, count):
                block.append(-1 - b)
                wanted.append(words[some].tobytes())
            for b, some in _cuts(pairs, count):
                block.append(b)
                wanted.append(_five(pairs[some]).tobytes())
            names = ["block", "chunk", "wanted"]
            yield pa.RecordBatch.from_arrays([pa.array(block, type=pa.int32()), pa.array(np.full(len(block), chunk.number)), pa.array(wanted, type=pa.binary())], names=names)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        for block, wanted in zip(asked["block"].to_pylist(), asked["wanted"], strict=True):
            raw, size = (held["raw"][0].as_buffer(), held["size"][0].as_py()) if held.num_rows else (pa.py_buffer(b""), 0)
            if block < 0:
                got = word_counts(np.frombuffer(wanted.as_buffer(), dtype=_U), np.frombuffer(raw, dtype=_U, count=size), np.frombuffer(raw, dtype=np.int64, offset=8 * size))
                out.append(got.astype(np.int64).tobytes())
            else:
                pairs = _unfive(np.frombuffer(wanted.as_buffer(), dtype=np.uint8).reshape(-1, 5))
                level = found_levels(pairs, np.full(len(pairs), size, dtype=_U), np.zeros(len(pairs), dtype=np.int64), np.frombuffer(raw, dtype=np.uint8))
                out.append(level.astype(np.uint8).tobytes())
        return pa.table([asked["chunk"], asked["block"], pa.array(out, type=pa.binary())], names=["chunk", "block", "raw"])

    asked = rows.mapInArrow(released(ask), "block int, chunk long, wanted binary")
    met = asked.groupBy("block").cogroup(blocks.select("block", "size", "raw").groupBy("block"))
    return met.applyInArrow(answer, "chunk long, block int, raw binary")


def _routed_scores(rows: DataFrame, key: str, blocks: DataFrame, count: int, facts: tuple[int, int, int]) -> DataFrame:
    """The scores of rows (key, text) by a model whose blocks answer chunks of texts; stored."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng()
        for chunk in _text_chunks(batches, 1):
            copy, seq = int(rng.integers(1 << 62)), 0
            for part in chunk.rows:
                columns = [np.full(part.num_rows, chunk.number), np.full(part.num_rows, copy), np.arange(seq, seq + part.num_rows)]
                seq += part.num_rows
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), part.column(0), part.column(1)], names=["chunk", "copy", "seq", key, "text"])

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        held: dict[int, bytes] = dict(zip(told["block"].to_pylist(), told["raw"].to_pylist(), strict=True))
        out = []
        for copy in texts["copy"].unique().to_pylist() or [None]:
            own = texts.filter(pa.compute.equal(texts["copy"], copy)).sort_by("seq")
            parts = [token_stream(data, offsets) for _, data, offsets in chunks(own["text"])]
            if not parts:
                empty = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64, np.float64)]
                out.append(pa.table([own[key], *map(pa.array, empty)], names=[key, *_SCORES]))
                continue
            chunk = _Chunk([(own, p) for p in parts])
            words, word = np.unique(chunk.tokens, return_inverse=True)
            pairs, pair = np.unique(chunk.pairs, return_inverse=True)
            c = np.frombuffer(b"".join(held.get(-1 - b, b"") for b, _ in _cuts(words, count)), dtype=np.int64)
            level = np.frombuffer(b"".join(held.get(b, b"") for b, _ in _cuts(pairs, count)), dtype=np.uint8)
            if len(c) != len(words) or len(level) != len(pairs):
                raise ValueError(_MOVED)
            out.append(pa.table([own[key], *map(pa.array, sums(chunk.tokens, chunk.ranges, c[word], level[pair].astype(np.int64), facts))], names=[key, *_SCORES]))
        return pa.concat_tables(out)

    answers, path = stored(_answers(rows, blocks, count), "answers")
    kind = rows.schema[key].dataType.simpleString()
    texts = rows.mapInArrow(released(number), f"chunk long, copy long, seq long, `{key}` {kind}, text string")
    try:
        return stored(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"`{key}` {kind}, {_SCORE_TYPES}"), "scores")[0]
    finally:
        drop(rows.sparkSession, path)


def scores(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row."""
    with small_batches(docs.sparkSession):
        return _scores(docs, learn, key, text, broadcast_bytes)


def _scores(docs: DataFrame, learn: Column, key: str, text: str, broadcast_bytes: int) -> DataFrame:
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    train = docs.where(F.coalesce(learn, F.lit(False))).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    facts = train.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    count = max(LEAST_BLOCKS, -(-int(facts.bytes) // BLOCK_BYTES))
    blocks, path = stored(model_blocks(counted(train, count)), "lm")
    words = F.col("block") < 0
    total = blocks.agg(
        F.coalesce(F.sum(F.when(words, F.col("total"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(words, F.col("size"))), F.lit(0)).alias("v"),
        F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"),
    ).first()
    known = (total.n, total.v, facts.texts)
    if total.bytes <= broadcast_bytes:
        sizes = {r.block: (r.size, r.bytes) for r in blocks.select("block", "size", F.octet_length("raw").alias("bytes")).collect()}  # a row a block of a bounded model
        out = _broadcast_scores(rows, key, blocks, sizes, count, known)
    else:
        try:
            out = _routed_scores(rows, key, blocks, count, known)
        except PySparkException as failure:
            if _MOVED not in str(failure):
                raise
            fixed, where = stored(rows, "texts")
            out = _routed_scores(fixed, key, blocks, count, known)
            drop(docs.sparkSession, where)
    drop(docs.sparkSession, path)
    return out.select(key, "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")


def document_scores(docs: DataFrame) -> DataFrame:
    """The scores of all documents; fold 0 of 10 is held out."""
    out = scores(docs, remainder("doc_id", 10) != 0)
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
