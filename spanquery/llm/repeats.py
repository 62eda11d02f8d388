"""Repeated spans of words by De Bruijn compaction (operator 12).

A window of ``width`` words is an edge of a De Bruijn graph, from the node of its first width - 1 words to
that of its last.  A node is a junction if its occurrences differ in the word before or after (the ends of a
document count as words of their own).  Between junctions the graph does not branch, so whoever meets one
edge of such a path goes through all of it: a path is cut alike wherever it occurs, and its first
occurrence (least document, then start) holds the first occurrence of each of its windows.  Hence:

1. Edges that can repeat.  The least hash of the shorter grams in a window is its minimizer; equal windows
   have equal ones, at different places.  Windows whose minimizer occurs at a single place are left out.
2. Junctions.  One aggregation over the nodes of those edges, with partial sums before the shuffle.
3. Paths.  Each document is cut at its junctions; a path is a row with a 128-bit digest of its words.
4. Joins.  Paths are joined by digest with their first occurrence, which gives every copy its source
   coordinates; the copies of a document are joined with its text.

Minimizers and junctions are told to the tasks as a bitmap of at most ``MAX_BITS`` bits.  Both may hold more
than is true: a window too many is a path that occurs once, a junction too many cuts a path alike at each
occurrence.  So the bitmap's size decides the work, never the result.

Defined cases: a null text has no words; documents are ordered by id, null last; rows that share an id (or
have none) are documents of their own, ordered by text; a document shorter than a window keeps all words;
windows overlap within a document, too; very long texts are taken whole; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stored
from .textkit import chunks, exact_word_hashes, joined_words, mix64, powers, word_spans
from .workers import released

WIDTH = 20
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29  # of a bitmap: 8 KB to 64 MB
BITS_EACH = 16
CHUNK = 1 << 20  # bytes of text at a time

_U = np.uint64


@lru_cache
def _salts(n: int, seed: int) -> np.ndarray:
    """Odd factors without a relation to each other, so that shifted spans have unrelated sums."""
    return mix64(powers(n, 0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def spans_of(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of words[i : i + width] for each i."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, dtype=_U)
    for j, salt in enumerate(_salts(width, seed)):
        out += words[j : n + j] * salt
    return mix64(out)


def least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of values[i : i + width] and its leftmost place, for each i."""
    low, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = low[: len(low) - step], low[step:]
        take = right < left
        low, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        have += step
    return low, at


class Words:
    """The words of a chunk of texts and its windows; ``windows`` are the places at which one begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int) -> None:
        self.width = width
        self.starts, self.ends, self.bounds = word_spans(data, offsets)
        self.words = exact_word_hashes(data, self.starts, self.ends)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.windows = np.flatnonzero(self.bounds[1:][self.rows] - np.arange(len(self.words)) >= width)
        gram = max(1, width // 2)
        low, at = least(spans_of(self.words, gram, 1), width - gram + 1) if len(self.windows) else (np.zeros(0, dtype=_U),) * 2
        self.minimizer, self.place = low[self.windows], at[self.windows]

    def nodes(self) -> np.ndarray:
        return spans_of(self.words, self.width - 1, 2)

    def around(self, at: np.ndarray) -> np.ndarray:
        """Hash of the words before and after the nodes at these places."""
        first, last = self.bounds[:-1][self.rows[at]], self.bounds[1:][self.rows[at]]
        after = at + self.width - 1
        before = np.where(at > first, self.words[np.maximum(at, 1) - 1], _U(1))
        behind = np.where(after < last, self.words[np.minimum(after, len(self.words) - 1)], _U(2))
        return mix64(before * _U(0xD1342543DE82EF95) + mix64(behind))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def within(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & _U(64 * len(bitmap) - 1)
    return (bitmap[slot >> _U(6)] >> (slot & _U(63))) & _U(1) != 0


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The low bits of the hashes (column h, stored) that occur, as 64-bit words."""
    n, bits = hashes.count(), MIN_BITS
    while bits < min(MAX_BITS, n * BITS_EACH):
        bits *= 2
    slot = F.col("h").bitwiseAND(bits - 1)
    cells = hashes.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("ones")).toArrow()
    out = np.zeros(bits // 64, dtype=_U)
    out[cells.column("cell").to_numpy()] = cells.column("ones").to_numpy().view(_U)
    return out


Emit = Callable[[pa.RecordBatch, Words, np.ndarray], list[pa.Array]]


def _each(docs: DataFrame, width: int, emit: Emit, schema: str) -> DataFrame:
    """Rows that ``emit`` makes of (keys, words, bytes) of about ``CHUNK`` bytes of texts."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1), CHUNK):
                words = Words(data, offsets, width)
                if len(words.windows):
                    yield pa.RecordBatch.from_arrays(emit(batch.column(0).slice(at, len(offsets) - 1), words, data), names=names)

    return docs.select("key", "text").mapInArrow(released(run), schema)


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str | None]:
    """key (distinct, in the order of the documents), doc_id and text; the path of the copy that repeated or null ids ask for."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if count.n == count.ids:
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text"), None
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), "text").select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return stored(ordered, "documents")


def _occurrences(docs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """The paths of each document (key, start, n windows, digest a and b, ahead: the first of its document), stored."""
    spark = docs.sparkSession

    def minimizers(keys: pa.Array, w: Words, data: np.ndarray) -> list[pa.Array]:
        new = np.ones(len(w.place), dtype=bool)
        new[1:] = w.place[1:] != w.place[:-1]
        return [signed(w.minimizer[new])]

    found, path = stored(_each(docs, width, minimizers, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "minimizers")
    repeated = spark.sparkContext.broadcast(bitmap(found))
    drop(spark, path)

    def nodes(keys: pa.Array, w: Words, data: np.ndarray) -> list[pa.Array]:
        edges = w.windows[within(repeated.value, w.minimizer)]
        met = np.zeros(len(w.words) + 1, dtype=bool)
        met[edges] = met[edges + 1] = True
        at = np.flatnonzero(met)
        return [signed(w.nodes()[at]), signed(w.around(at))]

    around = _each(docs, width, nodes, "h long, around long").groupBy("h").agg(F.min("around").alias("low"), F.max("around").alias("high"))
    found, path = stored(around.where("low <> high").select("h"), "junctions")
    junctions = spark.sparkContext.broadcast(bitmap(found))
    drop(spark, path)

    def paths(keys: pa.Array, w: Words, data: np.ndarray) -> list[pa.Array]:
        edges = w.windows[within(repeated.value, w.minimizer)]
        begins = np.ones(len(edges), dtype=bool)
        begins[1:] = edges[1:] != edges[:-1] + 1
        begins |= within(junctions.value, w.nodes()[edges])
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, len(edges)))
        at = edges[first]
        text, place = joined_words(data, w.starts, w.ends)
        ends = place[at + length + width - 1] - 1
        digests = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(place[at].tolist(), ends.tolist(), strict=True))
        a, b = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2).T
        row = w.rows[at]
        order = np.lexsort((at, b, a, row))
        ahead = np.ones(len(at), dtype=bool)
        x, y = order[1:], order[:-1]
        ahead[x] = (a[x] != a[y]) | (b[x] != b[y]) | (row[x] != row[y])
        start = (at - w.bounds[row]).astype(np.int64)
        return [keys.take(pa.array(row)), pa.array(start), pa.array(length.astype(np.int64)), pa.array(a), pa.array(b), pa.array(ahead)]

    return stored(_each(docs, width, paths, "key long, start long, n long, a long, b long, ahead boolean"), "paths")


def _copies(occurrences: DataFrame) -> DataFrame:
    """key, start and n of each path that occurs earlier, and source_key and source_start of its first occurrence."""
    firsts = occurrences.where("ahead").groupBy("a", "b").agg(F.min("key").alias("source_key"), F.min_by("start", "key").alias("source_start"), F.count(F.lit(1)).alias("docs"))
    # a path of one document alone has copies only if one of them is not ahead
    again = occurrences.where("not ahead").select("a", "b").distinct().withColumn("again", F.lit(True))
    firsts = firsts.join(again, ["a", "b"], "left").where("docs > 1 or again").select("a", "b", "source_key", "source_start")
    firsts, _ = stored(firsts, "sources")
    met = occurrences.join(firsts, ["a", "b"])
    return met.where("key <> source_key or start <> source_start").select("key", "start", "n", "source_key", "source_start")


def spans(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The repeated spans as paths: doc_id, start, n_words, and source_id and source_start of the first occurrence."""
    rows, _ = _keyed(docs, key, text)
    occurrences, _ = _occurrences(rows, width)
    found = _copies(occurrences).withColumn("n_words", F.col("n") + (width - 1))
    ids = rows.select("key", "doc_id")
    sources = ids.select(F.col("key").alias("source_key"), F.col("doc_id").alias("source_id"))
    return found.join(ids, "key").join(sources, "source_key").select("doc_id", "start", "n_words", "source_id", "source_start")


def long_spans(docs: DataFrame, least: int = 50, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated spans of ``least`` words or more, whole: doc_id, start, n_words, source_id, source_start and ``same``.

    Paths of a document that follow one another, there and at their source, are one span.  Its words are then read again
    at both coordinates, and ``same`` says whether these are the same (by SHA-256 of the words).
    """
    rows, _ = _keyed(docs, key, text)
    occurrences, _ = _occurrences(rows, width)
    found = _copies(occurrences).withColumn("line", F.col("source_start") - F.col("start"))
    lines = Window.partitionBy("key", "source_key", "line").orderBy("start")
    begins = F.coalesce(F.col("start") > F.lag(F.col("start") + F.col("n")).over(lines), F.lit(True))
    parts = found.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(lines))
    whole = parts.groupBy("key", "source_key", "line", "part").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) + (width - 1)).alias("until"))
    whole = whole.select("key", "source_key", "start", (F.col("start") + F.col("line")).alias("source_start"), (F.col("until") - F.col("start")).alias("n_words")).where(F.col("n_words") >= least)
    whole, _ = stored(whole, "spans")
    words = rows.select("key", "doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))

    def read(side: str, start: str) -> DataFrame:
        """The words of each span at one of its coordinates, by a digest."""
        told = whole.join(words, whole[side] == words["key"]).select(whole["key"], "source_key", "start", "source_start", "n_words", "doc_id", "words")
        spoken = F.sha2(F.concat_ws(" ", F.slice("words", (F.col(start) + 1).cast("int"), F.col("n_words").cast("int"))), 256)
        return told.select("key", "source_key", "start", "source_start", "n_words", F.col("doc_id").alias(f"{side}_id"), spoken.alias(f"{side}_words"))

    both = read("key", "start").join(read("source_key", "source_start"), ["key", "source_key", "start", "source_start", "n_words"])
    return both.select(F.col("key_id").alias("doc_id"), "start", "n_words", F.col("source_key_id").alias("source_id"), "source_start", (F.col("key_words") == F.col("source_key_words")).alias("same"))


def without_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by spaces) of each document: the words of
    every window that has begun earlier go, as judged on the input."""
    rows, _ = _keyed(docs, key, text)
    occurrences, _ = _occurrences(rows, width)
    marks = _copies(occurrences).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    marked = rows.join(marks, "key", "left").select("doc_id", "text", F.col("spans.start").alias("start"), F.col("spans.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column(1), CHUNK):
                piece = batch.slice(at, len(offsets) - 1)
                starts, ends, bounds = word_spans(data, offsets)
                count = np.nan_to_num(pc.list_value_length(piece.column(2)).to_numpy(zero_copy_only=False)).astype(np.int64)
                begin = np.repeat(bounds[:-1], count) + piece.column(2).flatten().to_numpy()
                covered = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(covered, begin, 1)
                np.add.at(covered, begin + piece.column(3).flatten().to_numpy() + (width - 1), -1)
                gone = np.cumsum(covered)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                left = np.flatnonzero(~gone)
                kept, place = joined_words(data, starts[left], ends[left])
                ranges = np.searchsorted(left, bounds)
                texts = [kept[place[a] : place[b] - 1].tobytes().decode() if b > a else "" for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array((total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)), pa.array(texts, type=pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return marked.mapInArrow(released(run), "doc_id long, n_words long, n_removed long, kept string")


def kept_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of ``without_repeats``."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
