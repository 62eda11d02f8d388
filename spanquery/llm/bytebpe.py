"""Byte-level BPE encoding and decoding (operator 6).

A text is split into pre-tokens by the rank file's pattern, evaluated here on arrays of code
points instead of with a backtracking matcher.  Each distinct pre-token of a chunk is encoded
once, by a *hierarchical-bitmap rank queue*: one bucket per merge rank holds the positions in a
linked list whose pair has that rank, three levels of 64-way bitmaps tell in three
find-first-set steps which bucket comes next, and entries whose pair has changed meanwhile are
skipped when they come up.  A pre-token of n bytes costs O(n log n) whatever its length.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; rows
that repeat are encoded one by one and an empty table gives an empty result; an input column named
as a new one is replaced;
bytes that are no UTF-8 are read as U+FFFD; null ids decode to no bytes; an id outside the
vocabulary raises ``ValueError``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import gather, list_array, map_text
from .textkit import _byte_values, span_hashes
from .workers import released

CACHE_BYTES = 48 << 20
LIST_BYTES = 1 << 17
CHUNK = 1 << 20  # bytes of text whose pre-tokens are told apart at a time

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def default_rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by merge rank; ``least`` finds the lowest rank that has any."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.leaf = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.root = 0

    def put(self, rank: int, positions: list[int]) -> None:
        """Open the bucket of a rank that has none."""
        self.buckets[rank] = positions
        self.leaf[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.root |= 1 << (rank >> 12)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [position])
        else:
            bucket.append(position)

    def least(self) -> int:
        """The lowest rank with a bucket, by find-first-set at each level; -1 if there is none."""
        root = self.root
        if not root:
            return -1
        high = (root & -root).bit_length() - 1
        word = self.middle[high]
        low = high << 6 | (word & -word).bit_length() - 1
        word = self.leaf[low]
        return low << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Close the bucket of a rank and return its positions."""
        low, high = rank >> 6, rank >> 12
        self.leaf[low] &= ~(1 << (rank & 63))
        if not self.leaf[low]:
            self.middle[high] &= ~(1 << (low & 63))
            if not self.middle[high]:
                self.root &= ~(1 << high)
        return self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known = np.zeros(size, dtype=bool)
        self.known[list(ranks.values())] = True
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.queue = RankQueue(size)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pair_ranks = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the offset of each piece's ids.

        The pieces lie in one linked list, without pairs across their borders, and share the
        queue: merges in one piece never touch another, so that the lowest rank of all may
        always go first.
        """
        ranks, tokens, queue = self.ranks, self.tokens, self.queue
        whole = [ranks.get(piece, -1) for piece in pieces]
        lengths = np.array([1 if w >= 0 else len(p) for w, p in zip(whole, pieces, strict=True)], dtype=np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        data = np.frombuffer(b"".join(b"\0" if w >= 0 else p for w, p in zip(whole, pieces, strict=True)), dtype=np.uint8)
        array_ids = self.byte_ids[data]
        known = np.array(whole, dtype=np.int64) >= 0
        array_ids[ends[known] - 1] = np.array(whole, dtype=np.int64)[known]
        rank_at = np.full(n, -1, dtype=np.int64)
        if n > 1:
            rank_at[:-1] = self.pair_ranks[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank_at[ends - 1] = -1
        after_at = np.arange(1, n + 1)
        after_at[ends - 1] = -1
        before_at = np.arange(-1, n - 1)
        before_at[ends[:-1]] = -1
        if n:
            before_at[0] = -1
        at = np.flatnonzero(rank_at >= 0)
        at = at[np.argsort(rank_at[at], kind="stable")]
        if len(at):
            cut = np.flatnonzero(np.diff(rank_at[at])) + 1
            for group in np.split(at, cut):
                queue.put(int(rank_at[group[0]]), group.tolist())
        ids, pair, after, before = array_ids.tolist(), rank_at.tolist(), after_at.tolist(), before_at.tolist()
        buckets, get = queue.buckets, ranks.get
        while (rank := queue.least()) >= 0:
            positions = queue.take(rank)
            positions.sort()
            token = tokens[rank]
            for k, at in enumerate(positions):
                if pair[at] != rank:
                    continue  # stale: the pair has changed since it was queued
                gone = after[at]
                follow = after[gone]
                ids[at], ids[gone], pair[gone], after[at], pair[at] = rank, -1, -1, follow, -1
                lower = False
                if follow >= 0:
                    before[follow] = at
                    merged = get(token + tokens[ids[follow]])
                    if merged is not None:
                        pair[at] = merged
                        lower = merged < rank
                        bucket = buckets.get(merged)
                        if bucket is None:
                            queue.put(merged, [at])
                        else:
                            bucket.append(at)
                prior = before[at]
                if prior >= 0:
                    merged = get(tokens[ids[prior]] + token)
                    if merged is None:
                        pair[prior] = -1
                    elif pair[prior] != merged:
                        pair[prior] = merged
                        lower |= merged < rank
                        bucket = buckets.get(merged)
                        if bucket is None:
                            queue.put(merged, [prior])
                        else:
                            bucket.append(prior)
                if lower:  # a new pair goes before the rest of this bucket
                    for rest in positions[k + 1 :]:
                        queue.push(rank, rest)
                    break
        out = np.array(ids, dtype=np.int64)
        alive = out >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return out[alive], kept[np.concatenate([[0], ends])]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.encode_pieces([piece])[0].tolist() if piece else []

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids one after another, and where each id's bytes end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.flat, self.offsets, ids)


_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    global _classes
    if _classes is None:
        import regex

        out = np.full(0x110000, _OTHER, dtype=np.uint8)
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        for pattern, kind in ((r"\p{White_Space}+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
            for m in regex.finditer(pattern, text):
                out[points[m.start() : m.end()]] = kind
        _classes = out
    return _classes


def piece_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Code-point positions at which a pre-token starts; ``begins`` are the starts of non-empty texts."""
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n, dtype=bool)
    first[begins] = True
    last = np.zeros(n, dtype=bool)
    last[np.append(begins[1:], n) - 1] = True
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= first
    space = kind == _SPACE
    # the last character of a white-space run that text follows stands alone or joins that text
    tail = space.copy()
    tail[:-1] &= ~space[1:]
    tail[-1:] = False
    tail &= ~last
    tail_at = np.flatnonzero(tail)
    joins = points[tail_at] == 0x20
    start[tail_at] = True
    start[tail_at[joins] + 1] = False
    # contractions: an apostrophe that starts a pre-token, then s t m d or re ve ll
    quote = np.flatnonzero((points == 0x27) & start & ~last)
    if len(quote):
        one = points[quote + 1]
        room = ~last[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = room & ~single & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        start[quote[single] + 1] = False
        start[quote[double] + 1] = False
        for at, width in ((quote[single], 2), (quote[double], 3)):
            rest = at + width
            # a contraction's rest starts a new pre-token, unless the next text starts there anyway
            inside = rest[(rest < n) & ~last[np.minimum(at + width - 1, n - 1)]]
            start[inside] |= kind[inside] == _LETTER
    return np.flatnonzero(start)


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of each row as (bytes, byte offsets of the pieces, piece range of each row)."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        raw = b"".join(rows)
        data, offsets = np.frombuffer(raw, dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        text = raw.decode("utf-8")
    if not text:
        return data, np.zeros(1, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    rows = np.searchsorted(at_byte, offsets)
    begins = np.unique(rows[:-1][np.diff(rows) > 0])
    starts = piece_starts(points, begins)
    return data, np.append(at_byte[starts], len(data)), np.searchsorted(starts, rows)


_symbols = (_byte_values(0xB9E), _byte_values(0x0DD5EED))


def distinct_pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct piece, and the distinct piece of each piece.

    Two hashes of different byte values must agree; should they ever not, all pieces of the
    chunk count as distinct, which costs time and changes nothing.
    """
    starts, ends = cuts[:-1], cuts[1:]
    one = span_hashes(_symbols[0][data], starts, ends)
    two = span_hashes(_symbols[1][data], starts, ends)
    _, first, which = np.unique(one, return_index=True, return_inverse=True)
    if not np.array_equal(two, two[first][which]):
        first = which = np.arange(len(starts))
    return first, which


class ChunkEncoder:
    """Encodes chunks; between them it keeps the ids of pre-tokens, in about ``CACHE_BYTES``."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.cache: dict[bytes, bytes] = {}
        self.held = 0

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        data, cuts, bounds = split_pieces(data, offsets)
        if len(cuts) == 1:
            return [list_array(np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64), pa.int32())]
        first, which = distinct_pieces(data, cuts)
        raw = data.tobytes()
        cache = self.cache
        if self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        pieces = [raw[a:b] for a, b in zip(cuts[first].tolist(), cuts[first + 1].tolist(), strict=True)]
        found = [cache.get(piece) for piece in pieces]
        new = [i for i, ids in enumerate(found) if ids is None]
        ends = np.cumsum([len(pieces[i]) for i in new])
        at = 0
        while at < len(new):
            # a linked list of Python numbers for so many bytes at a time, or for one longer pre-token
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LIST_BYTES, side="right")))
            some, at = new[at:to], to
            flat, offsets = self.bpe.encode_pieces([pieces[i] for i in some])
            flat = flat.astype(np.int32)
            for i, a, b in zip(some, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found[i] = flat[a:b].tobytes()
                if len(pieces[i]) <= 64:
                    cache[pieces[i]] = found[i]
                    self.held += len(pieces[i]) + len(found[i]) + 180  # two objects and an entry
        table = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in found])])
        ids, ends = gather(np.frombuffer(b"".join(found), dtype=np.int32), table, which)
        return [list_array(ids, np.concatenate([[0], ends])[bounds], pa.int32())]


def _encoder(path: str) -> ChunkEncoder:
    """An encoder for a rank file; each task loads its own and drops it."""
    return ChunkEncoder(ByteBPE(load_ranks(path)))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", rank_file: str | None = None) -> DataFrame:
    """Append ``ids`` (array<int>): the text's ids, without special tokens.

    The rank file is read by the workers, so it must be installed on every machine.
    """
    path = rank_file or default_rank_file()
    return map_text(df, text, lambda: _encoder(path), [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)], limit=CHUNK)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", rank_file: str | None = None) -> DataFrame:
    """Append ``decoded`` (binary): the bytes that the ids stand for."""
    path = rank_file or default_rank_file()
    kept = [f for f in df.schema.fields if f.name.lower() != decoded.lower()]
    names = [f.name for f in kept]
    source = df.select(*names, F.coalesce(df[ids].cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path).bpe
        width = len(names)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                column = rows.column(width)
                bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
                flat = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64)
                data, ends = bpe.decode_flat(flat)
                cuts = np.concatenate([[0], ends])[bounds - bounds[0]]
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(width)] + [_binary(data, cuts)], names=[*names, decoded])

    return source.mapInArrow(released(run), T.StructType([*kept, T.StructField(decoded, T.BinaryType(), False)]))


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", rank_file: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append the text's ids and the bytes that they decode to, in one pass of one worker a task."""
    path = rank_file or default_rank_file()

    def start():
        encoder = _encoder(path)

        def chunk(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            (encoded,) = encoder(data, offsets)
            back, ends = encoder.bpe.decode_flat(encoded.values.to_numpy())
            return [encoded, _binary(back, np.concatenate([[0], ends])[encoded.offsets.to_numpy()])]

        return chunk

    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.BinaryType(), False)]
    return map_text(df, text, start, new, keep, CHUNK)


def token_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None) -> DataFrame:
    """One row a document: n_tokens and SHA-256 digests of its ids and of what they decode to."""
    both = round_trip(docs.select(key, text), text, rank_file=rank_file, keep=[key])
    return both.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
