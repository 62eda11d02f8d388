"""Exact n-gram Jaccard self-join with set-relation skipping (operator 10).

Two documents link when the Jaccard similarity of their sets of word shingles is at least
``percent``.  Equal sets are one node from the start.  Nodes meet through a prefix index: with
the shingles of a set in a global order, rare ones first, two sets that link share one of their
first n - ceil(percent * n) + 1 shingles.  The order comes from a counter sketch, summed over all
documents, whose size follows the bytes of text: a counter that holds only rare shingles is about the
mean, with a spread of its square root, and what stands out from that by ever more is ever later in the
order.  So frequent passages stay out of the prefixes while they are frequent against the square root of
the shingles a counter, not against their number: some ten documents up to 8 GB of text, and beyond that,
where a task's counters stay at 64 MB, the square root of the words over 2^24 (800 at 10^13 words).  The
order decides the work, never the result.

Two kinds of skipping keep large groups of similar sets from costing all their pairs:

* *Answers from answers.*  In every index list the most central set is the pivot; pivots are
  compared first.  What a pivot's overlaps say about two of its neighbours decides most of
  their pairs (|Y & Z| lies between o(X,Y) + o(X,Z) - |X| and
  min(o(X,Y), o(X,Z)) + min(|Y| - o(X,Y), |Z| - o(X,Z))), and only pairs across the
  components found so far matter at all.
* *Blocks by position.*  What is left of the lists is cut into blocks of equal size band and
  position band; a pair of blocks is skipped when its bounds on size, position and component
  leave no possible link.

Every pair that could link is decided by such bounds or by counting the common shingles; for
components, pairs of sets already in one component are passed over, for ``linked_pairs`` and
``link_counts`` none is.  Their work grows with the pairs within groups of similar sets.
Shingles are 64-bit hashes; sets are told apart by 128 bits.

Hot shingles, by the sketch, are dealt out by token and node; all later joins on a token, a pivot or
a root are of stored tables with at most one row a key on one side, which Spark can split.

Defined cases: a document of one to four words has its whole sequence as its one shingle; null,
empty and wordless texts have the empty set, link with nothing and are their own component; rows
with a null doc_id link like others, and the component is named by the smallest non-null doc_id in
it, null if it has none; rows that share a doc_id are rows of their own; a very long text is one
set, taken whole; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .mapping import ChunkFunction, map_text, set_aside, small_batches
from .storage import drop, stored
from .textkit import chunks, distinct_per_row, mix64, per_row_sum, shingles, word_hashes, word_spans
from .workers import released

WIDTH = 5
PERCENT = 80
LEAST_BITS, MOST_BITS = 20, 24  # of the number of a counter; the most that a task holds are 64 MB
COUNTER_BYTES = 512  # of text for each counter in between
BLOCK = 128
BROADCAST_ROWS = 200_000
HOT_ROWS = 4096  # documents with a shingle, by the sketch, for each group that it is dealt to
_SKETCH_ROWS = 1 << 14  # counters a row of the sketch table
_FLUSH = 1 << 21  # shingles counted at a time

_U = np.uint64


def chunk_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ordered, and the range of each row."""
    starts, ends, bounds = word_spans(data, offsets)
    found, rows = shingles(word_hashes(data, starts, ends), bounds, width)
    found, rows = distinct_per_row(found, rows)
    return found, np.searchsorted(rows, np.arange(len(offsets)))


def signatures(found: np.ndarray, bounds: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit signatures of each set."""
    one = mix64(per_row_sum(mix64(found + _U(2 * salt + 1)), bounds) + np.diff(bounds).astype(_U))
    two = mix64(per_row_sum(mix64(found * _U(0xD6E8FEB86659FD93) + _U(2 * salt + 2)), bounds))
    return one.view(np.int64), two.view(np.int64)


def _stand_in(text: str) -> Column:
    """A number of a text for rows without a key, greater than any key below 2^62."""
    return F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 1).bitwiseOR(F.lit(1 << 62))


def _text_column(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, at (by which a row's text is fetched again) and text."""
    number = F.col(key).cast("long")
    return docs.select(number.alias("doc_id"), F.coalesce(number, _stand_in(text)).alias("at"), F.col(text).cast("string").alias("text"))


def sketch_bits(size: int) -> int:
    """Bits of a counter's number for so many bytes of text."""
    return min(MOST_BITS, max(LEAST_BITS, (size // COUNTER_BYTES).bit_length()))


def _narrow(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as they need, of 1, 2 and 4."""
    return counts.astype(f"<u{1 if (most := int(counts.max())) < 1 << 8 else 2 if most < 1 << 16 else 4}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // _SKETCH_ROWS}")


def _scan(docs: DataFrame, width: int, salt: int, bits: int) -> DataFrame:
    """Rows of kind 0: a document's set size and signatures; of kind 1: counters of a task."""
    schema = "kind int, doc_id long, at long, n int, node long, check long, block int, counts binary"
    fields = [("kind", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("check", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema(fields)
        counters = np.zeros(1 << bits, dtype=np.uint32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            if waiting:
                at, times = np.unique(np.concatenate(waiting), return_counts=True)
                counters[at] += times.astype(np.uint32)
                waiting.clear()

        for batch in batches:
            for at, data, offsets in chunks(batch.column(2)):
                m = len(offsets) - 1
                found, bounds = chunk_sets(data, offsets, width)
                waiting.append((found >> _U(64 - bits)).astype(np.int32))
                if sum(map(len, waiting)) > _FLUSH:
                    count()
                one, two = signatures(found, bounds, salt)
                empty = np.diff(bounds) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(m, dtype=np.int32)),
                        batch.column(0).slice(at, m),
                        batch.column(1).slice(at, m),
                        pa.array(np.diff(bounds).astype(np.int32)),
                        pa.array(one, mask=empty),
                        pa.array(two, mask=empty),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.binary()),
                    ],
                    schema=names,
                )
        count()
        rows = counters.reshape(-1, _SKETCH_ROWS)
        used = [i for i in range(len(rows)) if rows[i].any()]
        k = len(used)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(k, dtype=np.int32)),
                *(pa.nulls(k, f[1]) for f in fields[1:6]),
                pa.array(used, type=pa.int32()),
                pa.array([_narrow(rows[i]) for i in used], type=pa.binary()),
            ],
            schema=names,
        )

    return docs.mapInArrow(released(run), schema)


def _order(scan: DataFrame, bits: int, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each counter, a byte for each, and the groups to deal a shingle of each rank to."""
    spark = scan.sparkSession

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for block, counts in zip(part["block"], part["counts"], strict=True):
                have = sums.setdefault(int(block), np.zeros(_SKETCH_ROWS, dtype=np.uint64))
                have += _wide(counts)
        for block, counts in sums.items():
            yield pd.DataFrame({"block": [block], "usual": [float(np.median(counts))], "counts": [counts.tobytes()]})

    schema = "block int, usual double, counts binary"
    # sums of what each task reads, of a share of the tasks, and of all: nowhere more than the counters themselves
    sums = scan.where("kind = 1").select("block", "counts").mapInPandas(released(add), schema)
    ways = max(1, round(spark.sparkContext.defaultParallelism**0.5))
    sums = sums.withColumn("way", F.pmod(F.spark_partition_id(), F.lit(ways))).repartition("block", "way").mapInPandas(released(add), schema)
    sums = keep(sums.repartition("block").mapInPandas(released(add), schema), "sketch")
    # shingles fall on blocks by their hash, so the blocks' medians lie around that of all; untouched blocks have 0
    blocks = (1 << bits) // _SKETCH_ROWS
    medians = [r.usual for r in sums.select("usual").collect()]  # 2^MOST_BITS / _SKETCH_ROWS rows at most
    usual = float(np.median(medians + [0.0] * (blocks - len(medians))))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"block": part["block"], "rank": [ranks(_wide(x), usual)[0].tobytes() for x in part["counts"]]})

    rank = np.zeros(1 << bits, dtype=np.uint8)
    for row in sums.select("block", "counts").mapInPandas(released(place), "block int, rank binary").toLocalIterator():
        rank[row.block * _SKETCH_ROWS : (row.block + 1) * _SKETCH_ROWS] = np.frombuffer(bytes(row["rank"]), dtype=np.uint8)
    return rank, ranks(np.zeros(0), usual)[1]


def ranks(counts: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray]:
    """How far each counter stands out from the usual ones, on a log scale, and the groups of each rank."""
    spread = max(1.0, usual**0.5)
    above = np.maximum(counts.astype(float) - usual, 0) / spread
    rank = np.minimum(255, np.round(8 * np.log2(1 + above))).astype(np.uint8)
    held = spread * (2 ** (np.arange(256) / 8) - 1)
    return rank, np.maximum(1, np.ceil(held / HOT_ROWS)).astype(np.int64)


def _prefixes(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], width: int, percent: int, salt: int) -> DataFrame:
    """Index entries: token, part (-1, or the group that a hot token's entry is dealt to), node and pos, the place of the token in the set's order."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, ways = shared.value
        unused = _U(64 - (len(rank).bit_length() - 1))
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                found, bounds = chunk_sets(data, offsets, width)
                if not len(found):
                    continue
                node, _ = signatures(found, bounds, salt)
                n = np.diff(bounds)
                rows = np.repeat(np.arange(len(n)), n)
                weight = rank[(found >> unused).astype(np.int64)]
                turn = np.lexsort((found, weight, rows))
                found, weight = found[turn], weight[turn]
                if len(seen) > 100_000:
                    seen.clear()
                new = np.array([x not in seen and not seen.add(x) for x in node.tolist()])
                pos = np.arange(len(found)) - np.repeat(bounds[:-1], n)
                length = n - (percent * n + 99) // 100 + 1
                keep = (pos < length[rows]) & new[rows]
                rows, groups = rows[keep], ways[weight[keep]]
                part = np.where(groups > 1, (mix64(node[rows].view(_U)) % groups.astype(_U)).astype(np.int64), -1)
                columns = [found[keep].view(np.int64), part.astype(np.int32), node[rows], pos[keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "part", "node", "pos"])

    return docs.select("text").mapInArrow(released(run), "token long, part int, node long, pos int")


def _possible(na: Column, nb: Column, left_a: Column, left_b: Column, percent: int) -> Column:
    """Size and position filter: left_* counts what follows a common token, itself included."""
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sizes & (F.least(left_a, left_b) * (100 + percent) >= (na + nb) * percent)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


Keep = Callable[[DataFrame, str], DataFrame]


class Verifier:
    """Counts common shingles of pairs of nodes; ``where`` has a row's ``at`` for each node, ``keep`` stores a table."""

    def __init__(self, docs: DataFrame, where: DataFrame, width: int, salt: int, repeated: bool, keep: Keep):
        self.docs, self.where, self.width, self.salt, self.repeated, self.keep = docs, where, width, salt, repeated, keep

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, lead and the sorted shingle hashes of stored nodes (node, lead)."""
        width, salt = self.width, self.salt
        wanted = self.keep(self.where.join(nodes, "node").select("at", "node", "lead"), "wanted")
        texts = self.docs.join(_bounded(wanted), "at").select("node", "lead", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, data, offsets in chunks(batch.column(2)):
                    found, bounds = chunk_sets(data, offsets, width)
                    one, _ = signatures(found, bounds, salt)
                    node = batch.column(0).slice(at, len(one)).to_numpy()
                    right = np.flatnonzero(one == node)
                    raw = [found[bounds[i] : bounds[i + 1]].tobytes() for i in right]
                    lead = batch.column(1).slice(at, len(one)).take(pa.array(right))
                    yield pa.RecordBatch.from_arrays([pa.array(node[right]), lead, pa.array(raw, type=pa.binary())], names=["node", "lead", "hashes"])

        sets = texts.mapInArrow(released(run), "node long, lead boolean, hashes binary")
        return sets.dropDuplicates(["node"]) if self.repeated else sets

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """Append o, the number of common shingles, to stored pairs (a, b, na, nb)."""
        nodes = pairs.select(F.col("a").alias("node"), F.lit(True).alias("lead")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(False).alias("lead")))
        sets = self.keep(self.sets(nodes.groupBy("node").agg(F.max("lead").alias("lead"))), "sets")
        both = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")).join(_bounded(pairs), "b")
        both = both.join(sets.where("lead").select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [
                    len(np.intersect1d(np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U), assume_unique=True))
                    for x, y in zip(batch.column(4), batch.column(5), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, type=pa.int64())], names=["a", "b", "na", "nb", "o"])

        return both.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(released(run), "a long, b long, na long, nb long, o long")


def _linked(percent: int) -> Column:
    return F.col("o") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each list's sets with its pivot, where size and position allow a link."""
    n, p = F.col("n"), F.col("pivot.n")
    near = lists.where(F.col("node") != F.col("pivot.node")).where(_possible(n, p, n - F.col("pos"), p - F.col("pivot.pos"), percent))
    return near.select(F.col("pivot.node").alias("a"), F.col("node").alias("b"), p.cast("long").alias("na"), n.cast("long").alias("nb")).distinct()


def _blocks(entries: DataFrame, roots: DataFrame, percent: int, keep: Keep) -> DataFrame:
    """Blocks of the lists that hold sets of more than one component."""
    root = F.coalesce("root", "node")
    held = entries.select("token", "node").join(roots, "node", "left").groupBy("token")
    lists = keep(held.agg(F.min(root).alias("lo"), F.max(root).alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi").select("token", "rows"), "lists")
    entries = entries.select("token", "node", "n", "pos").join(_bounded(lists), "token").join(roots, "node", "left").withColumn("root", root)
    n, pos = F.col("n"), F.col("pos")
    entries = entries.select(
        "token", "node", "root", n.cast("long").alias("n"), pos.cast("long").alias("pos"),
        F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int").alias("size_band"),
        F.floor(pos * 16 / n).cast("int").alias("pos_band"),
        F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK))).alias("part"),
    )
    return entries.groupBy("token", "size_band", "pos_band", "part").agg(
        F.collect_list(F.struct("node", "root", "n", "pos")).alias("members"),
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("pos")).alias("most_left"),
        F.min("root").alias("least_root"), F.max("root").alias("most_root"),
    )


def _block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) across components from all pairs of blocks that the headers don't rule out."""
    a, b = blocks.alias("x"), blocks.alias("y")
    x, y = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
    order = F.struct(x("size_band"), x("pos_band"), x("part")) <= F.struct(y("size_band"), y("pos_band"), y("part"))
    joined = a.join(
        b,
        (x("token") == y("token")) & order & (y("size_band") <= x("size_band") + 1)
        & (x("most_n") * 100 >= y("least_n") * percent) & (y("most_n") * 100 >= x("least_n") * percent)
        & (F.least(x("most_left"), y("most_left")) * (100 + percent) >= (x("least_n") + y("least_n")) * percent)
        & ((x("least_root") != y("least_root")) | (x("most_root") != y("most_root")) | (x("least_root") != x("most_root"))),
    )
    pairs = joined.select(x("members").alias("xs"), y("members").alias("ys"))

    def fields(column: pa.Array) -> tuple[np.ndarray, ...]:
        flat = column.values if isinstance(column, pa.ListArray) else column
        return tuple(flat.field(i).to_numpy() for i in range(4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (fields(batch.column(k).slice(i, 1).flatten()) for k in (0, 1))
                na, nb = one[2][:, None], two[2][None, :]
                keep = (one[1][:, None] != two[1][None, :]) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
                left = np.minimum((one[2] - one[3])[:, None], (two[2] - two[3])[None, :])
                keep &= left * (100 + percent) >= (na + nb) * percent
                r, c = np.nonzero(keep)
                a, b, sa, sb = one[0][r], two[0][c], one[2][r], two[2][c]
                swap = a > b
                a, b, sa, sb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, sb, sa), np.where(swap, sa, sb)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (a, b, sa, sb)], names=["a", "b", "na", "nb"])

    return pairs.mapInArrow(released(run), "a long, b long, na long, nb long").distinct()


def _derived(pairs: DataFrame, checked: DataFrame, percent: int, keep: Keep) -> DataFrame:
    """Append lb and ub on the overlap, from what both sets have in common with one pivot."""
    told = checked.select(F.col("b").alias("node"), F.struct("o", F.col("a").alias("x"), F.col("na").alias("nx")).alias("best"))
    told = keep(told.groupBy("node").agg(F.max("best").alias("best")), "told")
    out = pairs.join(told.select(F.col("node").alias("a"), F.col("best").alias("p")), "a", "left")
    out = out.join(told.select(F.col("node").alias("b"), F.col("best").alias("q")), "b", "left")
    same = F.col("p.x") == F.col("q.x")
    lb = F.when(same, F.greatest(F.lit(0), F.expr("p.o + q.o - p.nx"))).otherwise(F.lit(0))
    ub = F.when(same, F.expr("least(p.o, q.o) + least(na - p.o, nb - q.o)")).otherwise(F.least("na", "nb"))
    return out.select("a", "b", "na", "nb", lb.alias("lb"), ub.alias("ub"))


def _keeper(paths: list[str]) -> Keep:
    """stored(), with the paths noted."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        paths.append(path)
        return out

    return keep


def _met(docs: DataFrame, key: str, text: str, width: int, percent: int, keep: Keep) -> tuple[DataFrame, DataFrame, DataFrame, Verifier, int]:
    """Rows with their nodes, entries of shared tokens, pairs compared with pivots, what verifies others, and the salt."""
    source = _text_column(docs, key, text)
    bits = sketch_bits(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    for salt in range(8):
        scan = keep(_scan(source, width, salt, bits), "scan")
        rows = scan.where("kind = 0").select("doc_id", "at", "n", "node", "check")
        # two different sets with one 64-bit node id: practically never; then take another salt
        nodes = rows.where("node is not null").groupBy("node").agg(F.min("at").alias("at"), F.min("n").alias("n"), F.min("check").alias("x"), F.max("check").alias("y"))
        nodes = keep(nodes, "nodes")
        if nodes.where("x <> y").isEmpty():
            break
    else:
        raise RuntimeError("set signatures keep clashing")
    repeated = not rows.groupBy("at").count().where("count > 1").isEmpty()
    w = Window.partitionBy("token", "part")
    lists = _prefixes(source, _order(scan, bits, keep), width, percent, salt).withColumns({"lo": F.min("node").over(w), "hi": F.max("node").over(w)})
    # what is left are tokens that different sets share, and hot ones; copies in several tasks go
    shared, path = stored(lists.where("part >= 0 or lo <> hi").dropDuplicates(["token", "part", "node", "pos"]).select("token", "node", "pos"), "shared")
    # the most central set of a list is the one that shares most of its prefix
    held = shared.groupBy("node").agg(F.count(F.lit(1)).alias("held")).join(nodes.select("node", "n"), "node")
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    facts = keep(held.select("node", "n", F.floor(F.col("held") * 1000 / length).cast("int").alias("central")), "facts")
    entries = keep(shared.join(facts, "node"), "entries")
    drop(docs.sparkSession, path)
    pivots = keep(entries.groupBy("token").agg(F.max(F.struct("central", "node", "n", "pos")).alias("pivot")), "lists")
    verifier = Verifier(source, nodes.select("node", "at"), width, salt, repeated, keep)
    checked = keep(verifier.overlaps(keep(_pivot_pairs(entries.join(pivots, "token"), percent), "pivots")), "checked")
    return rows, entries.select("token", "node", "n", "pos"), checked, verifier, salt


def _told(entries: DataFrame, roots: DataFrame, checked: DataFrame, percent: int, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Of the pairs of sets with different roots: links that follow from the pivots' overlaps, and pairs left to count."""
    left = _block_pairs(_blocks(entries, roots, percent, keep), percent)
    done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = keep(_derived(left.join(done, ["a", "b"], "left_anti"), checked, percent, keep), "left")
    need = (F.col("na") + F.col("nb")) * percent
    open_pairs = left.where((F.col("lb") * (100 + percent) < need) & (F.col("ub") * (100 + percent) >= need)).select("a", "b", "na", "nb")
    return left.where(F.col("lb") * (100 + percent) >= need).select("a", "b"), open_pairs


def _linked_rows(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, component_id, node and root of every row; also the salt of the nodes."""
    with small_batches(docs.sparkSession):
        return _decided(docs, key, text, width, percent)


def _decided(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    paths: list[str] = []
    keep = _keeper(paths)
    rows, entries, checked, verifier, salt = _met(docs, key, text, width, percent, keep)
    links = checked.where(_linked(percent)).select("a", "b")
    roots = keep(components(links), "roots")
    sure, open_pairs = _told(entries, roots, checked, percent, keep)
    links = keep(links.unionByName(sure), "links")
    # one pair for each pair of components, then up to eight, then all that are left
    for most in (1, 8, None):
        roots = keep(components(links), "roots")
        ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        apart = open_pairs.join(ra, "a", "left").join(rb, "b", "left")
        apart = apart.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb")
        open_pairs = keep(apart, "open")
        if open_pairs.isEmpty():
            break
        turn = open_pairs
        if most is not None:
            group = Window.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy(F.xxhash64("a", "b"), "a", "b")
            turn = open_pairs.withColumn("turn", F.row_number().over(group)).where(F.col("turn") <= most)
        turn = keep(turn.select("a", "b", "na", "nb"), "turn")
        found = keep(verifier.overlaps(turn), "found")
        links = keep(links.unionByName(found.where(_linked(percent)).select("a", "b")), "links")
        open_pairs = open_pairs.select("a", "b", "na", "nb").join(turn.select("a", "b"), ["a", "b"], "left_anti")
    else:
        roots = keep(components(links), "roots")
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = keep(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first")), "first")
    out = named.join(first, "root", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"), "node", "root")
    result, _ = stored(out, "components")
    for path in paths:
        drop(spark, path)
    return result, salt


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _linked_rows(docs, key, text, width, percent)[0].select("doc_id", "n_shingles", "component_id")


def _linked_nodes(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their nodes, and all linked pairs of nodes (a < b), those within components, too."""
    paths: list[str] = []
    keep = _keeper(paths)
    with small_batches(docs.sparkSession):
        rows, entries, checked, verifier, _ = _met(docs, key, text, width, percent, keep)
        # with each set its own root no pair is passed over
        sure, open_pairs = _told(entries, entries.select("node", F.col("node").alias("root")).distinct(), checked, percent, keep)
        found = keep(verifier.overlaps(keep(open_pairs, "open")), "found")
        pairs = checked.where(_linked(percent)).select("a", "b").unionByName(sure).unionByName(found.where(_linked(percent)).select("a", "b"))
        pairs, _ = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        rows, _ = stored(rows, "rows")
    for path in paths:
        drop(docs.sparkSession, path)
    return rows, pairs


def linked_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_a and doc_b (doc_a < doc_b) of every pair of different sets that link; each set goes by its smallest doc_id."""
    rows, pairs = _linked_nodes(docs, key, text, width, percent)
    name = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"))
    pairs = pairs.join(name.select(F.col("node").alias("a"), F.col("doc").alias("x")), "a").join(name.select(F.col("node").alias("b"), F.col("doc").alias("y")), "b")
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id and n_links of every row: how many other rows it links with, copies included."""
    rows, pairs = _linked_nodes(docs, key, text, width, percent)
    held = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ways.join(held.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("near"))
    counts = held.join(near, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return rows.join(counts, "node", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _nodes(docs: DataFrame, text: str, out: str, salt: int) -> DataFrame:
    """Append the node of each row's set; null for the empty set."""

    def start() -> ChunkFunction:
        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            found, bounds = chunk_sets(data, offsets, WIDTH)
            return [pa.array(signatures(found, bounds, salt)[0], mask=np.diff(bounds) == 0)]

        return run

    return map_text(docs, text, start, [T.StructField(out, T.LongType())])


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, one of the smallest key, null keys last; rows without words stay.  All columns are kept, whatever their names."""
    docs, (key, text), restored = set_aside(docs, key, text)
    return restored(_first_of_each(docs, key, text))


def _first_of_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same for documents whose columns clash with none here."""
    # texts stand in for null keys; should two have one number, it is a repeated key like any other
    keyed = docs.withColumn("__id", F.coalesce(F.col(key).cast("long"), _stand_in(text)))
    found, salt = _linked_rows(keyed, "__id", text, WIDTH, PERCENT)
    later = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"))
    again, path = stored(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")), "again")
    if again.isEmpty():
        drop(docs.sparkSession, path)
        return keyed.join(_bounded(later.distinct()), "__id", "left_anti").select(docs.columns)
    # a repeated key says nothing about a row: there the row's own set decides
    alone = keyed.join(_bounded(later.unionByName(again).distinct()), "__id", "left_anti")
    first = found.where("node is not null").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("b"))
    first = first.select(F.col("b.doc_id").alias("__id"), F.col("b.node").alias("__node"), F.lit(True).alias("__first")).join(again, "__id", "left_semi")
    told = _nodes(keyed.join(_bounded(again), "__id", "left_semi"), text, "__node", salt).withColumn("__own", F.when(F.col("__node").isNull(), F.monotonically_increasing_id()))
    told = told.join(_bounded(first), ["__id", "__node"], "left").where("__node is null or __first").dropDuplicates(["__id", "__node", "__own"])
    return alone.select(docs.columns).unionByName(told.select(docs.columns))
