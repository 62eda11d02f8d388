"""Balanced label propagation onto shards (operator 4).

Documents with equal texts are linked.  A group's members start on shards by hash; in each
round every member moves towards the shard that holds most of its group among the shards with
room, under a quota on linked documents (capacity less load), until groups sit together;
a group that fits a shard but is still apart then is placed with the unlinked documents, in one
run, so that at most one such group is cut at each border between shards.
Members of a group are interchangeable, so the state that the rounds join and update is the
count of members by group and shard, never documents or pairs.  Unlinked documents then fill
all shards up to the law ``rows``: document counts differ by one at most.

Size is the UTF-8 bytes of the text plus 16.  Running counts are taken in two levels (sums of
hash buckets, then rows within a bucket), so no task sees more than a bucket; a group of more than
``HOT_ROWS`` members (or of a ``MOST_HOT``-th of all documents, if that is more) is dealt to several tasks.

Defined cases: a null text is linked with nothing and has size 16 and crc32 0; empty texts are
equal texts; rows with equal or null doc_id are placed row by row; a very long text is only
measured and hashed, whole; a group larger than a shard is split; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stored

SHARDS = 40
ROUNDS = 4
BUCKET_ROWS = 20_000
HOT_ROWS = 2_000  # members of a group that one task places
MOST_HOT = 100_000  # groups dealt out to several tasks, as many as are broadcast


def running(df: DataFrame, part: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Append the sum of ``value`` over the rows before this one within ``part``.

    Rows are ordered by bucket, then ``order``; equal rows in any order.
    """
    cut = df.withColumn("__bucket", bucket).withColumn("__value", value.cast("long"))
    sums = cut.groupBy(*part, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*part).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*part, "__bucket"]]
    joined = cut.alias("x").join(sums.alias("y"), keys, "left").select("x.*", "y.__before")
    inner = Window.partitionBy(*part, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__before") + F.coalesce(F.sum("__value").over(inner), F.lit(0))
    return joined.withColumn(out, total).drop("__bucket", "__value", "__before")


def propagate(cells: DataFrame, path: str, shards: int, capacity: int, rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """Rounds of moves on (g, label, n), a table stored at ``path``; the load of a label that is within capacity stays so."""
    for _ in range(rounds):
        loads = {r.label: r.n for r in cells.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        room = [max(0, capacity - loads.get(s, 0)) for s in range(shards)]
        free = F.get(F.array(*[F.lit(x).cast("long") for x in room]), F.col("label").cast("int"))
        # the shard with room that holds most of the group; ties by a hash
        weight = F.struct("n", F.xxhash64("g", "label").alias("tie"), "label", free.alias("room"))
        best = cells.where(free > 0).groupBy("g").agg(F.max(weight).alias("best"))
        state = cells.join(best, "g", "left")
        wants = F.col("best").isNotNull() & (F.struct("n", F.xxhash64("g", "label").alias("tie")) < F.struct("best.n", "best.tie"))
        state = state.select("g", "label", "n", F.when(wants, F.col("best.label")).alias("target"), F.col("best.room").alias("room"))
        movers = state.where("target is not null")
        spread = F.pmod(F.xxhash64("g"), F.lit(64))
        movers = running(movers, ["target"], spread, ["g", "label"], F.col("n"), "ahead")
        moved = F.least(F.col("n"), F.greatest(F.lit(0), F.col("room") - F.col("ahead")))
        movers = movers.withColumn("moved", moved)
        after = (
            state.where("target is null").select("g", "label", "n")
            .unionByName(movers.select("g", "label", (F.col("n") - F.col("moved")).alias("n")))
            .unionByName(movers.select("g", F.col("target").alias("label"), F.col("moved").alias("n")))
        )
        moved_cells, new_path = stored(after.where("n > 0").groupBy("g", "label").agg(F.sum("n").alias("n")), "cells")
        drop(cells.sparkSession, path)
        cells, path = moved_cells, new_path
    return cells, path


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and linked (members of the text's group)."""
    value = F.col(text).cast("string")
    base = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(value.cast("binary")).alias("g"),
    )
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        paths.append(path)
        return out

    base = keep(base.withColumn("row", F.monotonically_increasing_id()), "base")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    capacity = total // shards
    cells = base.where("g is not null").groupBy("g", F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    cells = keep(cells, "first")
    sizes = keep(cells.groupBy("g").agg(F.sum("n").alias("members")).where("members > 1"), "sizes")
    cells, path = propagate(*stored(cells.join(sizes, "g").select("g", "label", "n"), "cells"), shards, capacity)
    paths.append(path)
    # set free again: small groups that are still apart, and what a label has beyond its capacity
    state = cells.groupBy("g").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("whole"))
    cells = cells.join(state, "g").where((F.col("labels") == 1) | (F.col("whole") > capacity))
    kept = running(cells, ["label"], F.pmod(F.xxhash64("g"), F.lit(64)), ["g"], F.col("n"), "ahead")
    room = F.greatest(F.lit(0), F.lit(capacity) - F.col("ahead"))
    fits = F.when(F.col("whole") > capacity, F.least("n", room)).when(F.col("n") <= room, F.col("n")).otherwise(0)
    kept = kept.withColumn("n", fits).where("n > 0")
    kept = keep(kept.select("g", "label", "n"), "kept")
    loads = {r.label: r.n for r in kept.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    upto = Window.partitionBy("g").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    ends = kept.withColumn("end", F.sum("n").over(upto)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("end", "label"))).alias("ends"))
    # hot groups are dealt out on both sides; there are fewer than MOST_HOT of them
    limit = max(HOT_ROWS, -(-total // MOST_HOT))
    ways = F.ceil(F.col("members") / limit).cast("int")
    hot = sizes.where(F.col("members") > limit).select("g", ways.alias("ways"))
    seats = keep(sizes.join(ends, "g", "left").select("*", F.explode(F.sequence(F.lit(0), ways - 1)).alias("deal")), "seats")
    dealt = base.where("g is not null").join(F.broadcast(hot), "g", "left").withColumn("deal", F.pmod(F.xxhash64("row"), F.coalesce("ways", F.lit(1))).cast("int"))
    grouped = dealt.join(seats, ["g", "deal"], "left")
    linked = running(grouped.where("members is not null"), ["g"], F.col("deal"), ["doc_id", "row"], F.lit(1), "turn")
    at = F.filter("ends", lambda e: e["end"] > F.col("turn"))
    linked = linked.select("doc_id", "size", "text_crc32", "g", "row", "members", F.get(at, F.lit(0))["label"].alias("shard"))
    lone = grouped.where("members is null").select(base.columns).unionByName(base.where("g is null"))
    single = lone.select("doc_id", "size", "text_crc32", "g", "row", F.lit(1).cast("long").alias("members"), F.lit(None).cast("int").alias("shard"))
    placed = keep(linked.unionByName(single), "placed")
    # the rest fills the shards; a group that found no room stays together as far as it can
    buckets = max(1, total // BUCKET_ROWS)
    where = F.pmod(F.xxhash64("g") + F.pmod(F.xxhash64("row"), F.ceil(F.col("members") / BUCKET_ROWS)), F.lit(buckets))
    where = F.when(F.col("g").isNull(), F.pmod(F.xxhash64("row"), F.lit(buckets))).otherwise(where)
    rest = running(placed.where("shard is null").withColumn("one", F.lit(1)), ["one"], where, ["g", "doc_id", "row"], F.lit(1), "turn")
    room = list(itertools.accumulate(q - loads.get(s, 0) for s, q in enumerate(quota)))
    filled = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in room]), lambda end: end <= F.col("turn")))
    rest = rest.withColumn("shard", filled.cast("int")).drop("one", "turn")
    full = keep(placed.where("shard is not null").unionByName(rest), "full")
    slot_bucket = F.pmod(F.xxhash64("row"), F.lit(max(1, capacity // BUCKET_ROWS)))
    out = running(full, ["shard"], slot_bucket, ["doc_id", "row"], F.lit(1), "slot")
    out = out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("members").alias("linked")
    )
    result, _ = stored(out, "shards")
    for path in paths:
        drop(docs.sparkSession, path)
    return result
