"""Operators over time, multisets and stateful streams, against brute force and by hand."""

import collections
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanquery import inputs
from spanquery.operators import multisets, rollups, similar, temporal
from spanquery.streaming import stateful

T0 = dt.datetime(2026, 1, 1)
NOW = {"availableNow": True}
N = {"n": ("count", None), "bad": ("count", "v > 5"), "total": ("total", "v"), "most": ("max", "v"), "least": ("min", "v")}


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def measured(values):
    some = [v for v in values if v is not None]
    return len(values), sum(v > 5 for v in some), float(sum(some)) if some else None, max(some, default=None), min(some, default=None)


@pytest.fixture(scope="module")
def log():
    """(key, minutes, value): a hot key, null keys, times and values, ties, and days without rows."""
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, *[rng.randint(0, 4000) for _ in range(30)]]), rng.choice([None, *range(10)])) for _ in range(400)]
    return [*rows, ("hot", 20_000, 3), ("hot", 20_000, 4), ("hot", -7000, 1)]


def frame(spark, rows, names="k string, ts timestamp_ntz, v int"):
    return spark.createDataFrame([(k, at(m), v) for k, m, v in rows], names)


@pytest.mark.parametrize("strict,forward,within", [(False, False, None), (True, False, None), (False, True, 90), (True, True, None), (False, False, 0)])
def test_as_of_against_brute_force(spark, log, strict, forward, within):
    left, right = log[::2], log[1::2]
    names = "k string, ts timestamp_ntz, v int"
    got = temporal.as_of(
        frame(spark, [(k, m, i) for i, (k, m, _) in enumerate(left)], names), frame(spark, [(k, m, i) for i, (k, m, _) in enumerate(right)], names).withColumnRenamed("ts", "since"),
        ["k"], "ts", "since", {"v": "found", "since": "since"}, tie=["v"], within=None if within is None else f"{within} minutes", strict=strict, forward=forward, bucket="3 hours",
    )
    assert got.columns == ["k", "ts", "v", "found", "since"]
    want = []
    for i, (k, m, _) in enumerate(left):
        near = [(n, j) for j, (key, n, _) in enumerate(right) if None not in (k, m, n) and key == k and (n >= m if forward else n <= m) and not (strict and n == m)]
        best = (min if forward else max)(near, key=lambda x: (x[0], -x[1] if forward else x[1]), default=None) if near else None
        if best and within is not None and abs(best[0] - m) > within:
            best = None
        want.append((i, None if best is None else best[1], None if best is None else at(best[0])))
    have = sorted((r.v, r.found, r.since) for r in got.collect())
    if forward:  # of rows of one time, either end of the tie's order may stand first
        assert [(i, s) for i, _, s in have] == [(i, s) for i, _, s in want]
    else:
        assert have == want


def test_as_of_without_keys_or_rows(spark):
    left, right = frame(spark, [("a", 5, 1), ("b", 500, 2)]), frame(spark, [("x", 3, 7), ("x", 4, None)])
    assert [(r.v, r.got) for r in temporal.as_of(left, right, [], "ts", "ts", {"v": "got"}, tie=["v"]).orderBy("v").collect()] == [(1, None), (2, None)]
    assert [r.got for r in temporal.as_of(left, right.where("false"), ["k"], "ts", "ts", {"v": "got"}).collect()] == [None, None]
    assert temporal.as_of(left.where("false"), right, ["k"], "ts", "ts", {"v": "got"}).isEmpty()
    clash = left.withColumnsRenamed({"v": "__t"}).withColumn("__bucket", F.lit("mine")).withColumn("__found", F.lit(1)).withColumn("c0", F.lit(9))
    assert [(r["__t"], r["__bucket"], r["__found"], r.c0, r.got) for r in temporal.as_of(clash, frame(spark, [("a", 4, 8)]), ["k"], "ts", "ts", {"v": "got"}).orderBy("__t").collect()] == [(1, "mine", 1, 9, 8), (2, "mine", 1, 9, None)]


def test_as_of_deals_a_hot_key_out(spark):
    left = spark.range(5000).select(F.lit("hot").alias("k"), (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 60)).alias("ts"), "id")
    plan = temporal.as_of(left, left, ["k"], "ts", "ts", {"id": "found"})._jdf.queryExecution().toString()
    assert "hashpartitioning(__k0" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_previous_against_brute_force(spark, log):
    rows = frame(spark, [(k, m, i) for i, (k, m, _) in enumerate(log)])
    got = {r.v: r.before for r in temporal.previous(rows, ["k"], "ts", {"v": "before"}, ["v"], bucket="2 hours").collect()}
    want, last = {}, {}
    for k, m, i in sorted(((k, m, i) for i, (k, m, _) in enumerate(log)), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = last.get(k)
        last[k] = i
    assert got == want


def test_rolling_counts_against_brute_force(spark, log):
    rows = frame(spark, [(k, m, i) for i, (k, m, _) in enumerate(log)])
    for spread in (1, 4):
        got = {r.v: (r.n, r.even) for r in temporal.rolling_counts(rows, ["k"], "ts", "45 minutes", {"n": F.lit(True), "even": F.col("v") % 2 == 0}, spread).collect()}
        for i, (k, m, _) in enumerate(log):
            near = [j for j, (key, n, _) in enumerate(log) if None not in (m, n) and key == k and m - 45 <= n <= m]
            assert got[i] == ((None, None) if m is None else (len(near), sum(j % 2 == 0 for j in near)))


def test_hopping_and_cumulating_against_brute_force(spark, log):
    rows = frame(spark, log)
    groups = collections.defaultdict(list)
    for k, m, v in log:
        if m is not None:
            for start in range(m // 20 * 20 - 40, m // 20 * 20 + 1, 20):
                groups[k, at(start)].append(v)
    got = {(r.k, r.window_start): (r.n, r.bad, r.total, r.most, r.least) for r in temporal.hopping(rows, ["k"], "ts", "1 hour", "20 minutes", N).collect()}
    assert got == {g: measured(v) for g, v in groups.items()}
    groups.clear()
    for k, m, v in log:
        if m is not None:
            for end in range(m // 30 * 30 + 30, m // 120 * 120 + 121, 30):
                groups[k, at(m // 120 * 120), at(end)].append(v)
    got = {(r.k, r.window_start, r.window_end): (r.n, r.bad, r.total, r.most, r.least) for r in temporal.cumulating(rows, ["k"], "ts", "2 hours", "30 minutes", N).collect()}
    assert got == {g: measured(v) for g, v in groups.items()}
    with pytest.raises(ValueError):
        temporal.hopping(rows, ["k"], "ts", "1 hour", "25 minutes", N)


@pytest.mark.parametrize("bucket", ["1 day", "1 hour"])
def test_sessions_are_those_of_session_window(spark, log, bucket):
    rows = frame(spark, [*log, ("edge", 0, 1), ("edge", 60, 2), ("edge", 119, 3), ("edge", 1439, 4), ("edge", 1441, 5)])
    got = sorted(map(str, temporal.sessions(rows, ["k"], "ts", "1 hour", N, bucket).select("k", "session_start", "session_end", "n", "total").collect()))
    want = rows.groupBy("k", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total")).select("k", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
    assert got == sorted(map(str, want.collect())) and len(got) > 20


def test_grouping_sets_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["p", None]), rng.randint(0, 9)) for _ in range(80)]
    got = {(r.grain, r.a, r.b): r.n for r in rollups.grouping_sets(spark.createDataFrame(rows, "a string, b string, v int"), ["a", "b"], rollups.cube_sets(["a", "b"]), {"n": ("count", None)}).collect()}
    want = collections.Counter()
    for a, b, _ in rows:
        want.update([("a,b", a, b), ("a", a, None), ("b", None, b), ("", None, None)])
    assert got == want
    assert rollups.rollup_sets(["a", "b"]) == [("a", "b"), ("a",), ()]


def test_sketches_merge_over_windows(spark):
    rows = spark.range(60_000).select(F.expr("case when id % 3 = 0 then 'm' else 'n' end").alias("model"), (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 240).cast("int"))).alias("ts"), (F.col("id") % 20_000).alias("who"))
    sketches = rollups.distinct_sketches(rows, ["model"], "ts", "1 day", "who")
    for first, last in ((None, None), (T0 + dt.timedelta(days=2), T0 + dt.timedelta(days=5))):
        told = {r.model: r.estimate for r in rollups.distinct_over(sketches, ["model"], first, last).collect()}
        some = rows if first is None else rows.where((F.col("ts") >= F.lit(str(first)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(str(last)).cast("timestamp_ntz")))
        exact = {r.model: r.n for r in some.groupBy("model").agg(F.count_distinct("who").alias("n")).collect()}
        assert all(abs(told[m] - n) <= 0.05 * n for m, n in exact.items()) and set(told) == set(exact)
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 10_000


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, i=i, x=x, row=row: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_nearest_names_against_all_pairs(spark, most):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    known, told = ["", "a", "ab", *[word(rng.randint(2, 7)) for _ in range(30)], None], [None, "", "zzzzzz", "ba", *[word(rng.randint(1, 7)) for _ in range(60)]]
    got = similar.nearest_names(spark.createDataFrame(list(enumerate(told)), "i int, name string"), spark.createDataFrame([(k,) for k in known], "name string"), "name", "name", most)
    for r in got.collect():
        near = sorted((distance(r.name, k), k) for k in known if k is not None) if r.name is not None else []
        assert (r.distance, r.nearest) == (near[0] if near and near[0][0] <= most else (None, None))
    assert got.count() == len(told)


def test_multisets_are_those_of_the_built_ins(spark):
    rng = random.Random(3)
    table = lambda n: spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([1, None, 2])) for _ in range(n)], "x string, y int")
    left, right = table(70), table(50)
    count = lambda df: collections.Counter((r.x, r.y) for r in df.collect())
    assert count(multisets.except_all(left, right, ["x", "y"])) == count(left.exceptAll(right)) and count(multisets.intersect_all(left, right, ["x", "y"])) == count(left.intersectAll(right))
    many = spark.range(25_001).select(F.lit("a").alias("x"), F.lit(1).alias("y"))
    assert multisets.except_all(many, right.where("false"), ["x", "y"]).count() == 25_001
    row = multisets.archive_difference(left, right, ["x", "y"], []).first()
    assert (row.only_left, row.only_right, row.both) == (left.exceptAll(right).count(), right.exceptAll(left).count(), left.intersectAll(right).count())


# streams


class Feed:
    """Rows written to a folder, file by file, and a stream over it."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def write(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def test_interval_join_across_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "kind string, id string, ts timestamp")

    def run():
        rows = feed.stream()
        parents = rows.where("kind = 'p'").select(F.col("id").alias("parent"), F.col("ts").alias("parent_ts"))
        children = rows.where("kind = 'c'").select("id", "ts")
        joined = stateful.interval_join(parents, children, {"parent": "id"}, "parent_ts", "ts", "10 minutes", delay="1 minute")
        stateful.append(joined, str(tmp_path / "out"), str(tmp_path / "ckpt"), NOW).awaitTermination()
        return sorted((r.parent, r.ts) for r in spark.read.schema(joined.schema).parquet(str(tmp_path / "out")).where("ts is not null").collect()), sorted(r.parent for r in spark.read.schema(joined.schema).parquet(str(tmp_path / "out")).where("ts is null").collect())

    feed.write([("p", "a", at(0)), ("p", "b", at(1)), ("p", "d", at(2)), ("c", "a", at(3)), ("c", "a", at(10)), ("c", "a", at(11))])
    assert run() == ([("a", at(3)), ("a", at(10))], [])
    feed.write([("c", "b", at(9)), ("c", "d", at(2)), ("c", "d", at(1)), ("p", "e", at(40)), ("c", "x", at(40))])
    assert run() == ([("a", at(3)), ("a", at(10)), ("b", at(9)), ("d", at(2))], [])
    feed.write([("p", "f", at(100)), ("c", "y", at(100)), ("c", "a", at(4))])  # the last comes too late
    assert run() == ([("a", at(3)), ("a", at(10)), ("b", at(9)), ("d", at(2))], ["e"])
    assert run()[1] == ["e"]
    with pytest.raises(ValueError):
        stateful.interval_join(feed.stream(), feed.stream(), {"id": "id"}, "ts", "ts", "1 minute")


def test_session_and_hopping_streams_are_the_batch_forms(spark, tmp_path, log):
    rows = sorted((k or "none", m, v) for k, m, v in log if m is not None and 0 <= m <= 4000)
    feed = Feed(spark, tmp_path / "in", "k string, ts timestamp, v int")
    schedule = sorted(rows, key=lambda r: r[1])
    for n in range(3):
        feed.write([(k, at(m), v) for k, m, v in schedule[n::3]] if n < 2 else [*[(k, at(m), v) for k, m, v in schedule[2::3]], ("end", at(9000), 1)])
    batch = spark.read.parquet(feed.path)
    for name, made, whole in (
        ("s", stateful.session_windows(feed.stream(), ["k"], "ts", "1 hour", N), temporal.sessions(batch, ["k"], "ts", "1 hour", N)),
        ("h", stateful.hopping_windows(feed.stream(), ["k"], "ts", "1 hour", "20 minutes", N), temporal.hopping(batch, ["k"], "ts", "1 hour", "20 minutes", N)),
    ):
        stateful.append(made, str(tmp_path / name), str(tmp_path / f"{name}_ckpt"), NOW).awaitTermination()
        got, want = spark.read.parquet(str(tmp_path / name)), whole.where("k <> 'end'").select(made.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_traces_close_by_root_and_by_silence(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "trace_id string, parent_span_id string, status string, ts timestamp")

    def run():
        stateful.append(stateful.closed_traces(feed.stream(), "30 minutes", "1 minute"), str(tmp_path / "out"), str(tmp_path / "ckpt"), NOW).awaitTermination()
        return sorted((r.trace_id, r.reason, r.spans, r.errors, r.first_ts, r.last_ts) for r in spark.read.schema(stateful.TRACE).parquet(str(tmp_path / "out")).collect())

    feed.write([("a", "x", "ok", at(0)), ("a", "x", "error", at(1)), ("b", "x", "ok", at(2)), ("c", None, "ok", at(3))])
    done = [("c", "root", 1, 0, at(3), at(3))]
    assert run() == done
    feed.write([("a", None, "ok", at(4)), ("b", "x", "error", at(20)), ("d", "x", "ok", at(20))])
    done = sorted([*done, ("a", "root", 3, 1, at(0), at(4))])
    assert run() == done
    feed.write([("c", "x", "ok", at(40)), ("e", None, "ok", at(60))])  # c again, after its root
    done = sorted([*done, ("b", "silence", 2, 1, at(2), at(20)), ("d", "silence", 1, 0, at(20), at(20)), ("e", "root", 1, 0, at(60), at(60))])
    assert run() == done
    feed.write([("f", None, "ok", at(200))])
    assert run() == sorted([*done, ("c", "silence", 1, 0, at(40), at(40)), ("f", "root", 1, 0, at(200), at(200))])


def test_state_of_traces_is_a_row_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 8, raising=False)
    feed = Feed(spark, tmp_path / "in", "trace_id string, parent_span_id string, status string, ts timestamp")

    def run(rows):
        feed.write(rows)
        job = stateful.append(stateful.closed_traces(feed.stream(), "30 minutes", "1 minute"), str(tmp_path / "out"), str(tmp_path / "ckpt"), NOW)
        job.awaitTermination()
        found = spark.read.schema(stateful.TRACE).parquet(str(tmp_path / "out")).collect()
        return sorted((r.trace_id or "", r.reason, r.spans, r.errors, r.first_ts, r.last_ts) for r in found), job.lastProgress["stateOperators"][0]["numRowsTotal"]

    done, held = run([(f"t{i:03}", "x", "error" if i % 2 else None, at(i % 7)) for i in range(200)] + [(None, "x", "ok", at(2)), (None, None, "ok", at(1))])
    assert done == [("", "root", 2, 0, at(1), at(2))] and 0 < held <= 8
    # half of them come again and end, by their roots or later; the others have been silent by then
    done, held = run([(f"t{i:03}", None if i < 50 else "x", "ok", at(20)) for i in range(100)] + [("u", "x", "ok", at(39))])
    want = [(f"t{i:03}", "root", 2, i % 2, at(i % 7), at(20)) for i in range(50)] + [(f"t{i:03}", "silence", 1, i % 2, at(i % 7), at(i % 7)) for i in range(100, 200)]
    assert done == sorted([("", "root", 2, 0, at(1), at(2)), *want]) and 0 < held <= 8
    want += [(f"t{i:03}", "silence", 2, i % 2, at(i % 7), at(20)) for i in range(50, 100)] + [("u", "silence", 1, 0, at(39), at(39)), ("v", "root", 1, 0, at(500), at(500))]
    assert run([("v", None, "ok", at(500))]) == (sorted([("", "root", 2, 0, at(1), at(2)), *want]), 0)


def test_partitions_have_watermarks_of_their_own(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "p int, id string, ts timestamp")
    out, ckpt, n = str(tmp_path / "out"), str(tmp_path / "ckpt"), {"n": ("count", None)}

    def run(rows):
        feed.write([(p, i, at(m)) for p, i, m in rows])
        stateful.partitioned_windows(feed.stream(), out, ckpt, "p", [], "ts", "5 minutes", n, "1 minute", 2, NOW).awaitTermination()
        closed = sorted((r.window_start, r.n) for r in stateful.closed_windows(spark, out, "5 minutes", [], n).collect())
        return [((w - T0).seconds // 60, c) for w, c in closed], sorted(r.id for r in stateful.put_aside(spark, out).collect())

    # the second partition lags: one maximum over both would close windows that it still fills
    assert run([(0, "a", 1), (0, "b", 100), (1, "c", 2)]) == ([], [])
    assert run([(1, "d", 3), (1, "e", 30), (0, "f", 101)]) == ([(0, 3)], [])
    assert run([(1, "late", 4), (1, "g", 31), (0, "h", 50), (0, "timeless", None)]) == ([(0, 3)], ["late", "timeless"])
    # the second partition falls silent, and is idle after two batches
    assert run([(0, "i", 120)]) == ([(0, 3)], ["late", "timeless"])
    assert run([(0, "j", 121)]) == ([(0, 3), (30, 2), (50, 1), (100, 2)], ["late", "timeless"])
    # it is back, behind the watermark
    assert run([(1, "k", 32), (1, "l", 300), (0, "m", 301)]) == ([(0, 3), (30, 2), (50, 1), (100, 2), (120, 2)], ["k", "late", "timeless"])
    rows = spark.read.parquet(feed.path)
    counted = spark.read.parquet(f"{out}/windows").where("closed = 'true' or batch = 5").agg(F.sum("n")).first()[0]
    assert counted + stateful.put_aside(spark, out).count() == rows.count()


def test_a_replayed_batch_writes_the_same_again(spark, tmp_path):
    """A failure between the writes of a batch and its commit: the checkpoint's last commit is taken back."""
    feed = Feed(spark, tmp_path / "in", "p int, id string, ts timestamp")
    out, ckpt, n = str(tmp_path / "out"), tmp_path / "ckpt", {"n": ("count", None)}
    run = lambda: stateful.partitioned_windows(feed.stream(), out, str(ckpt), "p", [], "ts", "5 minutes", n, "1 minute", 2, NOW).awaitTermination()
    state = lambda: (sorted(map(str, stateful.closed_windows(spark, out, "5 minutes", [], n).collect())), sorted(map(str, stateful.put_aside(spark, out).collect())))
    for rows in ([(0, "a", 1), (0, "b", 30)], [(0, "late", 2), (0, "c", 60)], [(0, "d", 31), (0, "e", 90)]):
        feed.write([(p, i, at(m)) for p, i, m in rows])
        run()
    before = state()
    for name in ("2", ".2.crc"):
        (ckpt / "commits" / name).unlink(missing_ok=True)
    run()
    assert state() == before and len(before[0]) == 3 and len(before[1]) == 2


def test_the_archive_follows_its_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(10).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert inputs.spans(spark, str(tmp_path)).count() == 10
    path = inputs.archive(spark, str(tmp_path))[0]
    assert inputs.archive(spark, str(tmp_path))[0] == path
    events.limit(30).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    spark.catalog.refreshByPath(str(tmp_path))
    assert inputs.spans(spark, str(tmp_path)).count() == 30 and inputs.archive(spark, str(tmp_path))[0] != path
    inputs.forget(spark, str(tmp_path))
