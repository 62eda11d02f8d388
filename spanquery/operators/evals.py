"""Evaluation: retrieval hits, citations, run metrics, baselines, gates, agreement and budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import KEY_PATTERN, approx_tokens, basename, collapse, stem
from ..functions.stats import INDEX, exact_mean, exact_sum, pearson, quantiles, rate, with_quantiles

#: Words of a path that identify nothing; what is gated, its floors for two runs and its
#: thresholds for one; what must be equal for runs to be compared.
CITATION_STOP_WORDS = ("index", "docs", "doc", "overview", "intro", "common", "config", "configuration", "content", "the", "and", "with", "from", "into")
GATED = ("faithfulness_mean", "hit_at_5_rate", "citation_ok_rate")
FLOORS = {"faithfulness_mean": 0.20, "hit_at_5_rate": 0.08}
DECLARED = {"faithfulness_mean": 0.30, "hit_at_5_rate": 0.10, "citation_ok_rate": 0.0}
PINNED = ("dataset_version", "corpus_version", "prompt_version", "judge_model", "n")
MAX_PARSE_FAILURES = 2
CI_SUBSET = 25
NOT_IN_CORPUS = "(not in the corpus)"


def prefix_hit(paths: Column, prefixes: Column) -> Column:
    """Whether any path starts with any expected prefix."""
    return F.exists(paths, lambda p: F.exists(prefixes, lambda e: p.startswith(e)))


def hit_at_k(calls: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """key, hit_at_k and any_call_hit; calls has key, call_index and paths, golden key and expected_sources.

    The first search call decides.  NULL means that no search was made, false that it found
    nothing expected, an empty result included.
    """
    joined = calls.join(golden.select("key", "expected_sources"), "key")
    hits = joined.select("key", "call_index", prefix_hit(F.slice("paths", 1, k), F.col("expected_sources")).alias("hit"))
    by_key = hits.groupBy("key").agg(F.min_by("hit", "call_index").alias("hit_at_k"), F.bool_or("hit").alias("any_call_hit"))
    return golden.select("key").join(by_key, "key", "left")


def citation_tokens(path: Column, section: Column | None = None) -> Column:
    """What names a retrieved chunk: its file name, the stem of that and the stem's words, and the last
    heading of its section; lower-cased, of four characters or more, without the stop words."""
    base = stem(path)
    found = F.concat(F.array(basename(path), base), F.split(F.translate(base, "-", "_"), "_"))
    if section is not None:
        found = F.concat(found, F.array(F.trim(F.element_at(F.split(section, " > "), -1))))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: (F.length(w) >= 4) & ~w.isin(*CITATION_STOP_WORDS)))


def citation_ok(answer: Column, retrieved: Column) -> Column:
    """Whether the answer names any of the retrieved chunks, an array of (source_path, section_path); false without any."""
    text = F.lower(collapse(answer))
    named = F.flatten(F.transform(retrieved, lambda r: citation_tokens(r["source_path"], r["section_path"])))
    return F.coalesce(F.exists(named, lambda w: F.contains(text, w)), F.lit(False))


def run_metrics(results: DataFrame) -> DataFrame:
    """One row of metrics over graded rows; NULL where nothing was measured.

    Rows with an error count only as errors; rows whose hit_source is 'n/a' stay out of the hit
    rates; a search that was not made is a miss in hit_at_5_rate and left out of hit_at_5_given_search;
    an unmeasured citation is a miss; unmeasured scores and costs are left out.
    """
    ok = F.col("error").isNull()
    only = lambda c: F.when(ok, F.col(c))
    hit = F.when(ok & ~F.col("hit_source").eqNullSafe("n/a"), F.struct("hit_at_k"))
    searched = hit["hit_at_k"]
    length = F.when(ok & (F.col("answer_len_tokens") != 0), F.col("answer_len_tokens"))
    facts = results.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("errors"), F.count_if(F.col("judge_parse_ok") == F.lit(False)).alias("parse_failures"),
        F.avg(only("faithfulness")).alias("faithfulness_mean"), F.avg(only("answer_quality")).alias("answer_quality_mean"),
        rate(F.when(hit.isNotNull(), F.coalesce(searched, F.lit(False))), None).alias("hit_at_5_rate"), rate(searched, None).alias("hit_at_5_given_search"),
        rate(F.when(ok, F.coalesce("citation_ok", F.lit(False))), None).alias("citation_ok_rate"), exact_mean(only("cost_usd")).alias("mean_cost_usd"),
        F.round(pearson(length, only("answer_quality")), 9).alias("length_r_quality"), F.round(pearson(length, only("faithfulness")), 9).alias("length_r_faithfulness"),
        F.coalesce(exact_sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    )
    return with_quantiles(facts, quantiles(results.where(ok), [], "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}, INDEX), [])


def long_metrics(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """metric and value rows of one row of metrics."""
    names = names or [c for c in metrics.columns if c not in ("rows", "errors", "parse_failures", "total_cost_usd")]
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")


def _by_metric(values: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, v in values.items()])


def baseline(runs: DataFrame) -> DataFrame:
    """metric, mean, sigma and threshold from (run, metric, value) rows of one run or two.

    Two runs give sigma = |a - b| / sqrt(2) and max(2 sigma, floor) for metrics with a floor; one run
    has measured no sigma and gets the declared thresholds.
    """
    spread = (F.max("value") - F.min("value")) / F.sqrt(F.lit(2.0))
    out = runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.when(F.count("value") == 2, spread).alias("sigma"), F.count_distinct("run").alias("__runs"))
    two = F.when(_by_metric(FLOORS).isNotNull(), F.greatest(2 * F.coalesce("sigma", F.lit(0.0)), _by_metric(FLOORS)))
    return out.select("metric", "mean", "sigma", F.when(F.col("__runs") > 1, two).otherwise(_by_metric(DECLARED)).alias("threshold"))


def gate(base: DataFrame, run: DataFrame) -> DataFrame:
    """Each gated metric with its verdict: ok, regressed (below the mean by more than the threshold; an
    improvement is ok) or missing, a regression too.  A metric without a threshold has the declared one."""
    names = base.select(F.explode(F.array(*map(F.lit, GATED))).alias("metric")).distinct()
    joined = names.join(base, "metric", "left").join(run.select("metric", F.col("value").alias("current")), "metric", "left")
    joined = joined.withColumns({"threshold": F.coalesce("threshold", _by_metric(DECLARED)), "delta": F.col("current") - F.col("mean")})
    verdict = F.when(F.col("delta").isNull(), "missing").when(F.col("delta") < -F.col("threshold"), "regressed").otherwise("ok")
    return joined.select("metric", "mean", "threshold", "current", "delta", verdict.alias("verdict"))


def config_drift(base: DataFrame, run: DataFrame, pinned: tuple[str, ...] = PINNED) -> DataFrame:
    """Pinned keys whose values differ, from (name, value) rows."""
    a = base.where(F.col("name").isin(*pinned)).select("name", F.col("value").alias("baseline"))
    b = run.where(F.col("name").isin(*pinned)).select("name", F.col("value").alias("current"))
    return a.join(b, "name", "full").where(~F.col("baseline").eqNullSafe(F.col("current")))


def exit_code(verdicts: DataFrame | None, metrics: DataFrame | None, drift: DataFrame | None = None, allow_drift: bool = False) -> int:
    """0 passed, 1 a regression or drift, 2 nothing to compare, 3 the harness failed (which goes before 1)."""
    m = None if metrics is None else metrics.first()
    if verdicts is None or m is None or not m.rows:
        return 2
    if m.errors or m.parse_failures > MAX_PARSE_FAILURES:
        return 3
    if drift is not None and not allow_drift and not drift.isEmpty():
        return 1
    return int(not verdicts.where("verdict <> 'ok'").isEmpty())


def latest_finished(runs: DataFrame) -> DataFrame:
    """The finished run of the greatest id; empty if none has finished."""
    return runs.where("finished_at is not null").orderBy(F.desc("id")).limit(1)


def with_prompt_version(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Runs with the version string of their prompt_version_id, NULL where that is unknown."""
    known = versions.select(F.col("prompt_version_id").alias("__id"), F.col("version").alias("prompt_version"))
    return runs.join(known, F.col("prompt_version_id") == F.col("__id"), "left").drop("__id")


def stored_run(runs: DataFrame, results: DataFrame, versions: DataFrame, run: int | str = "latest") -> tuple[DataFrame, DataFrame]:
    """(name, value) rows of a run's configuration, n its number of results, and its row of metrics;
    ``LookupError`` where there is no such run or it has no results."""
    row = (latest_finished(runs) if run == "latest" else runs.where(F.col("id") == int(run))).select("id").first()
    if row is None:
        raise LookupError("no finished run" if run == "latest" else f"no run {run}")
    own = results.where(F.col("eval_run_id") == row.id)
    metrics = run_metrics(own)
    if not metrics.first().rows:
        raise LookupError(f"run {row.id} has no results")
    config = with_prompt_version(runs.where(F.col("id") == row.id), versions).join(F.broadcast(own.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))
    names = [c for c in config.columns if c not in ("prompt_version_id", "started_at", "finished_at")]
    return config.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*"), metrics


def agreement(pairs: DataFrame, judge: str = "judge", human: str = "human") -> DataFrame:
    """One row: exact and within-one agreement and the mean signed difference (judge - human)."""
    both = pairs.where(F.col(judge).isNotNull() & F.col(human).isNotNull())
    d = F.col(judge) - F.col(human)
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.avg((d == 0).cast("int")).alias("exact"), F.avg((F.abs(d) <= 1).cast("int")).alias("within_one"), F.avg(d).alias("mean_diff"))


def confusion(pairs: DataFrame, judge: str = "judge", human: str = "human") -> DataFrame:
    return pairs.where(F.col(judge).isNotNull() & F.col(human).isNotNull()).groupBy(judge, human).agg(F.count(F.lit(1)).alias("n"))


def distinct_passages(passages: DataFrame, key: str = "key") -> DataFrame:
    """First occurrence of each chunk of an example, in order, renumbered from 0."""
    first = passages.groupBy(key, "chunk_id").agg(F.min("pos").alias("first_pos"))
    order = Window.partitionBy(key).orderBy("first_pos", "chunk_id")
    return first.select(key, "chunk_id", (F.row_number().over(order) - 1).alias("pos"))


def golden_violations(golden: DataFrame, projects: tuple[str, ...], types: tuple[str, ...], difficulties: tuple[str, ...]) -> DataFrame:
    """key and rule of everything wrong in a golden set; a rule whose column is missing is left out."""
    sources = F.coalesce("expected_sources", F.array().cast("array<string>"))
    under = F.exists(sources, lambda s: F.col("written_from").startswith(s))
    rules = {
        "key": ~F.coalesce(F.col("key").rlike(KEY_PATTERN), F.lit(False)),
        "key of another project": ~F.startswith(F.col("key"), F.concat(F.col("project"), F.lit("-"))),
        "project": ~F.col("project").isin(*projects),
        "type": ~F.col("type").isin(*types),
        "difficulty": ~F.col("difficulty").isin(*difficulties),
        "answerable": F.col("answerable") != (F.size(sources) > 0),
        "written_from": F.col("written_from").isNotNull() & F.col("answerable") & ~under,
        "blank question": F.coalesce(F.length(F.trim("question")), F.lit(0)) == 0,
        "blank written_from": F.coalesce(F.length(F.trim("written_from")), F.lit(0)) == 0,
        "unanswerable": ~F.col("answerable") & (F.col("written_from") != NOT_IN_CORPUS),
    }
    if "expected_answer" in golden.columns:
        rules["blank expected_answer"] = F.coalesce(F.length(F.trim("expected_answer")), F.lit(0)) == 0
    w = Window.partitionBy("key")
    checks = [F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()] + [F.when(F.col("__n") > 1, F.lit("duplicate key"))]
    out = golden.withColumn("__n", F.count(F.lit(1)).over(w)).select("key", F.explode(F.array_compact(F.array(*checks))).alias("rule"))
    return out.distinct()


def unresolved_sources(golden: DataFrame, corpus: DataFrame) -> DataFrame:
    """Expected prefixes under which the corpus has no path.  The corpus's paths are cut at each
    slash, so that the prefixes meet them in an equi-join; a prefix that ends inside a name is
    compared with the paths of its folder."""
    wanted = golden.select("key", F.explode("expected_sources").alias("prefix")).withColumn("folder", F.regexp_extract("prefix", "^(.*/)?", 0))
    parts = F.split("source_path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))
    paths = corpus.select("source_path").distinct().select("source_path", F.explode(folders).alias("folder"))
    found = wanted.join(paths, (wanted["folder"] == paths["folder"]) & F.col("source_path").startswith(F.col("prefix")), "left_semi")
    return wanted.select("key", "prefix").join(found.select("key", "prefix"), ["key", "prefix"], "left_anti")


def unwritten_sources(golden: DataFrame, corpus: DataFrame) -> DataFrame:
    """key and path of answerable examples that were written from a file that the corpus does not have."""
    wanted = golden.where("answerable").select("key", F.substring_index("written_from", "#", 1).alias("source_path"))
    return wanted.join(corpus.select("source_path").distinct(), "source_path", "left_anti").select("key", "source_path")


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows taken round-robin over the strata, each in a seeded order; the sampling is the feature.
    No stratum gives more than n, which is said before the ranks are used, so that they stop there."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key)
    return rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def stratification(golden: DataFrame, axes: tuple[str, ...] = ("project", "type", "difficulty")) -> DataFrame:
    """Counts by axis, value and ci."""
    return golden.unpivot(["ci"], list(axes), "axis", "value").groupBy("axis", "value", "ci").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Budget:
    """Spend against a cap; the first observation is where it starts."""

    cap_usd: float
    start_usd: float | None = None

    def check(self, observed_usd: float, planned_usd: float = 0.0) -> bool:
        """Whether what was spent since the start, with what is planned, stays within the cap."""
        if self.start_usd is None:
            self.start_usd = observed_usd
        return observed_usd - self.start_usd + planned_usd <= self.cap_usd


def spend_ledger(entries: DataFrame, cap_usd: float) -> DataFrame:
    """Running spend by run and whether it is within the cap; entries has run, seq and usd."""
    run = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.col("usd").cast("decimal(18,6)")).over(run).cast("double")
    return entries.withColumn("spent_usd", spent).withColumn("within_cap", F.col("spent_usd") <= cap_usd)


def answer_lengths(answers: DataFrame, text: str = "text") -> DataFrame:
    return answers.withColumn("answer_len_tokens", approx_tokens(F.col(text)))


def ci_subset_problem(golden: DataFrame, size: int = CI_SUBSET) -> str | None:
    """Why the CI subset is not what the thresholds rest on, or None."""
    n = golden.where("ci").count()
    return None if n == size else f"the CI subset must be exactly {size} examples, not {n}"
