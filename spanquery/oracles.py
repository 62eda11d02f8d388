"""Equivalent SQL of the registered queries, over the raw tables."""

from __future__ import annotations

from .sources.cdc import values_sql

SPANS = """base as (
  select event_id, ts, user_id, event_type as et, value, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k,
         row_number() over (partition by user_id order by ts, event_id) as rn
  from events
), turned as (
  select *, rn - ((rn - 1) % 3) as turn_start, md5(cast(event_id as varchar(20))) as span_id from base
), spans as (
  select md5(concat(cast(user_id as varchar(20)), ':', cast(turn_start as varchar(20)))) as trace_id, span_id,
         case when rn = turn_start then null else first_value(span_id) over (partition by user_id, turn_start order by rn) end as parent_span_id,
         concat('s', cast(user_id as varchar(20))) as session_id,
         case et when 'purchase' then 'LLM_CALL' when 'click' then 'TOOL_CALL' when 'error' then 'TOOL_CALL' when 'view' then 'RETRIEVAL' else 'AGENT_STEP' end as event_type,
         case when et = 'purchase' then case when k % 2 = 0 then 'model-small' else 'model-large' end end as model,
         case when et = 'purchase' then 180 + 2 * k end as prompt_tokens, case when et = 'purchase' then 40 + k end as completion_tokens, value as latency_ms,
         case when et = 'purchase' then cast((180 + 2 * k) * 1 + (40 + k) * 5 as double) / 1000000 end as cost_usd,
         case when et = 'error' then 'error' when et = 'purchase' and k % 10 = 7 then 'degraded' else 'ok' end as status, ts, cast(ts as date) as ts_day,
         case when et in ('click', 'error') then concat('tool_', cast(k % 4 as varchar(20))) else lower(et) end as tool_name,
         case when et = 'error' then case when k % 2 = 0 then 'TimeoutError' else 'ValueError' end end as error_class,
         case when et = 'purchase' and k % 5 <> 0 then concat('v', cast(k % 4 + 1 as varchar(20))) end as prompt_version
  from turned
)"""

CHANGES = f"changes as ({values_sql()})"
VERSIONS = """versions as (
  select id as prompt_version_id, name as prompt_name, version, template_text, op as last_op, op = 'd' as is_deleted, source_lsn as last_source_lsn,
         kafka_offset as last_kafka_offset
  from (select *, row_number() over (partition by id order by source_lsn desc nulls last, case op when 'r' then 0 else 1 end desc, kafka_offset desc) as recency
        from changes where op in ('c', 'u', 'd', 'r'))
  where recency = 1
)"""


def total(column: str) -> str:
    return f"cast(sum(cast({column} as decimal(18,6))) as double)"


def mean(column: str) -> str:
    return f"{total(column)} / nullif(count({column}), 0)"


TOKENS = """coalesce(cast(sum(prompt_tokens) as bigint), 0) as prompt_tokens, coalesce(cast(sum(completion_tokens) as bigint), 0) as completion_tokens,
  coalesce(cast(sum(prompt_tokens) as bigint), 0) + coalesce(cast(sum(completion_tokens) as bigint), 0) as total_tokens"""
LATE = "(status = 'timeout' or error_class = 'TimeoutError')"
ERRORS = "count(*) filter (where status <> 'ok')"

SESSIONS = f"""fct_sessions as (
  select session_id, count(distinct trace_id) as turn_count, count(*) as span_count, count(*) filter (where event_type = 'TOOL_CALL') as tool_call_count,
         count(*) filter (where event_type = 'LLM_CALL') as llm_call_count, {ERRORS} as error_count, {TOKENS}, coalesce({total("cost_usd")}, 0) as total_cost_usd,
         min(ts) as first_span_ts, max(ts) as last_span_ts, date_sub('millisecond', min(ts), max(ts)) as duration_ms
  from spans group by session_id)"""
MODEL_COSTS = f"""fct_model_costs as (
  select ts_day as event_day, model, count(*) as calls, {TOKENS}, coalesce({total("cost_usd")}, 0) as cost_usd, {mean("latency_ms")} as latency_avg_ms,
         max(latency_ms) as latency_max_ms, quantile_disc(latency_ms, 0.95) as latency_p95_ms, {ERRORS} as error_count
  from spans where event_type = 'LLM_CALL' group by ts_day, model)"""
TOOLS = f"""fct_tool_reliability as (
  select ts_day as event_day, tool_name, count(*) as calls, {ERRORS} as error_count, count(*) filter (where {LATE}) as timeout_count,
         cast({ERRORS} as double) / count(*) as error_rate, cast(count(*) filter (where {LATE}) as double) / count(*) as timeout_rate,
         {mean("latency_ms")} as latency_avg_ms, max(latency_ms) as latency_max_ms, quantile_disc(latency_ms, 0.95) as latency_p95_ms
  from spans where event_type = 'TOOL_CALL' group by ts_day, tool_name)"""
PROMPTS = f"""dim as (
  select * from (select *, row_number() over (partition by version order by last_source_lsn desc nulls last, prompt_version_id desc) as recency
                 from versions where version is not null) where recency = 1
), by_prompt as (
  select ts_day as event_day, prompt_version, count(*) as calls, count(distinct trace_id) as turns, {TOKENS}, coalesce({total("cost_usd")}, 0) as cost_usd,
         {ERRORS} as error_count, {mean("latency_ms")} as latency_avg_ms, max(latency_ms) as latency_max_ms
  from spans where event_type = 'LLM_CALL' group by ts_day, prompt_version
), fct_cost_by_prompt as (
  select event_day, prompt_version, prompt_version_id, prompt_name, is_deleted as prompt_is_deleted,
         case when prompt_version is null then 'unversioned' when version is null then 'unknown' else 'known' end as prompt_attribution,
         calls, turns, prompt_tokens, completion_tokens, total_tokens, cost_usd, cost_usd / turns as cost_per_turn_usd, error_count, latency_avg_ms, latency_max_ms
  from by_prompt left join dim on version = prompt_version)"""
AGG = f"""agg_model_5m as (
  select time_bucket(interval '5 minutes', ts) as window_start, time_bucket(interval '5 minutes', ts) + interval '5 minutes' as window_end, event_type, model,
         count(*) as event_count, count(*) filter (where status = 'error') as error_count, cast(sum(prompt_tokens) as bigint) as prompt_tokens_sum,
         cast(sum(completion_tokens) as bigint) as completion_tokens_sum, {total("cost_usd")} as cost_usd_sum, {total("latency_ms")} as latency_sum_ms,
         max(latency_ms) as latency_max_ms
  from spans group by all)"""


def over(*ctes: str, body: str) -> str:
    return f"with {', '.join(ctes)} {body}"


def spans(body: str, *more: str) -> str:
    return over(SPANS, *more, body=body)


ALL_MARTS = (CHANGES, VERSIONS, SESSIONS, MODEL_COSTS, TOOLS, PROMPTS)

# metrics and panels

_SPAN_COUNT = "count(distinct span_id)"
_BAD = "count(distinct case when status <> 'ok' then span_id end)"
_PCT = f"cast(100 as double) * {_BAD} / greatest({_SPAN_COUNT}, 1)"


def _q(name: str, q: float, digits: int) -> str:
    return f"cast(round(cast(quantile_cont(latency_ms, {q}) as decimal(28,9)), {digits}) as double) as {name}"


_TOKEN_SUM = "cast(sum(prompt_tokens) + sum(completion_tokens) as bigint)"
METRIC_BODIES = {
    "request_rate": (f"{_SPAN_COUNT} as spans, cast({_SPAN_COUNT} as double) / {{seconds}} * 60 as spans_per_min", "true", None),
    "p95_latency": (", ".join([_q("p50_ms", 0.5, 3), _q("p95_ms", 0.95, 3), _q("p99_ms", 0.99, 3), f"{_SPAN_COUNT} as spans"]), "true", None),
    "error_rate": (f"{_SPAN_COUNT} as spans, {_BAD} as errors, cast(round(cast({_PCT} as decimal(28,9)), 3) as double) as error_rate_pct", "true", None),
    "cost_by_model": (f"round({total('cost_usd')}, 6) as cost_usd, {_SPAN_COUNT} as spans, count(distinct trace_id) as turns", "model is not null", "model"),
    "tokens_by_model": (
        f"cast(sum(prompt_tokens) as bigint) as prompt_tokens_sum, cast(sum(completion_tokens) as bigint) as completion_tokens_sum, {_TOKEN_SUM} as total_tokens, {_SPAN_COUNT} as spans",
        "model is not null", "model",
    ),
    "tool_error_rate": (f"{_SPAN_COUNT} as tool_calls, {_BAD} as errors, cast(round(cast({_PCT} as decimal(28,9)), 3) as double) as error_rate_pct", "event_type = 'TOOL_CALL'", None),
}


def metric(name: str, seconds: int, group_by: str | None = None) -> str:
    body, where, fixed = METRIC_BODIES[name]
    by = fixed or group_by
    chosen, tail = (f"{by}, ", f" group by {by}") if by else ("", "")
    since = f"timestamp '2024-01-31 00:00:00' - interval '{seconds}' second"
    return spans(f"select {chosen}{body.format(seconds=seconds)} from spans where ts >= {since} and {where}{tail}")


_COST = f"{total('cost_usd')} as cost_usd"
_VERSIONED = "coalesce(prompt_version, '') <> ''"
PANEL_BODIES = {
    "spans": (f"{_SPAN_COUNT} as spans", "true", (), ""),
    "error_rate": (f"{_PCT} as error_rate_pct", "true", (), ""),
    "cost": (_COST, "true", (), ""),
    "p95_llm": (_q("p95_ms", 0.95, 6), "event_type = 'LLM_CALL'", (), ""),
    "request_rate": (f"{_SPAN_COUNT} * 60.0 / 3600 as spans_per_min", "true", ("time", "event_type"), ""),
    "llm_latency": (", ".join([_q("p50", 0.5, 6), _q("p95", 0.95, 6), _q("p99", 0.99, 6)]), "event_type = 'LLM_CALL'", ("time",), ""),
    "error_rate_series": (f"{_PCT} as error_rate_pct", "true", ("time",), ""),
    "tokens_per_min": (f"{_TOKEN_SUM} * 60.0 / 3600 as tokens_per_min", "model is not null", ("time", "model"), ""),
    "cost_by_model": (_COST, "model is not null", ("time", "model"), ""),
    "retrieval_latency": (", ".join([_q("p50", 0.5, 6), _q("p95", 0.95, 6)]), "event_type = 'RETRIEVAL'", ("time",), ""),
    "tool_error_rate": (f"{_PCT} as tool_error_rate_pct", "event_type = 'TOOL_CALL'", ("time",), ""),
    "session_cost": (f"{_COST}, count(distinct trace_id) as turns, {_SPAN_COUNT} as spans", "true", ("session_id",), " order by cost_usd desc nulls last, session_id limit 20"),
    "prompt_cost": (f"{total('cost_usd')} / greatest(count(distinct trace_id), 1) as cost_per_turn_usd", _VERSIONED, ("time", "prompt_version"), ""),
    "prompt_tokens": (f"cast({_TOKEN_SUM} as double) / greatest(count(distinct trace_id), 1) as tokens_per_turn", _VERSIONED, ("time", "prompt_version"), ""),
    "turn_cost": (
        f"{_COST}, {_TOKEN_SUM} as tokens, {_SPAN_COUNT} as spans, {ERRORS} as errors", "true", ("trace_id",), " order by cost_usd desc nulls last, trace_id limit 20",
    ),
}


def panel(name: str) -> str:
    body, where, keys, tail = PANEL_BODIES[name]
    shown = [("time_bucket(interval '3600 seconds', ts) as time" if k == "time" else k) for k in keys]
    cast = body.replace("* 60.0 / 3600", "* cast(60 as double) / 3600")
    group = " group by all" if keys else ""
    period = "ts between timestamp '2024-01-01 00:00:00' and timestamp '2024-01-31 00:00:00'"
    return spans(f"select {', '.join([*shown, cast])} from spans where {period} and {where}{group}{tail}")


# quality

_CHECKS = {
    "fct_sessions": [
        ("rows >= 1", "blocking", "count(*)", "count(*) >= 1"), ("session_id not null", "blocking", "session_id is null", None),
        ("unique session_id", "blocking", "count(*) - count(distinct session_id)", "count(*) = count(distinct session_id)"),
        ("total_cost_usd in [0, ]", "blocking", "total_cost_usd < 0", None), ("total_tokens in [0, ]", "blocking", "total_tokens < 0", None),
        ("turn_count in [1, ]", "blocking", "turn_count < 1", None), ("duration_ms in [0, ]", "blocking", "duration_ms < 0", None),
        ("span_count >= turn_count", "blocking", "span_count < turn_count", None),
        ("max last_span_ts is fresh", "warn", "cast(max(last_span_ts) < timestamp '2024-01-01 00:00:00' as int)", "max(last_span_ts) >= timestamp '2024-01-01 00:00:00'"),
    ],
    "fct_model_costs": [
        ("rows >= 1", "blocking", "count(*)", "count(*) >= 1"), ("event_day not null", "blocking", "event_day is null", None),
        ("cost_usd in [0, ]", "blocking", "cost_usd < 0", None), ("calls in [1, ]", "blocking", "calls < 1", None),
        ("total_tokens in [0, ]", "blocking", "total_tokens < 0", None), ("latency_p95_ms in [0, 600000]", "blocking", "latency_p95_ms < 0 or latency_p95_ms > 600000", None),
        ("latency_max_ms >= latency_p95_ms", "blocking", "latency_max_ms < latency_p95_ms", None), ("model not null", "warn", "model is null", None),
    ],
    "fct_tool_reliability": [
        ("rows >= 1", "blocking", "count(*)", "count(*) >= 1"), ("tool_name not null", "blocking", "tool_name is null", None),
        ("error_rate in [0, 1]", "blocking", "error_rate < 0 or error_rate > 1", None), ("timeout_rate in [0, 1]", "blocking", "timeout_rate < 0 or timeout_rate > 1", None),
        ("calls in [1, ]", "blocking", "calls < 1", None), ("latency_p95_ms in [0, 600000]", "blocking", "latency_p95_ms < 0 or latency_p95_ms > 600000", None),
        ("error_count >= timeout_count", "blocking", "error_count < timeout_count", None),
    ],
    "fct_cost_by_prompt": [
        ("rows >= 1", "blocking", "count(*)", "count(*) >= 1"), ("event_day not null", "blocking", "event_day is null", None), ("calls in [1, ]", "blocking", "calls < 1", None),
        ("turns in [1, ]", "blocking", "turns < 1", None), ("cost_usd in [0, ]", "blocking", "cost_usd < 0", None), ("total_tokens in [0, ]", "blocking", "total_tokens < 0", None),
        ("prompt_attribution one of known, unversioned, unknown", "blocking", "prompt_attribution not in ('known', 'unversioned', 'unknown')", None),
        ("calls >= turns", "blocking", "calls < turns", None), ("prompt_attribution none of unknown", "warn", "prompt_attribution = 'unknown'", None),
    ],
}


def _report() -> str:
    parts = []
    for suite, checks in _CHECKS.items():
        for name, severity, what, ok in checks:
            observed = what if ok else f"count(*) filter (where {what})"
            parts.append(f"select '{suite}' as suite, '{name}' as \"check\", '{severity}' as severity, cast({observed} as bigint) as observed, {ok or observed + ' = 0'} as ok from {suite}")
    return spans(" union all ".join(parts), *ALL_MARTS)


_COUNTS = """select mart, staging_rows, cast(mart_rows as bigint) as mart_rows, staging_rows = mart_rows as matches from (
  select 'fct_sessions' as mart, (select count(*) from spans) as staging_rows, (select coalesce(sum(span_count), 0) from fct_sessions) as mart_rows
  union all select 'fct_model_costs', (select count(*) from spans where event_type = 'LLM_CALL'), (select coalesce(sum(calls), 0) from fct_model_costs)
  union all select 'fct_tool_reliability', (select count(*) from spans where event_type = 'TOOL_CALL'), (select coalesce(sum(calls), 0) from fct_tool_reliability)
  union all select 'fct_cost_by_prompt', (select count(*) from spans where event_type = 'LLM_CALL'), (select coalesce(sum(calls), 0) from fct_cost_by_prompt))"""

_REPLAYED = "replayed as (select * from spans union all select * from spans where event_type = 'TOOL_CALL')"

# retrieval

_WINDOWS = """select doc_id, i as chunk_index, substr(text, i * {step} + 1, {size}) as text,
  substr(sha1(concat_ws(':', cast(doc_id as varchar), cast(i as varchar))), 1, 16) as chunk_id
  from (select doc_id, text, unnest(range(0, case when length(text) <= {size} then 1 else cast(ceil(length(text) / {step}) as int) end)) as i from documents where length(text) > 0)"""
CHUNKS = f"chunks as ({_WINDOWS.format(step=1400, size=1600)})"

BM25 = """dt as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
facts as (select count(*) as n, sum(len(t)) / count(*) as avgdl from dt),
tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from dt) group by all),
df as (select term, count(*) as df from tf group by term),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, facts),
idf as (select term, case when raw < 0 then 0.25 * (select cast(sum(cast(raw as decimal(28,9))) as double) / count(*) from raw) else raw end as idf from raw),
q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by all),
scored as (
  select query_id, doc_id, cast(sum(cast(times * idf * tf * 2.5 / (tf + cast(1.5 as double) * (cast(0.25 as double) + cast(0.75 as double) * dl / avgdl)) as decimal(28,9))) as double) as score
  from tf join q using (term) join idf using (term), facts group by all),
every_pair as (select item_id as query_id, documents.doc_id, coalesce(score, 0) as score from benchmark cross join documents left join scored on query_id = item_id and scored.doc_id = documents.doc_id where {bm25}),
bm25 as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from every_pair)"""


_UNIT = "list_transform(raw, lambda x: cast(cast(x / cast(cast(sqrt(list_dot_product(raw, raw)) as float) as double) as float) as double))"
_BYTES = "list_transform(range(0, 8), lambda i: cast(cast(concat('0x', substr(sha256(text), i * 2 + 1, 2)) as int) as double))"
HASHED = f"""dv as (select doc_id, {_UNIT} as v from (select doc_id, {_BYTES} as raw from documents where {{dense}})),
qv as (select item_id as query_id, {_UNIT} as v from (select item_id, {_BYTES} as raw from benchmark)),
dscored as (select query_id, doc_id, round(list_dot_product(dv.v, qv.v) / sqrt(list_dot_product(dv.v, dv.v)) / sqrt(list_dot_product(qv.v, qv.v)), 9) as score from dv, qv),
dense as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from dscored)"""


def _lists(dense: str = "true", bm25: str = "true") -> tuple[str, str]:
    return BM25.format(bm25=bm25), HASHED.format(dense=dense)


def _fused(pool: int) -> str:
    return f"""fused as (
  select query_id, doc_id, round(coalesce(1.0::double / (60 + d.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0), 12) as score, d.rank as d, b.rank as b
  from (select * from dense where rank <= {pool}) d full join (select * from bm25 where rank <= {pool}) b using (query_id, doc_id)),
hybrid as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, d asc nulls last, b asc nulls last, doc_id) as rank from fused)"""


_WIDE = """wide as (select *, hybrid is not distinct from bm25 as hybrid_is_bm25 from (select query_id,
  string_agg(cast(doc_id as varchar), ',' order by rank) filter (where mode = 'dense') as dense, string_agg(cast(doc_id as varchar), ',' order by rank) filter (where mode = 'bm25') as bm25,
  string_agg(cast(doc_id as varchar), ',' order by rank) filter (where mode = 'hybrid') as hybrid from ranked group by query_id))"""
_HITS = """hitq as (select distinct mode, query_id from ranked r join documents d on d.doc_id = r.doc_id join benchmark b on b.item_id = r.query_id where contains(d.text, b.text)),
asked as (select mode, item_id as query_id, case when length(text) >= 200 then 'long' else 'short' end as type from benchmark, (select unnest(['dense', 'bm25', 'hybrid']) as mode)),
judged as (select a.*, h.query_id is not null as hit from asked a left join hitq h on h.mode = a.mode and h.query_id = a.query_id)"""
_RANKED = """ranked as (select 'dense' as mode, query_id, doc_id, rank from dense where rank <= 5 union all select 'bm25', query_id, doc_id, rank from bm25 where rank <= 5
  union all select 'hybrid', query_id, doc_id, rank from hybrid where rank <= 5)"""

# evaluation

RESULTS = """results as (
  select doc_id, quality = 1 as hit_at_k, toxic = 0 as citation_ok, 1 + doc_id % 5 as faithfulness,
         case when doc_id % 13 <> 0 then 1 + (doc_id // 5) % 5 end as answer_quality, doc_id % 200 as answer_len_tokens, doc_id % 1000 + cast(0.5 as double) as latency_ms,
         cast(doc_id % 100 as double) / 1000000 as cost_usd, case when doc_id % 7 = 0 then 'n/a' else 'search' end as hit_source,
         case when doc_id % 11 = 0 then 'timeout' end as error, doc_id % 17 <> 0 as judge_parse_ok
  from labels)"""


def _index_quantile(column: str, q: float) -> str:
    return f"list_sort(list({column}) filter (where {column} is not null))[cast(round_even({q} * (count({column}) - 1), 0) as int) + 1]"


def _metrics(source: str) -> str:
    ok, asked = "error is null", "error is null and hit_source <> 'n/a'"
    length = "case when answer_len_tokens <> 0 then answer_len_tokens end"
    return f"""select count(*) as rows, count(*) filter (where error is not null) as errors, count(*) filter (where not judge_parse_ok) as parse_failures,
  avg(faithfulness) filter (where {ok}) as faithfulness_mean, avg(answer_quality) filter (where {ok}) as answer_quality_mean,
  avg(cast(coalesce(hit_at_k, false) as int)) filter (where {asked}) as hit_at_5_rate, avg(cast(hit_at_k as int)) filter (where {asked}) as hit_at_5_given_search,
  avg(cast(coalesce(citation_ok, false) as int)) filter (where {ok}) as citation_ok_rate,
  cast(sum(case when {ok} then cast(cost_usd as decimal(18,6)) end) as double) / nullif(count(case when {ok} then cost_usd end), 0) as mean_cost_usd,
  {_index_quantile("case when error is null then latency_ms end", 0.5)} as p50_latency_ms, {_index_quantile("case when error is null then latency_ms end", 0.95)} as p95_latency_ms,
  round(corr({length}, answer_quality) filter (where {ok}), 9) as length_r_quality, round(corr({length}, faithfulness) filter (where {ok}), 9) as length_r_faithfulness,
  coalesce({total("cost_usd")}, 0) as total_cost_usd from {source}"""


def _gate(baseline_runs: tuple[str, ...]) -> str:
    """Floors for two runs, declared thresholds for one and for what has no floor."""
    floors = "case metric when 'faithfulness_mean' then cast(0.2 as double) when 'hit_at_5_rate' then cast(0.08 as double) end"
    declared = "case metric when 'faithfulness_mean' then cast(0.3 as double) when 'hit_at_5_rate' then cast(0.1 as double) else cast(0 as double) end"
    gated = ("faithfulness_mean", "hit_at_5_rate", "citation_ok_rate")
    long = " union all ".join(f"select r, '{m}' as metric, {m} as value from runs" for m in gated)
    runs = " union all ".join(f"select {i} as r, * from ({_metrics(w)})" for i, w in enumerate([*(f"results where {w}" for w in baseline_runs), "results"]))
    n = len(baseline_runs)
    limit = f"coalesce(greatest(2 * abs(max(value) - min(value)) / sqrt(2), {floors}), {declared})" if n == 2 else declared
    if n == 2:
        limit = f"case when {floors} is null then {declared} else {limit} end"
    return over(
        RESULTS, f"runs as ({runs})", f"long as ({long})", f"base as (select metric, avg(value) as mean, {limit} as threshold from long where r < {n} group by metric)",
        body=f"""select metric, round(mean, 9) as mean, round(threshold, 9) as threshold, round(value, 9) as current, round(value - mean, 9) as delta,
        case when value is null or mean is null then 'missing' when value - mean < -threshold then 'regressed' else 'ok' end as verdict from base join long using (metric) where r = {n}""",
    )


_STORED_RUN = """stored_run as (select unnest(['id', 'judge_model', 'dataset_version', 'corpus_version', 'total_cost_usd', 'prompt_version', 'n']) as name,
  unnest([cast(n_nationkey as varchar), 'judge', 'v1', n_name, '0.5', version, (select cast(count(*) as varchar) from labels)]) as value
  from nation left join versions on prompt_version_id = n_nationkey % 7 where n_nationkey = (select max(n_nationkey) from nation where n_nationkey % 4 <> 0))"""
_PAIRS = "pairs as (select faithfulness as a, answer_quality as b from results where faithfulness is not null and answer_quality is not null)"


def _kappa(kind: str) -> str:
    weight = "cast(x.c <> y.c as int)" if kind == "plain" else "power(x.c - y.c, 2) / nullif(power(hi - lo, 2), 0)"
    return f"""select '{kind}' as kind, round(1 - sum(w * coalesce(n, 0) / total) / nullif(sum(w * ma * mb / total / total), 0), 9) as kappa, max(total) as pairs from (
  select {weight} as w, n, ma, mb, total from (select a as c, count(*) as ma from pairs group by a) x, (select b as c, count(*) as mb from pairs group by b) y
  left join (select a, b, count(*) as n from pairs group by a, b) o on o.a = x.c and o.b = y.c,
  (select count(*) as total, least(min(a), min(b)) as lo, greatest(max(a), max(b)) as hi from pairs))"""


_CLOSED = "a.window_end <= (select max(ts) from spans) - interval '30 seconds'"

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&"))
_TEXT = "regexp_replace(x, '<[^>]*>', '', 'g')"
for _code, _sign in _ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_code}', '{_sign}')"
_BARE = _STRIP.format(_TEXT)
PAGES = f"""cut as (
  select page_id, case when strpos(html, '<h1>') > 0 then substr(html, 1, strpos(html, '<h1>') - 1) else html end as front, regexp_extract(html, '<h1>([^<]*)', 1) as title,
         case when strpos(html, '</h1>') > 0 then split_part(substr(html, strpos(html, '</h1>') + 5), '</article>', 1) else '' end as rest from pages
), sections as (
  select page_id, cast(row_number() over (partition by page_id order by place) - 1 as int) as position, section, body from (
    select page_id, 0 as place, '(intro)' as section, array_to_string(list_filter(list_transform(regexp_extract_all(front, '<li>(.*?)</li>', 1), lambda x: {_BARE}), lambda x: x <> ''), ' ') as body from cut
    union all
    select page_id, 1, list_transform([title], lambda x: {_BARE})[1], array_to_string(list_filter(list_transform(string_split(rest, '<p>')[2:], lambda y: list_transform([split_part(y, '</p>', 1)], lambda x: {_BARE})[1]), lambda x: x <> ''), ' ') from cut
  ) where body <> ''
)"""

ORACLES: dict[str, str] = {
    "stg_trace_events": spans(
        """select trace_id, span_id, parent_span_id, session_id, event_type, model, prompt_tokens, completion_tokens, latency_ms, cost_usd, status, ts, ts_day,
        tool_name as span_name, tool_name, error_class, prompt_version, status <> 'ok' as is_error from spans"""
    ),
    "stg_prompt_versions": spans(
        "select versions.*, coalesce(calls, 0) as calls from versions left join (select prompt_version, count(*) as calls from spans where prompt_version is not null group by 1) on prompt_version = version", CHANGES, VERSIONS
    ),
    "agg_model_5m": spans("select * from agg_model_5m", AGG),
    "stg_agg_model_5m": spans("select *, cast(window_start as date) as window_day, latency_sum_ms / nullif(event_count, 0) as latency_avg_ms from agg_model_5m", AGG),
    "fct_sessions": spans("select * from fct_sessions", SESSIONS),
    "fct_model_costs": spans("select * from fct_model_costs", MODEL_COSTS),
    "fct_tool_reliability": spans("select * from fct_tool_reliability", TOOLS),
    "fct_cost_by_prompt": spans("select * from fct_cost_by_prompt", CHANGES, VERSIONS, PROMPTS),
    "model_counters": spans(f"select model, count(*) as requests, {ERRORS} as errors, {TOKENS}, coalesce({total('cost_usd')}, 0) as cost_usd from spans where model is not null group by model"),
    **{f"metric_{m}": metric(m, 86400) for m in METRIC_BODIES},
    **{f"metric_{m}_by_{g}": metric(m, 86400, g) for m, b in METRIC_BODIES.items() if not b[2] for g in ("model", "event_type", "status")},
    "metric_request_rate_1h": metric("request_rate", 3600),
    **{f"panel_{p}": panel(p) for p in PANEL_BODIES},
    "hot_dedup_counts": spans("select event_type, count(*) as delivered, count(distinct span_id) as spans, count(*) - count(distinct span_id) as duplicates from replayed group by event_type", _REPLAYED),
    "latest_spans": spans(f"select session_id, count(*) as spans, {total('cost_usd')} as cost_usd from spans group by session_id"),
    "raw_count_check": spans("select count(*) as raw_rows, count(distinct span_id) as distinct_spans, count(*) - count(distinct span_id) as duplicates, min(ts) as first_ts, max(ts) as last_ts from spans"),
    "busiest_session": spans(
        f"""select s.session_id, span_count, turn_count, total_cost_usd, raw_spans, raw_turns, raw_cost_usd from (select * from fct_sessions order by span_count desc, session_id desc limit 1) s
        join (select session_id, count(*) as raw_spans, count(distinct trace_id) as raw_turns, coalesce({total("cost_usd")}, 0) as raw_cost_usd from spans group by session_id) r
        on s.session_id = r.session_id""",
        SESSIONS,
    ),
    "percentile_crosscheck": spans(
        """select event_day, model, calls, latency_p95_ms, hot_p95_ms, round((hot_p95_ms - latency_p95_ms) / nullif(latency_p95_ms, 0) * 100, 6) as difference_pct
        from (select event_day, model, calls, latency_p95_ms, hot_p95_ms, hot_calls from fct_model_costs m
        join (select ts_day, model as hm, count(distinct span_id) as hot_calls, round(quantile_cont(latency_ms, 0.95), 6) as hot_p95_ms from spans where event_type = 'LLM_CALL' group by all) h
        on h.ts_day = m.event_day and h.hm is not distinct from m.model) where calls = hot_calls""",
        MODEL_COSTS,
    ),
    "agg_vs_raw": spans(
        f"""select a.window_start, a.event_type, a.model, a.event_count as streamed_count, coalesce(r.n, 0) as recomputed_count from agg_model_5m a
        left join (select time_bucket(interval '5 minutes', ts) as w, event_type, model, count(*) as n from spans group by all) r
        on r.w = a.window_start and r.event_type = a.event_type and r.model is not distinct from a.model where {_CLOSED}""",
        AGG,
    ),
    "streamed_overcount": spans(
        f"""select * from (select a.window_start, a.event_type, a.model, a.event_count * case when a.event_type = 'TOOL_CALL' then 2 else 1 end as streamed_count,
        (select count(*) from spans r where r.ts >= a.window_start and r.ts < a.window_end and r.event_type = a.event_type and r.model is not distinct from a.model) as recomputed_count
        from agg_model_5m a where {_CLOSED}) where streamed_count > recomputed_count""",
        AGG,
    ),
    "stream_dedup": spans("select event_type, count(*) as spans, count(*) as ids from spans group by event_type"),
    "hot_compact": spans("select event_type, count(*) as spans from spans group by event_type"),
    "latest_n": spans("select span_id, trace_id, event_type, ts from spans order by ts desc, span_id limit 25"),
    "deleted_errors": spans("select ts_day, count(*) as spans from spans where status <> 'error' group by ts_day"),
    "cdc_landing": "select case c_custkey % 10 when 0 then 'op t' when 1 then 'landed d' when 2 then 'malformed' when 3 then 'bad timestamp' else 'landed c' end as outcome, count(*) as n from customer group by 1",
    "upsert_changed": f"""with o as (select *, o_orderkey as k from orders)
        select 'merged' as what, count(*) as n, {total("o_totalprice + case when k % 5 <> 0 and k % 3 = 0 then 1 else 0 end")} as total from o where k % 7 <> 0 or k % 5 <> 0
        union all select case when k % 7 = 0 then 'inserted' else 'updated' end, count(*), null from o where k % 5 <> 0 and (k % 7 = 0 or k % 3 = 0) group by 1""",
    "insert_returning": "select cast((select max(n_nationkey) from nation) + row_number() over (order by r_name) as bigint) as id, r_name as name from region",
    "marts_reconcile": spans(_COUNTS, *ALL_MARTS),
    "p95_ge_avg": spans(
        """select * from (select 'fct_model_costs' as mart, event_day, latency_p95_ms, latency_avg_ms from fct_model_costs
        union all select 'fct_tool_reliability', event_day, latency_p95_ms, latency_avg_ms from fct_tool_reliability) where latency_p95_ms < latency_avg_ms""",
        MODEL_COSTS, TOOLS,
    ),
    "quality_report": _report(),
    "relationships_orphans": spans("select prompt_version as orphan, count(*) as n from spans where prompt_version is not null and prompt_version not in (select version from versions) group by 1", CHANGES, VERSIONS),
    "order_orphans": "select o_orderkey as orphan, count(*) as n from orders where o_orderkey is not null and not exists (select 1 from lineitem where l_orderkey = o_orderkey) group by 1",
    "trace_totals": spans(
        f"""select s.trace_id, count(*) as span_count, count(*) filter (where p.span_id is null) as root_count,
        count(*) filter (where p.span_id is null and s.parent_span_id is not null) as orphan_count, count(*) >= 500 as truncated,
        count(*) filter (where s.status <> 'ok') as error_count, date_sub('millisecond', min(s.ts), max(s.ts)) as duration_ms, round(coalesce({total("s.cost_usd")}, 0), 6) as total_cost_usd,
        coalesce(cast(sum(s.prompt_tokens) as bigint), 0) + coalesce(cast(sum(s.completion_tokens) as bigint), 0) as total_tokens
        from spans s left join spans p on p.trace_id = s.trace_id and p.span_id = s.parent_span_id group by s.trace_id"""
    ),
    "trace_orphans": spans(
        """select s.trace_id, s.span_id, s.parent_span_id from spans s where s.status <> 'error' and s.parent_span_id is not null
        and not exists (select 1 from spans p where p.status <> 'error' and p.trace_id = s.trace_id and p.span_id = s.parent_span_id)"""
    ),
    "trace_depth": "with recursive "
    + SPANS
    + """, walk as (select trace_id, span_id, 0 as depth from spans where parent_span_id is null
    union all select s.trace_id, s.span_id, depth + 1 from spans s join walk w on s.trace_id = w.trace_id and s.parent_span_id = w.span_id) select * from walk""",
    "cost_reprice": spans(
        f"""select model, case when model <> 'model-small' then concat('unknown model ', model) end as price_error, count(*) as calls,
        {total("case when model = 'model-small' then cast(prompt_tokens * 1.0 + completion_tokens * 5.0 as double) / 1000000 end")} as priced_usd
        from spans where model is not null group by all"""
    ),
    "upsert_classify": """with e as (select * from orders where o_orderkey % 7 <> 0), i as (select * from orders where o_orderkey % 5 <> 0)
        select case when e.o_orderkey is null then 'inserted' when i.o_orderkey is null then 'orphan' when i.o_orderkey % 3 = 0 then 'updated' else 'unchanged' end as change, count(*) as n
        from e full join i on e.o_orderkey = i.o_orderkey group by 1""",
    "missing_stale": over(
        f"a as (select distinct chunk_id from ({_WINDOWS.format(step=1200, size=1400)}))", f"b as (select distinct chunk_id from ({_WINDOWS.format(step=1400, size=1600)}))",
        body="""select state, count(*) as n from (select 'missing' as state, chunk_id from b where chunk_id not in (select chunk_id from a)
        union all select 'stale', chunk_id from a where chunk_id not in (select chunk_id from b)) group by state""",
    ),
    "content_hash_skip": "select doc_id, sha256(text) as content_hash, case when doc_id % 4 = 0 then 'ingest' else 'skip' end as action from documents",
    "chunk_windows": over(CHUNKS, body="select doc_id, cast(chunk_index as int) as chunk_index, chunk_id, sha1(text) as text_sha1 from chunks"),
    "html_sections": over(PAGES, body="select * from sections"),
    "html_chunks": over(
        PAGES, """windowed as (select page_id, position, section, i, substr(body, i * 1400 + 1, 1600) as text from (
          select *, unnest(range(0, case when length(body) <= 1600 then 1 else cast(ceil(length(body) / 1400) as int) end)) as i from sections)),
        numbered as (select *, cast(row_number() over (partition by page_id order by position, i) - 1 as int) as chunk_index from windowed)""",
        body="select page_id, chunk_index, section, text, substr(sha1(concat_ws(':', cast(page_id as varchar), cast(chunk_index as varchar))), 1, 16) as chunk_id from numbered",
    ),
    "corpus_inventory": over(CHUNKS, body="select lang as project, source as source_path, count(*) as chunks from chunks join documents using (doc_id) group by lang, source"),
    "bm25_topk": over(BM25.format(bm25="true"), body="select query_id, doc_id, round(score, 6) as score, cast(rank as int) as rank from bm25 where rank <= 5"),
    "dense_topk": """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
        s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(v.e, q.e) / sqrt(list_dot_product(v.e, v.e)) / sqrt(list_dot_product(q.e, q.e)), 9) as score
        from v, v q where q.vec_id % 100 = 0)
        select query_id, vec_id, score, cast(rank as int) as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""",
    "rrf_fusion": over(*_lists(), _fused(20), body="select query_id, doc_id, score, cast(rank as int) as rank from hybrid where rank <= 4"),
    "retrieve_project": over(
        *_lists("lang = 'en' and doc_id % 10 <> 0", "lang = 'en'"), _fused(20), body="select query_id, doc_id, score, cast(rank as int) as rank from hybrid where rank <= 4"
    ),
    "retrieval_ab": over(
        *_lists(), _fused(25), _RANKED, _HITS,
        body="""select mode, count(*) as queries, count(*) filter (where hit) as hits, count(*) filter (where hit) / count(*) as hit_rate, 'all' as type from judged group by mode
        union all select mode, count(*), count(*) filter (where hit), count(*) filter (where hit) / count(*), type from judged group by mode, type""",
    ),
    "retrieval_disagreements": over(
        *_lists(), _fused(25), _RANKED, _HITS, body="select query_id, string_agg(mode, ',' order by mode) as hit_by from hitq group by query_id having count(*) < 3"
    ),
    "retrieval_modes": over(*_lists(), _fused(25), _RANKED, _WIDE, body="select * from wide"),
    "retrieval_diagnose": over(
        *_lists(), _fused(25), _RANKED, _WIDE,
        body="""select dense_empty, hybrid_is_bm25, not (dense_empty or hybrid_is_bm25) as ok from (select bool_and(dense is null) as dense_empty, bool_and(hybrid_is_bm25) as hybrid_is_bm25 from wide)""",
    ),
    "eval_hit_at_k": spans(
        """select key, hit_at_k, any_call_hit from (select distinct session_id as key from spans) left join (
        select session_id as k, arg_min(hit, rn) as hit_at_k, bool_or(hit) as any_call_hit from (
          select session_id, row_number() over (partition by session_id order by ts, span_id) as rn, starts_with(tool_name, 'tool_1') or starts_with(tool_name, 'vi') as hit
          from spans where event_type in ('RETRIEVAL', 'TOOL_CALL')) group by session_id) on k = key"""
    ),
    "eval_citation": r"""with t as (
          select page_id, trim(regexp_replace(lower(html), '\s+', ' ', 'g')) as hay, list_last(string_split(url, '/')) as base,
                 regexp_replace(list_last(string_split(url, '/')), '\.[^.]*$', '') as stem, trim(string_split(url, '/')[3]) as leaf from pages
        ), named as (
          select page_id, hay, unnest(list_concat([lower(base), lower(stem), lower(leaf)], string_split(lower(replace(stem, '-', '_')), '_'))) as w from t
        )
        select page_id, coalesce(bool_or(length(w) >= 4 and contains(hay, w) and w not in ('index', 'docs', 'doc', 'overview', 'intro', 'common', 'config', 'configuration', 'content',
          'the', 'and', 'with', 'from', 'into')), false) as citation_ok from named group by page_id""",
    "eval_runs": over(
        CHANGES, VERSIONS,
        body="""select n_nationkey as id, version as prompt_version, 'judge' as judge_model, n_nationkey = (select max(n_nationkey) from nation where n_nationkey % 4 <> 0) as latest
        from nation left join versions on prompt_version_id = n_nationkey % 7""",
    ),
    "eval_stored_run": over(CHANGES, VERSIONS, _STORED_RUN, body="select * from stored_run"),
    "eval_drift": over(
        CHANGES, VERSIONS, _STORED_RUN,
        body="""select coalesce(b.name, r.name) as name, b.value as baseline, r.value as current
        from (values ('dataset_version', 'v1'), ('corpus_version', 'now'), ('judge_model', 'judge'), ('n', '25')) as b(name, value)
        full join (select * from stored_run where name in ('dataset_version', 'corpus_version', 'prompt_version', 'judge_model', 'n')) r on r.name = b.name where b.value is distinct from r.value""",
    ),
    "eval_judge": """select doc_id, case when ok then cast(1 + doc_id % 6 as int) end as score, case when ok then 'because of ' || doc_id end as rationale
        from (select doc_id, doc_id % 13 <> 0 and doc_id % 6 <> 5 and (doc_id % 3 = 0 or doc_id % 11 <> 0) as ok from labels)""",
    "eval_render": """select doc_id // 50 as prompt, cast(count(*) as int) as chunks, cast(least(count(*), 8) + 1 as int) as shown, count(*) > 8 as more
        from documents where doc_id % 50 < 10 and text is not null group by 1""",
    "eval_strata": """with r as (select lang, source, cast(n_chars > 500 as varchar) as size, doc_id % 4 = 0 as ci from documents)
        select axis, value, ci, count(*) as n from (select 'project' as axis, lang as value, ci from r union all select 'type', source, ci from r union all select 'difficulty', size, ci from r)
        where value is not null group by all""",
    "json_functions": """select doc_id, case when doc_id % 3 = 0 then '{"a":1.5,"b":{"x":[true,null],"y":1},"c":"' || lang || '"}' else '{"a":' || doc_id || ',"b":{"x":[true,null],"y":1}}' end as merged,
        cast(cast(concat('0x', substr(sha1(cast(doc_id as varchar)), 1, 16)) as ubigint) as varchar) as number, substr(j, 1, 18) as joined, 1 + doc_id % 12 > 10 or length(j) > 18 as cut,
        (doc_id % 2 = 0) || ',' || doc_id as attributes
        from (select *, array_to_string(list_transform(range(1, least(1 + doc_id % 12, 7) + 1), lambda n: 'd' || (n % 7)), ',') as j from documents)""",
    "eval_rates": over(RESULTS, body=_metrics("results")),
    "eval_gate": _gate(("doc_id % 2 = 0", "doc_id % 2 = 1")),
    "eval_gate_single": _gate(("doc_id % 2 = 0",)),
    "eval_index_percentiles": spans(f"select event_type, {_index_quantile('latency_ms', 0.5)} as p50, {_index_quantile('latency_ms', 0.95)} as p95 from spans group by event_type"),
    "percentiles_exact": "select l_returnflag, " + ", ".join(f"quantile_disc(l_extendedprice, {q}) as p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + ", count(*) as n from lineitem group by l_returnflag",
    "eval_pearson": "select round(corr(quality, toxic), 9) as r, cast(null as double) as constant, count(*) as n from labels",
    "eval_kappa": over(RESULTS, _PAIRS, body=f"{_kappa('plain')} union all {_kappa('quadratic')}"),
    "eval_agreement": over(RESULTS, _PAIRS, body="select count(*) as pairs, avg(cast(a = b as int)) as exact, avg(cast(abs(a - b) <= 1 as int)) as within_one, avg(a - b) as mean_diff from pairs"),
    "eval_confusion": over(RESULTS, _PAIRS, body="select a as faithfulness, b as answer_quality, count(*) as n from pairs group by all"),
    "eval_sample": """select doc_id, lang, cast(turn as int) as turn from (select doc_id, lang, row_number() over (partition by lang order by md5(concat('7:', cast(doc_id as varchar))), doc_id) as turn
        from documents) order by turn, lang limit 25""",
    "eval_passages": spans(
        """select key, chunk_id, cast(row_number() over (partition by key order by p, chunk_id) - 1 as int) as pos from (select session_id as key, tool_name as chunk_id, min(rn) as p from (
        select session_id, tool_name, row_number() over (partition by session_id order by ts, span_id) as rn from spans) group by all)"""
    ),
    "spend_ledger": spans(
        """select run, cast(seq as int) as seq, usd, spent as spent_usd, spent <= 0.005 as within_cap from (select *, cast(sum(cast(usd as decimal(18,6))) over (partition by run order by seq) as double) as spent
        from (select session_id as run, row_number() over (partition by session_id order by ts, span_id) as seq, cost_usd as usd from spans where cost_usd is not null))"""
    ),
    "text_functions": r"""select doc_id, cast(len(regexp_extract_all(lower(text), '[a-z0-9]+')) as int) as n_tokens,
        cast(greatest(1, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) // 4) as int) as approx_tokens,
        substr(sha1(concat_ws(':', lang, source, cast(doc_id as varchar))), 1, 16) as short_id, cast(case when length(text) > 500 then 503 else length(text) end as int) as clipped from documents""",
    "page_paths": r"select page_id, list_last(string_split(url, '/')) as basename, regexp_replace(list_last(string_split(url, '/')), '\.[^.]*$', '') as stem from pages",
    "stream_windows": spans("select * from agg_model_5m where window_end <= (select max(ts) from spans) - interval '30 seconds'", AGG),
    "stream_fan_out": spans(
        """select kind, count(*) as n from (select case cast(concat('0x', substr(span_id, 1, 8)) as bigint) % 20 when 0 then 'malformed JSON' when 1 then 'missing status' else 'span' end as kind
        from spans) group by kind"""
    ),
    "lineage_edges": spans(
        """select * from (values ('spans', 'agg_model_5m'), ('agg_model_5m', 'stg_agg_model_5m'), ('prompt_versions', 'stg_prompt_versions'), ('spans', 'fct_sessions'),
        ('spans', 'fct_model_costs'), ('spans', 'fct_tool_reliability'), ('spans', 'fct_cost_by_prompt'), ('stg_prompt_versions', 'fct_cost_by_prompt')) as t(input, output) join (
          select 'agg_model_5m' as output, count(*) as output_rows from agg_model_5m union all select 'stg_agg_model_5m', count(*) from agg_model_5m union all select 'stg_prompt_versions', count(*) from versions
          union all select 'fct_sessions', count(*) from fct_sessions union all select 'fct_model_costs', count(*) from fct_model_costs
          union all select 'fct_tool_reliability', count(*) from fct_tool_reliability union all select 'fct_cost_by_prompt', count(*) from fct_cost_by_prompt) using (output)""",
        *ALL_MARTS,
        AGG,
    ),
    "lineage_of_job": """select n_name as job, unnest(['spans_' || n_regionkey, 'prompts', 'spans_' || n_regionkey]) as input,
        unnest(['agg_' || n_nationkey, 'agg_' || n_nationkey, 'archive.' || lower(n_name)]) as output from nation""",
}

# over time

_COSTS = f"count(*) as spans, count(*) filter (where status = 'error') as errors, {total('cost_usd')} as cost_usd, max(latency_ms) as latency_max_ms"
_MARK = "(select max(ts) - interval '30 seconds' from spans)"
_SESSIONS_6H = f"""select session_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, {_COSTS}
  from (select *, sum(begins) over (partition by session_id order by ts, span_id) as part
        from (select *, case when ts <= lag(ts) over (partition by session_id order by ts, span_id) + interval '6 hours' then 0 else 1 end as begins from spans))
  group by session_id, part"""
_HOPS = f"""select window_start, window_start + interval '1 hour' as window_end, event_type, {_COSTS}
  from (select *, unnest(generate_series(time_bucket(interval '15 minutes', ts) - interval '45 minutes', time_bucket(interval '15 minutes', ts), interval '15 minutes')) as window_start from spans)
  group by window_start, event_type"""
_SETS = "grouping sets ((event_type, model, status), (event_type, model), (event_type, status), (model, status), (event_type), (model), (status), ())"


def _grain(*columns: str) -> str:
    """The columns of a row's grouping set, joined by commas."""
    return "concat_ws(',', " + ", ".join(f"case when grouping({c}) = 0 then '{c}' end" for c in columns) + ") as grain"


_WRONG = """case p_partkey % 5 when 0 then name when 1 then left(name, place - 1) || substr(name, place + 1) when 2 then left(name, place - 1) || substr(name, place + 1) || 'x'
  when 3 then left(name, place) || '~' || substr(name, place + 2) else '???' || name end"""
_MULTISETS = """l as (select event_type, model, status, tool_name, prompt_version from spans),
r as (select * from l where status <> 'error' union all select * from l where status <> 'error' and event_type = 'LLM_CALL')"""
_FED = """fed as (select *, least(third + case when cast(concat('0x', substr(span_id, 1, 8)) as bigint) % 20 = 0 then 1 else 0 end, 2) as delivery
  from (select *, cast(substr(session_id, 2) as int) % 4 as source, least(date_diff('day', date '2024-01-01', ts_day) // 10, 2) as third from spans) where source <> 3 or third = 0
), greatest_ts as (
  select d.delivery, f.source, max(f.ts) as greatest from (select distinct delivery from fed) d join fed f on f.delivery <= d.delivery group by all
  having max(f.delivery) = d.delivery
), mark as (
  select delivery, max(min(greatest) - interval '30 seconds') over (order by delivery) as mark from greatest_ts group by delivery
), told as (
  select f.*, m.mark as passed, coalesce(time_bucket(interval '5 minutes', ts) + interval '5 minutes' <= m.mark, false) as late from fed f left join mark m on m.delivery = f.delivery - 1
)"""

ORACLES |= {
    "asof_prompt_version": spans(
        """select l.span_id, l.ts, r.prompt_version, r.ts as since from (from spans where event_type = 'TOOL_CALL') l
        asof left join (from spans where prompt_version is not null) r on l.session_id = r.session_id and l.ts >= r.ts"""
    ),
    "asof_price": spans(
        """select span_id, model as name, ts, case when near then usd_per_mtok end as usd_per_mtok, case when near then since end as since from (
          select l.*, r.*, r.since >= l.ts - interval '6 hours' as near from (from spans where event_type = 'LLM_CALL') l
          asof left join (select case when p_partkey % 2 = 0 then 'model-small' else 'model-large' end as name, timestamp '2024-01-01' + p_partkey * interval '17 minutes' as since,
                                 p_retailprice as usd_per_mtok from part) r on l.model = r.name and l.ts >= r.since)"""
    ),
    "asof_next_call": spans(
        """select l.span_id, case when r.ts <= l.ts + interval '2 days' then r.span_id end as next_call, case when r.ts <= l.ts + interval '2 days' then r.ts end as next_ts
        from (from spans where event_type = 'RETRIEVAL') l asof left join (from spans where event_type = 'LLM_CALL') r on l.session_id = r.session_id and l.ts < r.ts"""
    ),
    "span_gaps": spans(
        """select session_id, count(gap) as gaps, max(gap) as longest_us, cast(sum(gap) as bigint) as total_us
        from (select session_id, date_diff('microsecond', lag(ts) over (partition by session_id order by ts, span_id), ts) as gap from spans) group by session_id"""
    ),
    "rolling_error_rate": spans(
        """select span_id, count(*) over w as calls, count(*) filter (where status = 'error') over w as errors from spans where event_type = 'TOOL_CALL'
        window w as (partition by tool_name order by ts range between interval '1 hour' preceding and current row)"""
    ),
    "agent_sessions": spans(_SESSIONS_6H),
    "hopping_windows": spans(_HOPS),
    "cumulating_windows": spans(
        f"""select cast(ts_day as timestamp) as window_start, window_end, event_type, {_COSTS} from (select *, unnest(generate_series(date_trunc('hour', ts) + interval '1 hour',
          cast(ts_day as timestamp) + interval '1 day', interval '1 hour')) as window_end from spans) group by ts_day, window_end, event_type"""
    ),
    "span_cube": spans(f"select {_grain('event_type', 'model', 'status')}, event_type, model, status, {_COSTS} from spans group by {_SETS}"),
    "span_rollup": spans(f"select {_grain('ts_day', 'event_type', 'tool_name')}, ts_day, event_type, tool_name, {_COSTS} from spans group by rollup (ts_day, event_type, tool_name)"),
    "distinct_sketches": spans("select event_type, count(distinct trace_id) as traces, true as close from spans where ts_day >= date '2024-01-04' and ts_day < date '2024-01-18' group by event_type"),
    "nearest_names": f"""with p as (select p_partkey, p_name || ' ' || p_type as name, cast(p_partkey % 11 + 1 as int) as place from part), told as (select p_partkey, {_WRONG} as told from p),
        known as (select distinct name from p), met as (select told, name, levenshtein(told, name) as far from (select distinct told from told) cross join known),
        best as (select told, min(row(far, name)) as best from met where far <= 2 group by told)
        select p_partkey, best[2] as nearest, cast(best[1] as int) as distance from told left join best using (told)""",
    "archive_difference": spans(
        """select event_type, status, cast(sum(greatest(a - b, 0)) as bigint) as only_left, cast(sum(greatest(b - a, 0)) as bigint) as only_right, cast(sum(least(a, b)) as bigint) as both,
        count(*) as distinct_rows from (select event_type, model, status, tool_name, prompt_version, sum(side) as a, sum(1 - side) as b
          from (select *, 1 as side from l union all select *, 0 from r) group by all) group by event_type, status""",
        _MULTISETS,
    ),
    "archive_except_all": spans("select * from l except all select * from r", _MULTISETS),
    "archive_intersect_all": spans("select * from l intersect all select * from r", _MULTISETS),
    "stream_parent_child": spans(
        """select l.span_id as root_id, r.span_id, r.ts from (from spans where parent_span_id is null) l
        left join spans r on r.parent_span_id = l.span_id and r.ts between l.ts and l.ts + interval '2 hours'
        where r.span_id is not null or l.ts + interval '2 hours' < (select least(max(ts) filter (where parent_span_id is null), max(ts) filter (where parent_span_id is not null)) - interval '30 seconds' from spans)"""
    ),
    "stream_sessions": spans(f"select * from ({_SESSIONS_6H}) where session_end <= {_MARK}"),
    "stream_hops": spans(f"select * from ({_HOPS}) where window_end <= {_MARK}"),
    "stream_closed_traces": spans(
        """select trace_id, case when bool_or(parent_span_id is null) then 'root' else 'silence' end as reason, count(*) as spans, count(*) filter (where status = 'error') as errors,
          min(ts) as first_ts, max(ts) as last_ts from fed group by trace_id
        having bool_or(parent_span_id is null) or max(ts) + interval '1 hour' <= (select max(ts) - interval '30 seconds' from fed)""",
        "fed as (select * from spans where not (parent_span_id is null and status = 'error'))",
    ),
    "stream_partition_windows": spans(
        f"""select * from (select time_bucket(interval '5 minutes', ts) as window_start, time_bucket(interval '5 minutes', ts) + interval '5 minutes' as window_end, event_type, {_COSTS}
        from told where not late group by all) where window_end <= (select max(mark) from mark)""",
        _FED,
    ),
    "stream_late_rows": spans("select span_id, ts, passed as watermark, cast(delivery as int) as delivery from told where late", _FED),
}

# The coins of the seed 7 and the names NATION_0 to NATION_24.
_COINS = [True, True, False, True, False, False, True, True, False, True, False, False, False, True, True, False, True, True, False, False, False, True, False, False, True]
_WITH_BAD = """real as (select * from spans), bad as (select * replace (repeat('0', 29) || 'bad' as span_id, -1.0::double as cost_usd) from real where event_type = 'LLM_CALL' order by real.span_id limit 1),
both_states as (select 'injected' as state, * from real union all select 'injected', * from bad union all select 'reverted', * from real)"""
_COST_CHECK = "select state, '{mart}' as suite, '{column} in [0, ]' as check, 'blocking' as severity, count(*) filter (where c < 0) as observed, count(*) filter (where c < 0) = 0 as ok from (select state, coalesce(" + total("cost_usd") + ", 0) as c from both_states {where} group by state, {by}) group by state"

ORACLES |= {
    "eval_order_examples": "select n_name, [" + ", ".join(str(c).lower() for c in _COINS) + "][n_nationkey + 1] as reference_first from nation",
    "quality_injected": spans(
        " union all ".join(
            _COST_CHECK.format(mart=mart, column=column, by=by, where=where)
            for mart, column, by, where in (
                ("fct_sessions", "total_cost_usd", "session_id", ""), ("fct_model_costs", "cost_usd", "ts_day, model", "where event_type = 'LLM_CALL'"), ("fct_cost_by_prompt", "cost_usd", "ts_day, prompt_version", "where event_type = 'LLM_CALL'"),
            )
        ),
        _WITH_BAD,
    ),
    "quality_of_lines": """with f as (select count(*) as n, count(*) filter (where not l_discount between 0 and 0.05) as d, count(*) filter (where not l_extendedprice / l_quantity between 900 and 950) as p,
          count(*) filter (where l_shipdate is null) as s, count(*) filter (where l_returnflag not in ('A', 'N')) as r from lineitem),
        u as (select count(*) as u3 from (select 1 from lineitem group by l_orderkey, l_partkey, l_suppkey having count(*) > 1)), v as (select count(*) as u1 from (select 1 from lineitem group by l_orderkey having count(*) > 1))
        select 'lineitem' as suite, * from (
          select 'unique l_orderkey, l_partkey, l_suppkey' as check, 'blocking' as severity, u3 as observed, u3 = 0 as ok from u union all select 'unique l_orderkey', 'warn', u1, u1 = 0 from v
          union all select 'l_discount in [0, 0.05]', 'warn', d, d = 0 from f union all select 'rows >= 10', 'blocking', n, n >= 10 from f union all select 'price of a unit is plausible', 'blocking', p, p = 0 from f
          union all select 'l_shipdate not null', 'blocking', s, s <= n * 0.1 from f union all select 'l_returnflag one of A, N', 'blocking', r, r = 0 from f)""",
    "counts_match": """select "left", "right", case when "left" = "right" then 'MATCH' else 'MISMATCH' end as verdict, other from (
        select count(*) as "left", count(*) as "right", 'events' as other from events union all select count(*), count(*) filter (where event_type <> 'error'), 'events without errors' from events)""",
    "archive_between": spans(
        """select event_type, count(*) as spans, count(*) filter (where tool_name is not null) as with_attributes
        from spans where ts >= timestamp '2024-01-05 06:00:00' and ts < timestamp '2024-01-12' group by event_type"""
    ),
    "archive_expired": spans("select ts_day, count(*) as spans from spans where ts_day >= date '2024-01-24' group by ts_day"),
    "stream_archive": spans("select ts_day, count(*) as spans, count(*) as ids from spans group by ts_day"),
    "upsert_plain": """with new as (select c_custkey * 2 as c_custkey, 'new ' || c_mktsegment as c_mktsegment from customer where c_custkey % 3 = 0),
        after as (select c_custkey, c_mktsegment from customer where c_custkey not in (select c_custkey from new) union all select * from new)
        select c_mktsegment, count(*) as n, cast(sum(c_custkey) as bigint) as keys from after group by c_mktsegment""",
    "markdown_sections": """select p_partkey, 0 as position, '(intro)' as section, p_name as body from part union all select p_partkey, 1, p_brand, p_type from part
        union all select p_partkey, 2, p_brand || ' > Size', 'size ' || p_size from part union all select p_partkey, 3, p_brand || ' > Size > Deep', 'deep' from part""",
    "label_sheet": """select eval_result_id, printf('key-%05d', eval_result_id) as example_key, 'why ' || eval_result_id as question, '[]' as retrieved_sources, 'as ' || eval_result_id * 7 as answer,
        cast(null as varchar) as human_faithfulness, cast(null as varchar) as human_notes from (
          select doc_id as eval_result_id, row_number() over (partition by doc_id % 3 order by md5('11:' || doc_id), doc_id) as turn, doc_id % 3 as type from labels)
        order by turn, type limit 30""",
}
