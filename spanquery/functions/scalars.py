"""Row-wise functions: ids, tokens, attributes, prices, JSON."""

from __future__ import annotations

import json
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_PATTERN = r"^[a-z]+-[a-z0-9]+(?:-[a-z0-9]+)*-\d{3}$"


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by colons."""
    return F.left(F.sha1(F.concat_ws(":", *parts).cast("binary")), F.lit(16))


def numeric_id(hex_id: Column) -> Column:
    """A 16-digit hex id as an unsigned decimal string."""
    return F.conv(hex_id, 16, 10)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def collapse(text: Column) -> Column:
    """White space trimmed and collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(collapse(text)) / 4)).cast("int")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def clip(text: Column, limit: int, marker: str = " [truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def bounded_join(items: Column, limit: int, length: int = 500) -> tuple[Column, Column]:
    """Distinct items among the first ``limit``, in their order, joined by commas and cut to ``length`` characters; and whether anything was cut."""
    joined = F.array_join(F.array_distinct(F.slice(items, 1, limit)), ",")
    return F.left(joined, F.lit(length)), (F.size(items) > limit) | (F.length(joined) > length)


def coerce_attributes(names: list[str], values: list[Column]) -> Column:
    """A map of strings from typed values: booleans as true and false, numbers by their digits, NULLs left out."""
    pairs = [x for name, value in zip(names, values, strict=True) for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def attribute(attributes: Column, key: str, missing: str | None = None) -> Column:
    """Value of a key; NULL, or ``missing``, where there is none."""
    found = F.try_element_at(attributes, F.lit(key))
    return found if missing is None else F.coalesce(found, F.lit(missing))


def with_cost(spans: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Append priced_usd and price_error; prices has alias, input_per_mtok and output_per_mtok.

    The price list is keyed by model alias and stays small; it is broadcast by the planner's own
    size limit.
    """
    known = prices.select(F.col("alias").alias("__alias"), "input_per_mtok", "output_per_mtok")
    joined = spans.join(known, spans[model] == F.col("__alias"), "left")
    usd = (F.col("prompt_tokens") * F.col("input_per_mtok") + F.col("completion_tokens") * F.col("output_per_mtok")) / 1_000_000
    error = F.when(F.col(model).isNotNull() & F.col("__alias").isNull(), F.concat(F.lit("unknown model "), F.col(model)))
    return joined.select(*[spans[c] for c in spans.columns], usd.alias("priced_usd"), error.alias("price_error"))


def merge_json(left: Column, right: Column) -> Column:
    """Top-level merge of two JSON objects, whose values keep their types; the right side wins.  NULL is an empty object."""
    kind = "map<string, variant>"
    a, b = (F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind)) for c in (left, right))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def canonical_json(value: Column) -> Column:
    """Sorted keys at every level, compact separators; NULL where it is no JSON."""
    return F.to_json(F.try_parse_json(value))


def parse_timestamp(value: Column) -> Column:
    """Epoch milliseconds or ISO-8601 as a timestamp; NULL where it is neither, which callers are to report (``bad_timestamp``)."""
    return F.when(value.rlike(r"^-?\d+$"), F.timestamp_millis(value.try_cast("long"))).otherwise(F.try_to_timestamp(value))


def bad_timestamp(value: Column) -> Column:
    """Whether there is a value that ``parse_timestamp`` cannot read."""
    return value.isNotNull() & parse_timestamp(value).isNull()


_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)  # fixed value: how a reply marks its answer
MAX_RATIONALE = 400
MAX_PASSAGES, MAX_PASSAGE_CHARS = 8, 1200


_DECODER = json.JSONDecoder()
_SCORES = frozenset(range(1, 6))


def last_object(text: str) -> dict:
    """The last JSON object that begins at a brace of a text and lies in no other; empty where there is none."""
    found: dict = {}
    at = text.find("{")
    while at >= 0:
        try:
            found, at = _DECODER.raw_decode(text, at)
        except ValueError:
            at += 1
        at = text.find("{", at)
    return found


def parse_judge_reply(reply: str | None) -> tuple[int | None, str | None]:
    """Score and rationale of a judge's reply; both None unless it is well-formed.

    The last object counts that is JSON, among fenced blocks if there are any.  The score must be a
    whole number from 1 to 5, 3.0 included, and the rationale must not be blank.
    """
    text = reply or ""
    told = last_object("\n".join(_FENCED.findall(text)) or text)
    score, rationale = told.get("score"), told.get("rationale")
    why = rationale.strip()[:MAX_RATIONALE] if isinstance(rationale, str) else ""
    whole = type(score) in (int, float) and score in _SCORES  # a boolean is no number here
    return (int(score), why) if whole and why else (None, None)


def judge_scores(replies: DataFrame, column: str = "reply", out: str = "judge") -> DataFrame:
    """Append a struct of score and rationale, with NULL fields where the reply does not parse."""
    @F.pandas_udf("score int, rationale string")
    def parse(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_judge_reply(v) for v in values], columns=["score", "rationale"]).astype({"score": "Int32"})

    return replies.withColumn(out, parse(column))


def reference_first(seed: int, key: Column) -> Column:
    """Whether the reference answer is shown first: a coin of the seed and the example alone."""
    @F.pandas_udf("boolean")
    def coin(keys: pd.Series) -> pd.Series:
        return pd.Series([random.Random(f"{seed}:{k}").random() < 0.5 for k in keys], dtype=bool)

    return coin(key)


def render_passages(chunks: Column) -> Column:
    """An array of (source_path, section_path, text) as numbered passages, the first ``MAX_PASSAGES`` of them."""

    def one(c: Column, i: Column) -> Column:
        body = F.regexp_replace(F.coalesce(c["text"], F.lit("")), r"^\s+|\s+$", "")
        cut = F.concat(F.regexp_replace(F.left(body, F.lit(MAX_PASSAGE_CHARS)), r"\s+$", ""), F.lit("\n[passage truncated]"))
        section = F.coalesce(c["section_path"], F.lit(""))
        head = F.concat(F.coalesce(c["source_path"], F.lit("?")), F.when(section != "", F.concat(F.lit(" \u2014 "), section)).otherwise(F.lit("")))
        number = (i + 1).cast("string")
        shown = F.when(F.length(body) > MAX_PASSAGE_CHARS, cut).otherwise(body)
        return F.concat(F.lit("<passage "), number, F.lit(": "), head, F.lit(">\n"), shown, F.lit("\n</passage "), number, F.lit(">"))

    more = F.size(chunks) - MAX_PASSAGES
    note = F.concat(F.lit("("), more.cast("string"), F.lit(" more were retrieved and are left out; that a claim's source is not among those shown says nothing against it.)"))
    parts = F.concat(F.transform(F.slice(chunks, 1, MAX_PASSAGES), one), F.when(more > 0, F.array(note)).otherwise(F.array().cast("array<string>")))
    return F.when(F.coalesce(F.size(chunks), F.lit(0)) > 0, F.array_join(parts, "\n\n")).otherwise("(no passages were retrieved)")
