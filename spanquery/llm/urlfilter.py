"""Host and path rules for urls by a Bloom filter cascade (operator 8, DataFrame functions only).

Every url has a few candidate keys: a suffix of its host with a prefix of its path, for each
shape (labels, path length) among the rules.  The distinct candidate keys of all pages are the
complete universe.  For each verdict a cascade answers whether a key is listed, exactly and
without a join: level 1 encodes the listed keys, level 2 the unlisted keys of the universe that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so on until a
level lets nothing wrong through.  The longest listed candidate decides.

Level 1 lets through sqrt(1/2) listed / unlisted of the unlisted keys, which makes the sum of all levels least, and each
level after it a half.  The filters are literals of the plan, one a level; ``MAX_BITS`` bounds a level, with a thousand
unlisted keys to each listed one about 4.4 million listed keys, and more raises ``ValueError`` before any page is judged.

Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule; a
url without rule gets ``default``; a rule listed with both verdicts blocks; rule hosts are
lower-cased; rules with a null host or path, or another verdict, are ignored; pages that repeat are
judged one by one; of two rules of one length that fit a url, the greater text decides; a very long url is taken whole; an empty table gives an empty result; input
columns named as the new ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import drop, stored

MAX_HASHES = 24
MAX_BITS = 1 << 26

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a url; both empty where there is no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(authority) + 1, F.length(rest))
    return F.translate(authority, _UPPER, _LOWER), F.regexp_extract(after, r"^[^?#]*", 0)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, bit count, hash count and salt."""

    words: list[int]
    bits: int
    hashes: int
    salt: int

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # one literal, whatever the hashes

        def test(at: Column) -> Column:
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            return F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

        return F.forall(F.array(*positions(key, self.bits, self.hashes, self.salt)), test)


def positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * salt + j)), F.lit(bits).cast("bigint")) for j in range(hashes)]


def build_level(keys: DataFrame, n: int, salt: int, rate: float) -> Level:
    """A filter of ``n`` distinct ``key`` values that lets about ``rate`` of other keys through."""
    hashes = min(MAX_HASHES, max(1, round(-math.log2(rate))))
    bits = math.ceil(n * hashes / math.log(2))
    if bits > MAX_BITS:
        raise ValueError(f"{n} keys need {bits} bits; a level has {MAX_BITS} at most")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, salt))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("w"))
    found = {r.i: r.w for r in words.collect()}  # at most MAX_BITS / 64 rows
    return Level([found.get(i, 0) for i in range(-(-bits // 64))], bits, hashes, salt)


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[depth].holds(key), out).otherwise(F.lit(depth % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, salt: int = 1, max_levels: int = 40) -> Cascade:
    """Cascade that tells ``listed`` keys from the other keys of ``universe`` (both: distinct ``key``)."""
    levels: list[Level] = []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    n, others = inside.count(), outside.count()
    rate = min(0.5, math.sqrt(0.5) * n / max(others, 1))
    for depth in range(max_levels):
        if not n:
            return Cascade(levels)
        level = build_level(inside, n, salt * 100 + depth, rate if depth == 0 else 0.5)
        levels.append(level)
        inside, outside = outside.where(level.holds(F.col("key"))), inside
        n = inside.count()
    raise ValueError("the cascade does not end; keys must be distinct")


def candidates(pages: DataFrame, url: str, shapes: list[tuple[int, int]]) -> tuple[Column, Column, list[Column]]:
    """Host, path and the candidate key of each shape (null where the url is too short for it)."""
    host, path = host_and_path(pages[url])
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = []
    for count, width in shapes:
        key = F.concat(F.substring_index(host, ".", -count), F.substring(path, 1, width))
        keys.append(F.when((labels >= count) & (F.length(path) >= width) & (F.length(host) > 0), key))
    return host, path, keys


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Append host, path, rule and verdict (replacing columns of these names)."""
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
    rules = rules.groupBy(F.concat("host", "path").alias("key"), "host", "path").agg(F.max("verdict").alias("verdict"))
    shapes = [
        (r.labels, r.width)
        for r in rules.select((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("path").alias("width"))
        .distinct()
        .orderBy("labels", "width")
        .collect()  # label counts times path lengths, whatever the number of rules
    ]
    host, path, keys = candidates(pages, url, shapes)
    universe = pages.select(F.explode(F.array(*keys) if keys else F.array().cast("array<string>")).alias("key")).where("key is not null").distinct()
    universe, folder = stored(universe, "universe")  # every level of both cascades reads it
    cascades = {v: build_cascade(rules.where(F.col("verdict") == v).select("key"), universe, salt) for salt, v in enumerate(("allow", "block"), 1)}
    drop(pages.sparkSession, folder)

    def told(key: Column) -> Column:
        verdict = F.when(cascades["block"].listed(key), "block").when(cascades["allow"].listed(key), "allow")
        return F.struct(F.length(key).alias("n"), key.alias("rule"), verdict.alias("verdict"))

    known = F.filter(F.array(*keys) if keys else F.array().cast("array<string>"), lambda k: k.isNotNull())
    best = F.array_max(F.filter(F.transform(known, told), lambda x: x["verdict"].isNotNull()))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    out = pages.select(*kept, host.alias("host"), path.alias("path"), best.alias("__best"))
    return out.select(*kept, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))


#: The rules of the registered query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    values = ", ".join("({})".format(", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r)) for r in rules)
    return spark.sql(f"select * from values {values} as t(host, path, verdict)")


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page under ``RULES``."""
    return judge(pages.select("page_id", "url"), rule_table(pages.sparkSession, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = """
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), s as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u
), rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best as (
  select page_id, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v
  from s join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select s.page_id, s.host, s.path, b.rule, coalesce(b.v, 'allow') as verdict from s left join best b on s.page_id = b.page_id
"""
