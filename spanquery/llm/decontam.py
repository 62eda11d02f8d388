"""Benchmark decontamination by size-partitioned MinHash containment search (operator 9, DataFrame functions only).

A test item is contained in a document if the document has at least ``percent`` of the item's
distinct word shingles.  Items are partitioned by size into classes (2^(j-1), 2^j].  In a class
of upper bound u, the MinHash sketch of an item is its u - ceil(percent * u) + 1 smallest shingle
hashes: a document that contains the item misses fewer of its shingles than that, so it shares
at least one sketch value, however long it is.  A document meets only the classes whose smallest
item it is long enough to hold ``percent`` of.  The search therefore loses nothing; what it
finds is verified by exact containment on the shingles themselves, not on hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Sketches, found pairs and items are broadcast up
to ``BROADCAST_BYTES``, added up first; beyond that they are joined by shuffles.

Defined cases: an item of one to four words is one shingle of that many words and is searched
for as such; an item without words is never found; a document of fewer words than a shingle
has none; null texts have no words; rows that share a doc_id are searched one by one and their
pairs merged, as are rows that share an item_id, keeping the largest containment; a very long text is
searched whole; without documents or items the result is empty; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import set_aside
from .storage import drop, stored

WIDTH = 5
PERCENT = 80
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words of a text; an empty array for none."""
    bare = F.call_function("btrim", F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(w: Column, width: int) -> Column:
    """xxhash64 of every run of ``width`` words."""
    run = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    return F.when(F.size(w) >= width, run).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column, width: Column) -> Column:
    """Distinct runs of ``width`` words, joined by a space."""
    run = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.when((F.size(w) >= width) & (width > 0), F.array_distinct(run)).otherwise(F.array().cast("array<string>"))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if it is small enough, whatever it grows from: rows and what their strings hold."""
    size = F.lit(64)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.aggregate(f.name, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long")).alias("n")).first().n or 0) <= BROADCAST_BYTES else df


def item_shingles(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, part (one for each distinct text), width, shingles and n of all items with words."""
    w = items.select(F.col(key).alias("item_id"), F.col(text).alias("t")).distinct().select("item_id", words(F.col("t")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("width", F.least(F.lit(WIDTH), F.size("w")))
    w = w.select("item_id", "width", F.array_sort(shingle_texts(F.col("w"), F.col("width"))).alias("shingles"))
    return w.distinct().select("item_id", F.xxhash64("shingles").alias("part"), "width", "shingles", F.size("shingles").alias("n"))


def _run_hash(width: int):
    return lambda w: F.xxhash64(*[F.get(w, F.lit(j)) for j in range(width)])


def sketches(shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Sketch values by item: h, item_id, part, and the shingles that a document has at least to hold an item of the size class."""
    size_class = F.ceil(F.log2(F.col("n").cast("double"))).cast("int")
    upper = F.pow(F.lit(2.0), size_class).cast("int")
    depth = upper - F.floor((upper * percent + 99) / 100).cast("int") + 1
    words_of = F.transform("shingles", lambda s: F.split(s, " "))
    by_width = F.coalesce(*[F.when(F.col("width") == k, F.transform(words_of, _run_hash(k))) for k in range(1, WIDTH + 1)])
    smallest = F.when(size_class == 0, 1).otherwise(F.floor(upper / 2).cast("int") + 1)
    least = F.floor((smallest * percent + 99) / 100).cast("int")
    return shingles.select("item_id", "part", least.alias("least"), F.explode(F.slice(F.array_sort(F.array_distinct(by_width)), F.lit(1), depth)).alias("h"))


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared and containment of all contained items."""
    spark = docs.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        paths.append(path)
        return out

    index = keep(item_shingles(items, item_key, item_text), "items")
    sketch = keep(sketches(index, percent), "sketches")
    widths = [r.width for r in index.select("width").distinct().orderBy("width").collect()]  # 1 to 5
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    if not widths:
        types = index.schema["item_id"].dataType.simpleString(), source.schema["doc_id"].dataType
        empty = T.StructType([T.StructField("doc_id", types[1])])
        return spark.createDataFrame([], empty).selectExpr(
            "doc_id", f"cast(null as {types[0]}) item_id", "0 n_shingles", "0 n_shared", "cast(0 as double) containment"
        )
    # a generator of one row, so that the words are split once and not again for each use
    source = source.select("doc_id", F.explode(F.array(words(F.col("t")))).alias("w")).where(F.size("w") > 0)
    runs = F.flatten(F.array(*[shingle_hashes(F.col("w"), k) for k in widths]))
    # a document has at most as many shingles as words
    probes = source.select("doc_id", F.size("w").alias("most"), F.explode(runs).alias("h"))
    pairs = probes.join(_bounded(sketch.select("h", "item_id", "part", "least")), "h").where("most >= least").select("doc_id", "item_id", "part").distinct()
    found = keep(pairs, "found")
    checked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).join(_bounded(found), "doc_id")
    # the words are a column of their own, so that they are split once a row
    checked = checked.withColumn("w", words(F.col("t"))).drop("t").join(_bounded(index), ["item_id", "part"])
    shared = F.size(F.array_intersect("shingles", shingle_texts(F.col("w"), F.col("width"))))
    checked = checked.select("doc_id", "item_id", F.col("n").alias("n_shingles"), shared.alias("n_shared"))
    checked = checked.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared"))
    pairs = checked.groupBy("doc_id", "item_id").agg(best.alias("b"))
    result, _ = stored(pairs.select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment"), "contained")
    for path in paths:
        drop(spark, path)
    return result


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that contain no test item; documents with a null key stay."""
    leaked, _ = stored(search(docs, items, key, text).select(F.col("doc_id").alias(key)).distinct(), "leaked")
    return docs.join(_bounded(leaked), key, "left_anti")


def clean_rows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose own text contains no test item, whatever their keys: null and repeated ones are told apart by text.
    All columns are kept, whatever their names."""
    docs, (key, text), restored = set_aside(docs, key, text)
    return restored(_clean_rows(docs, items, key, text))


def _clean_rows(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """The same for documents whose columns clash with none here."""
    again, _ = stored(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "again")
    if again.isEmpty() and docs.where(F.col(key).isNull()).isEmpty():
        return clean(docs, items, key, text).select(docs.columns)
    alone = clean(docs.where(F.col(key).isNotNull()).join(_bounded(again), key, "left_anti"), items, key, text)
    others = docs.where(F.col(key).isNull()).unionByName(docs.join(_bounded(again), key, "left_semi").select(docs.columns))
    others = clean(others.withColumn("__text", F.sha2(F.col(text).cast("string").cast("binary"), 256)), items, "__text", text)
    return alone.select(docs.columns).unionByName(others.select(docs.columns))


ORACLE_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from benchmark
), i as (
  select distinct item_id, least(5, len(w)) as k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) as s
  from iw where len(w) > 0
), n as (select item_id, count(*) as n from i group by item_id),
d as (
  select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s
  from w, (select distinct k from i) where len(w) >= k
), m as (select doc_id, item_id, count(*) as c from d join i using (k, s) group by all)
select doc_id, item_id, cast(n as int) as n_shingles, cast(c as int) as n_shared, c / n as containment
from m join n using (item_id) where c * 100 >= n * 80
"""
