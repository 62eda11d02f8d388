"""Documents of a folder with their hashes, and their resume-aware ingest into chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import short_id
from ..operators import chunking, upsert

SUFFIXES = (".md", ".html", ".htm")
DOCUMENT = "doc_id string, project string, version string, source_path string, content_hash string"


def doc_id_for(project: Column, version: Column, source_path: Column) -> Column:
    return short_id(project, version, source_path)


def fetch(spark: SparkSession, root: str, project: str, version: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """doc_id, project, version, source_path (below ``root``), content_hash and text of the files of a folder
    tree, local or remote, as an earlier download or checkout left them; other files are left alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    below = F.substring(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), len(base) + 1, F.lit(2**31 - 1))
    files = files.select(below.alias("source_path"), "content")
    files = files.where(F.regexp_extract(F.lower("source_path"), r"\.[^./]*$", 0).isin(*suffixes))
    own = [F.lit(project).alias("project"), F.lit(version).alias("version")]
    return files.select(
        doc_id_for(F.lit(project), F.lit(version), F.col("source_path")).alias("doc_id"), *own, "source_path", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text")
    )


def chunks_of(docs: DataFrame) -> DataFrame:
    """Chunks of fetched documents: HTML by its suffix, the rest as Markdown."""
    html = F.lower("source_path").rlike(r"\.html?$")
    keys = ["doc_id", "project", "version", "source_path"]
    parts = [chunking.chunk_documents(docs.where(html), "html"), chunking.chunk_documents(docs.where(~html), "markdown")]
    return parts[0].unionByName(parts[1]).join(docs.select(*keys), "doc_id")


def ingest(fetched: DataFrame, documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """What an ingest changes, from fetched documents and the stored documents and chunks.

    documents and chunks after it; embed: chunks that are not stored yet; stale: chunk ids of changed
    documents that they no longer have.  Documents of an unchanged hash are passed over; one whose chunks
    were stored before its own row was, as after a run that broke off, embeds only what is missing.
    """
    action = upsert.hash_skip(documents, fetched)
    changed = fetched.join(action.where("action = 'ingest'").select("doc_id"), "doc_id", "left_semi")
    cut = chunks_of(changed)
    held = chunks.join(cut.select("doc_id").distinct(), "doc_id", "left_semi")
    state = upsert.missing_and_stale(held, cut, "chunk_id")
    stale = state.where("state = 'stale'").select("chunk_id")
    embed = cut.join(state.where("state = 'missing'").select("chunk_id"), "chunk_id", "left_semi")
    done = changed.join(cut.select("doc_id").distinct(), "doc_id", "left_semi").select(documents.columns)
    return {
        "documents": upsert.upsert(documents, done, ["doc_id"]),
        "chunks": chunks.join(stale, "chunk_id", "left_anti").unionByName(embed.select(chunks.columns)),
        "embed": embed,
        "stale": stale,
    }


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of a numeric key; needs the database's driver."""
    ranges = {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **options).load()
