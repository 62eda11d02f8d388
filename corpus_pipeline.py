"""The corpus pipeline: toxicity, language, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  Models are fitted on the documents that reach the stage.  As what a stage
returns is computed when it is written, the stages that send texts to Python lower the session's Arrow
batches; ``run`` sets them back.

Defined cases, in every stage: rows are judged one by one, repeated and null doc_id included; a null text
has no words, no language (it goes in the language stage) and no tokens; very long texts are taken whole;
further columns are kept, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanquery.llm import bytebpe, decontam, jaccard, langid, toxicity
from spanquery.llm.mapping import lower_batches, small_batches
from spanquery.llm.storage import drop, shared_folder
from spanquery.llm.workers import shrink_heaps


def _prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and heaps without what the stage before has left."""
    lower_batches(spark)
    shrink_heaps(spark)


def _filtered(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``decide`` leaves of the documents; their columns stand aside meanwhile, so that no name clashes."""
    left = decide(docs.select(*[docs[c].alias(f"in_{c}") for c in docs.columns]))
    return left.select(*[left[f"in_{c}"].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below 0.5."""
    _prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, learn=toxicity.remainder("k", 5) != 0)
    return _filtered(docs, lambda renamed: toxicity.score(renamed, model, "in_text", "toxic").where("toxic < 0.5"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a language that the decoder settles on: neither ``und`` nor ambiguous."""
    _prepare(spark)
    model = langid.fit(docs, learn=langid.remainder("k", 4) != 2)
    return _filtered(docs, lambda renamed: langid.predict(renamed, model, "in_text").where("lang_pred <> 'und' and not ambiguous"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group linked by a 5-gram Jaccard similarity of 0.8."""
    _prepare(spark)
    return jaccard.first_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that contain less than 0.8 of the 5-grams of every benchmark item."""
    _prepare(spark)
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE token counts and digests."""
    _prepare(spark)
    return bytebpe.token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", encode_tokens),
]

#: No SQL expresses the fitted models and the encoder; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                drop(spark, f"{folder}/{i - 1}")  # the stage after it has been written
    return docs
