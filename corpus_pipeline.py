"""Corpus pipeline: from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_copies, token_files, toxicity
from tessera.llm.common import discard, free_name, ranges_for, table, written
from tessera.llm.queries import END_ID, WORD_VOCABULARY, tokenizer_path
from tessera.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below 0.5.

    A row is judged by its own text: null and empty texts score as texts without a match, repeated rows alike, keys do not
    matter (a row without labels or with a null key is scored like any other), and an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name("_toxicity", docs.columns)
    return toxicity.score_toxicity(docs, model, out=score).filter(F.col(score) < 0.5).drop(score)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a likeness of 0.8 or more.

    The smallest doc_id stays (a null one counts as the largest); rows with equal doc_ids and other texts are other
    documents; rows equal in doc_id and text are one and share its fate; null, empty and blank texts are alike.
    """
    return near_copies.deduplicated(docs, shingle=5, least=0.8)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, edited or not.

    A row is judged by its own text; null and empty texts and items hold nothing; an empty benchmark removes nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row each time that a document is taken, dealt to shards and shuffled within them.

    A null source is a source; documents without words are never taken; rows equal in doc_id and text share their fate.
    """
    names = mixing.mix_names(docs.columns)
    taken = mixing.mix(docs, shards=ranges_for(docs)).filter(F.col(names["copy"]).isNotNull())
    dealt = taken.repartition(names["shard"]).sortWithinPartitions(names["shard"], names["rank"])
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of doc_id, and a row for each written document, read back from them.

    Null doc_ids come first, equal ones follow each other by their texts' hashes, and a null or empty text is its end id.
    """
    return token_files.read_tokens(token_files.write_tokens(docs, tokenizer_path("word_bpe_49k.json"), END_ID, vocab=WORD_VOCABULARY))


def _shipped(stage: Callable) -> Callable:
    """The stage, with the package sent to the executors first."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in (("toxicity", without_toxic), ("near_duplicates", without_near_copies), ("decontamination", without_benchmarks), ("mixing", mixed), ("token_output", token_output))]

#: The grammar, fingerprints, alignment and the tokenizer are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's table goes when the next one's is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", compact=False)
        if before is not None:
            discard(before)
        before = docs
    return docs
