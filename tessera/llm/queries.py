"""The registered queries of this subpackage: thin, over whole tables, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The end-of-document id that the token files append.
END_ID = 2
WORD_VOCABULARY = 49_408


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_crf import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents; then three edits of each: a deletion, an insertion, and its own start appended."""
    import public_tokenizers

    from .token_counts import EDITS, apply_edits, token_trees

    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = token_trees(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    none, nothing = F.lit(0).cast("long"), F.lit("")
    edits = F.array(
        F.struct(F.floor(n / 4).alias("start"), F.lit(30).cast("long").alias("n_delete"), nothing.alias("insert")),
        F.struct(F.floor(n / 2).alias("start"), none.alias("n_delete"), F.lit(" an inserted remark, 42").alias("insert")),
        F.struct((n + 100).alias("start"), none.alias("n_delete"), F.coalesce(F.substring("text", 1, 25), nothing).alias("insert")),
    ).cast(EDITS)
    done = apply_edits(trees.withColumn("edits", edits), path, pattern)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.size("leaf_tokens").alias("n_leaves"), "n_encoded_chars")


def op4_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=64, radius=2)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID, vocab=WORD_VOCABULARY))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats, read_back

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_chats(rows))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard: where the tree has dealt the document's first copy; null where the mix takes none."""
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).filter("mix_copy is null or mix_copy = 1")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.col("mix_shard").alias("shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hyper_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, least=0.8)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"), dims=64, k=8, rounds=10, seed=3, scale=1024)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import document_audit

    return document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_secret_crf, op2_decontaminate, op3_token_counts, op4_simhash_near, op5_token_files, op6_suffix_dedup, op7_fingerprints, op8_chat_format, op9_mix_sources, op10_toxicity, op11_hyper_minhash, op12_centroids, op13_filter_audit)}
