"""The registered queries of the corpus operators: thin digests of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import collocations, conversations, decontam, hamming, jaccard, linededup, packing, quality, secrets, suffix, surrogate, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts of every document."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found inside a document."""
    return decontam.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup does to every document; text_sha256 is of the text that remains."""
    done = linededup.dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector among all others."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record reads back from the written archives."""
    manifest = warc.write_archive(_table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity class of every document."""
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exact substring dedup leaves of every document (all copies removed), and its words in passages of over 50
    words that occur elsewhere too."""
    return suffix.dedup(_table(spark, sf_dir, "documents"), keep="none", words=suffix.WORDS).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    done = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return done.select("doc_id", "lang", "kn.*")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how much of each kind it held."""
    return surrogate.anonymise(_table(spark, sf_dir, "documents")).select("doc_id", "text", "pii.*")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, and its cheapest repair."""
    rows = _table(spark, sf_dir, "conversations")
    return conversations.digest(conversations.damaged(rows), rows.select("conv_id")).withColumnRenamed("conv", "conv_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two to four words of every language."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return hamming.join(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op12_near_duplicates": op12_near_duplicates,
    "op11_collocations": op11_collocations,
    "op13_conversations": op13_conversations,
    "op4_surrogates": op4_surrogates,
    "op1_quality": op1_quality,
    "op3_suffix": op3_suffix,
    "op2_jaccard": op2_jaccard,
    "op6_warc": op6_warc,
    "op8_topk": op8_topk,
    "op10_line_dedup": op10_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op5_secrets": op5_secrets,
    "op9_packing": op9_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": decontam.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
    "op8_topk": topk.ORACLE,
    "op2_jaccard": jaccard.ORACLE,
    "op6_warc": warc.ORACLE,
    "op13_conversations": conversations.ORACLE,
    "op12_near_duplicates": hamming.ORACLE,
    "op11_collocations": collocations.ORACLE,
}
