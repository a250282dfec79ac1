"""Registered queries of the operators: name -> (spark, sf_dir) -> DataFrame, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softdeps.llm.chat import format_chat, read_chat, turn_records
from softdeps.llm.common import read
from softdeps.llm.cover_tree import top_k
from softdeps.llm.divergence import source_divergence
from softdeps.llm.itq_dedup import near_vectors
from softdeps.llm.merkle import merkle_audit
from softdeps.llm.mixing import mix_counts
from softdeps.llm.ngram_join import jaccard_components
from softdeps.llm.packing import pack_by_curve
from softdeps.llm.secret_scan import find_secrets
from softdeps.llm.sentence_spans import drop_repeated_sentences
from softdeps.llm.suffix_dedup import drop_repeated_strings
from softdeps.llm.toxicity import score_toxicity
from softdeps.llm.warc import read_bundles, write_bundles

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_itq_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_vectors(read(spark, d, "embeddings"))


def op2_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return find_secrets(read(spark, d, "documents"))


def op3_cover_tree(spark: SparkSession, d: str) -> DataFrame:
    return top_k(read(spark, d, "embeddings"))


def op4_curve_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_by_curve(read(spark, d, "documents"), tokenizer_path(), with_ids=False)


def op5_chat_format(spark: SparkSession, d: str) -> DataFrame:
    records = turn_records(read(spark, d, "conversations"))
    controls = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(controls).alias("text"),
    )
    return read_chat(format_chat(records.unionByName(turn_records(added))))


def op6_sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    return drop_repeated_sentences(read(spark, d, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return score_toxicity(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "labels")).drop("text")


def op8_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return drop_repeated_strings(read(spark, d, "documents"), with_kept=False)


def op9_source_mix(spark: SparkSession, d: str) -> DataFrame:
    counted = mix_counts(read(spark, d, "documents").select("doc_id", "source", "text"))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return counted.select("doc_id", "size", "source_size", "target", taken)


def op10_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_components(read(spark, d, "documents"))


def op11_warc_bundles(spark: SparkSession, d: str) -> DataFrame:
    found = read_bundles(write_bundles(read(spark, d, "pages")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle_audit(read(spark, d, "documents"))


def op13_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return source_divergence(read(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_itq_dedup,
        op2_secret_scan,
        op3_cover_tree,
        op4_curve_packing,
        op5_chat_format,
        op6_sentence_spans,
        op7_toxicity,
        op8_suffix_dedup,
        op9_source_mix,
        op10_ngram_join,
        op11_warc_bundles,
        op12_merkle_manifest,
        op13_source_divergence,
    )
}
