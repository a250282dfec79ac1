"""A corpus pipeline in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softdeps.llm.common import read, stage
from softdeps.llm.mixing import mix
from softdeps.llm.ngram_join import jaccard_components
from softdeps.llm.packing import pack_by_curve
from softdeps.llm.queries import tokenizer_path
from softdeps.llm.secret_scan import redact_secrets
from softdeps.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't call toxic."""
    own = [c for c in docs.columns if c in ("score", "predicted", "held_out")]
    scored = score_toxicity(docs.withColumnsRenamed({c: f"#own_{c}" for c in own}), read(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*(F.col(f"#own_{c}" if c in own else c).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id (nulls last) of each group; of repeated rows one stays.

    Rows go by numbers of their own, so null or shared ids join no documents.  Texts without words are alike only with equal ids.
    """
    rows = stage(docs.withColumn("#row", F.monotonically_increasing_id()), "rows")
    groups = jaccard_components(rows.select(F.col("#row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "#row")
    told = rows.select("#row", "doc_id", F.xxhash64("text").alias("#text")).join(groups, "#row")
    blank = F.col("n_shingles") == 0
    alike = [F.when(~blank, F.col("component_id")), F.when(blank, F.col("doc_id")), F.when(blank, F.col("#text"))]
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "#row")).alias("least")
    kept = told.groupBy(*(a.alias(f"#alike{i}") for i, a in enumerate(alike))).agg(least).select("least.#row")
    return rows.join(kept, "#row", "left_semi").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets of any layer replaced; ``n_chars`` follows the text."""
    hidden = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return hidden
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids along the curve, piece by piece."""
    return pack_by_curve(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("mix", mix_sources),
    ("packing", pack),
]

# The first and third stages can't be said in SQL; tests check each stage's operator by itself, and the pipeline's columns, counts and lengths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
