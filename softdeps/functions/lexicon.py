"""Lexicon scoring of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.session import stage

TOKEN = r"[\p{L}\p{N}']+"


def score_lexicon(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Per record: token count, summed weight, positive and negative word counts, and 100 * score / tokens.

    ``lexicon`` holds ``word, weight``, one row per word.  It is staged so that its size is
    known: below the broadcast limit it is joined inside the scan stage, and only one partial
    sum per record is shuffled.
    """
    known = stage(lexicon.select("word", "weight"), "lexicon")
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    words = df.select(F.col(key), F.explode_outer(tokens).alias("word"))
    weighed = words.join(known, "word", "left")
    weight = F.coalesce(F.col("weight"), F.lit(0)).cast("double")
    n, score = F.count("word"), F.sum(weight)
    return weighed.groupBy(key).agg(
        n.alias("sentiment_tokens"),
        score.alias("sentiment_score"),
        F.count_if(F.col("weight") > 0).alias("sentiment_positive_count"),
        F.count_if(F.col("weight") < 0).alias("sentiment_negative_count"),
        F.when(n > 0, score / n * 100).otherwise(F.lit(0.0)).alias("sentiment_comparative"),
    )
