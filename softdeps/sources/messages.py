"""Message records: JSON in, flat records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE_SCHEMA = (
    "lang string, _msgid string, "
    "tweet struct<created_at: string, text: string, retweet_count: bigint, favourite_count: bigint>, "
    "sentiment struct<score: double, comparative: double, tokens: array<string>, words: array<string>, "
    "positive: array<string>, negative: array<string>>"
)
RECORD_SCHEMA = (
    "created_at string, sentiment_word_count bigint, sentiment_comparative double, sentiment_score double, "
    "sentiment_positive_count bigint, sentiment_tokens bigint, text string, _msgid string, retweet_count bigint, "
    "sentiment_negative_count bigint"
)


def parse_messages(df: DataFrame, column: str = "value", schema: str = RECORD_SCHEMA) -> DataFrame:
    """JSON text to typed columns; unreadable text gives nulls."""
    parsed = F.from_json(F.col(column).cast("string"), schema)
    return df.select(parsed.alias("m")).select("m.*")


def length_of(c: Column) -> Column:
    """List length, 0 for a missing list."""
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


def flatten_message(df: DataFrame) -> DataFrame:
    """Nested message to a flat record: list lengths, comparative score times 100."""
    s = lambda f: F.col(f"sentiment.{f}")
    size = lambda f: F.when(s(f).isNull(), F.lit(0).cast("bigint")).otherwise(length_of(s(f)))
    return df.select(
        F.col("tweet.created_at").alias("created_at"),
        F.col("tweet.text").alias("text"),
        F.col("tweet.retweet_count").alias("retweet_count"),
        F.col("tweet.favourite_count").alias("favourite_count"),
        s("score").alias("sentiment_score"),
        size("tokens").alias("sentiment_tokens"),
        (s("comparative") * 100).alias("sentiment_comparative"),
        size("positive").alias("sentiment_positive_count"),
        size("negative").alias("sentiment_negative_count"),
        size("words").alias("sentiment_word_count"),
        F.col("_msgid"),
    )


def filter_records(df: DataFrame, lang: str = "en", column: str = "lang") -> DataFrame:
    return df.where(F.col(column) == lang)


def route_by_word_count(df: DataFrame, column: str = "sentiment_word_count") -> tuple[DataFrame, DataFrame]:
    """Records without words, and records with at least one."""
    return df.where(F.col(column) < 1), df.where(F.col(column) >= 1)


def escape_newlines(c: Column) -> Column:
    """Every newline as the two characters backslash and n."""
    return F.replace(c, F.lit("\n"), F.lit("\\n"))
