"""Message streams: typed records, the best rows of every ten minutes, bounded runs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from softdeps.sources.messages import RECORD_SCHEMA, escape_newlines, parse_messages


def read_messages(spark: SparkSession, fmt: str, schema: str = RECORD_SCHEMA, **options) -> DataFrame:
    """A stream of JSON messages (one per line of a text source, or per Kafka value) as typed records."""
    raw = spark.readStream.format(fmt).options(**options).load()
    records = parse_messages(raw, "value", schema)
    return records.withColumn("text", escape_newlines(F.col("text"))) if "text" in records.columns else records


def stream_top_k(
    df: DataFrame, ts: str, width: str, order: list[str], k: int = 5, delay: str = "10 minutes", ascending: tuple[str, ...] = ()
) -> DataFrame:
    """The ``k`` best rows of every tumbling window, emitted once the watermark passes its end.

    ``order`` lists columns, largest first (smallest first for those in ``ascending``); end
    it with a unique column to settle ties.  Each task of a micro-batch keeps only its best
    ``k`` rows per window before the shuffle, and the state of a window is ``k`` rows.
    """
    up = [c in ascending for c in order]
    fields = df.schema.fields
    names = [f.name for f in fields]
    # Times travel as epoch milliseconds, which no time zone changes.
    at = F.col(ts).cast("timestamp")
    bounds = {f"window_{side}": F.unix_millis(F.window(at, width)[side]) for side in ("start", "end")}
    windowed = df.withColumns(bounds).withColumn("window_seen", F.unix_millis(at))
    trimmed_type = T.StructType(fields + [T.StructField(f"window_{c}", T.LongType()) for c in ("start", "end", "seen")])

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf])
            pdf["window_seen"] = pdf.groupby("window_start")["window_seen"].transform("max")
            kept = pdf.sort_values(order, ascending=up, kind="stable").groupby("window_start").head(k)
        if kept is not None:
            yield kept

    trimmed = windowed.mapInPandas(trim, trimmed_type)
    trimmed = trimmed.withColumn("window_seen", F.timestamp_millis("window_seen")).withWatermark("window_seen", delay)
    out_type = T.StructType([T.StructField("window_start", T.LongType()), T.StructField("rank", T.IntegerType())] + fields)

    places = [(names.index(c), not a) for c, a in zip(order, up)][::-1]

    def best(rows: list[tuple]) -> list[tuple]:
        for at, descending in places:
            rows = sorted(rows, key=lambda r: r[at], reverse=descending)
        return rows[:k]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], i, *r) for i, r in enumerate(held, 1)], columns=["window_start", "rank", *names])
            return
        for pdf in batches:
            held = best(held + list(pdf[names].itertuples(index=False, name=None)))
        state.update((pickle.dumps(held),))
        state.setTimeoutTimestamp(int(key[1]))

    tops = trimmed.groupBy("window_start", "window_end").applyInPandasWithState(
        step, out_type, "top binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return tops.withColumn("window_start", F.timestamp_millis("window_start"))


def start_sink(
    df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", every: str | None = "1 hour", **options
) -> StreamingQuery:
    """Append the stream to files, one commit per ``every`` (``None``: all available input, then stop)."""
    writer = df.writeStream.format(fmt).outputMode("append").options(**options).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def run_until(query: StreamingQuery, seconds: float) -> bool:
    """Let a query run for a bounded time, then stop it; True when it ended by itself."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)
