"""Text as it arrives: the row-wise stages on a stream, and events kept by file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.operators.annotate import with_emotion, with_interpretation, with_sentiment
from loomtext.operators.segments import split_into_segments
from loomtext.sources.files import decoded


def stream_texts(spark: SparkSession, folder: str, pattern: str = "*.txt", encoding: str = "utf-8") -> DataFrame:
    """(file, fileId, text) of files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.select(F.col("path").alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("fileId"), decoded(F.col("content"), encoding).alias("text"))


def annotated(stream: DataFrame, n_segments: int = 100) -> DataFrame:
    """Segments with affect and readings; a stateless map of each row, so it runs on streams and tables alike."""
    return with_interpretation(with_emotion(with_sentiment(split_into_segments(stream, n_segments))))


def affect_by_window(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, sentiment_label, n, score): labels in tumbling windows; what is later than the watermark is dropped."""
    scored = with_sentiment(stream.withWatermark(time, late))
    return scored.groupBy(F.window(time, width), "sentiment_label").agg(F.count("*").alias("n"), F.avg("sentiment_score").alias("score"))


def mention_counts(stream: DataFrame, keep_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """(fileId, event, count_mentions) each time a phrase is mentioned again; counts are kept by file and phrase.

    A count that no mention renews for ``keep_ms`` is forgotten, so the state is bounded by what is said in that time.
    """

    def update(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, n = state.get if state.exists else (None, 0)
        for frame in frames:
            first = first or str(frame["canon"].iloc[0])
            n += len(frame)
        state.update((first, n))
        state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"fileId": [key[0]], "event": [first], "count_mentions": [n]})

    keyed = stream.where("trim(canon) <> ''").withColumn("key", F.lower("canon"))
    return keyed.groupBy("fileId", "key").applyInPandasWithState(
        update, "fileId string, event string, count_mentions bigint", "first string, n bigint", "update", GroupStateTimeout.ProcessingTimeTimeout
    )
