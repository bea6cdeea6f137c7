"""Documents to sentences and segments; all within a row, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T


def _each(df: DataFrame, parts: Column, number: str, first: int, count: str | None = None) -> DataFrame:
    others = [c for c in df.columns if c not in ("text", number, count)]
    kept = df.where(~T.is_blank(F.col("text"))).select(*others, parts.alias("__parts"))
    if count:
        # the number goes with each part, the parts themselves don't
        kept = kept.select(*others, "__parts", F.size("__parts").alias(count))
    found = kept.select(*others, *([count] if count else []), F.posexplode("__parts").alias("__at", "text"))
    numbered = [(F.col("__at") + first).alias(number), *([F.col(count)] if count else []), F.col("text")]
    return found.select(*others, *numbered)


def split_sentences(docs: DataFrame, abbreviations: Sequence[str] = T.ABBREVIATIONS) -> DataFrame:
    """The other columns of ``docs``, sent_id from 0 and text; blank texts have no row."""
    return _each(docs, T.sentences(F.col("text"), abbreviations), "sent_id", 0)


def split_into_segments(docs: DataFrame, n_segments: int = 100, abbreviations: Sequence[str] = T.ABBREVIATIONS) -> DataFrame:
    """The other columns, segId from 1, segCount and text: at most ``n_segments`` of whole sentences, evenly packed."""
    return _each(docs, T.packed_evenly(T.sentences(F.col("text"), abbreviations), n_segments), "segId", 1, "segCount")


def chunk_text(docs: DataFrame, n_segments: int = 100, abbreviations: Sequence[str] = T.ABBREVIATIONS) -> DataFrame:
    """The other columns, segId from 0 and text: segments of ``ceil(sentences / n_segments)`` sentences."""
    return _each(docs, T.packed_by_size(T.sentences(F.col("text"), abbreviations), n_segments), "segId", 0)
