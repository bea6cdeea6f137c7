"""Summaries, readings of affect labels, and themes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import let

THEMES: dict[str, tuple[str, ...]] = {
    "family": ("brother", "children", "family", "father", "mother", "parents", "sister"),
    "place": ("amsterdam", "auschwitz", "camp", "city", "forest", "ghetto", "village"),
    "movement": ("arrived", "deported", "left", "moved", "taken", "transported"),
}


def first_text(*texts: Column) -> Column:
    """The first text that isn't null or empty, else ''."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def summary(text: Column, max_chars: int = 240) -> Column:
    """The text, or its start and an ellipsis where it is over ``max_chars`` long."""
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars - 1), F.lit("…"))).otherwise(text)


def explanation(sentiment_label: Column, emotion_label: Column) -> Column:
    """One sentence for each label that says something."""
    tone = F.when(F.coalesce(sentiment_label, F.lit("")) != "", F.concat(F.lit("Sentiment suggests *"), sentiment_label, F.lit("* tone.")))
    felt = F.when(
        ~F.coalesce(emotion_label, F.lit("")).isin("", "neutral"),
        F.concat(F.lit("Dominant emotion appears to be *"), emotion_label, F.lit("*.")),
    )
    return first_text(F.concat_ws(" ", tone, felt), F.lit("No strong affective signal detected."))


def themes(text: Column, buckets: Mapping[str, Sequence[str]] = THEMES) -> Column:
    """Themes with a keyword anywhere in the lower-case text, also inside a word; none for null."""

    def tagged(low: Column) -> Column:
        hit = []
        for theme, words in buckets.items():
            found = F.lit(False)
            for word in words:
                found = found | F.contains(low, F.lit(word.lower()))
            hit.append(F.when(found, theme))
        return F.array_compact(F.array(*hit))

    return let(F.lower(F.coalesce(text, F.lit(""))), tagged) if buckets else F.array().cast("array<string>")
