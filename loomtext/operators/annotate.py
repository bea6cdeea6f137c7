"""Annotation records: entities, verb frames, affect and readings, one stage each."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import affect, interpret, phrases
from loomtext.operators.segments import split_into_segments
from loomtext.schemas import ENTITIES, VERBS
from loomtext.sources import resources
from loomtext.sources.files import read_texts, read_texts_or_errors, texts_frame

#: Adds ents (list of start_char, token, label) and verb_data to a DataFrame with text.
Backend = Callable[[DataFrame], DataFrame]


def place_names(classes: Mapping[str, Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """Names that a text may hold as a geopolitical entity: continents, countries, states and cities."""
    names = sorted({n for kind in phrases.PLACE_CLASSES if kind != "CAMP" for n in classes.get(kind, ())})
    return {"GPE": tuple(names)}


def with_entities(
    df: DataFrame,
    folder: str | None = None,
    terms: Mapping[str, Sequence[str]] | None = None,
    places: bool = True,
    backend: Backend | None = None,
) -> DataFrame:
    """``df`` with entities: gazetteer phrases, place names by class, and what a model backend finds.

    Phrases win over names where they overlap, as they are matched first. Only
    known labels stay; places are refined to their class. Null texts have none.
    """
    known = resources.gazetteer(folder)
    wanted = dict(terms if terms is not None else resources.phrase_terms(folder))
    if places:
        wanted |= place_names(known)
    found = phrases.phrase_matches("text", wanted)
    out = df.withColumn("__found", found)
    if backend is not None:
        model = backend(out)
        overlap = lambda e: F.exists(
            "__found",
            lambda x: (x["start_char"] < e["start_char"] + F.length(e["token"])) & (e["start_char"] < x["start_char"] + F.length(x["token"])),
        )
        own = F.filter("ents", lambda e: e["tag"].isin(*phrases.KEPT_LABELS) & ~overlap(e))
        out = model.withColumn("__found", F.array_sort(F.concat("__found", own.cast(ENTITIES)))).drop("ents")
    refined = F.transform(
        "__found",
        lambda e: F.struct(
            e["start_char"].alias("start_char"), e["token"].alias("token"), phrases.classified(e["token"], e["tag"], known).alias("tag")
        ),
    )
    return out.withColumn("entities", refined.cast(ENTITIES)).drop("__found")


def annotate(
    df: DataFrame,
    include_entities: bool = True,
    include_verbs: bool = False,
    include_text: bool = True,
    backend: Backend | None = None,
    **options,
) -> DataFrame:
    """``df`` with entities and verb_data; what isn't asked for is an empty list and isn't planned.

    Verb frames need a backend that parses, see :mod:`loomtext.backends`.
    """
    out = with_entities(df, backend=backend, **options) if include_entities else df.withColumn("entities", F.array().cast(ENTITIES))
    if include_verbs and backend is None:
        raise ValueError("verb frames need a backend that parses")
    if include_verbs and not include_entities:
        out = backend(out).drop("ents")
    if not include_verbs:
        out = out.withColumn("verb_data", F.array().cast(VERBS))
    return out if include_text else out.drop("text")


def annotate_texts(spark: SparkSession, texts: Sequence[str], file_id: str | None = None, start_seg_id: int = 1, **options) -> DataFrame:
    return annotate(texts_frame(spark, texts, file_id, start_seg_id), **options)


def annotate_text(spark: SparkSession, text: str, **options) -> DataFrame:
    return annotate_texts(spark, [text], **options)


def annotate_files(
    spark: SparkSession,
    inputs: str | Sequence[str],
    pattern: str = "*.txt",
    recursive: bool = True,
    chunk: bool = True,
    n_segments: int = 100,
    encoding: str = "utf-8",
    **options,
) -> DataFrame:
    """Records of files: their segments, or with ``chunk`` off each file as one segment.

    Files of any size split go to as many tasks as there are cores before the
    per-segment work.
    """
    files = read_texts(spark, inputs, pattern, recursive, encoding)
    if chunk:
        return annotate(split_into_segments(files, n_segments), **options)
    return annotate(files.withColumns({"segId": F.lit(1), "segCount": F.lit(1)}), **options)


def annotate_inputs(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8", **options) -> DataFrame:
    """Records of whole files; one that can't be read has a record with its error and no entities."""
    files_ = read_texts_or_errors(spark, paths, encoding).withColumns({"segId": F.lit(1), "segCount": F.lit(1)})
    return annotate(files_, **options)


def chunk_and_annotate_text(spark: SparkSession, text: str, file_id: str = "text", n_segments: int = 100, **options) -> DataFrame:
    docs = spark.createDataFrame([(file_id, text)], "fileId string, text string")
    return annotate(split_into_segments(docs, n_segments), **options)


def _said(df: DataFrame, text: str) -> Column:
    """The text, or the segment where a record has no text."""
    return interpret.first_text(*[F.col(c) for c in dict.fromkeys((text, "segment")) if c in df.columns])


def with_sentiment(
    df: DataFrame, backend: Callable[[Column], Column] | None = None, text: str = "text", include_signed: bool = False, **words
) -> DataFrame:
    """``df`` with sentiment_label, sentiment_score and, if asked for, sentiment_signed; ``backend`` maps a text column to (label, score, signed)."""
    found = (backend or (lambda t: affect.rule_sentiment(t, **words)))(_said(df, text))
    fields = {"sentiment_label": "label", "sentiment_score": "score"} | ({"sentiment_signed": "signed"} if include_signed else {})
    return _spread(df, found, fields)


def with_emotion(
    df: DataFrame,
    backend: Callable[[Column], Column] | None = None,
    distribution: bool = False,
    text: str = "text",
    include_signed: bool = False,
    **words,
) -> DataFrame:
    """``df`` with emotion_label, emotion_score and, if asked for, emotion_dist and emotion_signed."""
    found = (backend or (lambda t: affect.rule_emotion(t, **words)))(_said(df, text))
    fields = {"emotion_label": "label", "emotion_score": "score"} | ({"emotion_dist": "distribution"} if distribution else {})
    fields |= {"emotion_signed": "signed"} if include_signed else {}
    return _spread(df, found, fields)


def _spread(df: DataFrame, found: Column, fields: Mapping[str, str]) -> DataFrame:
    return df.withColumn("__found", found).withColumns({k: F.col(f"__found.{v}") for k, v in fields.items()}).drop("__found")


def with_interpretation(
    df: DataFrame,
    llm_fn: Callable[[Column, Column, Column], Column] | None = None,
    summarize: bool = True,
    explain: bool = True,
    tag_themes: bool = True,
    max_chars: int = 240,
) -> DataFrame:
    """``df`` with summary, interpretation and themes, from the first of text, segment and raw that isn't empty.

    ``llm_fn`` maps (text, sentiment label, emotion label) to an answer, whose
    first two lines that aren't blank are summary and interpretation.
    """
    there = [F.col(c) for c in ("text", "segment", "raw") if c in df.columns]
    t = interpret.first_text(*there)
    label = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    sentiment, emotion = label("sentiment_label"), label("emotion_label")
    short, reading = interpret.summary(t, max_chars), interpret.explanation(sentiment, emotion)
    out = df
    if llm_fn is not None:
        out = out.withColumn("__answer", F.filter(F.transform(F.split(llm_fn(t, sentiment, emotion), "\n"), F.trim), lambda x: x != ""))
        short = F.coalesce(F.get("__answer", F.lit(0)), short)
        reading = F.coalesce(F.get("__answer", F.lit(1)), reading)
    if tag_themes:
        out = out.withColumn("themes", interpret.themes(t))
    if explain:
        out = out.withColumn("interpretation", reading)
    if summarize:
        out = out.withColumn("summary", short)
    return out.drop("__answer")
