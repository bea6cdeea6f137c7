"""Events: mentions grouped by phrase, merged, categorised and exported."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.affect import clamp, rule_emotion
from loomtext.functions.text import let
from loomtext.operators import frames, parsing
from loomtext.operators.segments import split_sentences

PERSONS_SHOWN = 5
#: More names than a list can hold.
MOST_NAMES = (1 << 31) - 8
_FIRST_PERSON = r"(?iU)\b(?:I|I'm|me|my|our|us|we|we're)\b"


def event_key(phrase: Column) -> Column:
    return F.substring(F.sha1(F.lower(phrase)), 1, 16)


def aggregate_mentions(mentions: DataFrame, evidence: bool = True) -> DataFrame:
    """One row an event: mentions of a file with the same phrase in any case.

    ``mentions`` has fileId, ord, segId, canon, sentence, persons, places and
    dates. The event has the first spelling of its phrase, every source and
    sentence in order, the first place and date that is known, and the distinct
    persons, of whom the first five are ``persons`` and the rest ``others``.
    Confidence grows from 0.35 by 0.05 a mention and 0.05 for each kind of name in
    it, up to 1. Blank phrases are no events. One shuffle, by file and phrase; without
    ``evidence`` the sentences stay out of it, and of the result.
    """
    # all of a mention is in one struct, so whatever is asked of the events has the same shuffle and Spark makes it once
    per = F.struct("ord", "segId", "canon", *(["sentence"] if evidence else []), "persons", "places", "dates")
    grouped = (
        mentions.where(F.coalesce(F.trim("canon"), F.lit("")) != "")
        .withColumn("key", event_key(F.col("canon")))
        .groupBy("fileId", "key")
        .agg(F.array_sort(F.collect_list(per)).alias("m"))
    )
    names = F.array_distinct(F.flatten(F.transform("m", lambda x: x["persons"])))
    some = lambda x: F.when(F.size(x) > 0, 1).otherwise(0)
    gained = F.aggregate("m", F.lit(0), lambda s, x: s + 1 + some(x["persons"]) + some(x["places"]) + some(x["dates"]))
    known = grouped.withColumn("names", names)
    first = lambda c: F.get(F.filter(F.flatten(F.transform("m", lambda x: x[c])), lambda n: n != ""), F.lit(0))
    return known.select(
        "fileId",
        F.substring(F.sha1(F.concat_ws("\x01", "fileId", "key")), 1, 32).alias("eventId"),
        F.get("m", F.lit(0))["canon"].alias("event"),
        F.transform("m", lambda x: x["segId"].cast("int")).alias("sources"),
        *([F.transform("m", lambda x: x["sentence"]).alias("evidence")] if evidence else []),
        first("places").alias("place"),
        first("dates").alias("date"),
        F.slice("names", 1, PERSONS_SHOWN).alias("persons"),
        F.slice("names", PERSONS_SHOWN + 1, MOST_NAMES).alias("others"),
        F.least(F.lit(1.0), F.round(0.35 + 0.05 * gained, 9)).alias("confidence"),
        F.size("m").alias("count_mentions"),
        F.get("m", F.lit(0))["ord"].alias("ord"),
    )


def categorized(events: DataFrame, least_mentions: int = 2) -> DataFrame:
    """``events`` with category: major if mentioned often for its file, or if person and place are known."""
    # a maximum and a join: a file's events needn't meet in one task
    most = events.groupBy("fileId").agg(F.max("count_mentions").alias("most_mentions"))
    often = F.col("count_mentions") >= F.greatest(F.lit(least_mentions), F.lit(2), F.floor(0.4 * F.col("most_mentions")).cast("int"))
    known = (F.size("persons") > 0) & (F.coalesce("place", F.lit("")) != "")
    met = events.withColumn("category", F.when(known, "major").otherwise("minor")).join(most, "fileId")
    return met.withColumn("category", F.when(often, "major").otherwise(F.col("category"))).select(*events.columns, "category")


def with_pooled_emotion(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """``events`` with emotion and emotion_valence of their source segments.

    ``predictions`` has fileId, segId, label and signed. Valence is the mean over
    sources; emotion the most frequent label, of those as frequent the one met
    first. A source without prediction counts for neither.
    """
    each = events.select("fileId", "eventId", F.posexplode("sources").alias("pos", "segId"))
    met = each.join(predictions.select("fileId", "segId", "label", "signed"), ["fileId", "segId"])
    by_label = met.groupBy("fileId", "eventId", "label").agg(
        F.count("*").alias("n"), F.min("pos").alias("pos"), F.sum("signed").alias("signed"), F.count("signed").alias("valued")
    )
    best = F.max(F.when(F.coalesce("label", F.lit("")) != "", F.struct("n", (-F.col("pos")).alias("early"), "label")))
    pooled = by_label.groupBy("fileId", "eventId").agg(
        best["label"].alias("emotion"), clamp(F.sum("signed") / F.nullif(F.sum("valued"), F.lit(0))).alias("emotion_valence")
    )
    return events.drop("emotion", "emotion_valence").join(pooled, ["fileId", "eventId"], "left")


def greedy_clusters(vectors: np.ndarray, threshold: float) -> list[int]:
    """The cluster of each unit vector, in order: the nearest centroid from the threshold on, else a new one."""
    out: list[int] = []
    centroids = np.empty((0, vectors.shape[1] if vectors.ndim == 2 else 0))
    for x in vectors:
        near = centroids @ x
        best = int(near.argmax()) if len(near) else -1
        if best >= 0 and near[best] >= threshold:
            moved = centroids[best] + x
            centroids[best] = moved / np.linalg.norm(moved)
        else:
            best = len(centroids)
            centroids = np.vstack([centroids, x])
        out.append(best)
    return out


def semantic_clusters(vectors: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(group, id, cluster): greedy clusters within each group, in order of ord, which tells ids apart.

    ``vectors`` has group, id, ord and embedding. A vector joins the nearest
    centroid it is similar enough to, and moves it; else it opens a cluster. The
    result depends on the order, so a group is one task's work.
    """
    kind = dict(vectors.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "id"])
        matrix = np.array(frame["embedding"].tolist(), dtype=float).reshape(len(frame), -1)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        clusters = greedy_clusters(matrix / np.where(length == 0, 1.0, length), threshold)
        return pd.DataFrame({"group": frame["group"], "id": frame["id"], "cluster": clusters})

    return vectors.groupBy("group").applyInPandas(run, f"group {kind['group']}, id {kind['id']}, cluster int")


def merge_clusters(events: DataFrame, clusters: DataFrame | Column) -> DataFrame:
    """Events of one cluster as one: the first's phrase and id, sources once, all evidence, counts summed.

    ``clusters`` has fileId, eventId and cluster, or is the cluster as a column of
    ``events``, which spares the join. Confidence is the highest so
    far plus 0.05 for each event that joins, up to 1; persons beyond five are
    others. Events without evidence give none. Each of the lists is made by itself, in time by its length.
    """
    met = events.withColumn("cluster", clusters) if isinstance(clusters, Column) else events.join(clusters, ["fileId", "eventId"])
    # events that begin together go by id, of which a number is enough: ids don't compress
    met = met.withColumns({"people": F.concat("persons", "others"), "tie": F.conv(F.substring("eventId", 1, 15), 16, 10).cast("bigint")})
    head = lambda c: F.min(F.struct("ord", "tie", F.col(c).alias("value")))["value"]
    first = lambda c: F.min(F.when(F.coalesce(c, F.lit("")) != "", F.struct("ord", "tie", F.col(c).alias("value"))))["value"]
    listed = lambda *c: F.array_sort(F.collect_list(F.struct("ord", "tie", *c)))
    of = lambda m, c: F.transform(m, lambda x: x[c])
    grouped = met.groupBy("fileId", "cluster").agg(
        head("eventId").alias("first_id"),
        head("event").alias("event"),
        listed("sources", "people").alias("m"),
        *([F.flatten(of(listed("evidence"), "evidence")).alias("evidence")] if "evidence" in events.columns else []),
        first("place").alias("place"),
        first("date").alias("date"),
        of(listed("confidence"), "confidence").alias("c"),
        F.sum("count_mentions").cast("int").alias("count_mentions"),
        F.min("ord").alias("ord"),
    )
    grouped = grouped.withColumns({"s": of("m", "sources"), "names": F.array_distinct(F.flatten(of("m", "people")))})
    rest = lambda c: F.slice(c, 2, MOST_NAMES)
    confidence = F.aggregate(rest("c"), F.get("c", F.lit(0)), lambda c, x: F.least(F.lit(1.0), F.round(F.greatest(c, x) + 0.05, 9)))
    own = F.get("s", F.lit(0))
    return grouped.select(
        "fileId",
        F.col("first_id").alias("eventId"),
        "event",
        F.concat(own, F.array_except(F.flatten(rest("s")), own)).alias("sources"),
        *(["evidence"] if "evidence" in events.columns else []),
        "place",
        "date",
        F.slice("names", 1, PERSONS_SHOWN).alias("persons"),
        F.slice("names", PERSONS_SHOWN + 1, MOST_NAMES).alias("others"),
        confidence.alias("confidence"),
        "count_mentions",
        "ord",
    )


def normalized(events: DataFrame, answer: Column) -> DataFrame:
    """Events with the fields of a model's JSON answers merged in.

    What an answer has and isn't empty replaces event, place and date; new names
    are added, persons beyond five as others. A changed phrase adds 0.05 to the
    confidence. An answer that is no JSON object changes nothing.
    """
    told = F.from_json(F.when(F.startswith(F.ltrim(answer), F.lit("{")), answer), "event string, place string, date string, persons array<string>, others array<string>")
    none = F.array().cast("array<string>")
    new = lambda names, *old: F.filter(
        F.array_distinct(F.coalesce(names, none)), lambda p: p.isNotNull() & ~F.array_contains(F.concat(*old), p)
    )
    filled = lambda new_, old: F.coalesce(F.nullif(new_, F.lit("")), old)
    out = events.withColumn("__told", told)
    room = F.greatest(F.lit(0), F.lit(PERSONS_SHOWN) - F.size("persons"))
    out = out.withColumn("__new", new(F.col("__told.persons"), F.col("persons")))
    persons = F.concat("persons", F.slice(F.col("__new"), F.lit(1), room))
    others = F.concat("others", F.filter(F.slice(F.col("__new"), room + 1, 1_000_000), lambda p: ~F.array_contains("others", p)))
    out = out.withColumns({"__persons": persons, "__others": others})
    out = out.withColumn("__others", F.concat("__others", new(F.col("__told.others"), F.col("__persons"), F.col("__others"))))
    event = filled(F.col("__told.event"), F.col("event"))
    return out.withColumns(
        {
            "confidence": F.when(event != F.col("event"), F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence")),
            "event": event,
            "place": filled(F.col("__told.place"), F.col("place")),
            "date": filled(F.col("__told.date"), F.col("date")),
            "persons": F.col("__persons"),
            "others": F.col("__others"),
        }
    ).drop("__told", "__new", "__persons", "__others")


def extract_events(
    mentions: DataFrame, predictions: DataFrame | None = None, least_mentions: int = 2, clusters: DataFrame | None = None
) -> DataFrame:
    """Events of mentions, by files: grouped, merged by clusters if given, categorised, with pooled emotions."""
    found = aggregate_mentions(mentions)
    if clusters is not None:
        found = merge_clusters(found, clusters)
    found = categorized(found, least_mentions)
    if predictions is None:
        return found.withColumns({"emotion": F.lit(None).cast("string"), "emotion_valence": F.lit(None).cast("double")})
    return with_pooled_emotion(found, predictions)


def mentions_in_segments(segments_: DataFrame, places: Sequence[str] = (), parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """Event mentions of segments (fileId, segId, text): a phrase, names, places and dates for each sentence.

    ``parse`` maps sentences (doc_id, sent_id, text) to tokens and entities; without it the rules of
    :mod:`loomtext.operators.parsing` do. Blank segments have no mentions.
    """
    named = segments_.select(F.struct("fileId", "segId").alias("doc_id"), "text")
    said = split_sentences(named)
    if parse is None:
        found = parsing.rule_mentions(said, places)
    else:
        tokens, ents = parse(said)
        found = frames.mentions_of(frames.merge_entities(tokens, ents), ents, said.withColumnRenamed("text", "sentence"))
    return found.select(
        "doc_id.fileId", "doc_id.segId", F.struct("doc_id.segId", "sent_id").alias("ord"), "canon", "sentence", "persons", "places", "dates"
    )


def rule_parse(sentences: DataFrame, places: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    return parsing.rule_tokens(sentences), parsing.rule_entities(sentences, places)


def extract_events_from_segments(
    segments_: DataFrame,
    least_mentions: int = 2,
    emotion: Callable[[Column], Column] | None = rule_emotion,
    dedupe: float | None = None,
    answer: Callable[[Column, Column, Column, Column, Column], Column] | None = None,
    places: Sequence[str] = (),
    parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """Events of files from the texts of their segments (fileId, segId, text).

    ``emotion`` maps a text column to a prediction with label and signed, None leaves emotions out;
    ``dedupe`` is the similarity from which phrases of a file count as one event;
    ``answer`` maps (event, place, date, persons, others) to a model's JSON that is merged in.
    """
    found = aggregate_mentions(mentions_in_segments(segments_, places, parse))
    if dedupe is not None:
        order = F.shiftleft(F.col("ord.segId").cast("bigint"), 32) + F.col("ord.sent_id")
        phrases = found.select(F.col("fileId").alias("group"), F.col("eventId").alias("id"), order.alias("ord"), phrase_vector(F.col("event")).alias("embedding"))
        clusters = semantic_clusters(phrases, dedupe).withColumnsRenamed({"group": "fileId", "id": "eventId"})
        found = merge_clusters(found, clusters)
    found = categorized(found, least_mentions)
    if emotion is not None:
        felt = segments_.select("fileId", "segId", emotion(F.col("text")).alias("e")).select("fileId", "segId", "e.label", "e.signed")
        found = with_pooled_emotion(found, felt)
    else:
        found = found.withColumns({"emotion": F.lit(None).cast("string"), "emotion_valence": F.lit(None).cast("double")})
    if answer is not None:
        found = normalized(found, answer(*[F.col(c) for c in ("event", "place", "date", "persons", "others")]))
    return found


def extract_events_from_files(spark: SparkSession, files: Mapping[str, Sequence[str]], **options) -> DataFrame:
    """Events of {file: segments}; segments are numbered from 0."""
    rows = [(name, k, text) for name, own in files.items() for k, text in enumerate(own)]
    return extract_events_from_segments(spark.createDataFrame(rows, "fileId string, segId int, text string"), **options)


PHRASE_DIMENSIONS = 64


def phrase_vector(phrase: Column) -> Column:
    """A phrase as counts of its words' letter triples in hashed dimensions, so that phrases of like wording are near."""
    low = F.concat(F.lit(" "), F.lower(phrase), F.lit(" "))
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda k: F.pmod(F.xxhash64(F.substring(low, k, F.lit(3))), F.lit(PHRASE_DIMENSIONS)).cast("int"))
    zero = F.array_repeat(F.lit(0.0), PHRASE_DIMENSIONS)
    return let(triples, lambda t: F.transform(zero, lambda z, d: z + F.size(F.filter(t, lambda x: x == d))))


def witness(evidence: Column) -> Column:
    """narrator where a sentence speaks in the first person, else other/unknown."""
    return F.when(F.exists(evidence, lambda s: s.rlike(_FIRST_PERSON)), "narrator").otherwise("other/unknown")


def people(persons: Column, others: Column) -> Column:
    return F.array_join(F.array_distinct(F.concat(persons, others)), ", ")


def full_events(events: DataFrame) -> DataFrame:
    """The fourteen columns of an event table with its lists as they are."""
    return events.select(
        "fileId", "eventId", "event", "category", "place", "date", "persons", "others", "emotion", "emotion_valence", "confidence", "count_mentions", "sources", "evidence"
    )


def flat_events(events: DataFrame) -> DataFrame:
    """The twelve flat columns of an event table; what is unknown is '' where it is text."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return events.select(
        "fileId", "eventId", "event", "category", text("place"), text("date"), witness(F.col("evidence")).alias("witness"),
        people(F.col("persons"), F.col("others")).alias("people"), text("emotion"), "emotion_valence", "count_mentions", "confidence",
    )


def event_table(events: DataFrame, schema: str = "default") -> DataFrame:
    """``events`` as a table: ``default`` keeps lists, ``flat`` has twelve flat columns."""
    schemas = {"default": full_events, "flat": flat_events}
    if schema not in schemas:
        raise ValueError(f"unknown schema {schema!r}; one of {', '.join(sorted(schemas))}")
    return schemas[schema](events)
