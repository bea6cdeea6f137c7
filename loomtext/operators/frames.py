"""Verb frames, event phrases and sentence entities from parsed tokens.

``tokens(doc_id, sent_id, i, text, lemma, pos, dep, head_i)`` and
``ents(doc_id, sent_id, start_i, end_i, text, label)`` are what a parser backend
yields; ``end_i`` isn't included. All steps are equi-joins or groups by document
and sentence, so one partitioning serves them all.

:func:`merged`, :func:`frames_of`, :func:`phrase_of` and :func:`names_by_kind` are the same for one sentence whose tokens
are at hand (:class:`loomtext.operators.parsing.Parse`), without any join.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from loomtext.operators.parsing import Parse

_SENTENCE = ["doc_id", "sent_id"]
PERSON, PLACES, DATES = ("PERSON",), ("FAC", "GPE", "LOC"), ("DATE", "TIME")


def merged(tokens: Parse, names: Sequence[tuple[int, int, str, str]]) -> Parse:
    """A sentence's tokens with each name (start_i, end_i, text, label) as one token, as :func:`merge_entities` has them."""
    if not names:
        return tokens
    head_of = dict(zip(tokens.i, tokens.head))
    within: dict[int, tuple[int, str]] = {}
    for start, end, text, _ in names:
        root = next((i for i in range(start, end) if i in head_of and (not start <= head_of[i] < end or head_of[i] == i)), None)
        if root is not None:
            within.update(dict.fromkeys(range(start, end), (root, text)))
    rows = []
    for i, text, lemma, pos, dep, head in zip(*tokens):
        root, name = within.get(i, (i, None))
        if root == i:
            rows.append((i, text if name is None else name, lemma if name is None else name, pos, dep, within[head][0] if head in within else head))
    return type(tokens)(*map(list, zip(*rows)))


def _below(tokens: Parse) -> dict[int, list[int]]:
    """Places of the tokens that hang on each token, in order."""
    below: dict[int, list[int]] = {}
    for k, (i, head) in enumerate(zip(tokens.i, tokens.head)):
        if i != head:
            below.setdefault(head, []).append(k)
    return below


def _parts(tokens: Parse, below: dict[int, list[int]], head: int) -> tuple[list[str], list[str], list[str]]:
    """Texts of a token's subjects, objects and prepositions' objects, in order."""
    own = below.get(head, ())
    subjects = [tokens.text[k] for k in own if tokens.dep[k] in ("nsubj", "nsubjpass")]
    objects = [tokens.text[k] for k in own if tokens.dep[k] == "dobj"]
    under = [tokens.text[o] for k in own if tokens.dep[k] == "prep" for o in below.get(tokens.i[k], ()) if tokens.dep[o] == "pobj"]
    return subjects, objects, under


def frames_of(tokens: Parse) -> list[tuple[int, str, str, str]]:
    """(i, verb, subject, object) of a sentence's verbs, as :func:`verb_frames` has them."""
    if "VERB" not in tokens.pos:
        return []
    below, found = _below(tokens), []
    for i, text, pos in zip(tokens.i, tokens.text, tokens.pos):
        if pos == "VERB":
            subjects, objects, under = _parts(tokens, below, i)
            found.append((i, text, next(iter(subjects), ""), next(iter(objects or under), "")))
    return found


def phrase_of(tokens: Parse, sentence: str) -> str:
    """A sentence's phrase, as :func:`event_phrases` has it."""
    roots = (k for k, (dep, pos) in enumerate(zip(tokens.dep, tokens.pos)) if dep == "ROOT" and pos in ("VERB", "AUX"))
    k = next(roots, tokens.pos.index("VERB") if "VERB" in tokens.pos else None)
    if k is None:
        return sentence.strip(" ")
    subjects, objects, under = _parts(tokens, _below(tokens), tokens.i[k])
    parts = " ".join(subjects), tokens.lemma[k] or tokens.text[k], " ".join(objects) or " ".join(under)
    return " ".join(p for p in parts if p).strip(" ")


def names_by_kind(names: Sequence[tuple[int, int, str, str]]) -> list[list[str]]:
    """Distinct names of persons, places and dates, as :func:`sentence_entities` has them."""
    return [list(dict.fromkeys(text for _, _, text, label in names if label in own)) for own in (PERSON, PLACES, DATES)]


def merge_entities(tokens: DataFrame, ents: DataFrame) -> DataFrame:
    """Tokens with each entity as one token: the head of its span, with the entity's text.

    Heads that were inside a span point to its token.
    """
    spans = ents.select("doc_id", F.col("start_i"), F.col("end_i"), F.col("text").alias("ent_text"))
    inside = spans.select("doc_id", F.explode(F.sequence(F.col("start_i"), F.col("end_i") - 1)).alias("i"), "start_i", "end_i", "ent_text")
    met = tokens.join(inside, ["doc_id", "i"], "left")
    # the span's root has its head outside, or is the root of the sentence
    outside = (F.col("head_i") < F.col("start_i")) | (F.col("head_i") >= F.col("end_i")) | (F.col("head_i") == F.col("i"))
    roots = (
        met.where(F.col("start_i").isNotNull() & outside)
        .groupBy("doc_id", "start_i")
        .agg(F.min("i").alias("root_i"))
    )
    chosen = inside.join(roots, ["doc_id", "start_i"]).select("doc_id", "i", "root_i", "ent_text")
    to = chosen.select("doc_id", F.col("i").alias("head_i"), F.col("root_i").alias("new_head"))
    return (
        tokens.join(chosen, ["doc_id", "i"], "left")
        .where(F.col("root_i").isNull() | (F.col("root_i") == F.col("i")))
        .join(to, ["doc_id", "head_i"], "left")
        .select(
            "doc_id",
            "sent_id",
            "i",
            F.coalesce("ent_text", "text").alias("text"),
            F.coalesce("ent_text", "lemma").alias("lemma"),
            "pos",
            "dep",
            F.coalesce("new_head", "head_i").alias("head_i"),
        )
    )


def _dependants(tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, head, kind, at, text): subjects, objects and objects of prepositions of some tokens.

    ``kind`` is 0 for a subject, 1 for an object and 2 for a preposition's object.
    """
    child = tokens.select("doc_id", F.col("head_i").alias("head"), "i", "dep", "text").where(F.col("i") != F.col("head"))
    own = child.join(heads.select("doc_id", F.col("i").alias("head")), ["doc_id", "head"])
    direct = own.where(F.col("dep").isin("nsubj", "nsubjpass", "dobj", "obj")).select(
        "doc_id",
        "head",
        F.when(F.col("dep").startswith("nsubj"), 0).otherwise(1).alias("kind"),
        F.col("dep").alias("dep"),
        F.struct(F.col("i").alias("a"), F.col("i").alias("b")).alias("at"),
        "text",
    )
    preps = own.where("dep = 'prep'").select("doc_id", "head", F.col("i").alias("prep_i"))
    under = child.where("dep = 'pobj'").select("doc_id", F.col("head").alias("prep_i"), "i", "text")
    second = preps.join(under, ["doc_id", "prep_i"]).select(
        "doc_id", "head", F.lit(2).alias("kind"), F.lit("pobj").alias("dep"), F.struct(F.col("prep_i").alias("a"), F.col("i").alias("b")).alias("at"), "text"
    )
    return direct.unionByName(second)


def verb_frames(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, i, verb, subject, object, sentence): each verb with its first subject and object.

    A direct object goes before a preposition's; what is missing is ''.
    ``sentences`` has doc_id, sent_id and sentence.
    """
    verbs = tokens.where("pos = 'VERB'")
    found = _dependants(tokens, verbs).where("dep <> 'obj'")
    first = lambda test: F.min(F.when(test, F.struct("kind", "at", "text")))["text"]
    by_verb = found.groupBy("doc_id", F.col("head").alias("i")).agg(
        first(F.col("kind") == 0).alias("subject"), first(F.col("kind") > 0).alias("object")
    )
    return (
        verbs.join(by_verb, ["doc_id", "i"], "left")
        .join(sentences, _SENTENCE, "left")
        .select(
            *_SENTENCE,
            "i",
            F.col("text").alias("verb"),
            F.coalesce("subject", F.lit("")).alias("subject"),
            F.coalesce("object", F.lit("")).alias("object"),
            "sentence",
        )
    )


def verb_data(frames: DataFrame) -> DataFrame:
    """(doc_id, verb_data): a document's frames in order."""
    one = F.struct(F.col("sent_id").cast("int").alias("sent_id"), "i", "verb", "subject", "object", "sentence")
    kept = lambda x: F.struct(*[x[c].alias(c) for c in ("sent_id", "verb", "subject", "object", "sentence")])
    return frames.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), kept).alias("verb_data"))


def _joined(test: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(test, F.struct("at", "text"))))
    return F.array_join(F.transform(pairs, lambda x: x["text"]), " ")


def event_phrases(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, sentence, canon): a sentence's subject, lemma of its main verb, and object.

    The main verb is the root if that is a verb or an auxiliary, else the first
    verb. A sentence without either is its own phrase, stripped.
    """
    is_root = (F.col("dep") == "ROOT") & F.col("pos").isin("VERB", "AUX")
    mains = (
        tokens.where(is_root | (F.col("pos") == "VERB"))
        .groupBy(*_SENTENCE)
        .agg(F.min(F.struct((~is_root).alias("later"), "i", "text", "lemma")).alias("main"))
        .select(*_SENTENCE, F.col("main.i").alias("i"), F.coalesce(F.nullif("main.lemma", F.lit("")), F.col("main.text")).alias("verb"))
    )
    parts = (
        _dependants(tokens, mains)
        .groupBy("doc_id", F.col("head").alias("i"))
        .agg(_joined(F.col("kind") == 0).alias("subj"), _joined(F.col("kind") == 1).alias("obj"), _joined(F.col("kind") == 2).alias("pobj"))
    )
    phrase = F.concat_ws(" ", F.nullif("subj", F.lit("")), "verb", F.nullif(F.coalesce(F.nullif("obj", F.lit("")), "pobj"), F.lit("")))
    made = mains.join(parts, ["doc_id", "i"], "left").select(*_SENTENCE, F.trim(phrase).alias("canon"))
    return sentences.join(made, _SENTENCE, "left").select(
        *_SENTENCE, "sentence", F.coalesce("canon", F.trim("sentence")).alias("canon")
    )


def sentence_entities(ents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, persons, places, dates): distinct names of each kind in order."""

    def names(*labels: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("label").isin(*labels), F.struct("start_i", "text"))))
        return F.array_distinct(F.transform(own, lambda x: x["text"]))

    return ents.groupBy(*_SENTENCE).agg(
        names(*PERSON).alias("persons"), names(*PLACES).alias("places"), names(*DATES).alias("dates")
    )


def mentions_of(tokens: DataFrame, ents: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, sentence, canon, persons, places, dates): what events are made from."""
    none = F.array().cast("array<string>")
    return (
        event_phrases(tokens, sentences)
        .join(sentence_entities(ents), _SENTENCE, "left")
        .withColumns({c: F.coalesce(c, none) for c in ("persons", "places", "dates")})
    )
