"""A small rule parser: tokens with parts of speech and heads, and named spans, for where no model is at hand.

It yields the tables that :mod:`loomtext.operators.frames` takes, from word lists
and the order of words alone; a model's parse is better, see
:func:`loomtext.backends.token_backend`. Each sentence is read in its own row, in
one pass over its words, so neither parse, names, frames nor phrases need a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomtext.operators import frames

TOKEN = r"([A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9])"
AUXILIARIES = tuple("am are be been being can could did do does had has have is may might must shall should was were will would".split())
PREPOSITIONS = tuple(
    "about above across after against along among around at before behind below beside between beyond by during for from in inside into near of off on onto over"
    " through to toward towards under until upon with within without".split()
)
DETERMINERS = tuple("a all an any each every her his its my no our some that the their these this those your".split())
PRONOUNS = tuple("everyone he him i it me nobody she someone them they us we who you".split())
ADVERBS = tuple("again almost also always already even ever here just never not now often once only often soon still suddenly then there together too very".split())
CONJUNCTIONS = tuple("and because but if or so than when where while".split())
#: Verbs that no ending tells, with their lemmas.
VERBS = {
    "began": "begin", "born": "bear", "bring": "bring", "brought": "bring", "built": "build", "came": "come", "come": "come", "died": "die", "drew": "draw", "fell": "fall", "felt": "feel", "find": "find",
    "fled": "flee", "forced": "force", "found": "find", "gave": "give", "give": "give", "go": "go", "gone": "go", "grew": "grow", "heard": "hear", "held": "hold", "hid": "hide", "hidden": "hide",
    "kept": "keep", "knew": "know", "know": "know", "led": "lead", "left": "leave", "live": "live", "lived": "live", "lost": "lose", "made": "make", "meet": "meet", "met": "meet",
    "moved": "move", "ran": "run", "remember": "remember", "said": "say", "sang": "sing", "saw": "see", "say": "say", "see": "see", "seen": "see", "sent": "send", "shared": "share",
    "shot": "shoot", "slept": "sleep", "spoke": "speak", "stood": "stand", "survive": "survive", "take": "take", "taken": "take", "taught": "teach", "tell": "tell", "thought": "think", "told": "tell",
    "took": "take", "went": "go", "woke": "wake", "wore": "wear", "worked": "work", "wrote": "write",
}
#: Words in -ed or -ing that are no verbs.
NO_VERBS = tuple("being bed building during evening everything hundred indeed king morning nothing red something thing wedding".split())
#: Words in -ly that are no adverbs.
NO_ADVERBS = tuple("ally belly bully emily family fly italy jelly july lily reply sally supply".split())
MONTHS = tuple("January February March April May June July August September October November December".split())
DAYS = tuple("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
ORGANISATIONS = tuple("Army Association Church Committee Company Council Institute Ministry Office Party School Union University".split())
LEAST_VERB = 5


#: Tokens that a worker remembers the reading of, rows it takes from a batch, and rows it hands over at once.
HELD_READINGS, SLICE, OUT_ROWS = 1 << 18, 256, 1 << 16
_PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[^ \t\n\x0b\f\rA-Za-zÀ-ÖØ-öø-ÿ0-9]")
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
_YEAR = re.compile(r"1[0-9]{3}|20[0-9]{2}")
_LISTED = {w: pos for pos, own in (("CCONJ", CONJUNCTIONS), ("ADV", ADVERBS), ("PRON", PRONOUNS), ("DET", DETERMINERS), ("ADP", PREPOSITIONS), ("AUX", AUXILIARIES)) for w in own}
_NO_VERBS, _NO_ADVERBS, _DATES, _ORGANISATIONS = frozenset(NO_VERBS), frozenset(NO_ADVERBS), frozenset(MONTHS + DAYS), frozenset(ORGANISATIONS)
_BE = frozenset("am are is was were been being".split())


def part_of_speech(token: str) -> str:
    low = token.lower()
    pos = _LISTED.get(low)
    if pos is not None and pos != "CCONJ":
        return pos
    if low.endswith("ly") and low not in _NO_ADVERBS:
        return "ADV"
    if pos is not None:
        return pos
    if low in VERBS or (len(low) >= LEAST_VERB and low.endswith(("ed", "ing")) and low not in _NO_VERBS):
        return "VERB"
    return "NOUN" if _LETTER.match(token) else "NUM" if "0" <= token[0] <= "9" else "PUNCT"


def lemma(token: str, pos: str) -> str:
    """The verb without its ending, or its lemma where it is listed; other words in lower case."""
    low = token.lower()
    if pos == "VERB":
        return VERBS.get(low) or re.sub("(ed|ing)$", "", low)
    return "be" if low in _BE else low


class _Readings(dict):
    """(part of speech, lemma, kind of name) of a token, worked out when it is first met."""

    def __missing__(self, token: str) -> tuple[str, str, str]:
        pos = part_of_speech(token)
        dated = token in _DATES or _YEAR.fullmatch(token)
        named = ("A" <= token[0] <= "Z" or "À" <= token[0] <= "Þ" and token[0] != "×") and token.lower() not in _LISTED
        if len(self) >= HELD_READINGS:
            self.clear()
        self[token] = found = pos, lemma(token, pos), "DATE" if dated else "NAME" if named else ""
        return found


_READ = _Readings().__getitem__


class Parse(NamedTuple):
    """A sentence's tokens, in lists of one length, in order of ``i``."""

    i: list[int]
    text: list[str]
    lemma: list[str]
    pos: list[str]
    dep: list[str]
    head: list[int]


def parsed(sentence: str, first: int = 0) -> tuple[Parse, list[str]]:
    """(tokens of a sentence, numbered from ``first``, kinds of name that they are); one pass, however long it is."""
    words = _PIECES.findall(sentence)
    n = len(words)
    pos, lemmas, kinds = map(list, zip(*map(_READ, words))) if n else ([], [], [])
    deps, heads = ["dep"] * n, list(range(first, first + n))
    verb = prep = last = root = aux = -1
    k = 0
    while k < n:
        kind = pos[k]
        if kind == "NOUN" or kind == "PRON":
            end = k
            while end + 1 < n and (pos[end + 1] == "NOUN" or pos[end + 1] == "PRON"):
                end += 1
            for j in range(k, end):
                deps[j], heads[j] = "compound", first + end
            after = end + 1
            while after < n and (pos[after] == "AUX" or pos[after] == "ADV"):
                after += 1
            anchor = verb if verb > prep else prep
            if after < n and pos[after] == "VERB":
                deps[end], heads[end] = "nsubj", first + after
            elif anchor > last:
                deps[end], heads[end] = "pobj" if anchor == prep else "dobj", first + anchor
            last = k = end
        elif kind == "VERB":
            verb = k
            root = k if root < 0 else root
        elif kind == "ADP":
            if verb >= 0:
                deps[k], heads[k] = "prep", first + verb
            prep = k
        elif kind == "AUX" and aux < 0:
            aux = k
        k += 1
    root = root if root >= 0 else aux
    if root >= 0:
        deps[root] = "ROOT"
    return Parse(list(range(first, first + n)), words, lemmas, pos, deps, heads), kinds


def names_of(tokens: Parse, kinds: Sequence[str], places: Collection[str] = ()) -> list[tuple[int, int, str, str]]:
    """(start_i, end_i, text, label) of the names in a sentence, by the rules of :func:`rule_entities`."""
    words, found = tokens.text, []
    if not any(kinds):
        return found
    k, n = 0, len(words)
    while k < n:
        kind, end = kinds[k], k + 1
        if kind:
            while end < n and kinds[end] == kind:
                end += 1
            text = " ".join(words[k:end])
            if k or kind == "DATE" or end - k > 1 or text in places:
                label = "DATE" if kind == "DATE" else "GPE" if text in places else "ORG" if words[end - 1] in _ORGANISATIONS else "PERSON"
                found.append((tokens.i[k], tokens.i[k] + end - k, text, label))
        k = end
    return found


def each_sentence(sentences: DataFrame, schema: str, run: Callable[[bool, int, str], Sequence[list]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_id, columns of ``schema``): what ``run`` makes of (whether the id is known, sent_id, text), a list a column.

    All of it is a sentence's own work, so nothing is shuffled. Columns are bigint, string or array<string>.
    """
    fields = [f.split() for f in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[kind] for _, kind in fields]

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in given:
            for a in range(0, whole.num_rows, SLICE):
                ids, numbers, texts = whole.slice(a, SLICE).columns
                known, numbers = ids.is_valid().to_pylist(), numbers.to_pylist()
                at: list[int] = []
                columns: list[list] = [[] for _ in kinds]

                def out() -> pa.RecordBatch:
                    made = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
                    sent = pa.array([numbers[k] for k in at], pa.int64())
                    made = pa.record_batch([ids.take(pa.array(at, pa.int64())), sent, *made], names=["doc_id", "sent_id", *[n for n, _ in fields]])
                    at.clear()
                    for c in columns:
                        c.clear()
                    return made

                for k, said in enumerate(texts.to_pylist()):
                    rows = run(known[k], numbers[k], said or "")
                    at += [k] * len(rows[0])
                    for c, own in zip(columns, rows):
                        c += own
                    if len(at) >= OUT_ROWS:
                        yield out()
                yield out()

    own = sentences.select(F.col(key).alias("doc_id"), F.col("sent_id").cast("bigint").alias("sent_id"), F.col(text).alias("text"))
    kept = [StructField("doc_id", own.schema["doc_id"].dataType), StructField("sent_id", LongType())]
    return own.mapInArrow(batches, StructType(kept + StructType.fromDDL(schema).fields))


def _numbered_as(sentences: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with sent_id of the type that it has in ``sentences``, as joins with these would have it."""
    return found.withColumn("sent_id", F.col("sent_id").cast(sentences.schema["sent_id"].dataType))


def _first(sent_id: int) -> int:
    return sent_id * (1 << 20)


_TOKENS = "i bigint, text string, lemma string, pos string, dep string, head_i bigint"


def rule_tokens(sentences: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_id, i, text, lemma, pos, dep, head_i) of sentences (key, sent_id, text); i counts within the document.

    A noun or pronoun that ends a run of such is a subject if only auxiliaries and
    adverbs stand between it and the next verb. Else it is the object of the
    last verb or preposition before it, if it is the first to follow that. The others of a run hang on its end. A
    preposition belongs to the last verb. The first verb is the root, or the first auxiliary of a sentence without verb.
    Blank and null sentences have no tokens.
    """
    return each_sentence(sentences, _TOKENS, lambda _, sent_id, said: parsed(said, _first(sent_id))[0], key, text)


def rule_entities(sentences: DataFrame, places: Sequence[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_id, start_i, end_i, text, label) of sentences: runs of capitalised words, months, days and years.

    A run that opens a sentence counts if it has a second word. A run is a GPE if
    ``places`` has it, an ORG if its last word names a kind of body, else a PERSON; dates are DATE.
    """
    known = frozenset(places)
    run = lambda _, sent_id, said: _columns(names_of(*parsed(said, _first(sent_id)), known), 4)
    return each_sentence(sentences, "start_i bigint, end_i bigint, text string, label string", run, key, text)


def _columns(rows: Sequence[tuple], width: int) -> list[list]:
    return list(map(list, zip(*rows))) if rows else [[] for _ in range(width)]


def _merged(known: bool, sent_id: int, said: str, places: Collection[str]) -> tuple[Parse, list[tuple[int, int, str, str]]]:
    """(tokens with each name as one, names) of a sentence; names don't meet the tokens of a document without id, nor do heads."""
    tokens, kinds = parsed(said, _first(sent_id))
    names = names_of(tokens, kinds, places)
    return frames.merged(tokens, names) if known else tokens, names


def rule_merged(sentences: DataFrame, places: Sequence[str] = ()) -> DataFrame:
    """:func:`loomtext.operators.frames.merge_entities` of the rules' tokens and names, within each sentence's row."""
    among = frozenset(places)
    return each_sentence(sentences, _TOKENS, lambda known, sent_id, said: _merged(known, sent_id, said, among)[0])


def rule_frames(sentences: DataFrame, places: Sequence[str] = ()) -> DataFrame:
    """:func:`loomtext.operators.frames.verb_frames` of the rules' tokens, within each sentence's row; none without a document's id."""
    among = frozenset(places)

    def run(known: bool, sent_id: int, said: str) -> list[list]:
        found = frames.frames_of(_merged(known, sent_id, said, among)[0]) if known else []
        return _columns([(*f, said) for f in found], 5)

    return each_sentence(sentences, "i bigint, verb string, subject string, object string, sentence string", run)


def rule_phrases(sentences: DataFrame, places: Sequence[str] = ()) -> DataFrame:
    """:func:`loomtext.operators.frames.event_phrases` of the rules' tokens, within each sentence's row."""
    among = frozenset(places)

    def run(known: bool, sent_id: int, said: str) -> list[list]:
        return [[said], [frames.phrase_of(_merged(known, sent_id, said, among)[0], said) if known else said.strip(" ")]]

    return _numbered_as(sentences, each_sentence(sentences, "sentence string, canon string", run))


def rule_names(sentences: DataFrame, places: Sequence[str] = ()) -> DataFrame:
    """:func:`loomtext.operators.frames.sentence_entities` of the rules' names, within each sentence's row."""
    among = frozenset(places)

    def run(_: bool, sent_id: int, said: str) -> list[list]:
        names = names_of(*parsed(said), among)
        return [[x] for x in frames.names_by_kind(names)] if names else [[], [], []]

    return each_sentence(sentences, "persons array<string>, places array<string>, dates array<string>", run)


def rule_mentions(sentences: DataFrame, places: Sequence[str] = ()) -> DataFrame:
    """:func:`loomtext.operators.frames.mentions_of` of the rules' tokens and names, within each sentence's row."""
    among = frozenset(places)

    def run(known: bool, sent_id: int, said: str) -> list[list]:
        tokens, names = _merged(known, sent_id, said, among)
        canon = frames.phrase_of(tokens, said) if known else said.strip(" ")
        return [[said], [canon], *[[x] for x in frames.names_by_kind(names if known else [])]]

    return _numbered_as(sentences, each_sentence(sentences, "sentence string, canon string, persons array<string>, places array<string>, dates array<string>", run))


_NAME = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+(?: [A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+)*|\b(?:1[0-9]{3}|20[0-9]{2})\b"


def named_spans(text: Column, places: Sequence[str] = ()) -> Column:
    """(start_char, token, tag) of capitalised runs and years in a text, by the rules of :func:`rule_entities`; none for null.

    One word that opens a sentence isn't a name. Within a row: what is between names gives their offsets.
    """
    names = F.coalesce(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), F.array().cast("array<string>"))
    kind = "array<struct<start_char:int,token:string,tag:string>>"
    low = lambda token: F.lower(F.regexp_extract(token, r"^\S+", 0))
    small = (*AUXILIARIES, *PREPOSITIONS, *DETERMINERS, *PRONOUNS, *ADVERBS, *CONJUNCTIONS)

    def add(held: Column, found: Column) -> Column:
        begun = held["at"] + F.length(found["gap"])
        # a small word with a capital opens a sentence, not a name
        lead = F.when(low(found["token"]).isin(*small), F.length(F.regexp_extract(found["token"], r"^\S+ ", 0))).otherwise(0)
        start, token = begun + lead, F.substr(found["token"], lead + 1)
        date = token.isin(*MONTHS, *DAYS) | token.rlike("^[0-9]")
        tag = F.when(date, "DATE").when(token.isin(*places), "GPE") if places else F.when(date, "DATE")
        tag = tag.when(F.regexp_extract(token, r"\S+$", 0).isin(*ORGANISATIONS), "ORG").otherwise("PERSON")
        opens = ((held["at"] == 0) & (F.trim(found["gap"]) == "")) | found["gap"].rlike(r"[.!?][\"')\]]*\s+$")
        one = F.instr(token, " ") == 0
        kept = date | (token.isin(*places) if places else F.lit(False)) | (~(opens & one & (lead == 0)) & ~(one & low(token).isin(*small)))
        own = F.array(F.struct(start.cast("int").alias("start_char"), token.alias("token"), tag.alias("tag")))
        spans = F.when(kept, F.concat(held["spans"], own.cast(kind))).otherwise(held["spans"])
        return F.struct((begun + F.length(found["token"])).cast("int").alias("at"), spans.alias("spans"))

    pairs = F.arrays_zip(names.alias("token"), F.slice(F.split(text, _NAME), F.lit(1), F.size(names)).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    return F.coalesce(F.aggregate(pairs, zero, add)["spans"], F.array().cast(kind))
