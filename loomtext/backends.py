"""Seams for models: parsers, classifiers, language models and geocoders, called in Arrow batches.

Every factory makes its model once in a Python worker and keeps it. Missing
libraries raise an error that names them.
"""

from __future__ import annotations

import importlib
import os
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import affect, responses
from loomtext.functions.text import let
from loomtext.operators import parsing
from loomtext.schemas import ENTITIES, VERBS

SENTIMENT_PROMPT = (
    "Rate the sentiment of this text. Answer with one JSON object with the fields"
    ' "label" (positive, negative or neutral) and "score" (from 0 to 1).\n'
)
EMOTION_PROMPT = (
    "Name the emotion that is strongest in this text, of anger, disgust, fear, joy, neutral, sadness, surprise."
    ' Answer with one JSON object with the fields "label", "score" (from 0 to 1) and, if you can, "distribution",'
    " an object with a probability for each of the seven.\n"
)
EVENT_PROMPT = (
    "Put this event in normal form, as one JSON object with the fields event, place, date, persons and others"
    " (the last two are lists). Use only what is said here; leave unknown fields empty.\n"
)


#: Words of a text that a classifier gets at once.
WINDOW_WORDS = 250


class MissingLibrary(RuntimeError):
    pass


def needed(name: str) -> Any:
    try:
        return importlib.import_module(name)
    except ImportError as error:
        raise MissingLibrary(f"this backend needs the library {name!r}") from error


def llm_answers(answer: Callable[[list[str]], list[str]], prompt: str = "", pause_s: float = 0.0) -> Callable[[Column], Column]:
    """A column function: ``answer`` gets the prompts of a batch and gives their answers.

    A batch whose call fails has null answers: one bad request must not end a job.
    """

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            asked = [prompt + (t or "") for t in texts]
            try:
                told = list(answer(asked)) if asked else []
            except MissingLibrary:
                raise
            except Exception:  # noqa: BLE001
                told = [None] * len(asked)
            if pause_s:
                time.sleep(pause_s)
            yield pd.Series(told, dtype="object")

    return call


def llm_sentiment(answer: Callable[[list[str]], list[str]], pause_s: float = 0.0) -> Callable[[Column], Column]:
    ask = llm_answers(answer, SENTIMENT_PROMPT, pause_s)

    def told(p: Column) -> Column:
        return F.struct(p["label"].alias("label"), p["score"].alias("score"), affect.signed_from_top(p["label"], p["score"]).alias("signed"))

    return lambda text: let(responses.parsed_sentiment(ask(text)), told)


def llm_emotion(
    answer: Callable[[list[str]], list[str]], pause_s: float = 0.0, return_distribution: bool = True
) -> Callable[[Column], Column]:
    ask = llm_answers(answer, EMOTION_PROMPT, pause_s)

    def told(p: Column) -> Column:
        shares = p["distribution"] if return_distribution else F.lit(None).cast("map<string,double>")
        from_top = affect.emotion_signed_from_top(p["label"], p["score"])
        signed = F.when(p["distribution"].isNotNull(), affect.emotion_signed_from_distribution(p["distribution"])).otherwise(from_top)
        return F.struct(p["label"].alias("label"), p["score"].alias("score"), signed.alias("signed"), shares.alias("distribution"))

    return lambda text: let(responses.parsed_emotion(ask(text)), told)


def event_prompt(event: Column, place: Column, date: Column, persons: Column, others: Column) -> Column:
    told = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit(EVENT_PROMPT + "Event: "), told(event), F.lit("\nPlace: "), told(place), F.lit("\nDate: "), told(date),
        F.lit("\nPersons: "), F.array_join(persons, ", "), F.lit("\nOthers: "), F.array_join(others, ", "),
    )


def chat_client(
    provider: str, model: str, api_key: str | None = None, base_url: str | None = None, temperature: float = 0.0, max_tokens: int = 128
) -> Callable[[list[str]], list[str]]:
    """One request for each prompt to a provider of language models.

    Providers: openai, xai, groq and openai_compat (with ``base_url``), anthropic,
    google, and ollama on a local port.
    """

    @cache
    def client() -> Callable[[str], str]:
        if provider in ("openai", "openai_compat", "xai", "groq"):
            base = base_url or {"xai": "https://api.x.ai/v1", "groq": "https://api.groq.com/openai/v1"}.get(provider)
            made = needed("openai").OpenAI(api_key=api_key, base_url=base)
            return lambda p: (
                made.chat.completions.create(
                    model=model, temperature=temperature, max_tokens=max_tokens, messages=[{"role": "user", "content": p}]
                ).choices[0].message.content or ""
            )
        if provider == "anthropic":
            made = needed("anthropic").Anthropic(api_key=api_key)
            return lambda p: made.messages.create(
                model=model, temperature=temperature, max_tokens=max_tokens, messages=[{"role": "user", "content": p}]
            ).content[0].text
        if provider == "google":
            library = needed("google.generativeai")
            library.configure(api_key=api_key)
            made = library.GenerativeModel(model)
            return lambda p: made.generate_content(p).text
        if provider == "ollama":
            import json
            from urllib.request import Request, urlopen

            def post(p: str) -> str:
                body = {"model": model, "prompt": p, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens}}
                request = Request(f"{base_url or 'http://localhost:11434'}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
                with urlopen(request) as reply:  # noqa: S310
                    return json.load(reply)["response"]

            return post
        raise ValueError(f"unknown provider {provider!r}")

    return lambda prompts: [client()(p) for p in prompts]


def _classifier(model: str) -> Callable[[Column], Column]:
    """Scores of a text over all its windows of WINDOW_WORDS words, each weighed by its words; no text is cut."""

    @F.pandas_udf("map<string,double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pipe = needed("transformers").pipeline("text-classification", model=model, top_k=None)
        for texts in batches:
            out = []
            for words in ((t or "").split() for t in texts):
                parts = [words[a : a + WINDOW_WORDS] for a in range(0, len(words), WINDOW_WORDS)] or [[]]
                found = pipe([" ".join(p) for p in parts], truncation=True)
                mean: dict[str, float] = {}
                for part, row in zip(parts, found):
                    for x in row:
                        label = x["label"].lower()
                        mean[label] = mean.get(label, 0.0) + float(x["score"]) * (len(part) or 1) / (len(words) or 1)
                out.append(mean)
            yield pd.Series(out)

    return scores


def _top(scores: Column) -> Column:
    return F.get(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("label")))), F.lit(0))


def hf_sentiment(model: str, normalize_signed: bool = True) -> Callable[[Column], Column]:
    classify = _classifier(model)

    def run(text: Column) -> Column:
        scores = classify(text)
        best = _top(scores)
        return F.struct(
            affect.normal_label(best["label"]).alias("label"), (-best["less"]).alias("score"), affect.signed_from_scores(scores, normalize_signed).alias("signed")
        )

    return run


def hf_emotion(model: str) -> Callable[[Column], Column]:
    classify = _classifier(model)

    def run(text: Column) -> Column:
        shares = affect.renormalized(classify(text))
        best = _top(shares)
        return F.struct(
            best["label"].alias("label"), (-best["less"]).alias("score"), affect.emotion_signed_from_distribution(shares).alias("signed"), shares.alias("distribution")
        )

    return run


#: name -> function of (backend options) that maps a text column to a prediction.
SENTIMENT_BACKENDS: Mapping[str, Callable[..., Callable[[Column], Column]]] = {
    "rule": lambda **words: lambda text: affect.rule_sentiment(text, **words),
    "llm": llm_sentiment,
    "hf": hf_sentiment,
}
EMOTION_BACKENDS: Mapping[str, Callable[..., Callable[[Column], Column]]] = {
    "rule": lambda **words: lambda text: affect.rule_emotion(text, **words),
    "llm": llm_emotion,
    "hf": hf_emotion,
}


def backend(kinds: Mapping[str, Callable[..., Callable[[Column], Column]]], name: str, **options) -> Callable[[Column], Column]:
    if name not in kinds:
        raise ValueError(f"unknown backend {name!r}; one of {', '.join(sorted(kinds))}")
    return kinds[name](**options)


def parser_backend(parse: Callable[[], Callable[[str], tuple[list[tuple], list[tuple]]]]) -> Callable[[DataFrame], DataFrame]:
    """A backend of :func:`loomtext.operators.annotate.annotate` from a parser.

    ``parse()`` makes the parser, once in a worker; it maps a text to entities
    (start_char, token, label) and verb frames (sent_id, verb, subject, object,
    sentence). A text that the parser fails on has empty lists and an error.
    """

    @F.pandas_udf(f"struct<ents:{ENTITIES},verb_data:{VERBS},error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = parse()
        for texts in batches:
            rows = []
            for t in texts:
                try:
                    ents, frames = parser(t or "")
                    rows.append(
                        (
                            [dict(zip(("start_char", "token", "tag"), e)) for e in ents],
                            [dict(zip(("sent_id", "verb", "subject", "object", "sentence"), v)) for v in frames],
                            None,
                        )
                    )
                except MissingLibrary:
                    raise
                except Exception as error:  # noqa: BLE001
                    rows.append(([], [], repr(error)))
            yield pd.DataFrame(rows, columns=["ents", "verb_data", "error"])

    return lambda df: df.withColumn("__parsed", run(F.col("text"))).select(
        *[c for c in df.columns if c not in ("ents", "verb_data", "error")], "__parsed.ents", "__parsed.verb_data", "__parsed.error"
    )


def spacy_model() -> str:
    """The parser that the environment names in SPACY_MODEL, else a small English one."""
    return os.environ.get("SPACY_MODEL", "en_core_web_sm")


def _loaded(model: str | None, merge: bool = True) -> Any:
    """A spaCy pipeline in which an entity is one token; without the model, blank English that only splits sentences."""
    spacy = needed("spacy")
    try:
        nlp = spacy.load(model or spacy_model())
    except OSError:
        nlp = spacy.blank("en")
        nlp.add_pipe("sentencizer")
    if merge and "ner" in nlp.pipe_names:
        nlp.add_pipe("merge_entities")
    return nlp


TOKENS = "array<struct<at:int,text:string,lemma:string,pos:string,dep:string,head:int>>"
SPANS = "array<struct<start:int,end:int,text:string,label:string>>"


def token_backend(parse: Callable[[], Callable[[str], tuple[list[tuple], list[tuple]]]]) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A parser for :func:`loomtext.operators.events.mentions_in_segments`: sentences to tokens and entities.

    ``parse()`` makes the parser, once in a worker; it maps a sentence to tokens (place, text, lemma,
    part of speech, relation, place of the head) and entities (first place, end, text, label).
    """

    @F.pandas_udf(f"struct<tokens:{TOKENS},ents:{SPANS}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = parse()
        fields = ("at", "text", "lemma", "pos", "dep", "head"), ("start", "end", "text", "label")
        for texts in batches:
            rows = [[[dict(zip(names, x)) for x in own] for names, own in zip(fields, parser(t or ""))] for t in texts]
            yield pd.DataFrame(rows, columns=["tokens", "ents"])

    def apply(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
        parsed = sentences.select("doc_id", F.col("sent_id").cast("bigint").alias("sent_id"), run("text").alias("p"))
        first = F.shiftleft("sent_id", 20)
        t = parsed.select("doc_id", "sent_id", F.explode("p.tokens").alias("t"))
        e = parsed.select("doc_id", "sent_id", F.explode("p.ents").alias("e"))
        tokens = t.select(
            "doc_id", "sent_id", (first + F.col("t.at")).alias("i"), "t.text", "t.lemma", "t.pos", "t.dep", (first + F.col("t.head")).alias("head_i")
        )
        return tokens, e.select(
            "doc_id", "sent_id", (first + F.col("e.start")).alias("start_i"), (first + F.col("e.end")).alias("end_i"), "e.text", "e.label"
        )

    return apply


def spacy_tokens(model: str | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """:func:`token_backend` of a spaCy model."""

    def parse() -> Callable[[str], tuple[list[tuple], list[tuple]]]:
        nlp = _loaded(model, merge=False)

        def run(text: str) -> tuple[list[tuple], list[tuple]]:
            doc = nlp(text)
            return [(t.i, t.text, t.lemma_, t.pos_, t.dep_, t.head.i) for t in doc], [(e.start, e.end, e.text, e.label_) for e in doc.ents]

        return run

    return token_backend(parse)


def rule_backend(places: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """A backend of :func:`loomtext.operators.annotate.annotate` without a model: names, bodies and dates by rules, no verb frames."""

    def run(df: DataFrame) -> DataFrame:
        nothing = F.lit(None).cast("string")
        return df.withColumns({"ents": parsing.named_spans(F.col("text"), places).cast(ENTITIES), "verb_data": F.array().cast(VERBS), "error": nothing})

    return run


def hf_answers(model: str | None = None) -> Callable[[Column], Column]:
    """Answers of a text-to-text model; EVENT_HF_MODEL names it where it isn't given."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pipe = needed("transformers").pipeline("text2text-generation", model=model or os.environ.get("EVENT_HF_MODEL", "google/flan-t5-base"))
        for prompts in batches:
            yield pd.Series([x["generated_text"] for x in pipe([p or "" for p in prompts])], dtype="object")

    return call


def event_answers(ask: Callable[[Column], Column]) -> Callable[[Column, Column, Column, Column, Column], Column]:
    """What :func:`loomtext.operators.events.extract_events_from_segments` takes as ``answer``, of :func:`llm_answers` or :func:`hf_answers`."""
    return lambda *fields: ask(event_prompt(*fields))


def configured_client(provider: str | None = None, model: str | None = None, base_url: str | None = None, **options) -> Callable[[list[str]], list[str]]:
    """:func:`chat_client` with LLM_PROVIDER, LLM_MODEL and LLM_BASE_URL of the environment for what isn't given."""
    env = os.environ.get
    return chat_client(provider or env("LLM_PROVIDER", "openai"), model or env("LLM_MODEL", "gpt-4o-mini"), base_url=base_url or env("LLM_BASE_URL"), **options)


def spacy_backend(model: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Entities and verb frames of a spaCy model, where spaCy is installed."""

    def parse() -> Callable[[str], tuple[list[tuple], list[tuple]]]:
        nlp = _loaded(model)

        def run(text: str) -> tuple[list[tuple], list[tuple]]:
            doc = nlp(text)
            frames = []
            for n, sentence in enumerate(doc.sents):
                for verb in (t for t in sentence if t.pos_ == "VERB"):
                    below = list(verb.children)
                    subjects = [t.text for t in below if t.dep_.startswith("nsubj")]
                    objects = [t.text for t in below if t.dep_ == "dobj"]
                    objects += [o.text for t in below if t.dep_ == "prep" for o in t.children if o.dep_ == "pobj"]
                    frames.append((n, verb.text, next(iter(subjects), ""), next(iter(objects), ""), sentence.text))
            return [(e.start_char, e.text, e.label_) for e in doc.ents], frames

        return run

    return parser_backend(parse)
