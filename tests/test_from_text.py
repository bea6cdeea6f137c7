"""The way from text to events by the rule parser, and the seams about it."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext import backends
from loomtext.operators import annotate as A
from loomtext.operators import events, frames, graph, parsing, segments
from loomtext.sources import files, writers

PLACES = ("Amsterdam", "Auschwitz", "Budapest", "Warsaw")
SAID = [
    (1, "Anne Frank was taken from Amsterdam to Auschwitz."),
    (2, "My name is Eva. I was born in Budapest. My family was forced into the ghetto by the Arrow Cross Party."),
    (3, "From there, we were transported by train. I still remember the final words my father said to me."),
    (4, "In May 1944 William Wordsworth often wandered over the valleys."),
    (5, " \n"),
    (6, None),
]


def docs_of(spark, rows=SAID):
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_frames_from_text(spark):
    said = segments.split_sentences(docs_of(spark))
    tokens, ents = events.rule_parse(said, PLACES)
    found = frames.verb_data(frames.verb_frames(frames.merge_entities(tokens, ents), said.withColumnRenamed("text", "sentence")))
    got = {r["doc_id"]: [(v["sent_id"], v["verb"], v["subject"], v["object"]) for v in r["verb_data"]] for r in found.collect()}
    assert got == {
        1: [(0, "taken", "Anne Frank", "Amsterdam")],
        2: [(1, "born", "I", "Budapest"), (2, "forced", "family", "ghetto")],
        3: [(0, "transported", "we", "train"), (1, "remember", "I", "words"), (1, "said", "father", "me")],
        4: [(0, "wandered", "William Wordsworth", "valleys")],
    }
    labels = {(r["doc_id"], r["text"], r["label"]) for r in ents.collect()}
    assert {(1, "Anne Frank", "PERSON"), (1, "Amsterdam", "GPE"), (2, "Eva", "PERSON"), (2, "Arrow Cross Party", "ORG"), (4, "May 1944", "DATE")} <= labels


def test_names_with_offsets_and_without_a_model(spark):
    rows = A.annotate(docs_of(spark), backend=backends.rule_backend(PLACES), terms={}, places=False).collect()
    for r in rows:
        assert all(r["text"][e["start_char"] : e["start_char"] + len(e["token"])] == e["token"] for e in r["entities"])
    tags = {(r["doc_id"], e["token"], e["tag"]) for r in rows for e in r["entities"]}
    assert {(1, "Anne Frank", "PERSON"), (2, "Eva", "PERSON"), (4, "1944", "DATE"), (4, "William Wordsworth", "PERSON")} <= tags
    assert not any(t in ("My", "From", "In", "I") for _, t, _ in tags) and (2, "Arrow Cross Party", "PLACE") in tags


def test_events_of_files(spark):
    given = {"f": ["Mother was taken to Auschwitz. She wept.", "", "Mother was taken to Auschwitz."], "g": ["Anselm left Warsaw in 1944."]}
    got = {(r["fileId"], r["event"]): r for r in events.extract_events_from_files(spark, given, places=PLACES).collect()}
    taken = got["f", "Mother take Auschwitz"]
    assert taken["count_mentions"] == 2 and taken["sources"] == [0, 2] and taken["place"] == "Auschwitz" and taken["category"] == "major"
    assert got["g", "Anselm leave Warsaw"]["date"] == "1944"
    plain = events.extract_events_from_files(spark, given, emotion=None, answer=lambda event, *_: F.concat(F.lit('{"event": "E '), event, F.lit('"}')))
    assert all(r["event"].startswith("E ") and r["emotion"] is None for r in plain.collect())
    assert events.extract_events_from_files(spark, {"f": [" "]}).count() == 0


def test_like_phrases_become_one_event(spark):
    given = {"f": ["The soldiers burned houses there.", "The soldiers burned houses here.", "Snow covered everything."]}
    alone = events.extract_events_from_files(spark, given).count()
    merged = events.extract_events_from_files(spark, given, dedupe=0.8)
    assert alone >= merged.count() == 2 and max(r["count_mentions"] for r in merged.collect()) == 2


def test_events_to_tables(spark, tmp_path):
    found = events.extract_events_from_files(spark, {"f": ["Mother was taken to Auschwitz."]})
    assert len(events.event_table(found).columns) == 14 and len(events.event_table(found, "flat").columns) == 12
    with pytest.raises(ValueError, match="schema"):
        events.event_table(found, "other")
    with pytest.raises(ValueError, match="format"):
        writers.save_events(found, f"{tmp_path}/x.xml")
    writers.save_events(found, f"{tmp_path}/x.geojson")
    writers.save_events(found, f"{tmp_path}/x.csv", schema="flat")
    assert spark.read.json(f"{tmp_path}/x.geojson").first()["sources"] == [0]
    assert spark.read.option("header", True).csv(f"{tmp_path}/x.csv").columns[0] == "fileId"
    writers.save_rows(found.select("fileId", "event"), f"{tmp_path}/y.jsonl")
    assert json.loads(spark.read.text(f"{tmp_path}/y.jsonl").first()["value"])["fileId"] == "f"


def test_tokens_of_a_parser(spark):
    def parse():
        def run(text):
            words = text.split()
            return [(i, w, w.lower(), "VERB" if i == 1 else "NOUN", "ROOT" if i == 1 else "nsubj" if i == 0 else "dobj", 1) for i, w in enumerate(words)], [(0, 1, words[0], "PERSON")]

        return run

    told = spark.createDataFrame([("f", 0, "Eva saw ships")], "fileId string, segId int, text string")
    got = events.mentions_in_segments(told, parse=backends.token_backend(parse)).first()
    assert (got["canon"], got["persons"]) == ("Eva saw ships", ["Eva"])


def test_signed_scores_and_segments_in_place_of_texts(spark):
    df = spark.createDataFrame([("", "joy and hope"), ("fear fear", "joy"), (None, None)], "text string, segment string")
    got = A.with_emotion(A.with_sentiment(df, include_signed=True), include_signed=True).collect()
    assert [r["sentiment_label"] for r in got] == ["positive", "negative", "neutral"]
    assert got[0]["sentiment_signed"] > 0 > got[1]["sentiment_signed"] and got[0]["emotion_signed"] > got[1]["emotion_signed"]
    said = backends.llm_sentiment(lambda prompts: ['{"label": "negative", "score": 0.9}'] * len(prompts))
    assert A.with_sentiment(df, said, include_signed=True).first()["sentiment_signed"] == -0.9
    felt = backends.llm_emotion(lambda prompts: ['{"label": "joy", "score": 0.5, "distribution": {"joy": 1}}'] * len(prompts), return_distribution=False)
    one = A.with_emotion(df, felt, distribution=True, include_signed=True).first()
    assert one["emotion_dist"] is None and one["emotion_signed"] == 1.0


def test_a_missing_library_ends_the_job(spark):
    def answer(prompts):
        raise backends.MissingLibrary("nothing here")

    with pytest.raises(Exception, match="nothing here"):
        A.with_sentiment(docs_of(spark), backends.llm_sentiment(answer)).collect()


def test_files_that_cannot_be_read_have_their_error(spark, tmp_path):
    good = tmp_path / "a.txt"
    good.write_bytes("Löwe am Fluss".encode("latin-1"))
    got = {r["fileId"]: r for r in A.annotate_inputs(spark, [str(good), str(tmp_path / "gone.txt")], encoding="latin-1").collect()}
    assert got["a"]["text"] == "Löwe am Fluss" and got["a"]["error"] is None
    assert "FileNotFoundError" in got["gone"]["error"] and got["gone"]["entities"] == []
    odd = tmp_path / "b.txt"
    odd.write_bytes(b"ok \xff\xfe fine")
    assert files.read_texts(spark, str(odd), encoding="ascii").first()["text"] == "ok  fine"


def test_ordinals_are_those_of_one_sorted_list(spark, monkeypatch):
    monkeypatch.setattr(graph, "RANGES", 3)
    rows = [(f"p{k:02d}", s) for k in range(17) for s in range(1, 1 + (k * 7) % 5)]
    got = graph.global_ordinals(spark.createDataFrame(rows, "fileId string, segId int")).collect()
    assert {(r["fileId"], r["segId"]): r["ordinal"] for r in got} == {x: i for i, x in enumerate(sorted(rows))}
    assert graph.global_ordinals(spark.createDataFrame([], "fileId string, segId int")).count() == 0


def test_spans_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("Eva",), ("Then Eva Braun left. Maria came.",)], "text string")
    got = [[tuple(s) for s in r[0]] for r in df.select(parsing.named_spans(F.col("text"))).collect()]
    assert got == [[], [], [], [(5, "Eva Braun", "PERSON")]]
