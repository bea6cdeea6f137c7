"""Verb frames, events, graphs and maps against hand-made parses and sequential folds."""

import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomtext.functions import responses
from loomtext.plans import catalog
from loomtext.operators import events, frames, graph
from loomtext.sources import writers

TOKENS = "doc_id string, sent_id int, i int, text string, lemma string, pos string, dep string, head_i int"
#: "Anne Frank was taken from Amsterdam to Auschwitz." and "He gave her books."
PARSE = [
    ("d", 0, 0, "Anne", "Anne", "PROPN", "compound", 1), ("d", 0, 1, "Frank", "Frank", "PROPN", "nsubjpass", 3), ("d", 0, 2, "was", "be", "AUX", "auxpass", 3),
    ("d", 0, 3, "taken", "take", "VERB", "ROOT", 3), ("d", 0, 4, "from", "from", "ADP", "prep", 3), ("d", 0, 5, "Amsterdam", "Amsterdam", "PROPN", "pobj", 4),
    ("d", 0, 6, "to", "to", "ADP", "prep", 3), ("d", 0, 7, "Auschwitz", "Auschwitz", "PROPN", "pobj", 6), ("d", 0, 8, ".", ".", "PUNCT", "punct", 3),
    ("d", 1, 9, "He", "he", "PRON", "nsubj", 10), ("d", 1, 10, "gave", "give", "VERB", "ROOT", 10), ("d", 1, 11, "her", "she", "PRON", "dative", 10),
    ("d", 1, 12, "books", "book", "NOUN", "dobj", 10), ("d", 1, 13, ".", ".", "PUNCT", "punct", 10), ("d", 2, 14, "Silence", "silence", "NOUN", "ROOT", 14),
]
SENTENCES = [("d", 0, "Anne Frank was taken from Amsterdam to Auschwitz."), ("d", 1, "He gave her books."), ("d", 2, " Silence ")]
ENTS = [("d", 0, 0, 2, "Anne Frank", "PERSON"), ("d", 0, 5, 6, "Amsterdam", "GPE"), ("d", 0, 7, 8, "Auschwitz", "CAMP")]


def parsed(spark):
    return (
        spark.createDataFrame(PARSE, TOKENS),
        spark.createDataFrame(ENTS, "doc_id string, sent_id int, start_i int, end_i int, text string, label string"),
        spark.createDataFrame(SENTENCES, "doc_id string, sent_id int, sentence string"),
    )


def test_verb_frames_and_phrases(spark):
    tokens, ents, sentences = parsed(spark)
    merged = frames.merge_entities(tokens, ents)
    assert merged.count() == len(PARSE) - 1
    found = frames.verb_data(frames.verb_frames(merged, sentences)).first()["verb_data"]
    assert [tuple(v)[:4] for v in found] == [(0, "taken", "Anne Frank", "Amsterdam"), (1, "gave", "He", "books")]
    rows = {r["sent_id"]: r for r in frames.mentions_of(merged, ents, sentences).collect()}
    assert [rows[i]["canon"] for i in range(3)] == ["Anne Frank take Amsterdam Auschwitz", "He give books", "Silence"]
    assert (rows[0]["persons"], rows[0]["places"], rows[2]["persons"]) == (["Anne Frank"], ["Amsterdam"], [])


MENTION = "fileId string, ord int, segId int, canon string, sentence string, persons array<string>, places array<string>, dates array<string>"


def random_mentions(seed=1):
    rng = random.Random(seed)
    some = lambda names, n: rng.sample(names, rng.randrange(n))
    return [
        (f, i, i // 2, rng.choice(["Go home", "go HOME", "eat bread", "sing", " "]), f"s{i}", some(list("abcdefghij"), 5), some(["x", "y"], 2), some(["1944"], 2))
        for f in "fg"
        for i in range(40)
    ]


def fold(rows):
    out = {}
    for f, _, seg, canon, sentence, persons, places, dates in rows:
        if not canon.strip():
            continue
        e = out.setdefault((f, canon.lower()), dict(event=canon, place=None, date=None, persons=[], others=[], confidence=0.35, n=0, sources=[], evidence=[]))
        e["n"] += 1
        e["sources"].append(seg)
        e["evidence"].append(sentence)
        e["place"] = e["place"] or next(iter(places), None)
        e["date"] = e["date"] or next(iter(dates), None)
        for p in persons:
            if p not in e["persons"] + e["others"]:
                (e["persons"] if len(e["persons"]) < 5 else e["others"]).append(p)
        e["confidence"] = min(1.0, e["confidence"] + 0.05 * (1 + bool(persons) + bool(places) + bool(dates)))
    return out


def test_events_equal_a_fold(spark):
    rows = random_mentions()
    got = events.extract_events(spark.createDataFrame(rows, MENTION)).collect()
    want = fold(rows)
    assert len(got) == len(want)
    for r in got:
        e = want[r["fileId"], r["event"].lower()]
        assert (r["event"], r["place"], r["date"], r["persons"], r["others"], r["count_mentions"], r["sources"], r["evidence"]) == (
            e["event"], e["place"], e["date"], e["persons"], e["others"], e["n"], e["sources"], e["evidence"],
        )
        assert abs(r["confidence"] - e["confidence"]) < 1e-6
        most = max(x["n"] for (f, _), x in want.items() if f == r["fileId"])
        assert r["category"] == ("major" if e["n"] >= max(2, int(0.4 * most)) or (e["persons"] and e["place"]) else "minor")


def test_pooled_emotion_and_merge(spark):
    rows = [("f", i, i, c, c, [p], [], []) for i, (c, p) in enumerate([("a", "x"), ("b", "y"), ("a", "z"), ("c", "x")])]
    told = spark.createDataFrame([("f", 0, "joy", 1.0), ("f", 2, "fear", -0.5), ("f", 1, None, None)], "fileId string, segId int, label string, signed double")
    found = events.aggregate_mentions(spark.createDataFrame(rows, MENTION))
    pooled = {r["event"]: (r["emotion"], r["emotion_valence"]) for r in events.with_pooled_emotion(found, told).collect()}
    assert pooled == {"a": ("joy", 0.25), "b": (None, None), "c": (None, None)}
    ids = {r["event"]: r["eventId"] for r in found.collect()}
    clusters = spark.createDataFrame([("f", ids["a"], 0), ("f", ids["b"], 0), ("f", ids["c"], 1)], "fileId string, eventId string, cluster int")
    merged = {r["event"]: r for r in events.merge_clusters(found, clusters).collect()}
    assert merged.keys() == {"a", "c"} and merged["a"]["count_mentions"] == 3 and merged["a"]["sources"] == [0, 2, 1]
    assert merged["a"]["persons"] == ["x", "z", "y"] and abs(merged["a"]["confidence"] - (0.35 + 0.2 + 0.05)) < 1e-9
    flat = events.flat_events(events.categorized(found).withColumns({"emotion": F.lit(None).cast("string"), "emotion_valence": F.lit(None).cast("double")}))
    assert len(flat.columns) == 12 and {r["witness"] for r in flat.collect()} == {"other/unknown"}


def test_normalized(spark):
    found = events.categorized(events.aggregate_mentions(spark.createDataFrame([("f", 0, 0, "a", "a", list("uvwxy"), [], [])], MENTION)))
    answer = F.lit('{"event": "A.", "place": "", "date": "1944", "persons": ["u", "z"], "others": ["q", "z"]}')
    r = events.normalized(found, answer).first()
    assert (r["event"], r["place"], r["date"], r["persons"], r["others"]) == ("A.", None, "1944", list("uvwxy"), ["z", "q"])
    assert events.normalized(found, F.lit("none")).first()["event"] == "a"


def test_greedy_clusters(spark):
    x = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.14, 0.99]])
    assert events.greedy_clusters(x / np.linalg.norm(x, axis=1, keepdims=True), 0.82) == [0, 0, 1, 1]
    rows = [(0, i, i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "group int, id int, ord int, embedding array<double>")
    assert [r["cluster"] for r in events.semantic_clusters(df).orderBy("id").collect()] == [0, 0, 1, 1]


def test_cooccurrence(spark):
    rng = random.Random(7)
    segs = [sorted(set(rng.choices("abcde", k=rng.randrange(4)))) for _ in range(25)]
    rows = [("f", i + 1, n) for i, own in enumerate(segs) for n in own]
    sizes = spark.createDataFrame([("f", 1, 25)], "fileId string, low int, high int")
    for w in (0, 1, 2):
        want = {}
        for i in range(25):
            bag = sorted({n for j in range(max(0, i - w), min(25, i + w + 1)) for n in segs[j]})
            for a, u in enumerate(bag):
                for v in bag[a + 1 :]:
                    want[u, v] = want.get((u, v), 0) + 1
        got = graph.ranked_edges(graph.cooccurrence(spark.createDataFrame(rows, "fileId string, segId int, node string"), w, sizes=sizes)).collect()
        assert [(r["u"], r["v"], r["w"]) for r in got] == [(*k, n) for k, n in sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))]


def test_geojson(spark):
    entities = "array<struct<start_char:int,token:string,tag:string>>"
    df = spark.createDataFrame([("f", 1, [(0, "Paris", "CITY"), (9, "Eva", "PERSON"), (12, "Nowhere", "PLACE")])], f"fileId string, segId int, entities {entities}")
    places = spark.createDataFrame([("Paris", 48.85, 2.35)], "name string, lat double, lon double")
    found = graph.features(graph.located(graph.place_mentions(df), places))
    told = json.loads(writers.feature_collection(found).first()["value"])
    assert told["features"][0]["geometry"]["coordinates"] == [2.35, 48.85] and len(told["features"]) == 1
    assert json.loads(writers.feature_collection(graph.features(graph.located(graph.place_mentions(df)))).first()["value"])["features"] == []
    assert "Paris" in writers.map_page(found)


def test_model_answers(spark):
    raw = ['{"label": "Positive", "score": 3}', "this is negative", "[1]", '{"label": "x", "score": "bad"}', None, '{"label": "joy"']
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    got = [tuple(r[0]) for r in df.select(responses.parsed_sentiment(F.col("raw"))).collect()]
    assert got[:4] == [("positive", 1.0), ("negative", 0.7), ("neutral", 0.5), ("neutral", 0.0)] and got[4] == ("neutral", 0.5)
    felt = [r[0] for r in df.select(responses.parsed_emotion(F.col("raw"))).collect()]
    assert felt[5]["label"] == "joy" and felt[5]["score"] == 0.5 and felt[0]["label"] == "neutral"


def test_cooccurrence_of_all_names(spark, tmp_path):
    texts = [(1, "Maria met Jo. Then Anselm left Warsaw."), (2, "Jo saw Maria and Anselm."), (3, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    segs = {}
    for r in catalog._segments(spark, str(tmp_path)).collect():
        segs.setdefault(r["doc_id"], {})[r["segId"]] = set(re.findall("[A-Z][a-z]+", r["text"] or ""))
    for w, query in ((0, catalog.cooccurrence_w0), (1, catalog.cooccurrence_w1)):
        want = {}
        for own in segs.values():
            for i in own:
                bag = sorted(set().union(*[own.get(j, set()) for j in range(i - w, i + w + 1)]))
                for a, u in enumerate(bag):
                    for v in bag[a + 1 :]:
                        want[u, v] = want.get((u, v), 0) + 1
        assert {(r["u"], r["v"]): r["w"] for r in query(spark, str(tmp_path)).collect()} == want
        assert ("Anselm", "Maria") in want
