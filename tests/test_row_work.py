"""Parses, frames and phrases within a sentence's row: as the joins have them, and without a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import affect, phrases
from loomtext.operators import events, frames, parsing, segments
from loomtext.plans import catalog

WORDS = "Eva Maria Warsaw May 1944 Party she the of to in and was had often walked left saw built house river bread 12 , Then We".split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture
def said(spark):
    rng = random.Random(5)
    rows = [(d, s, " ".join(rng.choices(WORDS, k=rng.randrange(1, 25))) + ".") for d in range(30) for s in range(4)]
    return spark.createDataFrame([*rows, (99, 0, " "), (99, 1, None), (None, 0, "Eva Braun saw bread. ")], "doc_id int, sent_id int, text string")


def rows_of(df):
    return sorted(map(repr, (r.asDict(True) for r in df.collect())))


def test_rows_equal_joins(spark, said):
    tokens, ents = events.rule_parse(said, ["Warsaw"])
    named = said.withColumnRenamed("text", "sentence")
    merged = frames.merge_entities(tokens, ents)
    assert rows_of(parsing.rule_merged(said, ["Warsaw"])) == rows_of(merged)
    want = frames.verb_frames(merged, named).where("doc_id is not null")
    assert rows_of(parsing.rule_frames(said, ["Warsaw"])) == rows_of(want) and want.count() > 50
    there = said.where("text is not null")
    want = frames.mentions_of(merged, ents, there.withColumnRenamed("text", "sentence"))
    got = parsing.rule_mentions(there, ["Warsaw"]).select(*want.columns)
    assert rows_of(got) == rows_of(want)
    assert rows_of(parsing.rule_phrases(there, ["Warsaw"])) == rows_of(want.select("doc_id", "sent_id", "sentence", "canon"))
    assert rows_of(parsing.rule_names(said, ["Warsaw"])) == rows_of(frames.sentence_entities(ents))


@pytest.mark.parametrize("name", ["rule_tokens", "rule_entities", "merge_entities", "verb_frames", "event_phrases", "sentence_entities"])
def test_sentences_are_not_shuffled(spark, tmp_path, name):
    spark.createDataFrame([(1, "s", "Eva left Warsaw in May. She saw ships.")], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert found.count() > 0 and "Exchange" not in plan_of(found) and "Window" not in plan_of(found)


def test_a_long_sentence_is_one_pass():
    tokens, kinds = parsing.parsed("she was often " * 100_000 + "Eva saw bread", 7)
    assert len(tokens.i) == 300_003 and tokens.head[-3] == tokens.i[-2] and parsing.names_of(tokens, kinds) == [(300_007, 300_008, "Eva", "PERSON")]


def test_texts_are_parsed_once_for_events_and_their_categories(spark, tmp_path):
    spark.createDataFrame([(1, "s", "Eva left Warsaw in May. She saw ships.")], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.text_events(spark, str(tmp_path))
    found.collect()
    final = plan_of(found)
    assert "ReusedExchange" in final and final.count("MapInArrow") == 1


def test_clusters_by_column_equal_clusters_by_table(spark):
    rng = random.Random(3)
    rows = [
        ("f", i, i % 7, rng.choice(["go a", "go b", "eat c", "eat d", "eat e"]), f"s{i}", rng.sample(list("abcdefghijkl"), rng.randrange(4)), [], [])
        for i in range(60)
    ]
    kind = "fileId string, ord int, segId int, canon string, sentence string, persons array<string>, places array<string>, dates array<string>"
    found = events.aggregate_mentions(spark.createDataFrame(rows, kind))
    first = F.substring_index("event", " ", 1)
    by_table = events.merge_clusters(found, found.select("fileId", "eventId", first.alias("cluster")))
    by_column = events.merge_clusters(found, first)
    assert rows_of(by_column) == rows_of(by_table) and by_column.where("size(evidence) <> count_mentions").isEmpty()
    assert all(len(r["persons"]) == 5 and len(set(r["persons"] + r["others"])) == len(r["persons"] + r["others"]) for r in by_column.collect())
    assert "evidence" not in events.merge_clusters(events.aggregate_mentions(spark.createDataFrame(rows, kind), evidence=False), first).columns
    # one shuffle for the events and one for the clusters
    assert plan_of(by_column).count("Exchange hashpartitioning") == 2


def test_an_answer_is_parsed_once(spark, tmp_path):
    spark.range(50).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("llm_parse_emotion", "llm_parse_sentiment"):
        found = catalog.QUERIES[name](spark, str(tmp_path))
        plan = plan_of(found)
        assert plan.count("from_json") + plan.count("jsontostructs") + plan.count("JsonToStructsEvaluator") <= 2
        assert plan.count("get_json_object") <= 2
    shares = affect.renormalized(F.col("d"))
    df = spark.createDataFrame([({"joy": 3.0, "fear": 1.0},), ({"joy": 0.0},), (None,)], "d map<string,double>")
    got = [r[0] for r in df.select(shares).collect()]
    assert (got[0]["joy"], got[0]["fear"], got[0]["anger"]) == (0.75, 0.25, 0.0) and set(got[1].values()) == {0.0} and got[2] is None


def test_parts_of_a_text_do_not_travel_with_each_part(spark):
    docs = spark.createDataFrame([(1, "Dr. Kay left. Then Eva came! So?"), (2, "no stop"), (3, None)], "doc_id int, text string")
    found = segments.split_into_segments(docs, 2)
    assert [(r["doc_id"], r["segId"], r["segCount"], r["text"]) for r in found.orderBy("doc_id", "segId").collect()] == [
        (1, 1, 2, "Dr. Kay left. Then Eva came!"), (1, 2, 2, "So?"), (2, 1, 1, "no stop")
    ]
    generate = next(line for line in plan_of(found).splitlines() if "Generate posexplode" in line)
    assert "segCount" in generate.split("], false")[0] and "__parts" not in generate.split("), [", 1)[1]


def test_rows_without_a_listed_word(spark):
    df = spark.createDataFrame([("Joy, joy and pain!",), ("nothing here",), ("enjoyment",), (None,)], "text string")
    joy = affect.EMOTION_WORDS
    got = [r[0] for r in df.select(affect.rule_emotion(F.col("text"), joy)).collect()]
    assert [g["label"] for g in got] == ["joy", "neutral", "neutral", "neutral"] and got[1] == got[2] == got[3] and got[1]["distribution"]["neutral"] == 1.0
    assert [tuple(r[0]) for r in df.select(affect.polarity_counts(F.col("text"))).collect()] == [(2, 1), (0, 0), (0, 0), (0, 0)]


def test_terms_of_one_and_of_many_pieces(spark):
    terms = {"A": ("New", "New York", "New York City Hall by Day", "[laughs out]"), "B": ("Hall",)}
    df = spark.createDataFrame([("In New York City Hall by Day, New York, New Hall [laughs out]",), ("none",), ("",), (None,)], "text string")
    got = [[tuple(e) for e in r[0]] for r in df.select(phrases.phrase_matches("text", terms)).collect()]
    assert got == [[(3, "New York City Hall by Day", "A"), (30, "New York", "A"), (40, "New", "A"), (44, "Hall", "B"), (49, "[laughs out]", "A")], [], [], []]
