"""Reading, writing, annotating files, the command line, backends and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext import backends, cli
from loomtext.functions import affect
from loomtext.operators import annotate as A
from loomtext.sources import files, resources, writers
from loomtext.streaming import annotate as S


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"The village was quiet.\r\nMy mother was in Paris.\xff")
    (tmp_path / "in" / "sub" / "b.txt").write_text("Hope and love.", encoding="utf-8")
    (tmp_path / "in" / "plain").write_text("No ending.", encoding="utf-8")
    return tmp_path


def test_files(spark, folder):
    rows = {r["fileId"]: r["text"] for r in files.read_texts(spark, [str(folder / "in"), str(folder / "in" / "plain"), str(folder / "in" / "a.txt")]).collect()}
    assert rows == {"a": "The village was quiet.\nMy mother was in Paris.", "b": "Hope and love.", "plain": "No ending."}
    assert files.read_texts(spark, str(folder / "in"), recursive=False).count() == 1
    assert files.read_texts(spark, str(folder / "in" / "*.txt")).count() == 1
    assert files.read_texts(spark, str(folder / "none*")).count() == 0


def test_annotated_files(spark, folder):
    rows = A.annotate_files(spark, str(folder / "in")).orderBy("file", "segId").collect()
    assert [(r["fileId"], r["segId"], r["segCount"]) for r in rows] == [("a", 1, 2), ("a", 2, 2), ("b", 1, 1)]
    assert [tuple(e) for e in rows[1]["entities"]] == [(3, "mother", "FAMILY"), (17, "Paris", "CITY")]
    whole = A.annotate_files(spark, str(folder / "in" / "a.txt"), chunk=False, include_text=False)
    assert "text" not in whole.columns and whole.first()["segCount"] == 1


@pytest.mark.parametrize("fmt", ["json", "jsonl", "csv", "tsv"])
def test_round_trip(spark, folder, fmt):
    df = A.with_interpretation(A.annotate_texts(spark, ['A "quoted", village', "some\tone"], "f"))
    path = str(folder / f"out.{fmt}")
    writers.save(df, path, fmt, single=True)
    back = files.load_annotations(spark, path, fmt).orderBy("segId").collect()
    assert [(r["fileId"], r["segId"], r["text"]) for r in back] == [("f", 1, 'A "quoted", village'), ("f", 2, "some\tone")]
    assert [tuple(e) for e in back[0]["entities"]] == [(12, "village", "GEONOUN")] and back[1]["entities"] == [] and back[0]["verb_data"] == []
    assert back[0]["error"] is None


def test_formats():
    assert [files.infer_format(x) for x in ("a.ndjson", "a.TSV", "a.csv", "a", "a.txt")] == ["jsonl", "tsv", "csv", "json", "json"]
    with pytest.raises(ValueError):
        files.infer_format("a", "xml")


def test_lists(tmp_path):
    (tmp_path / "positive-words.txt").write_text("; note\nGood\n\n", encoding="latin-1")
    assert resources.sentiment_words(str(tmp_path)) == (affect.POSITIVE, affect.NEGATIVE)
    (tmp_path / "negative-words.txt").write_text("bad", encoding="latin-1")
    assert resources.sentiment_words(str(tmp_path)) == ({"good"}, {"bad"})
    assert resources.gazetteer(str(tmp_path))["CAMP"] == () and len(resources.gazetteer()["CAMP"]) == 1074


def test_segments_json(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(["one", {"text": "two", "fileId": "g", "segId": 9}, "three"]))
    rows = files.read_segments_json(spark, str(tmp_path / "s.json")).orderBy("fileId", "segId").collect()
    assert [tuple(r) for r in rows] == [("g", 9, "two"), ("segments", 1, "one"), ("segments", 2, "three")]


def test_command_line(spark, folder, capsys):
    assert cli.main(["-i", str(folder / "in"), "--sentiment", "rule", "--emotion", "rule", "--interpret", "--include-text"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 3 and {r["sentiment_label"] for r in rows} == {"neutral", "positive"}
    assert cli.main(["-i", str(folder / "nothing*")]) == 1 and cli.main([]) == 1
    assert cli.main(["--info"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["CAMP"] == 1074
    (folder / "t.txt").write_text("INT: Who was there?\nANNE: My mother.")
    assert cli.main(["-i", str(folder / "t.txt"), "--testimony", "-o", str(folder / "o.json"), "--output-format", "jsonl"]) == 0
    assert files.load_annotations(spark, str(folder / "o.json"), "jsonl").count() == 2


def test_backends(spark):
    with pytest.raises(ValueError):
        backends.backend(backends.SENTIMENT_BACKENDS, "none")
    df = spark.createDataFrame([("a",), (None,)], "text string")
    told = A.with_sentiment(df, backends.llm_sentiment(lambda ps: ['{"label": "negative", "score": 0.9}' for _ in ps])).collect()
    assert {r["sentiment_label"] for r in told} == {"negative"}

    def broken(prompts):
        raise OSError("no network")

    assert {r["emotion_label"] for r in A.with_emotion(df, backends.llm_emotion(broken)).collect()} == {"neutral"}

    def parse():
        def run(text):
            if text == "bad":
                raise ValueError(text)
            return [(0, "Eva", "PERSON"), (4, "fish", "ANIMAL")], [(0, "ran", "Eva", "", text)]

        return run

    texts = spark.createDataFrame([(1, "Eva ran"), (2, "bad")], "segId int, text string")
    rows = {r["segId"]: r for r in A.annotate(texts, include_verbs=True, backend=backends.parser_backend(parse)).collect()}
    assert rows[1]["entities"][0]["token"] == "Eva" and len(rows[1]["entities"]) == 1 and rows[1]["verb_data"][0]["verb"] == "ran"
    assert "bad" in rows[2]["error"] and rows[2]["entities"] == []
    with pytest.raises(ValueError):
        A.annotate(texts, include_verbs=True)


def test_streams(spark, folder):
    stream = S.annotated(S.stream_texts(spark, str(folder / "in")))
    query = stream.select("fileId", "segId", "sentiment_label").writeStream.format("memory").queryName("said").option("checkpointLocation", str(folder / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert sorted((r["fileId"], r["segId"]) for r in spark.table("said").collect()) == [("a", 1), ("a", 2)]
    events = spark.createDataFrame([("f", "Go"), ("f", "go"), ("g", "Go"), ("g", " ")], "fileId string, canon string")
    events.write.parquet(str(folder / "m"))
    source = spark.readStream.schema(events.schema).parquet(str(folder / "m"))
    query = S.mention_counts(source).writeStream.format("memory").queryName("counted").outputMode("update").option("checkpointLocation", str(folder / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert sorted((r["fileId"], r["count_mentions"]) for r in spark.table("counted").collect()) == [("f", 2), ("g", 1)]


def test_windows_of_affect(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "hope"), ("2024-01-01 00:50:00", "fear"), ("2024-01-01 01:10:00", "hope")], "at string, text string")
    found = S.affect_by_window(rows.withColumn("ts", F.to_timestamp("at"))).collect()
    assert sorted((r["sentiment_label"], r["n"]) for r in found) == [("negative", 1), ("positive", 1), ("positive", 1)]
