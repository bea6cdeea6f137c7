"""Sentences, segments, lines and phrases against plain Python."""

import random

from pyspark.sql import functions as F

from loomtext.functions import affect, interpret, phrases, roles
from loomtext.functions import text as T
from loomtext.operators import segments
from loomtext.sources import resources


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first()["x"]


def test_sentences(spark):
    text = 'Dr. Mengele came. "Why?" she asked!\nNo stop here'
    assert one(spark, text, T.sentences(F.col("text"))) == ["Dr. Mengele came.", '"Why?"', "she asked!", "No stop here"]
    assert one(spark, text, T.sentences(F.col("text"), ()))[0] == "Dr."
    assert one(spark, "", T.sentences(F.col("text"))) == []
    assert one(spark, None, T.sentences(F.col("text"))) is None


def evenly(parts, n):
    n = max(1, min(n, len(parts)))
    base, extra = divmod(len(parts), n)
    out, i = [], 0
    for k in range(n):
        size = base + (k < extra)
        out.append(" ".join(parts[i : i + size]))
        i += size
    return [x for x in out if x]


def test_packing(spark):
    rng = random.Random(3)
    rows = [(k, [f"s{i}" for i in range(rng.randrange(0, 40))]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, parts array<string>")
    for n in (0, 1, 3, 7, 100):
        got = {r["k"]: r for r in df.select("k", T.packed_evenly(F.col("parts"), n).alias("a"), T.packed_by_size(F.col("parts"), n).alias("b")).collect()}
        for k, parts in rows:
            assert got[k]["a"] == evenly(parts, n)
            size = max(1, -(-len(parts) // max(1, n)))
            assert got[k]["b"] == [" ".join(parts[i : i + size]) for i in range(0, len(parts), size)]


def test_segments_of_blank_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, " \n"), (3, "A b. C d."), (3, "A b. C d.")], "doc_id int, text string")
    rows = segments.split_into_segments(docs, 2).collect()
    assert sorted((r["doc_id"], r["segId"], r["segCount"], r["text"]) for r in rows) == [(3, 1, 2, "A b.")] * 2 + [(3, 2, 2, "C d.")] * 2
    assert [r["segId"] for r in segments.chunk_text(docs.where("doc_id = 3").limit(1), 2).collect()] == [0, 1]


def test_lines(spark):
    for text in ("a\nb", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029g", "\n\n", ""):
        assert one(spark, text, T.lines(F.col("text"))) == text.splitlines() or text == ""


def test_tokens(spark):
    text = "  The (old) town's square; \u00a0 END! ''"
    want = [t.strip(".,;:!?\"'()[]{} ").lower() for t in text.split()]
    assert one(spark, text, T.tokens(F.col("text"))) == want


GOLDEN = [
    ("Anne Frank was taken from Amsterdam to Auschwitz.", [(39, "Auschwitz", "CAMP")]),
    (
        "My name is Eva. I was born in Budapest, a city that was once vibrant. My family was forced into the ghetto by the Arrow Cross Party."
        " From there, we were transported by train to Ravensbrück. I still remember the final words my father said to me.",
        [(42, "city", "GEONOUN"), (100, "ghetto", "GEONOUN"), (168, "train", "GEONOUN"), (177, "Ravensbrück", "CAMP"), (226, "father", "FAMILY")],
    ),
]


def test_phrases_of_known_texts(spark):
    for text, want in GOLDEN:
        assert [tuple(r) for r in one(spark, text, phrases.phrase_matches("text", resources.phrase_terms()))] == want


def greedy(text, terms):
    pieces = phrases.regex.findall(phrases.PIECE, text)
    at, starts = 0, []
    for p in pieces:
        starts.append(at)
        at += len(p)
    ends = [*starts[1:], at]
    found = sorted((-(e - s), s, text[s:e]) for i, s in enumerate(starts) for e in ends[i:] if text[s:e] in terms)
    kept = []
    for less, s, t in found:
        if all(s >= y or s - less <= x for x, y, _ in kept):
            kept.append((s, s - less, t))
    return sorted((s, t) for s, _, t in kept)


def test_longest_first_matches_a_sequential_greedy(spark):
    rng = random.Random(5)
    terms = {"A": ("a", "a b", "b c d", "it's"), "B": ("c", "d-a", "a b c", "a")}
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "d-a", "it's", "x"]) for _ in range(rng.randrange(0, 20))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", phrases.phrase_matches("text", terms).alias("m"))
    every = {t for own in terms.values() for t in own}
    for r in df.collect():
        assert [(m["start_char"], m["token"]) for m in r["m"]] == greedy(r["text"], every)
        assert all(m["tag"] == ("A" if m["token"] in terms["A"] else "B") for m in r["m"])
    assert one(spark, None, phrases.phrase_matches("text", terms)) == []
    assert one(spark, "a", phrases.phrase_matches("text", {})) == []


def test_classified(spark):
    rows = [("Europe", "GPE"), ("Georgia", "LOC"), ("Ohio", "GPE"), ("Paris", "FAC"), ("Dachau", "ORG"), ("Grasmere", "GPE"), ("Eva", "PERSON")]
    df = spark.createDataFrame(rows, "name string, label string")
    got = [r[0] for r in df.select(phrases.classified(F.col("name"), F.col("label"), resources.gazetteer())).collect()]
    assert got == ["CONTINENT", "COUNTRY", "US-STATE", "CITY", "CAMP", "PLACE", "PERSON"]


def test_affect(spark):
    found = one(spark, "Hope, love and FEAR!", affect.rule_sentiment(F.col("text")))
    assert (found["label"], round(found["score"], 4)) == ("positive", 0.3215)
    assert one(spark, "town's", affect.rule_sentiment(F.col("text")))["label"] == "neutral"
    assert one(spark, None, affect.rule_sentiment(F.col("text")))["score"] == 0
    felt = one(spark, "sad and happy", affect.rule_emotion(F.col("text")))
    assert felt["label"] == "joy" and abs(sum(felt["distribution"].values()) - 1) < 1e-12
    assert one(spark, "plain", affect.rule_emotion(F.col("text")))["score"] == 1.0
    assert round(one(spark, "panic", affect.rule_emotion(F.col("text")))["score"], 4) == 0.3118


def test_interpretation(spark):
    assert one(spark, "x" * 300, interpret.summary(F.col("text"))) == "x" * 239 + "…"
    assert one(spark, "leftover capacity", interpret.themes(F.col("text"))) == ["place", "movement"]
    lit = F.lit
    assert one(spark, "", interpret.explanation(lit(None).cast("string"), lit("neutral"))) == "No strong affective signal detected."
    assert one(spark, "", interpret.explanation(lit("positive"), lit("joy"))) == "Sentiment suggests *positive* tone. Dominant emotion appears to be *joy*."


def test_roles(spark):
    lines = ["INT: Where?", "Q. Who", "A: Here", "Interviewer - go on", "ANNE: I went", "INTX: so", "I was born", "Note that", "plain words", "(he left)", "  A young boy"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", roles.detected_role(F.col("line")).alias("r")).collect():
        assert tuple(r["r"]) == roles.python_roles(r["line"])
    strict = [r[0] for r in df.select(roles.detected_role(F.col("line"), roles.STRICT_SPEAKERS)["role"]).collect()]
    assert strict[6] == "unknown" and strict[0] == "interviewer"
    asked = ["Is it?", "what", "a whatever", "", None, "so did he."]
    got = spark.createDataFrame([(x,) for x in asked], "t string").select(roles.is_question(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, True]
