"""The corpus pipeline against an independent expectation in plain Python, and its odd inputs."""

import hashlib
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from loomtext.llm import common, mixing, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxicity int, may int, c0 int"
TOXIC = "grubble snark vexol dregg"


def corpus():
    """(rows, labels, toxic ids, copy ids, {id: redacted text})."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdflmnprst") + rng.choice("aeiou") for _ in range(3))
    common_words = [word() for _ in range(400)]
    prose = lambda n: [rng.choice(common_words) for _ in range(n)]
    rows, labels, toxic, copies, redacted = [], [], set(), set(), {}
    for i in range(180):
        words = prose(60)
        if i % 6 == 0:
            toxic.add(i)
            for w in TOXIC.split():
                words.insert(rng.randrange(60), w)
        if i % 6 == 1 and i < 60:
            words[10:10] = ["mail", f"user{i}@site.org", "now"]
            redacted[i] = " ".join(words).replace(f"user{i}@site.org", "<EMAIL>")
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        if i % 4:
            labels.append((i, int(i in toxic)))
    for i in range(1, 25, 6):
        copies |= {200 + i, 300 + i}
        rows += [(200 + i, rows[i][1].upper() if i > 6 else rows[i][1], "en", "s1"), (300 + i, rows[i][1] + " indeed", None, "s2")]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, " ".join(prose(9000)), "en", "s1"), (403, "x y z", "xx", None), (404, "p q", "en", "tiny"), (2, rows[2][1], "en", "s2")]
    return rows, labels, toxic, copies, redacted


def written(spark, folder, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, 2, 3) for i, t, lang, s in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def mixed(rows):
    """Ids that the mix keeps: of each source the least hashes that fit its budget."""
    own = [(s or "", int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), len((t or "").split()), i) for i, t, _, s in rows]
    totals = {}
    for s, _, n, _ in own:
        totals[s] = totals.get(s, 0) + n
    budgets = {s: b for s, _, b in mixing.plan_budgets(totals, None, [1.0], 0.7, corpus_pipeline.KEPT)}
    return {i for s, h, _, i in own if s in budgets and sum(m for z, g, m, _ in own if z == s and g <= h) <= budgets[s]}


def test_stages_equal_an_expectation_in_plain_python(spark, tmp_path):
    rows, labels, toxic, copies, redacted = corpus()
    folder = written(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mix", "pack"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns
        kept.append(docs.select("doc_id", "text", "lang", "source", "n_chars").collect())
    left = [r for r in rows if r[0] not in toxic]
    assert sorted(map(str, kept[0])) == sorted(str(r) for r in spark.createDataFrame([(*r, len(r[1] or "")) for r in left], kept_schema()).collect())
    left = [r for r in left if r[0] not in copies]
    assert sorted(r["doc_id"] for r in kept[1]) == sorted(r[0] for r in left)
    left = [(i, redacted.get(i, t), lang, s) for i, t, lang, s in left]
    assert sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in kept[2]) == sorted((i, t or "", len(t or "")) for i, t, _, _ in left)
    stay = mixed(left)
    assert sorted(r["doc_id"] for r in kept[3]) == sorted(i for i, *_ in left if i in stay)
    tokens = {}
    for i, t, _, _ in left:
        if i in stay and t and t.split():
            tokens[i] = tokens.get(i, 0) + len(t.split())
    packed = corpus_pipeline.run(spark, folder).collect()
    load, got = {}, {}
    for r in packed:
        load[r["bin_id"]] = load.get(r["bin_id"], 0) + r["length"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == tokens and max(load.values()) <= 2048
    assert sum(tokens.values()) > 0.85 * sum(len((t or "").split()) for _, t, _, _ in left)


def kept_schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_an_empty_table_gives_nothing(spark, tmp_path):
    folder = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.toxic_filter, corpus_pipeline.near_dedup, corpus_pipeline.redact])
def test_what_a_stage_returns_is_computed_in_small_batches(spark, tmp_path, stage):
    rows, labels, *_ = corpus()
    folder = written(spark, tmp_path, rows, labels)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    sizes = spark.range(0, 2000, 1, 1).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n bigint")
    assert max(r["n"] for r in sizes.collect()) <= common.BATCH_ROWS


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["words", ""])
def test_scratch_tables_go_when_released(spark, name):
    made = common.cut(spark.range(3), name or "x")
    with common.scratch(spark) as folder:
        inner = common.cut(spark.range(2), "inner", folder)
        assert inner.count() == 2
    with pytest.raises(Exception, match="(?i)not.*exist|path|file"):
        spark.read.parquet(folder).count()
    assert made.count() == 3
    common.release(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|path|file"):
        spark.read.parquet(common.scratch_folder(spark)).count()
