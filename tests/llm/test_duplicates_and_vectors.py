"""SimHash near-dedup, top-k search and embedding near-dedup against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import groups, queries, simhash, vectors

DOCS = "doc_id bigint, text string, lang string, source string, high string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for _ in range(n))


def fixture():
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(40, 200))) for i in range(60)]
    for i in range(60, 90):
        words = rows[i - 60][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(90, rows[0][1]), (91, rows[0][1].upper()), (90, rows[0][1]), (92, None), (93, ""), (94, "12 34"), (None, rows[1][1]), (95, prose(rng, 30_000))]
    return rows


def brute_groups(spark, rows):
    named = [(i, t) for i, t in rows if i is not None]
    weights = simhash.document_weights(docs_of(spark, named))
    high, low, n = simhash.fingerprint_texts([t for _, t in named], weights)
    bits = [(int(h) & (2**64 - 1)) << 64 | (int(x) & (2**64 - 1)) for h, x in zip(high, low)]
    use = [k for k in range(len(named)) if n[k]]
    root = {named[k][0]: named[k][0] for k in use}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in use:
        for b in use:
            if (bits[a] ^ bits[b]).bit_count() <= 17:
                x, y = find(named[a][0]), find(named[b][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root if find(i) != i}


def test_near_duplicates_are_those_of_brute_force(spark):
    rows = fixture()
    got = [tuple(r) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert dict(got) == brute_groups(spark, rows)
    assert {90, 91} <= set(dict(got)) and sum(60 <= i < 90 for i in dict(got)) >= 27


def test_one_of_each_group_stays(spark):
    rows = fixture()
    docs = docs_of(spark, rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    gone = brute_groups(spark, rows)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in gone)


def test_one_table_of_fingerprints_is_shuffled_at_a_time(spark, monkeypatch):
    rows, sizes, cut = fixture(), [], simhash.cut

    def noted(df, name, *a):
        plan = df._jdf.queryExecution().logical().toString()
        sizes.append(plan.count("RepartitionByExpression"))
        return cut(df, name, *a)

    ball = simhash._ball_keys
    most = []
    monkeypatch.setattr(simhash, "cut", noted)
    monkeypatch.setattr(simhash, "_ball_keys", lambda prints, *a: most.append(ball(prints, *a).count() / prints.count()) or ball(prints, *a))
    assert dict(tuple(r) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()) == brute_groups(spark, rows)
    assert len(most) == sum(sizes) == 6 and max(sizes) == 1 and max(most) <= 23


def test_no_documents_no_duplicates(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(docs_of(spark, [(1, None)])).count() == 1


VECTORS = "vec_id bigint, embedding array<float>, label int, row bigint, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, 7) for i, v in rows], VECTORS)


def points(seed=2, n=70, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base[n // 2 :] = base[: n - n // 2] + rng.normal(size=(n - n // 2, d)) * 0.05
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    odd = [(200, None), (201, [0.0] * d), (202, [1.0] * (d - 1)), (203, [None] + [1.0] * (d - 1)), (204, [float("nan")] * d), (None, [1.0] * d)]
    return rows + odd + [(3, rows[3][1]), (300, rows[5][1])]


def unit(rows, d=16):
    keep = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == d and None not in v]
    return [(i, v / np.linalg.norm(v)) for i, v in keep if np.isfinite(v).all() and v.any()]


@pytest.mark.parametrize("asked", [None, "vec_id % 5 = 0"])
def test_top_k_is_exact(spark, asked):
    rows = points()
    known = unit(rows)
    got = {}
    for r in vectors.exact_top_k(table(spark, rows), k=5, fan_in=2, asked=asked and F.expr(asked)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], r["similarity"]))
    want = {}
    for a, (i, v) in enumerate(known):
        if asked and i % 5:
            continue
        order = sorted(((-round(float(v @ w), 6), j) for b, (j, w) in enumerate(known) if b != a))[:5]
        want.setdefault(i, []).extend((n, j, -s) for n, (s, j) in enumerate(order, 1))
    assert set(got) == set(want)
    for i in want:
        assert sorted((n, round(s, 5)) for n, _, s in got[i]) == sorted((n, round(s, 5)) for n, _, s in want[i])
        assert sorted(j for _, j, _ in got[i]) == sorted(j for _, j, _ in want[i])


def brute_classes(known, least):
    """(id, class, links) of distinct (id, vector) items."""
    items = list({(i, v.tobytes()): (i, v) for i, v in known}.values())
    near = [[b for b, (_, w) in enumerate(items) if b != a and round(float(v @ w), 6) >= least] for a, (_, v) in enumerate(items)]
    out = []
    for a, (i, _) in enumerate(items):
        seen, todo = {a}, [a]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        out.append((i, min(items[b][0] for b in seen), len(near[a])))
    return sorted(out)


@pytest.mark.parametrize("tile", [None, 7])
def test_near_vector_classes_are_exact(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(vectors, "TILE_ROWS", tile)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    group = [(400 + i, [float(np.float32(x)) for x in centre + rng.normal(size=16) * 0.06]) for i in range(40)]
    rows = points() + group + [(500 + i, group[0][1]) for i in range(9)]
    got = sorted((r["vec_id"], r["class_id"], r["links"]) for r in vectors.near_vector_classes(table(spark, rows)).collect())
    want = brute_classes(unit(rows), 0.98)
    assert got == want
    assert sum(n > 0 for _, _, n in want) > 80 and len({c for _, c, n in want if n}) > 10


def test_the_registered_query_on_planted_neighbours(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[i] + rng.normal(size=64) * 0.1) for i in range(120)]
    rows += [(2000 + i, rows[300 + i][1] + rng.normal(size=64) * 0.1) for i in range(60)] + [(3000, base[299]), (3001, base[299])]
    table(spark, [(i, [float(x) for x in v]) for i, v in rows]).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op3_topk", "op7_embedding_dedup"):
        with duckdb.connect() as sql:
            sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
            want = sql.sql(queries.ORACLE_SQL[name])
            columns, want = want.columns, sorted(want.fetchall())
        got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
        assert got == want
    assert sum(r[columns.index("links")] > 0 for r in got) > 200


def test_one_class_may_hold_everything(spark):
    rows = [(i, [1.0, i * 1e-4, 0.0]) for i in range(200)]
    got = vectors.near_vector_classes(table(spark, rows)).collect()
    assert {(r["class_id"], r["links"]) for r in got} == {(0, 199)}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(3, 9), (9, 4), (7, 8), (4, 3)]])
def test_components(spark, links):
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = groups.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: r for x, r in root.items() if x != r}


def test_no_vectors(spark):
    assert vectors.exact_top_k(table(spark, [])).count() == 0
    assert vectors.near_vector_classes(table(spark, [(1, None)])).count() == 0
    assert [tuple(r) for r in vectors.near_vector_classes(table(spark, [(1, [1.0, 2.0])])).collect()] == [(1, 1, 0)]
    assert vectors.exact_top_k(table(spark, [(1, [1.0, 2.0])])).count() == 0


@pytest.mark.parametrize("segments", [4, 6])
def test_segments_cover_the_fingerprint(segments):
    bounds = simhash.segment_bounds(segments)
    assert sum(w for _, w in bounds) == simhash.BITS and bounds[0][0] == 0
    assert all(a + w == b for (a, w), (b, _) in zip(bounds, bounds[1:]))
