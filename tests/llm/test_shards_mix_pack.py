"""Sharding, mixing and packing: exact counts, thresholds and capacities."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from loomtext.llm import mixing, packing, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, tokens string, tier string, hash string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "a", "b", "c", "d") for i, t, s in rows], SCHEMA)


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(0, 60))), rng.choice(["a", "b", "b", "c", None])) for i in range(n)]
    return [*rows, (7, rows[7][1], rows[7][2]), (None, "x y", "a"), (901, None, "b"), (902, " \n\t", "c"), (903, "w " * 9000, "a")]


def test_hypergeometric_mean_and_bounds():
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 10**6) for _ in range(200)]
    assert abs(np.mean(draws) / 250_000 - 1) < 0.001
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0


def test_matrix_rows_add_up():
    before, sizes = [0, 10, 10, 45, 100], sharding.shard_sizes(100, 7)
    rows = [sharding.matrix_row(p, before, sizes, 3) for p in range(4)]
    assert [sum(r) for r in rows] == [10, 0, 35, 55] and [sum(c) for c in zip(*rows)] == sizes


def test_shards_hold_every_row_once(spark):
    rows = corpus()
    docs = docs_of(spark, rows).repartition(3)
    out = sharding.shard_documents(docs, shards=7)
    got = out.collect()
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "position"]
    assert sorted(str((r["doc_id"], r["text"], r["source"])) for r in got) == sorted(map(str, rows))
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["position"])
    assert sorted(len(p) for p in places.values()) == sorted(sharding.shard_sizes(len(rows), 7))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards_of_few_and_no_rows(spark):
    assert sharding.shard_documents(docs_of(spark, []), shards=4).count() == 0
    few = sharding.shard_documents(docs_of(spark, corpus()[:2]), shards=4).collect()
    assert sorted(r["shard"] for r in few) == [0, 1]


def test_every_order_is_about_as_likely(spark):
    docs = spark.range(4).selectExpr("id doc_id").coalesce(2)
    seen = {}
    for seed in range(48):
        rows = sorted(sharding.shard_documents(docs, 2, seed).collect(), key=lambda r: (r["shard"], r["position"]))
        seen[tuple(r["doc_id"] for r in rows)] = seen.get(tuple(r["doc_id"] for r in rows), 0) + 1
    assert len(seen) >= 15 and max(seen.values()) <= 9


def brute_mix(rows, weights, fractions):
    h = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    own = [(s or "", h(i), len((t or "").split()), i) for i, t, s in rows]
    totals = {}
    for s, _, n, _ in own:
        totals[s] = totals.get(s, 0) + n
    out = []
    for s, t, budget in mixing.plan_budgets(totals, weights, fractions, 0.7):
        for _, hash_, n, i in [x for x in own if x[0] == s]:
            if sum(m for z, g, m, _ in own if z == s and g <= hash_) <= budget:
                out.append((i, s, n, t))
    least = {}
    for i, s, n, t in out:
        least[i, s, n] = min(t, least.get((i, s, n), 9))
    return least


def test_mix_takes_the_least_hashes_within_each_budget(spark):
    rows = corpus()
    for weights in (None, {"a": 1.0, "b": 2.0, "": 1.0, "nowhere": 5.0}):
        got = mixing.mix_sources(docs_of(spark, rows), weights, (0.2, 0.6, 1.0)).collect()
        want = brute_mix(rows, weights, (0.2, 0.6, 1.0))
        assert {(r["doc_id"], r["source"], r["tokens"]): r["tier"] for r in got} == want


def test_sample_keeps_columns_and_repeats(spark):
    docs = docs_of(spark, corpus())
    kept = mixing.sample_to_weights(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in mixing.mix_sources(docs, fractions=(1.0,)).collect()}
    assert {r["doc_id"] for r in kept.collect()} == ids
    assert mixing.sample_to_weights(docs_of(spark, [])).count() == 0


def test_packing_round_trip(spark):
    rows = corpus(2000)
    got = packing.pack_documents(docs_of(spark, rows), capacity=64).collect()
    load, pieces = {}, {}
    for r in got:
        load[r["bin_id"]] = load.get(r["bin_id"], 0) + r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert max(load.values()) <= 64
    tokens = {}
    for i, t, _ in rows:
        tokens[i] = tokens.get(i, 0) + len((t or "").split())
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: n for i, n in tokens.items() if n}
    single = [i for i in tokens if sum(x[0] == i for x in rows) == 1 and tokens[i]]
    for i in single:
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
    # linear grouping costs at most the bins of its longest group, and one bin a size
    large = sum(8 < n < 64 for p in pieces.values() for _, n in p)
    assert len(load) <= -(-sum(tokens.values()) // 64) + -(-large // 12) + 12


def test_nothing_to_pack(spark):
    assert packing.pack_documents(docs_of(spark, [(1, None, "a"), (2, " ", "b")])).count() == 0
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def test_configurations_cover_the_demand():
    sizes, found = packing.configurations({30: 50, 45: 20, 70: 33}, 100)
    for k, s in enumerate(sizes):
        assert sum(p[k] * n for p, n in found) >= {30: 50, 45: 20, 70: 33}[s]
    assert all(sum(a * b for a, b in zip(p, sizes)) <= 100 for p, _ in found)
    assert packing.configurations({}, 100) == ([], [])


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([(1, 10), (2, 4)], [3, 9, 5], 20, 100) == [2, 1, 100]


def test_a_tiny_or_hot_source_does_not_cut_the_others():
    even = {f"s{i}": 1_000_000 for i in range(8)}
    for totals in (even | {"": 5}, even | {"rare": 1000}, even | {"hot": 50_000_000}, {"a": 7}):
        given = {s: b for s, _, b in mixing.plan_budgets(totals, None, [1.0], 0.7, 0.9)}
        whole = sum(totals.values())
        assert sum(given.values()) >= 0.9 * whole - len(totals) and all(given[s] <= totals[s] for s in totals)
    assert mixing.plan_budgets({"a": 10, "b": 10}, {"a": 1.0, "b": 3.0}, [1.0], 0.7, 0.5) == [("a", 0, 3), ("b", 0, 10)]
    assert mixing.plan_budgets({"a": 10, "b": 10}, {"a": 1.0, "b": 3.0}, [1.0], 0.7, 0.9) == [("a", 0, 8), ("b", 0, 10)]


def test_the_pipeline_keeps_clean_documents_beside_a_null_source(spark):
    rows = [(i, "w " * 50, f"s{i % 4}") for i in range(400)]
    docs = docs_of(spark, [*rows, (1000, "a b c d e", None)])
    assert corpus_pipeline.mix(spark, docs, "").count() >= 350
