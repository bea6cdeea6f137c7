"""PII, licences, language and toxicity on small corpora with planted cases."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import common, language, licenses, pii, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, entity string, kind string, toxicity string, word string"


def docs_of(spark, rows, lang="en"):
    return spark.createDataFrame(
        [(i, t, row[0] if row else lang, "s", len(t or ""), "e", "k", "t", "w") for i, t, *row in rows], SCHEMA
    )


FILL = "the river ran by the old mill and on "
SEEDED = [(i, f"{FILL}mail user{i}@site{i}.org or call +1 415 555 {1000 + i} from 10.0.{i}.7 now") for i in range(8)]
KEYED = [(20 + i, f'{FILL}api_key = "{"%032x" % (i * 7919 + 16**31)}" end') for i in range(6)]
#: Of the same form as nothing that a seed knows, but with the key that seeds have.
UNSEEN = [(30 + i, f'{FILL}api_key = "Zq{i}x9Lm{i}7Ty" end') for i in range(4)]
CLEAN = [(40 + i, f"{FILL} in the year {1900 + i} there were {100000 + i} ships") for i in range(8)]
ODD = [(50, None), (51, ""), (52, FILL * 3000), (0, SEEDED[0][1]), (None, SEEDED[1][1])]


def test_pii_finds_seeds_and_what_their_contexts_lead_to(spark):
    found = pii.find_pii(docs_of(spark, [*SEEDED, *KEYED, *UNSEEN, *CLEAN, *ODD])).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r["doc_id"], set()).add(r["kind"])
    assert all({"EMAIL", "PHONE", "IP"} <= kinds[i] for i, _ in SEEDED) and {"EMAIL"} <= kinds[None]
    assert all(kinds[i] == {"SECRET"} for i, _ in KEYED + UNSEEN)
    assert not any(i in kinds for i, _ in CLEAN) and not {50, 51, 52} & set(kinds)
    text = dict(SEEDED + KEYED + UNSEEN)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["entity"] for r in found if r["doc_id"] in text)
    assert sum(r["doc_id"] == 0 for r in found) == 2 * sum(r["doc_id"] == 2 for r in found)


def brute_graph(mentions, rounds=3, support=3, pattern_least=0.7, instance_least=0.8, unknown=0.3):
    """score_graph in plain Python; mentions are (entity, seed, fits, patterns)."""
    seed, fits, edges = {}, {}, set()
    for entity, kind, own, patterns in mentions:
        seed[entity], fits[entity] = kind, own
        edges |= {(entity, p) for p in patterns}
    found, trusted = {}, {}
    miss = lambda trust: math.log(1 - min(trust, 0.999))
    for _ in range(rounds):
        now = {}
        for pattern in {p for _, p in edges}:
            own = [e for e, p in edges if p == pattern]
            for kind in pii.KINDS:
                weight, with_, open_, taken = 0.0, 0, 0, 0
                for e in own:
                    if seed[e]:
                        w = 1.0 if seed[e] == kind else None
                    elif e in found:
                        k, m = found[e]
                        w = round(1 - math.exp(m - (miss(trusted[pattern, kind]) if (pattern, kind) in trusted else 0)), 9) if k == kind else None
                    else:
                        open_ += kind in fits[e]
                        w = None
                    if w is not None:
                        weight, with_, taken = weight + w, with_ + (w > 0), taken + 1
                if with_ >= support:
                    trust = round(weight / (weight + unknown * open_ + len(own) - taken - open_), 9)
                    if trust >= pattern_least:
                        now[pattern, kind] = trust
        trusted, found = now, {}
        for e in seed:
            if not seed[e]:
                best = min(((round(sum(miss(trusted[p, k]) for f, p in edges if f == e and (p, k) in trusted), 9), k) for k in fits[e]), default=(0, ""))
                if round(1 - math.exp(best[0]), 9) >= instance_least:
                    found[e] = best[1], best[0]
    out = {e: (k, 1.0, True) for e, k in seed.items() if k} | {e: (k, round(1 - math.exp(m), 6), False) for e, (k, m) in found.items()}
    return out, trusted


def test_graph_scores_equal_brute_force(spark):
    rng = random.Random(4)
    contexts = [f"after {w}" for w in "abcdefgh"] + ["key token=", "key id="]
    rows = []
    for _ in range(300):
        e = rng.randrange(90)
        kind = [None, None, "PHONE", "SECRET", "IP"][e % 5]
        fits = [kind] if kind else [["PHONE"], ["PHONE", "SECRET"], ["SECRET"], []][e % 4]
        p = contexts[(e % 5) * 2 + rng.randrange(2)] if rng.random() < 0.97 else rng.choice(contexts)
        if e % 7 == 0 and e % 5 < 2:
            p = rng.choice(contexts[4:8])
        rows.append((f"e{e}", kind, fits, [p, contexts[0]] if rng.random() < 0.3 else [p]))
    mentions = spark.createDataFrame(rows, "entity string, seed string, fits array<string>, patterns array<string>")
    want, trusts = brute_graph(rows)
    known, trusted = pii.score_graph(mentions)
    got = {r["entity"]: (r["kind"], r["confidence"], r["is_seed"]) for r in known.collect()}
    assert {r["pattern"]: r["kind"] for r in trusted.collect()} == {p: k for p, k in trusts}
    assert got.keys() == want.keys() and sum(not x[2] for x in got.values()) > 3
    assert all(got[e][0] == want[e][0] and abs(got[e][1] - want[e][1]) < 2e-6 for e in want)


def test_forms_only_admit_and_failed_checks_rule_out(spark):
    """Numbers of sixteen digits in prose stay, though half of that form are cards."""
    cards = [n for n in (str(4_000_000_000_000_000 + k * 7919) for k in range(400)) if pii.seed_kind(n)][:30]
    others = [str(int(n) + 1) for n in cards]
    rows = [(i, f"{FILL}{n} and so on") for i, n in enumerate(cards)] + [(100 + i, f"{FILL}{n} and so on") for i, n in enumerate(others)]
    found = {r["doc_id"] for r in pii.find_pii(docs_of(spark, rows)).collect()}
    assert found == set(range(30))


def test_values_of_any_form_at_trusted_keys(spark):
    keyed = [(i, f'{FILL}password = "{"%032x" % (i * 104729 + 16**31)}" end') for i in range(8)]
    plain = [(20, f'{FILL}password = "hunterTwoBlue" end'), (21, f"{FILL}password = hunterTwoBlue, end"), (22, f"{FILL}nothing = hunterTwoBlue")]
    docs = docs_of(spark, [*keyed, *plain])
    got = {r["doc_id"]: r["entity"] for r in pii.find_pii(docs).collect()}
    assert got[20] == got[21] == "hunterTwoBlue" and 22 not in got and len(got) == 10
    redacted = {r["doc_id"]: r["text"] for r in pii.redact_pii(docs).collect()}
    assert 'password = "<SECRET>" end' in redacted[20] and redacted[22] == plain[2][1]


def test_numbers_with_blanks():
    found = lambda t: [(t[a:b], k, f) for a, b, _, k, f, _ in pii.mentions_in(t)]
    assert found("call +1 (826) 555-4081 190.137.223.204 now") == [("+1 (826) 555-4081", "PHONE", ["PHONE"]), ("190.137.223.204", "IP", ["IP", "PHONE"])]
    assert found("tel 06 12 34 56 78.")[0][0] == "06 12 34 56 78" and found("020 7946 0958")[0][2] == ["PHONE"]
    assert found("page 12 3782 822463 10005 end")[0][:2] == ("3782 822463 10005", "CARD")
    assert found("IBAN DE89 3704 0044 0532 0130 00 end")[0][:2] == ("DE89 3704 0044 0532 0130 00", "IBAN")
    assert found("12 4012 8888 8888 1881")[0][:2] == ("4012 8888 8888 1881", "CARD")


def test_phones_by_context_alone(spark):
    known = [(i, f"the old mill. tel +44 20 7946 {1000 + i} was there") for i in range(6)]
    local = [(20 + i, f"the old mill. tel 06 12 34 56 7{i} was there") for i in range(3)]
    years = [(30 + i, f"in the years 1901 1902 190{i} ships came") for i in range(5)]
    got = {r["doc_id"]: r["entity"] for r in pii.find_pii(docs_of(spark, [*known, *local, *years])).collect()}
    assert set(got) == {*range(6), 20, 21, 22} and got[20] == "06 12 34 56 70"


def test_pii_in_texts_with_ids_of_text_and_clashing_names(spark):
    docs = docs_of(spark, [*SEEDED, *ODD]).selectExpr("concat('d', doc_id) doc_id", "text", "1 text_key", "2 spans", "3 may", "4 row", "5 c1")
    assert {r["doc_id"] for r in pii.find_pii(docs).collect()} == {None, *(f"d{i}" for i, _ in SEEDED)}
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("text like '%@%'").count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = docs_of(spark, [*SEEDED, *KEYED, *CLEAN, *ODD])
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        if r["text"] is not None:
            assert "@" not in r["text"] and r["n_chars"] == len(r["text"])
        if r["doc_id"] is not None and 40 <= r["doc_id"] < 50:
            assert r["text"] == dict(CLEAN)[r["doc_id"]]
    assert pii.redact_pii(docs_of(spark, [])).count() == 0 and pii.find_pii(docs_of(spark, [])).count() == 0


def test_licences(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, f"{FILL}{notice}. {FILL}{gpl}"), (2, "the license of the apache"), (3, None), (4, ""), (5, notice.upper()), (5, notice.upper()), (None, gpl), (6, FILL * 9000 + notice)]
    docs = docs_of(spark, rows)
    got = [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()]
    assert sorted(map(str, got)) == sorted(
        map(str, [(1, "Apache-2.0"), (1, "GPL-3.0"), (5, "Apache-2.0"), (5, "Apache-2.0"), (None, "GPL-3.0"), (6, "Apache-2.0")])
    )
    first = [r for r in licenses.scan_licenses(docs).collect() if r["doc_id"] == 1 and r["license"] == "Apache-2.0"][0]
    assert rows[0][1][first["start"] : first["end"]] == notice
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_common_length_equals_the_textbook():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        common, upto = licenses.common_length(licenses._places(a), len(a), b)
        assert common == longest_common(a, b)
        assert common == longest_common(a, b[:upto]) and (not upto or longest_common(a, b[: upto - 1]) < common)


def test_index_equals_a_scan_of_every_place():
    rng = random.Random(2)
    templates = licenses.packaged_templates()
    index = licenses.Index(templates, {}, 4, {})
    hits = 0
    for _ in range(120):
        t = rng.choice([x for x in templates if len(x.text) < 400])
        words = t.text.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([["other"], [], ["put", "in"]])
        text = " ".join(["some"] * rng.randrange(3) + words + ["thing"])
        tokens = [x for x, _, _ in licenses.tokens_of(text)]
        best = 0
        for k, own in enumerate(index.tokens):
            for at in range(-len(own), len(tokens)):
                lo, hi = max(0, at - index.slack(k)), min(len(tokens), at + len(own) + index.slack(k))
                if all(licenses._has(tokens, p, lo, hi) for p in index.phrases[k]):
                    common = longest_common(own, tokens[lo:hi])
                    best = max(best, common if common >= 0.8 * len(own) else 0)
        found = index.scan(text, 0.8)
        hits += bool(found)
        assert bool(found) == bool(best), text
        if found:
            assert max(round(share * n) for _, _, _, share in found for n in map(len, index.tokens) if abs(share * n - round(share * n)) < 0.01) >= best
    assert 40 < hits < 120


def test_templates_hold_their_first_phrase_and_are_found():
    index = licenses.Index(licenses.packaged_templates(), {}, 4)
    for k, t in enumerate(index.templates):
        for phrase in index.phrases[k]:
            assert licenses._has(index.tokens[k], phrase, 0, len(index.tokens[k])), t
        assert [x[0] for x in index.scan(f"{FILL} {t.text} {FILL}", 0.8)] == [t.license], t


LETTERS = {"en": "the and of ing er", "de": "der und ein sch ich", "fr": "le la que oi eau", "es": "el los que ión ar"}


def tongue(rng, lang, n):
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_on_held_out_texts(spark):
    rng = random.Random(3)
    rows = [(i, tongue(rng, lang, 60), lang) for i, lang in enumerate(sorted(LETTERS) * 40)]
    held = [(1000 + i, tongue(rng, lang, 60), None) for i, lang in enumerate(sorted(LETTERS) * 10)]
    odd = [(2000, None, None), (2001, "", "en"), (2002, "ab", None), (2003, tongue(rng, "fr", 30_000), None), (0, rows[0][1], rows[0][2]), (None, rows[1][1], None)]
    docs = docs_of(spark, [*rows, *held, *odd])
    got = language.identify_languages(docs, train_rows=30).collect()
    assert len(got) == len(rows) + len(held) + len(odd)
    by = {r["doc_id"]: r for r in got}
    right = sum(by[1000 + i]["language"] == lang for i, lang in enumerate(sorted(LETTERS) * 10))
    assert right >= 38
    assert by[2000]["language"] is None and by[2000]["ambiguous"] and by[2001]["language"] is None
    assert by[2003]["language"] == "fr" and not by[2003]["ambiguous"]
    assert language.identify_languages(docs_of(spark, [])).count() == 0
    alone = language.identify_languages(docs_of(spark, rows[:1])).first()
    assert alone["language"] is None and alone["ambiguous"]


def test_windows_and_whole_texts_give_the_same_margins(monkeypatch):
    rng = random.Random(1)
    model = language.train({lang: [tongue(rng, lang, 50) for _ in range(20)] for lang in LETTERS})
    data = [tongue(rng, "en", 400).encode(), b"", b"a", tongue(rng, "de", 20).encode()]
    offsets = np.cumsum([0, *map(len, data)])
    whole = np.frombuffer(b"".join(data), np.uint8)
    a = language.batch_margins(model, whole, offsets)
    monkeypatch.setattr(language, "WINDOW", 37)
    b = language.batch_margins(model, whole, offsets)
    assert np.allclose(a[0], b[0]) and (a[1] == b[1]).all()


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9):
        code = language.code_matrix(k)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(k, dtype=bool)].min() >= 1


TOXIC = "grubble snark vexol dregg"


def polluted(seed=5, n=240):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdflmnprst") + rng.choice("aeiou") for _ in range(2))
    common = [word() for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for w in TOXIC.split():
                words.insert(rng.randrange(60), w)
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or not bad:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxic_documents_are_found_and_clean_ones_kept(spark):
    rows, labels = polluted()
    odd = [(900, None), (901, ""), (902, "bada " * 20_000), (903, TOXIC), (903, TOXIC), (None, TOXIC)]
    docs = docs_of(spark, [*rows, *odd])
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (777, 1)], "doc_id bigint, toxic int")
    bad = {i for i, _ in rows if i % 6 == 0} | {903, None}
    got = toxicity.toxic_documents(docs, known).collect()
    assert {r["doc_id"] for r in got} == bad and len(got) == len(bad) + 1
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in [*rows, *odd]} - bad


def test_no_labels_no_toxicity(spark):
    rows, labels = polluted(n=24)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxic_documents(docs_of(spark, rows), none).count() == 0
    assert toxicity.drop_toxic(docs_of(spark, rows), none).count() == len(rows)
    assert toxicity.drop_toxic(docs_of(spark, []), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0


def brute_bit(block, i):
    """The context bit of a word in its block, in plain numbers."""
    full = 2**64 - 1
    id_ = lambda k: toxicity.word_id("en", block[k]) & full if 0 <= k < len(block) else 0
    mixed = (id_(i - 1) * 0x9E3779B97F4A7C15 ^ id_(i + 1) * 0xC2B2AE3D27D4EB4F) & full
    mixed = (mixed ^ mixed >> 32) * 0xD6E8FEB86659FD93 & full
    return 1 << (mixed >> 33) % 62


def brute_contexts(n, mask):
    bits = mask.bit_count()
    return n if bits >= 62 else min(n, -62 * math.log(1 - bits / 62))


def brute_lexicon(rows, labels, size=16, support=3, steps=4, restart=0.2, rings=2):
    """Seeds, edges and polarities of one language, in plain Python."""
    blocks = [t.split()[a : a + size] for _, t in rows for a in range(0, len(t.split()), size)]
    n = Counter(w for b in blocks for w in set(b))
    meet = sum(len(set(b)) ** 2 for b in blocks) / sum(len(set(b)) for b in blocks) ** 2
    clean, toxic, masks = Counter(), Counter(), Counter()
    for i, t in rows:
        if i in labels:
            words = t.split()
            (toxic if labels[i] else clean).update(set(words))
            for k, w in enumerate(words) if labels[i] else ():
                masks[w] |= brute_bit(words, k)
    known = [w for w in n if clean[w] + toxic[w] >= 3]
    rate = sum(labels.values()) / len(labels)
    t = {w: min(toxic[w], brute_contexts(toxic[w], masks[w])) for w in known}
    part = lambda x, all_, r: x * math.log(x / (all_ * r)) if x > 0 else 0.0
    ratio = {w: part(t[w], t[w] + clean[w], rate) + part(clean[w], t[w] + clean[w], 1 - rate) for w in known}
    up = [w for w in known if t[w] >= 3 and t[w] >= 0.8 * (t[w] + clean[w]) and ratio[w] >= 3 + math.log(len(known))]
    most = max(n[w] for w in up)
    down = sorted((w for w in known if t[w] < rate / 2 * (t[w] + clean[w]) and n[w] <= most), key=lambda w: (-ratio[w], w))[: len(up)]
    edges, fresh, done = {}, {*up, *down}, set()
    for _ in range(rings):
        pairs = {}
        for b in blocks:
            last = {w: k for k, w in enumerate(b)}
            for s in fresh & set(b):
                for w, k in last.items():
                    if w != s and n[w] >= support and n[w] * meet <= 0.5:
                        c, m = pairs.get((s, w), (0, 0))
                        pairs[s, w] = c + 1, m | brute_bit(b, k)
        least = 3 + math.log(max(1, len(pairs)))
        new = set()
        for (s, w), (c, m) in pairs.items():
            c = brute_contexts(c, m)
            chance = n[s] * n[w] * meet
            if c >= support and c > 2 * chance and c * math.log(c / chance) - (c - chance) >= least:
                new.add(w)
                for key in ((s, w), (w, s)):
                    edges[key] = max(edges.get(key, 0), math.log(c / chance))
        done |= fresh
        fresh = new - done
    whole = Counter()
    for (a, _), v in edges.items():
        whole[a] += v
    at = start = {w: (1 / len(up) if w in up else 0.0, 1 / len(down) if w in down else 0.0) for w in {*up, *down}}
    for _ in range(steps):
        moved = {w: [restart * x for x in start[w]] for w in start}
        for (a, b), v in edges.items():
            if a in at:
                own = moved.setdefault(b, [0.0, 0.0])
                for k in (0, 1):
                    own[k] += (1 - restart) * at[a][k] * v / whole[a]
        at = moved
    e = 0.1 * restart / len(up)
    return set(up), set(down), edges, {w: round((p - q) / (p + q + e), 6) for w, (p, q) in at.items()}


def passages(seed=11, n=400):
    """Documents about one of several themes, so that the graph has edges beyond the seeds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdflmnprst") + rng.choice("aeiou") for _ in range(3))
    common = [word() for _ in range(300)]
    themes = [[word() for _ in range(12)] for _ in range(6)]
    rows, labels = [], {}
    for i in range(n):
        theme = themes[i % 6]
        words = [rng.choice(common) for _ in range(24)] + [rng.choice(theme) for _ in range(8)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3 == 0:
            labels[i] = int(i % 6 == 0)
    return rows, labels


@pytest.mark.parametrize("rings", [2, 4])
def test_seeds_edges_walks_and_scores_equal_brute_force(spark, rings):
    rows, labels = passages()
    docs = docs_of(spark, rows)
    known = spark.createDataFrame(sorted(labels.items()), "doc_id bigint, toxic int")
    up, down, edges, polarity = brute_lexicon(rows, labels, rings=rings)
    assert len(up) >= 5 and len(down) >= 5 and len(polarity) > len(up) + len(down)
    lexicon, sample = toxicity.induce_lexicon(docs, known, block=16, rings=rings)
    assert sample == {str(k): v for k, v in labels.items()}
    got = {r["word"]: r["polarity"] for r in lexicon.collect()}
    assert got.keys() == polarity.keys() and all(abs(got[w] - polarity[w]) < 2e-6 for w in got)
    assert min(got.values()) < -0.5 and max(got.values()) > 0.5
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.score_documents(docs, lexicon).collect()}
    for i, t in rows:
        best = run = 0
        for w in t.split():
            run = max(0, run + (round(got.get(w, 0) * 1e6) if abs(got.get(w, 0)) >= 0.5 else 0))
            best = max(best, run)
        assert scored[i] == best / 1e6


def test_by_default_the_graph_has_a_row_for_each_word_that_a_walk_leaves(spark):
    rows, labels = passages()
    known = spark.createDataFrame(sorted(labels.items()), "doc_id bigint, toxic int")
    near, far = (brute_lexicon(rows, labels, rings=k) for k in (2, 4))
    assert far[2].keys() > near[2].keys() and far[3] != near[3]
    got = {r["word"]: r["polarity"] for r in toxicity.induce_lexicon(docs_of(spark, rows), known, block=16)[0].collect()}
    assert got.keys() == far[3].keys() and all(abs(got[w] - far[3][w]) < 2e-6 for w in got)


def test_words_by_table_equal_words_by_expression():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(3)
    texts = [*every[:0x3000], "".join(every[:256]), "".join(every), *["".join(rng.choices(every[:k], k=40)) for k in (128, 256, 0x180) for _ in range(200)]]
    assert all(common.words_of(t) == common.WORD.findall(t.lower()) for t in texts)


def test_no_scan_lists_more_pairs_than_its_share(spark, monkeypatch):
    rows, labels = passages()
    docs, known = docs_of(spark, rows), spark.createDataFrame(sorted(labels.items()), "doc_id bigint, toxic int")
    whole = sorted(map(tuple, toxicity.induce_lexicon(docs, known, block=16)[0].collect()))
    blocks = [set(t.split()[a : a + 16]) for _, t in rows for a in range(0, len(t.split()), 16)]
    listed, near_words = [], toxicity._near_words
    monkeypatch.setattr(toxicity, "SCAN_PAIRS", 10)
    monkeypatch.setattr(toxicity, "SCAN_SHARE", 0.2)
    monkeypatch.setattr(toxicity, "_near_words", lambda sources, *a: listed.append(sources["en"]) or near_words(sources, *a))
    assert sorted(map(tuple, toxicity.induce_lexicon(docs, known, block=16)[0].collect())) == whole
    most = max(len(own) > 1 and sum(len(b) * len(b & own) for b in blocks) for own in listed)
    assert len(listed) > 8 and most <= 1.05 * 0.2 * sum(map(len, blocks))


def test_partial_counts_and_slices_change_nothing(spark, monkeypatch):
    rows, labels = passages()
    known = spark.createDataFrame(sorted(labels.items()), "doc_id bigint, toxic int")
    docs = docs_of(spark, [*rows, (900, None), (901, "")])
    whole = sorted(map(tuple, toxicity.toxic_documents(docs, known, block=16).collect()))
    for name, value in {"HELD_LEXICON": 7, "SCAN_SOURCES": 5}.items():
        monkeypatch.setattr(toxicity, name, value)
    assert len(whole) > 60 and sorted(map(tuple, toxicity.toxic_documents(docs, known, block=16).collect())) == whole


def test_small_holdings_give_the_same_sums(monkeypatch):
    rows, labels = passages(n=60)
    batch = pa.record_batch({"kind": pa.array([labels.get(i) for i, _ in rows], pa.int32()), "lang": ["en"] * len(rows), "text": [t for _, t in rows]})

    def sums():
        words, pairs = Counter(), Counter()
        for b in toxicity._count_words(16)(iter([batch])):
            for r in b.to_pylist():
                words[r["lang"], r["word"]] += np.array([r["n"], r["squares"], r["clean"], r["toxic"]])
        sources = {"en": frozenset(rows[0][1].split())}
        common_ids = np.sort([toxicity.word_id("en", w) for w in rows[0][1].split()[:2]])
        every = np.full(toxicity.FILTER_BITS // 8, 255, np.uint8)
        for b in toxicity._near_words(sources, common_ids, every, 16)(iter([batch.select(["lang", "text"])])):
            for r in b.to_pylist():
                pairs[r["source"], r["near"]] += r["n"]
        return {k: v.tolist() for k, v in words.items()}, pairs

    whole = sums()
    assert len(whole[1]) > 200
    for name, value in {"CHUNK_WORDS": 90, "LISTED_PAIRS": 50, "HELD_WORDS": 120, "HELD_PAIRS": 100}.items():
        monkeypatch.setattr(toxicity, name, value)
    monkeypatch.setattr(common, "PIECE_CHARS", 31)
    assert sums() == whole


def test_only_pairs_that_may_be_edges_are_shuffled_and_no_edge_is_lost(spark, monkeypatch):
    rows, labels = passages(n=1200)
    docs, known = docs_of(spark, rows), spark.createDataFrame(sorted(labels.items()), "doc_id bigint, toxic int")
    listed, kept, edges = [], [], []
    cut, counted = toxicity.cut, toxicity._counted_pairs

    def pairs_of(*a):
        out = counted(*a)
        listed.append(out[1])
        return out

    monkeypatch.setattr(toxicity, "_counted_pairs", pairs_of)

    def seen(df, name, *at):
        out = cut(df, name, *at)
        if name == "near-words":
            kept.append(out.count())
        elif name.startswith("edges-"):
            edges.extend(map(tuple, out.select("source", "near").collect()))
        return out

    monkeypatch.setattr(toxicity, "cut", seen)
    toxicity.induce_lexicon(docs, known, block=16)
    want = brute_lexicon(rows, labels, rings=4)[2]
    id_ = lambda w: toxicity.word_id("en", w)
    assert {frozenset(e) for e in edges} == {frozenset(map(id_, e)) for e in want}
    assert sum(kept) < sum(listed) / 4
    # too many pairs assumed: all is scanned again
    whole, sure = sorted(edges), len(listed)
    listed.clear(), edges.clear()
    monkeypatch.setattr(toxicity, "DISTINCT_SHARE", 1e6)
    toxicity.induce_lexicon(docs, known, block=16)
    assert sorted(edges) == whole and len(listed) == 2 * sure


def test_cells_of_pairs_come_back_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_PAIRS", 50)
    rng = np.random.default_rng(8)
    width = toxicity.REGION_BITS + 4
    tables, whole = [], Counter()
    for _ in range(6):
        key = np.unique(np.append(rng.integers(0, 3 << width, 90), [0, (1 << width) - 1, 7 << width]))
        n = rng.integers(1, 60, len(key))
        n[0] = 1 << 20
        whole.update(dict(zip(key.tolist(), n.tolist())))
        tables += toxicity.pack_cells(key, n).to_pylist()
    names = ["region", "entries", "packed"]
    batches = [pa.record_batch({c: [r[c]] for c in names}) for r in sorted(tables, key=lambda r: r["region"])]
    assert toxicity.pack_cells(np.zeros(0, np.int64), np.zeros(0, np.int64)).num_rows == 0
    got = [r for b in toxicity._add_cells(iter(batches)) for r in b.to_pylist()]
    bits = {(r["region"] << toxicity.REGION_BITS) + int(i) for r in got for i in np.flatnonzero(np.unpackbits(np.frombuffer(r["passing"], np.uint8), bitorder="little"))}
    assert bits == {k >> 4 for k, n in whole.items() if n >= toxicity.NEEDS[k & 15]}
    assert sum(np.frombuffer(r["used"], np.int64).sum() for r in got) == len(whole)


def test_a_pair_that_passes_needs_no_more_than_its_class_says():
    rng = random.Random(6)
    counts = {f"w{k}": max(3, int(3 * 1.6 ** rng.uniform(0, 24))) for k in range(60)}
    meet, least, support = 1 / 400_000, 19.5, 3
    steps = np.zeros(1 << 10, np.uint8)
    ids = np.array([toxicity.word_id("en", w) for w in counts], np.int64)
    n = np.array(list(counts.values()))
    steps[:] = 255
    np.minimum.at(steps, ids & 1023, np.floor(2 * np.log2(n)).astype(np.uint8))
    cells = toxicity.PairCells({"en": counts}, {"en": meet}, steps, support, least)
    tight = 0
    for a in range(len(n)):
        needs = toxicity.NEEDS[cells.keys(ids)(np.full(len(n), a), np.arange(len(n))) & 15]
        for b in range(len(n)):
            chance = n[a] * n[b] * meet
            passes = lambda c: c >= support and c > 2 * chance and c * math.log(c / chance) - (c - chance) >= least  # noqa: B023, E731
            fewest = next((c for c in [*range(3, 2000), 10**4, 10**5, 10**6] if c <= min(n[a], n[b]) and passes(c)), None)
            assert fewest is None or needs[b] <= fewest
            tight += needs[b] > 4
    assert tight > 100


def test_packed_pairs_come_back_whole(spark):
    rng = np.random.default_rng(5)
    single = [1 << k for k in range(toxicity.CONTEXT_BITS)]
    mixed = [int(x) for x in rng.integers(1, 1 << toxicity.CONTEXT_BITS, 200)] + [3, (1 << toxicity.CONTEXT_BITS) - 1]
    masks = single + mixed
    rows = [(-k if k % 2 else k, k * 7 - 900, [1, 2, 63, 64, 10**9][k % 5], m) for k, m in enumerate(masks)]
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["source", "near", "n", "mask"])
    packed = [r for b in toxicity._coded(iter)(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert sum(r["mask"] == 0 for r in packed) >= len(single)
    names = ["near", "code", "mask", "source"]
    frame = spark.createDataFrame([tuple(r[c] for c in names) for r in packed], toxicity._PAIR_COUNTS)
    assert sorted(map(tuple, toxicity._decoded(frame).collect())) == sorted(rows)


def test_ids_of_text_and_clashing_names(spark):
    rows, labels = polluted()
    docs = docs_of(spark, rows).selectExpr("concat('d', doc_id) doc_id", "text", "lang", "1 toxicity", "2 labelled_id", "3 kind", "4 c0", "5 may")
    known = spark.createDataFrame([(f"d{i}", k) for i, k in labels], "doc_id string, toxic int")
    assert {r["doc_id"] for r in toxicity.toxic_documents(docs, known).collect()} == {f"d{i}" for i, _ in rows if i % 6 == 0}
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(i % 6 > 0 for i, _ in rows)


def test_rare_and_null_languages_have_toxic_documents_too(spark):
    rows, labels = polluted()
    clean = [(i + 2000, t, "xx" if i % 2 else None) for i, t in rows if i % 6][:40]
    few = [(1000, rows[1][1] + " " + TOXIC, "xx"), (1001, rows[2][1] + " " + TOXIC, None), (1002, TOXIC, "yy")]
    docs = docs_of(spark, [*rows, *clean, *few])
    known = spark.createDataFrame([*labels, (1000, 1), *[(i, 0) for i, _, _ in clean[:20]]], "doc_id bigint, toxic int")
    bad = {i for i, _ in rows if i % 6 == 0} | {1000, 1001, 1002}
    assert {r["doc_id"] for r in toxicity.toxic_documents(docs, known).collect()} == bad


def test_each_language_has_its_own_label_sample(spark):
    docs = docs_of(spark, [*[(i, "a") for i in range(50)], *[(100 + i, "a", "xx") for i in range(3)], (200, "a", None)])
    known = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, toxic int")
    sample = toxicity._label_sample(docs, known, 2)
    assert len(sample) == 5 and sum(int(i) < 50 for i in sample) == 2 and "200" in sample


def test_licences_named_in_other_wordings():
    index = licenses.Index(licenses.packaged_templates(), {}, 4)
    wordings = {
        "Licensed under the terms of the Apache License, Version 2.0": "Apache-2.0",
        "This code is available under Apache License, Version 2.0": "Apache-2.0",
        "Licensed under the terms of the GNU General Public License, version 3": "GPL-3.0",
        "This project uses the MIT License": "MIT",
        "MIT License": "MIT",
        "Released under the very permissive MIT License": "MIT",
        "Released under the MIT License": "MIT",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "SPDX-License-Identifier: MIT": "MIT",
        "This project uses the Apache-2.0 license": "Apache-2.0",
        "Licensed under the GNU General Public License v3": "GPL-3.0",
        "distributed under GPLv2 terms": "GPL-2.0",
        "GPL-3.0-or-later": "GPL-3.0-or-later",
        "GNU LGPL version 2.1": "LGPL-2.1",
    }
    for text, license in wordings.items():
        assert [x[0] for x in index.scan(f"{FILL}{text}. {FILL}", 0.8)] == [license], text
    assert [x[0] for x in index.scan("The MIT License (MIT)", 0.8)] == ["MIT"]
    for text in ("the license of MIT and the Apache version", "GPL", "a license to fish, version 2.0", "permission is hereby granted, free of charge, to enter"):
        assert not index.scan(text, 0.8), text


def test_equal_templates_and_repeats(spark):
    two = [licenses.Template(x, "under the Quite Free Licence of ours", ("quite free licence",)) for x in ("A-1", "B-2")]
    docs = docs_of(spark, [(1, f"{FILL}under the Quite Free Licence of ours {FILL}"), (1, "under the Quite Free Licence of ours")])
    assert [r["license"] for r in licenses.scan_licenses(docs, two).collect()] == ["A-1", "A-1"]
