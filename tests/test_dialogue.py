"""Turns and pairs against sequential restatements of their rules."""

import random

from loomtext.functions import roles
from loomtext.operators import dialogue

WORDS = ["INT: where did you go?", "INT: tell me.", "A: home.", "ANNE: I stayed. And more.", "CREW: cut", "go on", "(pause)", "Q: why?", "", "NOTE: music"]


def texts(seed, n=60):
    rng = random.Random(seed)
    return [(k, "\n".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))) for k in range(n)]


def sentences(text):
    import re

    return [s for s in re.sub(r"([.!?]+)[ \n\t\r]+", "\\1\x01", text).split("\x01") if s.strip()]


def is_q(text):
    import re

    return text.endswith("?") or bool(re.search(rf"(?i)\b(?:{'|'.join(roles.CUES)})\b", text))


def expected_testimony(text):
    rows = [(r, t) for r, _, t in map(roles.python_roles, text.splitlines()) if t]
    turns = []
    for role, t in rows:
        if turns and turns[-1][0] == role:
            turns[-1][1] += " " + t
        else:
            turns.append([role, t])
    out, pair, waiting = [], 0, False
    for role, s in ((r, s) for r, t in turns for s in sentences(t)):
        asks = role == "interviewer" and is_q(s)
        given = None
        if asks:
            pair, waiting = pair + 1, True
            given = pair
        elif waiting and role != "interviewer":
            given, waiting = pair, False
        out.append((len(out) + 1, role, s, asks, role != "interviewer" and given is not None, given))
    return out


def expected_pairs(text):
    rows = [(r, t or r.upper(), x) for r, t, x in map(roles.python_roles, text.splitlines()) if x and t != "CREW"]
    turns = []
    for row in rows:
        if turns and turns[-1][0] == row[0] and turns[-1][1] == row[1] and not row[2].startswith("("):
            turns[-1][2] += " " + row[2]
        else:
            turns.append(list(row))
    said = [(r, t, s) for r, t, x in turns for s in sentences(x)]
    asks = lambda x: x[0] == "interviewer" or x[1] in roles.INTERVIEWER_TAGS
    out, i = [], 0
    while i < len(said):
        if not (asks(said[i]) and is_q(said[i][2])):
            i += 1
            continue
        question = []
        while i < len(said) and asks(said[i]):
            question.append(said[i][2])
            i += 1
        if i == len(said):
            break
        who, answer = said[i][1], []
        while i < len(said) and said[i][1] == who:
            answer.append(said[i][2])
            i += 1
        out.append((len(out) + 1, "INTERVIEWER", " ".join(question), who, " ".join(answer)))
    return out


def test_testimony(spark):
    rows = texts(1)
    df = spark.createDataFrame([*rows, (99, None)], "fileId int, text string")
    got = {}
    for r in dialogue.segment_testimony(df).orderBy("fileId", "turn_id").collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    for k, text in rows:
        assert got.get(k, []) == expected_testimony(text), text


def test_pairs(spark):
    rows = texts(2)
    got = {}
    for r in dialogue.extract_qa_pairs(spark.createDataFrame(rows, "fileId int, text string")).orderBy("fileId", "pairId").collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    for k, text in rows:
        assert got.get(k, []) == expected_pairs(text), text


def test_testimony_records(spark):
    df = spark.createDataFrame([("f", "INT: who?\nANNE: me.")], "fileId string, text string")
    rows = dialogue.testimony_records(df).orderBy("segId").collect()
    assert [(r["segId"], r["segCount"], r["role"], r["isQuestion"], r["qaPairId"]) for r in rows] == [(1, 2, "interviewer", True, 1), (2, 2, "witness", False, 1)]
