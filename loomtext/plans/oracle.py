"""DuckDB SQL of the registered queries, stated relationally and not as the operators do it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from loomtext.functions import affect, interpret, phrases, roles
from loomtext.functions.text import ABBREVIATIONS, BLANKS, EDGE_MARKS
from loomtext.operators import parsing
from loomtext.sources import resources


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join(_text(v) for v in sorted(values)) + "]"


def _among(values: Sequence[str]) -> str:
    return "(" + ", ".join(_text(v) for v in sorted(values)) + ")"


def _sentences(text: str, blanks: str = _text(BLANKS)) -> str:
    masked = f"regexp_replace({text}, {_text(r'(^|[ \n\t\r(\"' + chr(39) + r'])(' + '|'.join(sorted(ABBREVIATIONS)) + r')\.')}, '\\1\\2' || chr(2), 'g')"
    marked = f"regexp_replace({masked}, {_text(r'([.!?]+[\"' + chr(39) + r')\]]*)[ \n\t\r]+')}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(replace(s, chr(2), '.'), {blanks})), lambda s: s <> '')"


_TOKENS = f"list_transform(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''), lambda t: lower(trim(t, {_text(EDGE_MARKS)})))"
_SENTS = f"""parts AS (SELECT doc_id, {_sentences('text')} AS p FROM documents),
    sents AS (SELECT doc_id, unnest(p) AS text, (generate_subscripts(p, 1) - 1)::INT AS sent_id FROM parts)"""
_SEGMENTS = _SENTS + """,
    tiled AS (SELECT *, ntile(100) OVER (PARTITION BY doc_id ORDER BY sent_id) AS tile FROM sents),
    segments AS (SELECT doc_id, tile::INT AS "segId", string_agg(text, ' ' ORDER BY sent_id) AS text FROM tiled GROUP BY doc_id, tile)"""
_LINES = r"""broken AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS l FROM documents),
    said AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS line, unnest(l) AS raw FROM broken)"""


def _roles(speakers: Mapping[str, Sequence[str]]) -> str:
    capitals = r"^([A-Z][A-Z0-9 .\-]{0,30}):\s*(.*)$"
    role, tag, text = [], [], []
    for name, patterns in speakers.items():
        for p in patterns:
            test = f"WHEN regexp_matches(t, {_text('(?i)' + p)}) THEN"
            role.append(f"{test} {_text(name)}")
            tag.append(f"{test} {_text(name.upper())}")
            text.append(f"{test} trim(regexp_replace(t, {_text('(?i)' + p)}, ''), {_text(BLANKS)})")
    named = f"regexp_matches(t, {_text(capitals)})"
    label = f"trim(regexp_extract(t, {_text(capitals)}, 1))"
    role.append(f"WHEN {named} THEN CASE WHEN starts_with({label}, 'INT') OR {label} = 'Q' THEN 'interviewer' ELSE 'witness' END")
    tag.append(f"WHEN {named} THEN {label}")
    text.append(f"WHEN {named} THEN trim(regexp_extract(t, {_text(capitals)}, 2), {_text(BLANKS)})")
    return f"""{_LINES},
    stripped AS (SELECT doc_id, line, trim(raw, {_text(BLANKS)}) AS t FROM said),
    spoken AS (SELECT doc_id, line, CASE {' '.join(role)} ELSE 'unknown' END AS role, CASE {' '.join(tag)} ELSE '' END AS tag,
        CASE {' '.join(text)} ELSE t END AS text FROM stripped),
    labelled AS (SELECT * FROM spoken WHERE text <> '')"""


def _question(text: str) -> str:
    cue = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(roles.CUES)})(?:$|[^\p{{L}}\p{{N}}_])"
    return f"(trim({text}, {_text(BLANKS)}) <> '' AND (ends_with(trim({text}, {_text(BLANKS)}), '?') OR regexp_matches({text}, {_text(cue)})))"


def _turns(same: str, apart: str = "false") -> str:
    """Runs of labelled lines as turns; ``same`` is a condition on this row and the one before, p."""
    return f"""{_roles(roles.SPEAKERS)},
    lagged AS (SELECT *, lag(role) OVER w AS p_role, lag(tag) OVER w AS p_tag FROM labelled WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    opened AS (SELECT *, sum(CASE WHEN p_role IS NULL OR NOT ({same}) OR {apart} THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY line) AS turn FROM lagged),
    turns AS (SELECT doc_id, turn::BIGINT AS turn, any_value(role) AS role, any_value(tag) AS tag, string_agg(text, ' ' ORDER BY line) AS text
        FROM opened GROUP BY doc_id, turn)"""


def _turn_sentences(columns: str) -> str:
    return f"""cut AS (SELECT doc_id, turn, {columns}, {_sentences('text')} AS p FROM turns),
    flat AS (SELECT doc_id, turn, {columns}, unnest(p) AS text, generate_subscripts(p, 1) AS nth FROM cut),
    uttered AS (SELECT doc_id, {columns}, text, row_number() OVER (PARTITION BY doc_id ORDER BY turn, flat.nth)::INT AS ord FROM flat)"""


def _paired(source: str, key: str, order: str) -> str:
    return f"""asked AS (SELECT *, role = 'interviewer' AND {_question('text')} AS is_question FROM {source}),
    counted AS (SELECT *, sum(is_question::INT) OVER (PARTITION BY {key} ORDER BY {order}) AS pair FROM asked),
    placed AS (SELECT *, sum((role <> 'interviewer')::INT) OVER (PARTITION BY {key}, pair ORDER BY {order}) AS nth FROM counted),
    answered AS (SELECT *, role <> 'interviewer' AND pair > 0 AND nth = 1 AS is_answer FROM placed)"""


def _qa(source: str, key: str) -> str:
    return f"""own AS (SELECT *, role = 'interviewer' OR tag IN ('INT', 'INTERVIEWER', 'Q') AS asks FROM {source}),
    voiced AS (SELECT *, CASE WHEN asks THEN chr(1) ELSE tag END AS who FROM own),
    changed AS (SELECT *, coalesce((lag(who) OVER (PARTITION BY {key} ORDER BY ord) <> who)::INT, 1) AS opens FROM voiced),
    runs AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY ord) AS run FROM changed),
    begun AS (SELECT *, max((asks AND {_question('text')})::INT) OVER (PARTITION BY {key}, run ORDER BY ord) AS q FROM runs),
    islands AS (SELECT {key}, run, any_value(asks) AS asks, any_value(who) AS who, string_agg(text, ' ' ORDER BY ord) AS whole
        FROM begun WHERE NOT asks OR q = 1 GROUP BY {key}, run),
    looked AS (SELECT *, lead(who) OVER (PARTITION BY {key} ORDER BY run) AS a_speaker, lead(whole) OVER (PARTITION BY {key} ORDER BY run) AS a_text FROM islands)
    SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY run))::INT AS "pairId", 'INTERVIEWER' AS q_speaker, whole AS q_text, a_speaker, a_text
    FROM looked WHERE asks AND a_text IS NOT NULL"""


def _counts(positive: Sequence[str], negative: Sequence[str]) -> str:
    hits = lambda words: f"len(list_filter(w, lambda t: list_contains({_list(words)}, t)))"
    return f"{hits(positive)}::INT AS pos, {hits(negative)}::INT AS neg"


_LABEL = "CASE WHEN tanh((pos - neg) / 3.0) > 0.15 THEN 'positive' WHEN tanh((pos - neg) / 3.0) < -0.15 THEN 'negative' ELSE 'neutral' END"


def _sentiment(positive: Sequence[str], negative: Sequence[str]) -> str:
    return f"""WITH {_SEGMENTS}, worded AS (SELECT doc_id, "segId", {_TOKENS} AS w FROM segments),
    counted AS (SELECT doc_id, "segId", {_counts(positive, negative)} FROM worded)
    SELECT doc_id, "segId", pos, neg, {_LABEL} AS label, round(tanh((pos - neg) / 3.0), 6) AS score FROM counted"""


def _emotion(words: Mapping[str, Sequence[str]], source: str = "segments", keys: str = 'doc_id, "segId"') -> str:
    n = [f"len(list_filter(w, lambda t: list_contains({_list(words[e])}, t)))" if words.get(e) else "0" for e in affect.EMOTIONS]
    names = [f"n_{e}" for e in affect.EMOTIONS]
    counted = ", ".join(f"{x} AS {a}" for x, a in zip(n, names))
    whole = " + ".join(f"exp({a}::DOUBLE)" for a in names)
    shares = ", ".join(
        f"CASE WHEN {' + '.join(names)} > 0 THEN exp({a}::DOUBLE) / ({whole}) ELSE {1.0 if i == 0 else 0.0} END AS s_{e}"
        for i, (a, e) in enumerate(zip(names, affect.EMOTIONS))
    )
    top = "greatest(" + ", ".join(f"s_{e}" for e in affect.EMOTIONS) + ")"
    label = "CASE " + " ".join(f"WHEN s_{e} = {top} THEN '{e}'" for e in affect.EMOTIONS) + " END"
    signed = " + ".join(f"s_{e} * ({affect.VALENCE[e]})" for e in affect.EMOTIONS if e != "neutral")
    return f"""worded AS (SELECT {keys}, {_TOKENS} AS w FROM {source}),
    counted AS (SELECT {keys}, {counted} FROM worded),
    shared AS (SELECT {keys}, {shares} FROM counted),
    felt AS (SELECT *, {label} AS label, {top} AS score, greatest(-1.0, least(1.0, {signed})) AS signed FROM shared)"""


def _matches(terms: Mapping[str, Sequence[str]]) -> str:
    """Longest-first matches of terms in segments: pieces, runs of pieces, equi-join, then a fold in order."""
    first: dict[str, str] = {}
    for label, own in terms.items():
        for t in own:
            first.setdefault(t, label)
    pieces = {t: phrases.pieces_of(t) for t in first}
    most = max(len(p) for p in pieces.values())
    values = ", ".join(f"({_text(t)}, {_text(k)}, {_text(pieces[t][0])})" for t, k in sorted(first.items()))
    return f"""gaz(term, label, head) AS (VALUES {values}),
    heads AS (SELECT DISTINCT head FROM gaz),
    split AS (SELECT doc_id, "segId", regexp_extract_all(text, {_text(phrases.PIECE)}) AS p FROM segments),
    pieces AS (SELECT doc_id, "segId", p, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM split),
    placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, "segId" ORDER BY i) - length(piece) AS o FROM pieces),
    starts AS (SELECT * FROM placed SEMI JOIN heads ON piece = head),
    runs AS (SELECT doc_id, "segId", o, array_to_string(p[i:i + k], '') AS token FROM starts, range(0, {most}) r(k) WHERE i + k <= len(p)),
    met AS (SELECT doc_id, "segId", o::BIGINT AS o, token, label FROM runs JOIN gaz ON token = term),
    ordered AS (SELECT doc_id, "segId", list([{{'o': o, 'til': o + length(token), 'token': token, 'tag': label}}] ORDER BY length(token) DESC, o) AS m
        FROM met GROUP BY doc_id, "segId"),
    folded AS (SELECT doc_id, "segId", unnest(list_reduce(m, lambda own, x: CASE
        WHEN len(list_filter(own, lambda y: x[1].o < y.til AND y.o < x[1].til)) > 0 THEN own ELSE list_concat(own, x) END)) AS e FROM ordered)"""


def _mentions(places: Sequence[str]) -> str:
    keep = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
    inner = "regexp_extract_all(s.text, ' ([A-Z][a-z]+)', 1)"
    every = "regexp_extract_all(s.text, '([A-Z][a-z]+)', 1)"
    dates = "regexp_extract_all(s.text, '([0-9]{4})', 1)"
    return f"""{_SENTS},
    mentions AS (SELECT d.source AS "fileId", s.doc_id AS "segId", s.sent_id, s.text AS canon, substr(sha1(lower(s.text)), 1, 16) AS key,
        list_filter({keep(inner)}, lambda x: NOT list_contains({_list(places)}, x)) AS persons,
        list_filter({keep(every)}, lambda x: list_contains({_list(places)}, x)) AS places,
        {keep(dates)} AS dates FROM sents s JOIN documents d USING (doc_id))"""


def _events(places: Sequence[str]) -> str:
    keep = "list_filter(names, lambda x, i: list_position(names, x) = i)"
    bonus = "0.05 + CASE WHEN len(persons) > 0 THEN 0.05 ELSE 0 END + CASE WHEN len(places) > 0 THEN 0.05 ELSE 0 END + CASE WHEN len(dates) > 0 THEN 0.05 ELSE 0 END"
    order = 'ORDER BY "segId", sent_id'
    return f"""{_mentions(places)},
    grouped AS (SELECT "fileId", key, arg_min(canon, "segId" * 1000000 + sent_id) AS event, count(*) AS n, flatten(list(persons {order})) AS names,
        flatten(list(places {order}))[1] AS place, flatten(list(dates {order}))[1] AS date, list("segId" {order}) AS sources,
        sum({bonus}) AS bonus FROM mentions GROUP BY "fileId", key),
    events AS (SELECT *, {keep} AS who FROM grouped)"""


def _parse(places: Sequence[str]) -> str:
    """Tokens, entities and tokens merged by entities, by the rules of the parser, stated in SQL."""
    low = "lower(token)"
    verb = f"({low} IN {_among(parsing.VERBS)} OR (length(token) >= {parsing.LEAST_VERB} AND regexp_matches({low}, '(ed|ing)$') AND {low} NOT IN {_among(parsing.NO_VERBS)}))"
    listed = {"AUX": parsing.AUXILIARIES, "ADP": parsing.PREPOSITIONS, "DET": parsing.DETERMINERS, "PRON": parsing.PRONOUNS}
    pos = " ".join(f"WHEN {low} IN {_among(own)} THEN '{k}'" for k, own in listed.items())
    pos += f" WHEN {low} IN {_among(parsing.ADVERBS)} OR (ends_with({low}, 'ly') AND {low} NOT IN {_among(parsing.NO_ADVERBS)}) THEN 'ADV' WHEN {low} IN {_among(parsing.CONJUNCTIONS)} THEN 'CCONJ'"
    pos += f" WHEN {verb} THEN 'VERB' WHEN regexp_matches(token, '^[A-Za-zÀ-ÖØ-öø-ÿ]') THEN 'NOUN' WHEN regexp_matches(token, '^[0-9]') THEN 'NUM' ELSE 'PUNCT'"
    lemmas = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in parsing.VERBS.items())
    small = _among([*parsing.AUXILIARIES, *parsing.PREPOSITIONS, *parsing.DETERMINERS, *parsing.PRONOUNS, *parsing.ADVERBS, *parsing.CONJUNCTIONS])
    first = "(verb IS NOT NULL OR prep IS NOT NULL) AND (nominal IS NULL OR nominal < greatest(verb, prep))"
    is_subject, is_pobj = "(ends AND next_pos = 'VERB')", f"(ends AND {first} AND greatest(verb, prep) = prep)"
    is_dobj, inner = f"(ends AND {first} AND greatest(verb, prep) = verb)", "(pos IN ('NOUN', 'PRON') AND NOT ends)"
    return f"""{_SENTS},
    raw AS (SELECT doc_id, sent_id::BIGINT AS sent_id, unnest(regexp_extract_all(text, {_text(parsing.TOKEN)})) AS token,
        generate_subscripts(regexp_extract_all(text, {_text(parsing.TOKEN)}), 1) - 1 AS place FROM sents),
    posed AS (SELECT doc_id, sent_id, (sent_id * 1048576 + place)::BIGINT AS i, token, CASE {pos} END AS pos FROM raw),
    marked AS (SELECT *, pos IN ('NOUN', 'PRON') AND coalesce(lead(pos) OVER w NOT IN ('NOUN', 'PRON'), true) AS ends,
        max(CASE WHEN pos = 'VERB' THEN i END) OVER b AS verb, max(CASE WHEN pos = 'ADP' THEN i END) OVER b AS prep,
        min(CASE WHEN pos = 'VERB' THEN i END) OVER s AS root, min(CASE WHEN pos = 'AUX' THEN i END) OVER s AS aux,
        min(CASE WHEN pos NOT IN ('AUX', 'ADV') THEN i END) OVER a AS next_i, arg_min(pos, i) FILTER (WHERE pos NOT IN ('AUX', 'ADV')) OVER a AS next_pos
        FROM posed WINDOW s AS (PARTITION BY doc_id, sent_id), w AS (PARTITION BY doc_id, sent_id ORDER BY i),
        b AS (PARTITION BY doc_id, sent_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        a AS (PARTITION BY doc_id, sent_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    held AS (SELECT *, max(CASE WHEN ends THEN i END) OVER (PARTITION BY doc_id, sent_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nominal,
        min(CASE WHEN ends THEN i END) OVER (PARTITION BY doc_id, sent_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS run_end FROM marked),
    tokens AS (SELECT doc_id, sent_id, i, token AS text,
        CASE WHEN pos = 'VERB' THEN CASE {low} {lemmas} ELSE regexp_replace({low}, '(ed|ing)$', '') END
            WHEN {low} IN ('am', 'are', 'is', 'was', 'were', 'been', 'being') THEN 'be' ELSE {low} END AS lemma, pos,
        CASE WHEN i = coalesce(root, aux) THEN 'ROOT' WHEN {is_subject} THEN 'nsubj' WHEN {is_pobj} THEN 'pobj' WHEN {is_dobj} THEN 'dobj' WHEN {inner} THEN 'compound'
            WHEN pos = 'ADP' AND verb IS NOT NULL THEN 'prep' ELSE 'dep' END AS dep,
        CASE WHEN {is_subject} THEN next_i WHEN {is_pobj} THEN prep WHEN {is_dobj} OR pos = 'ADP' THEN coalesce(verb, i) WHEN {inner} THEN run_end ELSE i END AS head_i FROM held),
    kinds AS (SELECT doc_id, sent_id, i, text, CASE WHEN text IN {_among([*parsing.MONTHS, *parsing.DAYS])} OR regexp_full_match(text, '1[0-9]{{3}}|20[0-9]{{2}}') THEN 'DATE'
        WHEN regexp_matches(text, '^[A-ZÀ-ÖØ-Þ]') AND lower(text) NOT IN {small} THEN 'NAME' END AS kind FROM tokens),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, sent_id, kind ORDER BY i) AS run FROM kinds WHERE kind IS NOT NULL),
    spans AS (SELECT doc_id, sent_id, kind, min(i) AS start_i, max(i) + 1 AS end_i, string_agg(text, ' ' ORDER BY i) AS text, arg_max(text, i) AS last FROM runs GROUP BY doc_id, sent_id, kind, run),
    ents AS (SELECT doc_id, sent_id, start_i, end_i, text, CASE WHEN kind = 'DATE' THEN 'DATE' WHEN text IN {_among(places)} THEN 'GPE'
        WHEN last IN {_among(parsing.ORGANISATIONS)} THEN 'ORG' ELSE 'PERSON' END AS label FROM spans
        WHERE start_i <> sent_id * 1048576 OR kind = 'DATE' OR end_i - start_i > 1 OR text IN {_among(places)}),
    within_ AS (SELECT t.*, e.start_i, e.end_i, e.text AS own FROM tokens t LEFT JOIN ents e ON e.doc_id = t.doc_id AND e.sent_id = t.sent_id AND t.i >= e.start_i AND t.i < e.end_i),
    tops AS (SELECT doc_id, start_i, min(i) AS top FROM within_ WHERE start_i IS NOT NULL AND (head_i < start_i OR head_i >= end_i OR head_i = i) GROUP BY 1, 2),
    chosen AS (SELECT w.*, top FROM within_ w LEFT JOIN tops p ON p.doc_id = w.doc_id AND p.start_i = w.start_i),
    merged AS (SELECT c.doc_id, c.sent_id, c.i, coalesce(c.own, c.text) AS text, coalesce(c.own, c.lemma) AS lemma, c.pos, c.dep, coalesce(h.top, c.head_i) AS head_i
        FROM chosen c LEFT JOIN chosen h ON h.doc_id = c.doc_id AND h.i = c.head_i WHERE c.top IS NULL OR c.top = c.i)"""


def _phrases(places: Sequence[str]) -> str:
    return f"""{_parse(places)},
    mains AS (SELECT doc_id, sent_id, arg_min(i, rank) AS i, arg_min(lemma, rank) AS lemma FROM (
        SELECT *, i + CASE WHEN dep = 'ROOT' AND pos IN ('VERB', 'AUX') THEN 0 ELSE 1::BIGINT << 60 END AS rank FROM merged
        WHERE (dep = 'ROOT' AND pos IN ('VERB', 'AUX')) OR pos = 'VERB') GROUP BY 1, 2),
    kids AS (SELECT c.doc_id, c.head_i AS i, string_agg(c.text, ' ' ORDER BY c.i) FILTER (WHERE c.dep = 'nsubj') AS subj,
        string_agg(c.text, ' ' ORDER BY c.i) FILTER (WHERE c.dep = 'dobj') AS obj FROM merged c WHERE c.i <> c.head_i GROUP BY 1, 2),
    under_ AS (SELECT p.doc_id, p.head_i AS i, string_agg(o.text, ' ' ORDER BY p.i, o.i) AS pobj FROM merged p
        JOIN merged o ON o.doc_id = p.doc_id AND o.head_i = p.i AND o.dep = 'pobj' WHERE p.dep = 'prep' AND p.i <> p.head_i GROUP BY 1, 2),
    phrased AS (SELECT m.doc_id, m.sent_id, trim(concat_ws(' ', subj, lemma, coalesce(obj, pobj))) AS canon FROM mains m
        LEFT JOIN kids USING (doc_id, i) LEFT JOIN under_ USING (doc_id, i)),
    phrases AS (SELECT s.doc_id, s.sent_id, s.text AS sentence, coalesce(canon, trim(s.text)) AS canon FROM sents s LEFT JOIN phrased p ON p.doc_id = s.doc_id AND p.sent_id = s.sent_id)"""


def _text_events(places: Sequence[str]) -> str:
    keep = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
    names = lambda labels: f"list(text ORDER BY start_i) FILTER (WHERE label IN {_among(labels)})"
    bonus = "0.05 + CASE WHEN len(persons) > 0 THEN 0.05 ELSE 0 END + CASE WHEN len(places) > 0 THEN 0.05 ELSE 0 END + CASE WHEN len(dates) > 0 THEN 0.05 ELSE 0 END"
    order = "ORDER BY doc_id, sent_id"
    return f"""{_phrases(places)},
    named AS (SELECT doc_id, sent_id, {names(["PERSON"])} AS persons, {names(["FAC", "GPE", "LOC"])} AS places, {names(["DATE", "TIME"])} AS dates FROM ents GROUP BY 1, 2),
    mentions AS (SELECT d.source AS "fileId", p.doc_id, p.sent_id, p.sentence, canon, coalesce(persons, []) AS persons, coalesce(places, []) AS places, coalesce(dates, []) AS dates
        FROM phrases p JOIN documents d USING (doc_id) LEFT JOIN named n ON n.doc_id = p.doc_id AND n.sent_id = p.sent_id WHERE trim(canon) <> ''),
    grouped AS (SELECT "fileId", lower(canon) AS key, arg_min(canon, doc_id * 1000000 + sent_id) AS event, min(doc_id * 1000000 + sent_id) AS ord, count(*) AS n,
        flatten(list(persons {order})) AS names, flatten(list(places {order}))[1] AS place, flatten(list(dates {order}))[1] AS date,
        list(doc_id {order}) AS sources, sum({bonus}) AS bonus FROM mentions GROUP BY 1, 2),
    events AS (SELECT *, {keep("names")} AS who, round(least(1.0, 0.35 + bonus), 9) AS confidence FROM grouped)"""


def queries(
    positive: Sequence[str], negative: Sequence[str], emotions: Mapping[str, Sequence[str]], places: Sequence[tuple[str, float, float]]
) -> dict[str, str]:
    names = [n for n, _, _ in places]
    known = resources.gazetteer()
    terms = resources.phrase_terms()
    words = lambda source: f"SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+)', 1)) AS name FROM {source}"
    classes = " ".join(f"WHEN name IN {_among(known[k])} THEN '{k}'" for k in phrases.PLACE_CLASSES)
    summary = "CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '…' ELSE text END"
    theme = ", ".join(
        f"CASE WHEN {' OR '.join(f'contains(lower(text), {_text(w)})' for w in own)} THEN '{k}' END"
        for k, own in (interpret.THEMES | {"article": ("the", "der", "la")}).items()
    )
    nodes = f"""{_SEGMENTS}, found AS (SELECT DISTINCT doc_id, "segId", unnest(regexp_extract_all(text, '([A-Z][a-z]+)', 1)) AS node FROM segments)"""
    windows = lambda w: f"""spread AS (SELECT DISTINCT c.doc_id, c."segId" AS centre, f.node FROM segments c JOIN found f
        ON f.doc_id = c.doc_id AND f."segId" BETWEEN c."segId" - {w} AND c."segId" + {w})
        SELECT a.node AS u, b.node AS v, count(*) AS w FROM spread a JOIN spread b ON a.doc_id = b.doc_id AND a.centre = b.centre AND a.node < b.node GROUP BY 1, 2"""  # noqa: E731
    user = "CASE role WHEN 'user' THEN 'interviewer' WHEN 'assistant' THEN 'witness' ELSE 'narration' END"
    talk = f"talk AS (SELECT conv_id, turn, {user} AS role, text FROM conversations)"
    located = f"""{_SEGMENTS}, {_matches({"GPE": names})},
        spots(name, lat, lon) AS (VALUES {", ".join(f"({_text(n)}, {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in places)}),
        tagged AS (SELECT e.token AS name, CASE {' '.join(f"WHEN e.token IN {_among([x for x in names if x in known[k]])} THEN '{k}'" for k in phrases.PLACE_CLASSES if set(names) & set(known[k]))
        or "WHEN false THEN ''"} ELSE 'PLACE' END AS tag FROM folded),
        located AS (SELECT tagged.*, lat, lon FROM tagged JOIN spots USING (name) WHERE tag <> 'CAMP' AND tag <> 'CONTINENT')"""
    classed = " ".join(f"WHEN e.tag = 'GPE' AND e.token IN {_among(own)} THEN '{k}'" for k in phrases.PLACE_CLASSES if (own := sorted({*names} & {*known[k]})))
    tagged_nodes = f"""{_SEGMENTS}, {_matches({"GPE": names, "FAMILY": negative})},
        tags AS (SELECT doc_id, "segId", e.token AS node, CASE {classed} WHEN e.tag = 'GPE' THEN 'PLACE' ELSE e.tag END AS tag FROM folded),
        names_ AS (SELECT DISTINCT doc_id, "segId", node FROM tags WHERE tag IN ('PLACE', 'FAMILY', 'COUNTRY', 'CITY'))"""
    label = "['positive', 'Negative ', 'neutral', 'odd'][event_id % 4 + 1]"
    felt = "['joy', 'FEAR', 'odd', 'anger'][event_id % 4 + 1]"
    category = f"""CASE WHEN n >= greatest(2, floor(0.4 * max(n) OVER (PARTITION BY "fileId"))) OR (len(who) > 0 AND coalesce(place, '') <> '') THEN 'major' ELSE 'minor' END"""
    return {
        "sentence_split": f"WITH {_SENTS} SELECT doc_id, sent_id, text FROM sents",
        "segment_ntile": f"""WITH {_SEGMENTS} SELECT doc_id, "segId", (count(*) OVER (PARTITION BY doc_id))::INT AS "segCount", text FROM segments""",
        "segment_pack_fixed": f"""WITH {_SENTS},
            sized AS (SELECT *, ceil(count(*) OVER (PARTITION BY doc_id) / 10.0) AS size FROM sents)
            SELECT doc_id, floor(sent_id / size)::INT AS "segId", string_agg(text, ' ' ORDER BY sent_id) AS text FROM sized GROUP BY 1, 2""",
        "token_counts": f"WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct FROM w",
        "sentiment_rule": _sentiment(affect.POSITIVE, affect.NEGATIVE),
        "sentiment_own_words": _sentiment(positive, negative),
        "sentiment_by_lang": f"""WITH worded AS (SELECT lang, {_TOKENS} AS w FROM documents), counted AS (SELECT lang, {_counts(positive, negative)} FROM worded)
            SELECT lang, {_LABEL} AS label, count(*) AS n, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, round(avg(round(tanh((pos - neg) / 3.0), 6)), 4) AS score
            FROM counted GROUP BY 1, 2""",
        "emotion_rule": f"""WITH {_SEGMENTS}, {_emotion(affect.EMOTION_WORDS)} SELECT doc_id, "segId", label, round(score, 6) AS score, round(signed, 6) AS signed FROM felt""",
        "emotion_signed": f"""WITH {_SEGMENTS}, {_emotion(emotions)} SELECT doc_id, "segId", label, round(score, 6) AS score, round(signed, 6) AS signed FROM felt""",
        "emotion_distribution": f"WITH {_SEGMENTS}, {_emotion(emotions)}, long AS ("
        + " UNION ALL ".join(f"SELECT doc_id, '{e}' AS label, s_{e} AS share FROM felt" for e in affect.EMOTIONS)
        + ") SELECT doc_id, label, round(avg(share), 6) AS share FROM long GROUP BY 1, 2",
        "summary_truncate": f"SELECT doc_id, {summary} AS summary FROM documents",
        "interpretation": f"""WITH {_SEGMENTS}, {_emotion(emotions)}, c2 AS (SELECT doc_id, "segId", {_counts(positive, negative)} FROM worded)
            SELECT doc_id, "segId", 'Sentiment suggests *' || {_LABEL} || '* tone.' || CASE WHEN label <> 'neutral' THEN ' Dominant emotion appears to be *' || label || '*.' ELSE '' END AS interpretation
            FROM felt JOIN c2 USING (doc_id, "segId")""",
        "themes": f"SELECT doc_id, array_to_string(list_filter([{theme}], lambda x: x IS NOT NULL), ',') AS themes FROM documents",
        "annotate_gazetteer": f"""WITH {_SEGMENTS}, {_matches(terms)} SELECT doc_id, "segId", e.o::INT AS start_char, e.token AS token, e.tag AS tag FROM folded""",
        "entity_label_counts": f"WITH {_SEGMENTS}, {_matches(terms)} SELECT e.tag AS tag, count(*) AS n, count(DISTINCT doc_id) AS docs FROM folded GROUP BY 1",
        "classify_places": f"WITH w AS ({words('documents')}) SELECT name, count(*) AS n, CASE {classes} ELSE 'PLACE' END AS class FROM w GROUP BY name",
        "ambiguous_names": f"WITH w AS ({words('documents')}) SELECT name, count(*) AS n FROM w WHERE name IN {_among(known['AMBIGUOUS-CITY'])} GROUP BY name",
        "line_roles": f"WITH {_roles(roles.SPEAKERS)} SELECT doc_id, line, role, tag, text FROM labelled",
        "line_roles_strict": f"WITH {_roles(roles.STRICT_SPEAKERS)} SELECT doc_id, line, role, tag, text FROM labelled",
        "is_question": f"WITH {_SENTS} SELECT doc_id, sent_id, {_question('text')} AS is_question FROM sents",
        "turn_merge": f"""WITH {_turns("p_role = role AND p_tag = tag", "starts_with(text, '(')")} SELECT doc_id, turn, role, tag, text FROM turns""",
        "testimony_segments": f"""WITH {_turns("p_role = role")}, {_turn_sentences("role")}, {_paired("uttered", "doc_id", "ord")}
            SELECT doc_id, ord AS turn_id, role, text, is_question, is_answer, CASE WHEN is_question OR is_answer THEN pair::INT END AS qa_pair_id FROM answered""",
        "conversation_pairs": f"""WITH {talk}, {_paired("talk", "conv_id", "turn")}
            SELECT conv_id, turn, role, is_question, is_answer, CASE WHEN is_question OR is_answer THEN pair::INT END AS qa_pair_id FROM answered""",
        "qa_pairs": f"""WITH {talk}, rows_ AS (SELECT conv_id, turn AS ord, role, upper(role) AS tag, text FROM talk), {_qa("rows_", "conv_id")}""",
        "qa_pairs_documents": "WITH "
        + _turns("p_role = role AND p_tag = tag", "starts_with(text, '(')").replace(
            "SELECT * FROM spoken WHERE text <> ''",
            "SELECT doc_id, line, role, CASE tag WHEN '' THEN upper(role) ELSE tag END AS tag, text FROM spoken WHERE text <> '' AND tag <> 'CREW'",
        )
        + f", {_turn_sentences('role, tag')}, {_qa('uttered', 'doc_id')}",
        "event_mentions": f"""WITH {_mentions(names)} SELECT "fileId", "segId", sent_id, key, array_to_string(persons, '|') AS persons,
            array_to_string(places, '|') AS places, array_to_string(dates, '|') AS dates FROM mentions""",
        "event_aggregate": f"""WITH {_events(names)} SELECT "fileId", event, place, date, n::INT AS count_mentions, array_to_string(who[1:5], '|') AS persons,
            array_to_string(who[6:], '|') AS others, array_to_string(sources, ',') AS sources, round(least(1.0, 0.35 + bonus), 6)::DOUBLE AS confidence FROM events""",
        "event_major_minor": f"""WITH {_events(names)} SELECT "fileId", event, n::INT AS count_mentions, {category} AS category FROM events""",
        "event_emotion_mode": f"""WITH {_events(names)}, {_emotion(emotions, 'documents', 'doc_id')},
            each_ AS (SELECT "fileId", event, unnest(sources) AS doc_id, generate_subscripts(sources, 1) AS pos FROM events),
            met AS (SELECT e.*, label, signed FROM each_ e JOIN felt USING (doc_id)),
            ranked AS (SELECT "fileId", event, label, row_number() OVER (PARTITION BY "fileId", event ORDER BY count(*) DESC, min(pos)) AS nth FROM met GROUP BY 1, 2, 3),
            meant AS (SELECT "fileId", event, avg(signed) AS v FROM met GROUP BY 1, 2)
            SELECT "fileId", event, label AS emotion, round(v, 6) + 0.0 AS emotion_valence FROM ranked JOIN meant USING ("fileId", event) WHERE nth = 1""",
        "people_flatten": f"""WITH {_events(names)} SELECT "fileId", event, {category} AS category, coalesce(place, '') AS place, coalesce(date, '') AS date,
            array_to_string(who, ', ') AS people FROM events""",
        "rule_tokens": f"WITH {_parse(names)} SELECT doc_id, sent_id, i, text, lemma, pos, dep, head_i FROM tokens",
        "rule_entities": f"WITH {_parse(names)} SELECT doc_id, sent_id, start_i, end_i, text, label FROM ents",
        "merge_entities": f"WITH {_parse(names)} SELECT * FROM merged",
        "verb_frames": f"""WITH {_parse(names)},
            own AS (SELECT doc_id, head_i AS i, arg_min(text, i) FILTER (WHERE dep = 'nsubj') AS subject, arg_min(text, i) FILTER (WHERE dep = 'dobj') AS direct FROM merged WHERE i <> head_i GROUP BY 1, 2),
            under_ AS (SELECT p.doc_id, p.head_i AS i, first(o.text ORDER BY p.i, o.i) AS pobj FROM merged p
                JOIN merged o ON o.doc_id = p.doc_id AND o.head_i = p.i AND o.dep = 'pobj' WHERE p.dep = 'prep' AND p.i <> p.head_i GROUP BY 1, 2)
            SELECT m.doc_id, m.sent_id, m.i, m.text AS verb, coalesce(subject, '') AS subject, coalesce(direct, pobj, '') AS object, s.text AS sentence
            FROM merged m JOIN sents s ON s.doc_id = m.doc_id AND s.sent_id = m.sent_id LEFT JOIN own o ON o.doc_id = m.doc_id AND o.i = m.i
            LEFT JOIN under_ u ON u.doc_id = m.doc_id AND u.i = m.i WHERE m.pos = 'VERB'""",
        "event_phrases": f"WITH {_phrases(names)} SELECT doc_id, sent_id, sentence, canon FROM phrases",
        "sentence_entities": f"""WITH {_parse(names)}, lists AS (SELECT doc_id, sent_id, list(text ORDER BY start_i) FILTER (WHERE label = 'PERSON') AS p,
            list(text ORDER BY start_i) FILTER (WHERE label = 'GPE') AS g, list(text ORDER BY start_i) FILTER (WHERE label = 'DATE') AS d FROM ents GROUP BY 1, 2)
            SELECT doc_id, sent_id, coalesce(array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), '|'), '') AS persons,
            coalesce(array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), '|'), '') AS places,
            coalesce(array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), '|'), '') AS dates FROM lists""",
        "text_events": f"""WITH {_text_events(names)} SELECT "fileId", event, place, date, {category} AS category, n::INT AS count_mentions,
            array_to_string(who[1:5], '|') AS persons, array_to_string(who[6:], '|') AS others, round(confidence, 6)::DOUBLE AS confidence FROM events""",
        "merge_clusters": f"""WITH {_text_events(names)}, c AS (SELECT *, lower(split_part(event, ' ', 1)) AS cluster FROM events),
            m AS (SELECT "fileId", cluster, arg_min(event, ord) AS event, arg_min(place, ord) FILTER (WHERE place <> '') AS place, arg_min(date, ord) FILTER (WHERE date <> '') AS date,
                sum(n) AS n, flatten(list(sources)) AS s, flatten(list(who)) AS w, bool_or(true) AS t, arg_min(sources, ord) AS first, count(*) AS k FROM c GROUP BY 1, 2),
            rest AS (SELECT c."fileId", c.cluster, unnest(c.sources) AS x FROM c JOIN m USING ("fileId", cluster) WHERE c.event <> m.event),
            added AS (SELECT r."fileId", r.cluster, list(DISTINCT x) AS xs FROM rest r JOIN m USING ("fileId", cluster) WHERE NOT list_contains(m.first, x) GROUP BY 1, 2)
            SELECT "fileId", event, place, date, n::INT AS count_mentions, len(s)::INT AS n_evidence,
            array_to_string(list_sort(list_concat(first, coalesce(xs, []))), ',') AS sources, len(list_distinct(w))::INT AS n_people FROM m LEFT JOIN added USING ("fileId", cluster)""",
        "normalized_events": f"""WITH {_text_events(names)}, t AS (SELECT *, n % 3 > 0 AS told FROM events)
            SELECT "fileId", md5(event) AS phrase, CASE WHEN told THEN 'It was: ' || event ELSE event END AS event, CASE WHEN told AND n % 2 = 0 THEN 'Elsewhere' ELSE place END AS place,
            array_to_string(CASE WHEN NOT told OR list_contains(who, 'Somebody') THEN who WHEN len(who) < 5 THEN list_append(who, 'Somebody') ELSE list_concat(who, ['Somebody']) END, '|') AS people,
            round(CASE WHEN told THEN least(1.0, confidence + 0.05) ELSE confidence END, 6)::DOUBLE AS confidence FROM t""",
        "witness_infer": rf"""WITH {_SENTS} SELECT doc_id, CASE WHEN bool_or(regexp_matches(text,
            '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:I|me|my|our|us|we)(?:$|[^\p{{L}}\p{{N}}_])')) THEN 'narrator' ELSE 'other/unknown' END AS witness FROM sents GROUP BY doc_id""",
        "cooccurrence_w0": f"WITH {nodes}, {windows(0)}",
        "cooccurrence_w1": f"WITH {nodes}, {windows(1)}",
        "cooccurrence_across": f"""WITH {nodes}, listed AS (SELECT doc_id, "segId", row_number() OVER (ORDER BY doc_id, "segId") AS o FROM segments),
            held AS (SELECT o, node FROM found JOIN listed USING (doc_id, "segId")),
            spread AS (SELECT DISTINCT c.o AS centre, node FROM (SELECT o, unnest([o - 1, o, o + 1]) AS near FROM listed) c JOIN held h ON h.o = c.near)
            SELECT a.node AS u, b.node AS v, count(*) AS w FROM spread a JOIN spread b ON a.centre = b.centre AND a.node < b.node GROUP BY 1, 2""",
        "segment_nodes": f"WITH {tagged_nodes} SELECT * FROM names_",
        "ranked_edges": f"""WITH {tagged_nodes} SELECT a.node AS u, b.node AS v, count(*) AS w FROM names_ a JOIN names_ b
            ON a.doc_id = b.doc_id AND a."segId" = b."segId" AND a.node < b.node GROUP BY 1, 2""",
        "geojson_features": f"WITH {located} SELECT name, tag, count(*) AS n, min(lon) AS lon, min(lat) AS lat FROM located GROUP BY 1, 2",
        "place_centroid": f"WITH {located} SELECT round(coalesce(avg(lat), 0), 6) AS lat, round(coalesce(avg(lon), 0), 6) AS lon FROM located",
        "export_flatten_json": f"""WITH {_SEGMENTS}, {_matches(terms)} SELECT doc_id, "segId", to_json(list({{'token': e.token, 'tag': e.tag}} ORDER BY e.o))::VARCHAR AS entities FROM folded GROUP BY 1, 2""",
        "llm_parse_sentiment": f"""SELECT event_id, CASE WHEN lower(trim({label})) IN ('positive', 'negative') THEN lower(trim({label})) ELSE 'neutral' END AS label,
            CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 4 < 2 THEN 0.7 ELSE 0.5 END ELSE round(least(1.0, (event_id % 13) / 10.0), 6) END::DOUBLE AS score FROM events""",
        "llm_parse_emotion": f"""WITH p AS (SELECT event_id, CASE WHEN lower({felt}) = 'odd' THEN 'neutral' ELSE lower({felt}) END AS label,
            (event_id % 5)::DOUBLE AS j, (event_id % 3)::DOUBLE AS f FROM events)
            SELECT event_id, label, CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS score,
            CASE WHEN event_id % 7 <> 0 THEN round(j / CASE WHEN j + f = 0 THEN 1 ELSE j + f END, 6) END AS joy FROM p""",
        "gazetteer_labels": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {len(v)}::BIGINT)" for k, v in known.items()) + ") AS t(label, terms)",
        "texts_list": """SELECT * FROM (VALUES ('list', 1, 2, 12, 'village', 'GEONOUN'), ('list', 1, 2, 27, 'river', 'GEONOUN'),
            ('list', 2, 2, 3, 'mother', 'FAMILY'), ('list', 2, 2, 14, 'father', 'FAMILY')) AS t("fileId", "segId", "segCount", start_char, token, tag)""",
        "speaker_turn_counts": f"""WITH {talk}, c AS (SELECT role, coalesce((lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role)::INT, 1) AS changes FROM talk)
            SELECT role, count(*) AS turns, sum(changes)::BIGINT AS runs FROM c GROUP BY role""",
    }
