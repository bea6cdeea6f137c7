"""Phrases of a gazetteer in a text, with offsets, and classes of place names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, runs of white space and single marks; together they are the whole text.
PIECE = r"([\p{L}\p{M}\p{N}_]+|\s+|[^\s\p{L}\p{M}\p{N}_])"
ENTITY = "struct<start_char:int,token:string,tag:string>"
#: Labels of a place name, the first that holds it wins.
PLACE_CLASSES = ("CONTINENT", "COUNTRY", "US-STATE", "CITY", "CAMP")
#: Labels that are refined to a class of place.
PLACE_LABELS = ("FAC", "GPE", "LOC", "ORG")
KEPT_LABELS = (
    "CAMP", "DATE", "EVENT", "FAC", "FAMILY", "GEONOUN", "GPE", "LOC", "NON-VERBAL", "ORG", "PERSON", "QUANTITY", "TIME",
)


def holds(terms: Iterable[str], value: Column) -> Column:
    """Whether some terms hold a value: a hash lookup."""
    return value.isin(*sorted(terms))


def classified(name: Column, label: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """The class of a place name by exact spelling, PLACE for a place in no list; other labels stay."""
    out = F.when(~label.isin(*PLACE_LABELS), label)
    for kind in PLACE_CLASSES:
        if classes.get(kind):
            out = out.when(holds(classes[kind], name), kind)
    return out.otherwise("PLACE")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def phrase_matches(text: str, terms: Mapping[str, Sequence[str]]) -> Column:
    """(start_char, token, tag) of each term in the column ``text``, in order; none for null.

    ``terms`` maps a label to its terms; a term of two labels has the first. A
    match is exact and starts and ends between pieces of the text. Of matches
    that overlap the longest stays, then the first. Offsets count code points
    from 0.

    The pieces that start some term are found first, by a hash lookup; only there
    are the next pieces joined and looked up. All of it is one row's work, with
    neither shuffle nor join. Made for segments: the offset of a match takes the
    length of what is before it. It is one SQL text, as thousands of literals
    take long to hand over one by one.
    """
    every = sorted({t for own in terms.values() for t in own if t})
    if not every:
        return F.expr(f"cast(array() as array<{ENTITY}>)")
    split = [pieces_of(t) for t in every]
    heads = ", ".join(map(_quoted, sorted({p[0] for p in split})))
    known = ", ".join(map(_quoted, every))
    kind = "array<struct<less:int,at:int,token:string>>"
    # let(v, x -> body) is transform(array(v), x -> body)[0]: v is worked out once
    # few terms have many pieces; only after their first pieces are so many joined
    longest: dict[str, int] = {}
    for own in split:
        longest[own[0]] = max(longest.get(own[0], 0), len(own))
    upto = str(max(longest.values()))
    for most in (3, 1):
        short = sorted(h for h, n in longest.items() if n <= most)
        upto = f"if(p[i] in ({', '.join(map(_quoted, short))}), {most}, {upto})" if short else upto
    runs = f"filter(transform(sequence(1, {upto}), k -> array_join(slice(p, i + 1, k), '')), c -> c in ({known}))"
    placed = "transform(array(length(array_join(slice(p, 1, i), ''))), n -> transform(f, c -> named_struct('less', -length(c), 'at', n, 'token', c)))[0]"
    at_start = f"transform(array(array_distinct({runs})), f -> if(size(f) > 0, {placed}, cast(array() as {kind})))[0]"
    starts = f"filter(if(size(p) > 0, sequence(0, size(p) - 1), cast(array() as array<int>)), i -> p[i] in ({heads}))"
    # most texts have no such piece, and nothing to sort or to fold
    matched = f"transform(array({starts}), b -> if(size(b) > 0, array_sort(flatten(transform(b, i -> {at_start}))), cast(array() as {kind})))[0]"
    pieces = f"coalesce(regexp_extract_all(`{text}`, {_quoted(PIECE[1:-1])}, 0), cast(array() as array<string>))"
    found = f"transform(array({pieces}), p -> {matched})[0]"
    apart = "exists(own, y -> x.at < y.at - y.less and y.at < x.at - x.less)"
    kept = F.expr(f"aggregate({found}, cast(array() as {kind}), (own, x) -> if({apart}, own, concat(own, array(x))))")
    label = lambda token: F.coalesce(*[F.when(holds(own, token), k) for k, own in terms.items() if own])
    return F.array_sort(
        F.transform(kept, lambda x: F.struct(x["at"].alias("start_char"), x["token"].alias("token"), label(x["token"]).alias("tag")))
    )


def pieces_of(term: str) -> list[str]:
    return regex.findall(PIECE, term)
