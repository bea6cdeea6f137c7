"""Sentences, segments, lines and tokens of a text, as column expressions.

A text is cut within its own row, so none of these needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"
#: Marks that are stripped from the ends of a token.
EDGE_MARKS = ".,;:!?\"'()[]{} "
#: Titles whose full stop ends no sentence.
ABBREVIATIONS = ("Capt", "Col", "Dr", "Gen", "Jr", "Lt", "Mr", "Mrs", "Ms", "Prof", "Rev", "Sgt", "Sr", "St")
_END, _DOT = "\x01", "\x02"
LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often the body, or a lambda in it, names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space texts."""
    return F.coalesce(stripped(text) == "", F.lit(True))


def sentences(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """The sentences of a text, stripped; blank ones are dropped and null gives null.

    A sentence ends with ``.``, ``!`` or ``?``, closing quotes or brackets after
    it, and white space. The stop of an abbreviation isn't an end.
    """
    if abbreviations:
        names = "|".join(sorted(abbreviations))
        masked = F.regexp_replace(text, rf"(^|[ \n\t\r(\"'])({names})\.", f"$1$2{_DOT}")
        # most texts have none of these, which a plain search tells much sooner than the pattern
        some = reduce(Column.__or__, [F.contains(text, F.lit(f"{name}.")) for name in sorted(abbreviations)])
        text = F.when(some, masked).otherwise(text)
    marked = F.regexp_replace(text, r"([.!?]+[\"')\]]*)[ \n\t\r]+", f"$1{_END}")
    parts = F.transform(F.split(marked, _END), lambda s: stripped(F.replace(s, F.lit(_DOT), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def packed_evenly(parts: Column, n_segments: int = 100) -> Column:
    """At most ``n_segments`` runs of parts, joined by a blank; the first runs have the odd ones.

    Sizes are those of ``ntile``: they differ by one at most.
    """

    def pack(own: Column) -> Column:
        count = F.size(own)
        n = F.greatest(F.lit(1), F.least(F.lit(n_segments), count))
        base, extra = F.floor(count / n).cast("int"), count % n
        start = lambda k: k * base + F.least(k, extra)
        runs = F.transform(
            F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(own, start(k) + 1, start(k + 1) - start(k)), " ")
        )
        return F.when(count > 0, runs).otherwise(F.array().cast("array<string>"))

    return let(parts, pack)


def packed_by_size(parts: Column, n_segments: int = 100) -> Column:
    """Runs of ``ceil(parts / n_segments)`` parts, joined by a blank; the last run may be shorter."""

    def pack(own: Column) -> Column:
        count = F.size(own)
        size = F.greatest(F.lit(1), F.ceil(count / max(1, n_segments)).cast("int"))
        runs = F.transform(
            F.sequence(F.lit(0), F.ceil(count / size).cast("int") - 1), lambda k: F.array_join(F.slice(own, k * size + 1, size), " ")
        )
        return F.when(count > 0, runs).otherwise(F.array().cast("array<string>"))

    return let(parts, pack)


def lines(text: Column) -> Column:
    """Lines at any Unicode line break; a break at the end opens no further line."""

    def cut(parts: Column) -> Column:
        last = F.size(parts)
        return F.when(F.get(parts, last - 1) == "", F.slice(parts, 1, F.greatest(last - 1, F.lit(0)))).otherwise(parts)

    return let(F.split(text, LINE_BREAKS), cut)


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space, without marks at their ends."""
    return _tokens_of(F.lower(text))


def _tokens_of(low: Column) -> Column:
    runs = F.filter(F.split(low, r"(?U)\s+"), lambda t: t != "")
    return F.transform(runs, lambda t: F.btrim(t, F.lit(EDGE_MARKS)))


def tokens_among(text: Column, wanted: Iterable[str]) -> Column:
    """The tokens that are among some words; none for null. Counts of several lists start from these few.

    Only a text that holds one of the words anywhere is cut into tokens.
    """
    words, none = sorted(set(wanted)), F.array().cast("array<string>")

    def among(low: Column) -> Column:
        some = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
        return F.when(some, F.filter(_tokens_of(low), lambda t: t.isin(*words))).otherwise(none)

    return let(F.lower(text), among) if words else none


def count_in(words: Column, wanted: Sequence[str]) -> Column:
    """How many of the tokens are among some words; a hash lookup each."""
    return F.size(F.filter(words, lambda t: t.isin(*sorted(wanted))))
