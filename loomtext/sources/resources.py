"""Term lists: the packaged gazetteer, word lists in files, lookups by label."""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import affect

_PACKAGED = Path(__file__).parent.parent / "resources"
#: Labels whose phrases are matched in texts, in order of precedence.
PHRASE_LABELS = ("GEONOUN", "NON-VERBAL", "FAMILY", "CAMP")
#: The file of each label in a folder of plain lists.
LIST_FILES = {
    "CAMP": "cleaned_holocaust_camps.txt",
    "FAMILY": "family_terms.txt",
    "GEONOUN": "combined_geonouns.txt",
    "NON-VERBAL": "non_verbals.txt",
    "AMBIGUOUS-CITY": "ambiguous_cities.txt",
}


@cache
def _packaged(name: str) -> dict[str, tuple[str, ...]]:
    found: dict[str, list[str]] = {}
    for row in (_PACKAGED / name).read_text(encoding="utf-8").splitlines():
        term, label = row.split("\t")
        found.setdefault(label, []).append(term)
    return {k: tuple(sorted(set(v))) for k, v in found.items()}


def gazetteer(folder: str | None = None) -> dict[str, tuple[str, ...]]:
    """Terms by label, from the package or from a folder of lists; a missing list has no terms."""
    if folder is None:
        return {**_packaged("gazetteer.tsv"), **_packaged("places.tsv")}
    out = dict(_packaged("places.tsv"))
    for label, name in LIST_FILES.items():
        path = Path(folder) / name
        lines = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
        out[label] = tuple(sorted({x.strip() for x in lines if x.strip()}))
    return out


def phrase_terms(folder: str | None = None) -> dict[str, tuple[str, ...]]:
    known = gazetteer(folder)
    return {k: known.get(k, ()) for k in PHRASE_LABELS}


def gazetteer_table(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(term, label), one row for each."""
    rows = [(t, label) for label, terms in gazetteer(folder).items() for t in terms]
    return spark.createDataFrame(rows, "term string, label string")


def label_counts(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(label, terms): how many terms each list has."""
    return gazetteer_table(spark, folder).groupBy("label").agg(F.count("*").alias("terms"))


def read_terms(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(term, label) of a list with a term a line; blank lines and repeats are dropped."""
    return spark.read.text(path).select(F.btrim("value").alias("term"), F.lit(label).alias("label")).where("term <> ''").distinct()


def read_wordlist(path: str, encoding: str = "latin-1", header_lines: int = 35) -> frozenset[str]:
    """Lower-case words of a list; a header, comments after ``;`` and blank lines are skipped.

    The header is only taken off where the file is longer than it.
    """
    lines = Path(path).read_text(encoding=encoding, errors="ignore").splitlines()
    body = lines[header_lines:] if len(lines) > header_lines else lines
    return frozenset(w.lower() for w in map(str.strip, body) if w and not w.startswith(";"))


def sentiment_words(folder: str | None = None) -> tuple[frozenset[str], frozenset[str]]:
    """(positive, negative) words: from the two files that the environment or a folder names, else built in.

    ``POS_LEXICON`` and ``NEG_LEXICON`` name the files, ``SENTIMENT_LEXICON_DIR``
    a folder with ``positive-words.txt`` and ``negative-words.txt``. Both files
    of a pair must be there.
    """
    pairs: list[tuple[str, str]] = []
    if os.environ.get("POS_LEXICON") and os.environ.get("NEG_LEXICON"):
        pairs.append((os.environ["POS_LEXICON"], os.environ["NEG_LEXICON"]))
    for base in filter(None, (os.environ.get("SENTIMENT_LEXICON_DIR"), folder)):
        pairs.append((f"{base}/positive-words.txt", f"{base}/negative-words.txt"))
    for up, down in pairs:
        if os.path.exists(up) and os.path.exists(down):
            return read_wordlist(up), read_wordlist(down)
    return affect.POSITIVE, affect.NEGATIVE


def longest_first(names: Iterable[str]) -> list[str]:
    return sorted(set(names), key=lambda n: (-len(n), n))
