"""License scans with a positional index of rare tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from importlib import resources
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import type_of


class Template(NamedTuple):
    """A licence notice and the phrases without which it isn't that licence."""

    license: str
    text: str
    phrases: tuple[str, ...]


def packaged_templates() -> tuple[Template, ...]:
    """The packaged notices: short lines as authors write them, standard headers and bodies."""
    found: list[Template] = []
    for line in resources.files("loomtext.llm").joinpath("notices.txt").read_text("utf-8").splitlines():
        if line.startswith("= "):
            license, *phrases = [x.strip() for x in line[2:].split("|")]
            found.append(Template(license, "", tuple(phrases)))
        elif found:
            found[-1] = found[-1]._replace(text=f"{found[-1].text} {line}".strip())
    return tuple(found)


#: Identifiers of the public SPDX list, which are names by themselves after ``SPDX-License-Identifier:``.
SPDX_IDS = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0",
    "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0",
    "EUPL-1.2", "GFDL-1.3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PSF-2.0",
    "Python-2.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
#: Identifiers of several words or numbers, which name a licence wherever they stand.
_TELLING = re.compile(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*-\d+\.\d+(?:-only|-or-later)?|BSD-\d-Clause|0BSD|WTFPL")


def licence_names() -> dict[str, str]:
    """Licence by full name, as words: what counts by itself in any wording."""
    names = {
        "apache license 2 0": "Apache-2.0", "apache license version 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0", "apache software license 2 0": "Apache-2.0",
        "mit license": "MIT", "expat license": "MIT", "isc license": "ISC", "zlib license": "Zlib", "boost software license": "BSL-1.0", "the unlicense": "Unlicense",
        "bsd 3 clause license": "BSD-3-Clause", "3 clause bsd": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause",
        "bsd 2 clause license": "BSD-2-Clause", "2 clause bsd": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause",
        "mozilla public license v 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mozilla public license version 2 0": "MPL-2.0",
        "eclipse public license 2 0": "EPL-2.0", "eclipse public license v 2 0": "EPL-2.0", "eclipse public license v2 0": "EPL-2.0",
        "creative commons attribution 4 0 international": "CC-BY-4.0", "creative commons attribution sharealike 4 0 international": "CC-BY-SA-4.0",
        "creative commons attribution noncommercial 4 0 international": "CC-BY-NC-4.0", "creative commons zero": "CC0-1.0", "cc0 1 0 universal": "CC0-1.0",
        "unencumbered software released into the public domain": "Unlicense",
    }
    for short, middle, versions in (("gpl", "", ("2", "3")), ("lgpl", "lesser ", ("2 1", "3")), ("agpl", "affero ", ("3",))):
        for version in versions:
            license = f"{short.upper()}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
            numbers = {version, version + " 0"} - {"2 1 0"}
            for name in (f"gnu {middle}general public license", f"gnu {short}", short):
                for number in numbers:
                    names |= {f"{name} version {number}": license, f"{name} v{number}": license, f"{name} v {number}": license}
                    if number.count(" ") or name.endswith("license"):
                        names[f"{name} {number}"] = license
            names |= {f"{short}v{n}": license for n in numbers}
    for license in SPDX_IDS:
        words = " ".join(t for t, _, _ in tokens_of(license))
        names[f"spdx license identifier {words}"] = license
        if _TELLING.fullmatch(license):
            names.setdefault(words, license)
    return names


_TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str | None) -> list[tuple[str, int, int]]:
    """(lower-case token, start, end) of a text's runs of letters and digits; none for null."""
    return [(m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(text or "")]


def common_length(template: dict[str, int], size: int, words: Sequence[str]) -> tuple[int, int]:
    """(longest common subsequence, how many of the words it takes to reach it), with bits for the template's places of each word."""
    full = (1 << size) - 1
    free, best, upto = full, 0, 0
    for i, w in enumerate(words, 1):
        met = free & template.get(w, 0)
        if met:
            free = (free + met | free - met) & full
            found = size - free.bit_count()
            if found > best:
                best, upto = found, i
    return best, upto


def _places(tokens: Sequence[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, t in enumerate(tokens):
        out[t] = out.get(t, 0) | 1 << i
    return out


class Index:
    """Postings of each template's anchors, its tokens of highest IDF, and the licences' names by first word."""

    def __init__(self, templates: Sequence[Template], idf: dict[str, float], anchors: int, names: dict[str, str] | None = None) -> None:
        self.templates = templates
        self.tokens = [[t for t, _, _ in tokens_of(x.text)] for x in templates]
        self.places = [_places(t) for t in self.tokens]
        self.backward = [_places(t[::-1]) for t in self.tokens]
        self.phrases = [[p.split() for p in x.phrases] for x in templates]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.needed: list[int] = []
        self.names: dict[str, list[tuple[list[str], str]]] = {}
        for name, license in (licence_names() if names is None else names).items():
            self.names.setdefault(name.split()[0], []).append((name.split(), license))
        for own in self.names.values():
            own.sort(key=lambda x: (-len(x[0]), x))
        for k, tokens in enumerate(self.tokens):
            rare = sorted(set(tokens), key=lambda t: (-idf.get(t, math.inf), t))[:anchors]
            # the first phrase stands in the notice word for word, so its two rarest words always agree on a place
            named = sorted(set(self.phrases[k][0]), key=lambda t: (-idf.get(t, math.inf), t))[:2]
            chosen = set(rare) | set(named)
            self.needed.append(min(2, len(chosen)))
            for i, t in enumerate(tokens):
                if t in chosen:
                    self.postings.setdefault(t, []).append((k, i))

    def slack(self, k: int) -> int:
        """Words by which a notice may be longer or shorter than its template."""
        return 2 + len(self.tokens[k]) // 5

    def matched(self, words: list[str], k: int, at: int, least: float) -> tuple[int, int, int] | None:
        """(common words, first, end) of a template near a place, if enough of it is there in order and each of its phrases word for word."""
        size, slack = len(self.tokens[k]), self.slack(k)
        lo, hi = max(0, at - slack), min(len(words), at + size + slack)
        if not all(_has(words, p, lo, hi) for p in self.phrases[k]):
            return None
        common, upto = common_length(self.places[k], size, words[lo:hi])
        if common < least * size:
            return None
        _, back = common_length(self.backward[k], size, words[lo : lo + upto][::-1])
        return common, lo + upto - back, lo + upto

    def scan(self, text: str | None, least: float) -> list[tuple[str, int, int, float]]:
        """(license, start, end, share): notices in a text, the best template where several overlap, then full names elsewhere."""
        found_tokens = tokens_of(text)
        words = [t for t, _, _ in found_tokens]
        votes: dict[tuple[int, int], set[str]] = {}
        for p, w in enumerate(words):
            for k, q in self.postings.get(w, ()):
                votes.setdefault((k, p - q), set()).add(w)
        found = set()
        for (k, at), agreed in votes.items():
            if len(agreed) >= self.needed[k] and (near := self.matched(words, k, at, least)):
                common, a, b = near
                found.add((-common, -common / len(self.tokens[k]), k, a, b))
        taken: list[tuple[int, int]] = []
        out = []
        for _, share, k, a, b in sorted(found):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((self.templates[k].license, found_tokens[a][1], found_tokens[b - 1][2], round(-share, 4)))
        # a licence that is named in full counts in any wording about it
        for p, w in enumerate(words):
            for name, license in self.names.get(w, ()):
                b = p + len(name)
                if words[p:b] == name and all(b <= x or p >= y for x, y in taken):
                    taken.append((p, b))
                    out.append((license, found_tokens[p][1], found_tokens[b - 1][2], 1.0))
        return sorted(out, key=lambda x: x[1])


def _has(words: list[str], phrase: list[str], lo: int, hi: int) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(lo, hi - len(phrase) + 1))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Documents that have each word of the templates, and all documents; both over every text."""
    tokens = F.split(F.lower("text"), "[^a-z0-9]+")
    own = F.array_intersect(tokens, F.array(*[F.lit(w) for w in vocabulary]))
    # the empty token stands for the document itself
    counted = (
        docs.where("text is not null")
        .select(F.explode(F.array_append(own, F.lit(""))).alias("word"))
        .groupBy("word")
        .count()
        .collect()
    )
    df = {r["word"]: r["count"] for r in counted}
    return df, df.pop("", 0)


def scan_licenses(docs: DataFrame, templates: Sequence[Template] | None = None, anchors: int = 4, least: float = 0.8) -> DataFrame:
    """(doc_id, license, start, end, share): each licence notice in a text.

    The corpus says how rare each template word is; each template is indexed by
    its ``anchors`` rarest words, and the two rarest of its first key phrase, with their positions. A file's own such words
    are looked up; where two or more agree on the position of a template, it is
    compared with the words about there: the share of its words that stand there
    in order must reach ``least``, so words may be missing or put in, but
    all of its key phrases must be there word for word. A licence's full name or
    SPDX identifier counts by itself in other wordings; its row has the name only, with share 1. Where notices overlap, the
    one with more matching words stands; of as many, the closer, then the earlier template and place. Only texts with a word that some key
    phrase or name needs are looked at closer.

    ``start`` and ``end`` count code points from 0. A text has a row for each
    notice in it. Null and empty texts have none; repeated rows have theirs each;
    a doc_id of any type, or null, stays as it is. Columns other than doc_id and text are not read.
    An empty table gives no rows.
    """
    templates = packaged_templates() if templates is None else templates
    names = licence_names()
    vocabulary = sorted({t for x in templates for t, _, _ in tokens_of(x.text)} | {t for name in names for t in name.split()})
    df, total = document_frequencies(docs, vocabulary)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    index = Index(templates, idf, anchors, names)
    required = sorted({max(p.split(), key=lambda t: (idf.get(t, 0.0), t)) for p in [*(x.phrases[0] for x in templates), *names]})
    first = "|".join(map(re.escape, required))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *notice) for i, text in enumerate(batch.column(1).to_pylist()) for notice in index.scan(text, least)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64()]
            arrays = [batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(list(c), k) for c, k in zip(columns[1:], kinds)]]
            yield pa.record_batch(arrays, names=["doc_id", "license", "start", "end", "share"])

    return (
        docs.where(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{first})(?![a-z0-9])"))
        .select("doc_id", "text")
        .mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, license string, start int, end int, share double")
    )


def license_counts(found: DataFrame) -> DataFrame:
    """(license, files) over the notices of :func:`scan_licenses`."""
    return found.groupBy("license").agg(F.countDistinct("doc_id").alias("files"))
