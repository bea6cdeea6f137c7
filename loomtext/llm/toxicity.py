"""Toxicity by lexicon induction: random walks from labelled seed terms over a word graph."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm import common
from loomtext.llm.common import (
    bitmap_of, broadcast_if_small, cut, free_name, freeing, has_bit, hash60, scratch, small_batches, word_pieces
)

#: Words that a task takes from texts at once, pairs that it lists at once, different words that it holds, rows it takes from a batch.
CHUNK_WORDS, LISTED_PAIRS, HELD_WORDS, HELD_PAIRS, SLICE = 100_000, 150_000, 150_000, 500_000, 128
#: More words than a task holds: HELD_WORDS and those of a piece of text.
HELD_LIMIT = 1 << 22
#: Bits of the filter of words that are frequent enough to have an edge; its size is the same for any corpus.
FILTER_BITS = 1 << 25
#: Source words of one scan, and lexicon words of one scoring pass; more take more passes.
SCAN_SOURCES, HELD_LEXICON = 100_000, 500_000
#: Pairs that one scan lists, as a share of the different words of all blocks, or this many if that is more: what it shuffles follows
#: the input, however many words a ring has. More pairs take more scans. Most pairs are shuffled as some two bytes of a sketch only.
SCAN_SHARE, SCAN_PAIRS = 2.0, 5_000_000
#: Bits of a cell of the sketch of pairs and of a region of cells, which is added up in one place; the sketch has the same size for any corpus.
CELL_BITS, REGION_BITS = 26, 18
#: Counts of which a pair needs one at least to be an edge; the sketch adds up the pairs of each by themselves.
NEEDS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 24, 34, 50, 80, 140, 300])
#: Bits of the table of the words' least counts (in steps of the square root of 2); its size is the same for any corpus.
LEAST_BITS, LEAST_STEPS = 22, 64
#: A ring is taken to have so many different pairs for each that it lists; where it has fewer, it is scanned again.
DISTINCT_SHARE = 1 / 16
#: A scan for the words of so many languages reads only texts of these.
FILTERED_LANGUAGES = 50
CONTEXT_BITS = 62
#: Weights and scores are whole numbers of this part, so that a sum doesn't depend on its order.
UNIT = 1_000_000
#: Polarities nearer to 0 say too little to count.
LEAST_POLARITY = 0.5
_NO_IDS = np.zeros(0, np.int64)


def _language(docs: DataFrame) -> Column:
    """The declared language; '' for null, or where the table has none."""
    return (F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")).alias("lang")


def _label_sample(docs: DataFrame, labels: DataFrame, rows: int) -> dict[str, int]:
    """toxic by doc_id, as text, for the ``rows`` labelled documents of least hash in each language; one with two labels has the larger."""
    known = labels.where("doc_id is not null and toxic is not null")
    merged = known.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = Window.partitionBy("lang").orderBy(hash60(F.col("doc_id")), "doc_id")
    named = docs.select(F.col("doc_id").cast("string"), _language(docs)).join(merged, "doc_id").distinct()
    picked = named.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows).select("doc_id", "toxic").toArrow()
    return dict(zip(picked["doc_id"].to_pylist(), picked["toxic"].to_pylist()))


def _sample_rows(spark: SparkSession, sample: dict[str, int]) -> DataFrame:
    """(labelled_id, kind), to be broadcast: at most ``label_rows`` a language."""
    return F.broadcast(spark.createDataFrame(sorted(sample.items()), "labelled_id string, kind int"))


def word_id(lang: str, word: str) -> int:
    """64 bits for a word of a language: what Spark's ``xxhash64`` makes of both with a blank between."""
    value = xxhash.xxh64_intdigest(f"{lang} {word}".encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def _id_column() -> Column:
    return F.xxhash64(F.concat_ws(" ", "lang", "word"))


class Book:
    """The words that a task has met; each has a small number, given when it is first met."""

    def __init__(self) -> None:
        self.next = count()
        self.by_language: dict[str, defaultdict[str, int]] = {}
        self.ids = _NO_IDS
        self.seen: dict[str, int] = {}

    def language(self, lang: str) -> defaultdict[str, int]:
        if lang not in self.by_language:
            self.by_language[lang] = defaultdict(self.next.__next__)
        return self.by_language[lang]

    def __len__(self) -> int:
        return sum(map(len, self.by_language.values()))

    def id_array(self) -> np.ndarray:
        """Ids of :func:`word_id` by number; those of words that are new since the last call are worked out."""
        ids = np.zeros(len(self), np.int64)
        ids[: len(self.ids)] = self.ids
        digest = xxhash.xxh64_intdigest
        for lang, own in self.by_language.items():
            start, prefix = self.seen.get(lang, 0), f"{lang} ".encode()
            new = [digest(prefix + w.encode(), 42) for w in islice(own, start, None)]
            numbers = np.fromiter(islice(own.values(), start, None), np.int64, len(new))
            ids[numbers] = np.array(new, np.uint64).view(np.int64)
            self.seen[lang] = len(own)
        self.ids = ids
        return ids

    def strings(self) -> tuple[list[str], list[str]]:
        """(language, word) by number."""
        langs, words = [""] * len(self), [""] * len(self)
        for lang, own in self.by_language.items():
            for word, number in own.items():
                langs[number], words[number] = lang, word
        return langs, words


def _numbers(words: list[str], own: defaultdict[str, int]) -> np.ndarray:
    return np.fromiter(map(own.__getitem__, words), np.int64, len(words))


def _parts(text: str | None, block: int) -> Iterator[list[str]]:
    """A text's words, in parts that start where a block does."""
    rest: list[str] = []
    for piece in word_pieces(text):
        part = rest + piece if rest else piece
        whole = len(part) // block * block
        if len(text) <= common.PIECE_CHARS:
            whole = len(part)
        if whole:
            yield part if whole == len(part) else part[:whole]
        rest = part[whole:]
    if rest:
        yield rest


def _in_blocks(parts: list[np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, block of each): the parts one after another, cut into blocks."""
    sizes = np.array([len(p) for p in parts], np.int64)
    held = -(-sizes // block)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(parts), np.repeat(np.cumsum(held) - held, sizes) + within // block


def context_bits(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """One of CONTEXT_BITS bits for the neighbours that each word has in its block; copies of a passage share it."""
    before, after = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
    together = blocks[1:] == blocks[:-1]
    before[1:][together] = ids.view(np.uint64)[:-1][together]
    after[:-1][together] = ids.view(np.uint64)[1:][together]
    mixed = before * np.uint64(0x9E3779B97F4A7C15) ^ after * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.uint64(1) << (mixed >> np.uint64(33)) % np.uint64(CONTEXT_BITS)


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) in order of key, then of place; both are sorted as one number where they fit in one."""
    bits = max(1, len(key) - 1).bit_length()
    if len(key) and 0 <= key.min() and int(key.max()).bit_length() + bits <= 63:
        both = np.sort(key << bits | np.arange(len(key)))
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(key, kind="stable")
    return key[order], order


def _last_of_each(numbers: np.ndarray, blocks: np.ndarray, most: int) -> np.ndarray:
    """Places of the last occurrence of each word of each block, by block and word."""
    key, order = _ordered(blocks * most + numbers)
    return order[np.append(np.diff(key) != 0, True)] if len(order) else order


def _summed(tables: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row a key (first column); others are added up, the last, of bits, is united."""
    columns = [np.concatenate(c) for c in zip(*tables)]
    if not len(columns[0]):
        return tuple(columns)
    key, order = _ordered(columns[0])
    starts = np.flatnonzero(np.append(True, np.diff(key) != 0))
    sums = [np.add.reduceat(c[order], starts) for c in columns[1:-1]]
    return (key[starts], *sums, np.bitwise_or.reduceat(columns[-1][order], starts))


def _contexts(n: Column, mask: Column) -> Column:
    """Occurrences in different contexts: ``n``, or fewer where the mask's bits show that they repeat."""
    set_ = F.bit_count(mask)
    return F.when(set_ >= CONTEXT_BITS, n).otherwise(
        F.least(n.cast("double"), -CONTEXT_BITS * F.log(1 - set_ / F.lit(float(CONTEXT_BITS))))
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield from zip(*[c.to_pylist() for c in batch.slice(a, SLICE).columns])


_WORD_COUNTS = "lang string, word string, n bigint, squares bigint, clean bigint, toxic bigint, mask bigint"


def _count_words(block: int):
    """(lang, word, n, squares, clean, toxic, mask) of (kind, lang, text): blocks with the word, labelled documents of either kind.

    The word '' has a language's totals: distinct words summed over blocks, the
    squares of these, and labelled documents. ``mask`` has the contexts in toxic ones.
    """

    class Held:
        def __init__(self) -> None:
            self.book = Book()
            self.parts: dict[str, list[np.ndarray]] = {}
            self.labelled: list[tuple[np.ndarray, bool]] = []
            self.tables: list[tuple[np.ndarray, ...]] = []
            self.totals: dict[str, np.ndarray] = {}
            self.waiting = 0

        def count(self) -> None:
            """Counts the words that wait."""
            most = len(self.book)
            for lang, parts in self.parts.items():
                numbers, blocks = _in_blocks(parts, block)
                at = _last_of_each(numbers, blocks, most)
                each = np.bincount(blocks[at])
                total = self.totals.setdefault(lang, np.zeros(4, np.int64))
                total[0] += len(at)
                total[1] += int((each * each).sum())
                words, n = np.unique(numbers[at], return_counts=True)
                none = np.zeros(len(words), np.int64)
                self.tables.append((words, n, none, none, none.view(np.uint64)))
            for numbers, toxic in self.labelled:
                words = np.unique(numbers)
                none, one = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
                if toxic:
                    ids = self.book.id_array()
                    bits = context_bits(ids[numbers], np.zeros(len(numbers), np.int64))
                    words, mask = _summed([(numbers, bits)])
                    self.tables.append((words, none, none, one, mask))
                else:
                    self.tables.append((words, none, one, none, none.view(np.uint64)))
            self.tables = [_summed(self.tables)] if self.tables else []
            self.parts, self.labelled, self.waiting = {}, [], 0

        def flush(self) -> pa.RecordBatch:
            self.count()
            langs, words = self.book.strings()
            number, *sums, mask = self.tables[0] if self.tables else [_NO_IDS] * 5
            own = sorted(self.totals)
            rows = [self.totals[lang] for lang in own]
            columns = [
                pa.array([langs[i] for i in number] + own, pa.string()),
                pa.array([words[i] for i in number] + [""] * len(own), pa.string()),
                pa.array(np.append(sums[0], [r[0] for r in rows]).astype(np.int64)),
                pa.array(np.append(np.zeros(len(number)), [r[1] for r in rows]).astype(np.int64)),
                pa.array(np.append(sums[1], [r[2] for r in rows]).astype(np.int64)),
                pa.array(np.append(sums[2], [r[3] for r in rows]).astype(np.int64)),
                pa.array(np.append(mask.view(np.int64), [0] * len(own)).astype(np.int64)),
            ]
            self.__init__()
            return pa.record_batch(columns, names=["lang", "word", "n", "squares", "clean", "toxic", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for label, lang, text in _rows(batches):
            whole = []
            own = held.book.language(lang)
            for words in _parts(text, block):
                part = _numbers(words, own)
                held.parts.setdefault(lang, []).append(part)
                held.waiting += len(part)
                if label is not None:
                    whole.append(part)
                elif held.waiting >= CHUNK_WORDS:
                    held.count()
            if whole:
                held.labelled.append((np.concatenate(whole), label > 0))
                held.totals.setdefault(lang, np.zeros(4, np.int64))[3 if label > 0 else 2] += 1
            if held.waiting >= CHUNK_WORDS:
                held.count()
            if len(held.book) >= HELD_WORDS:
                yield held.flush()
        yield held.flush()

    return run


def frequent_filter(words: DataFrame, support: int) -> np.ndarray:
    """Bits by id of the words in ``support`` blocks at least: no other word can have an edge.

    A word that shares a bit with a frequent one is counted in vain and dropped later.
    """
    return bitmap_of(words.where((F.col("word") != "") & (F.col("n") >= support)), "id", FILTER_BITS)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


#: Numbers that fill few bytes stand side by side, and a task's rows come by source: what is shuffled then compresses best.
_PAIR_COUNTS = "near bigint, code bigint, mask bigint, source bigint"


def pair_codes(n: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, mask): ``n`` above 6 bits, which have the place of a mask's only bit; such a mask is 0 then."""
    one = np.bitwise_count(mask) == 1
    place = np.where(one, np.bitwise_count(mask - one.astype(np.uint64)), 63).astype(np.int64)
    return n << 6 | place, np.where(one, np.uint64(0), mask).view(np.int64)


def _coded(counts):
    """``counts``, a function that gives batches of (source, near, n, mask), with these in the form of :func:`pair_codes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in counts(batches):
            source, near, n, mask = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            code, rest = pair_codes(n, mask.view(np.uint64))
            yield pa.record_batch([pa.array(c) for c in (near, code, rest, source)], names=["near", "code", "mask", "source"])

    return run


def _decoded(coded: DataFrame) -> DataFrame:
    """(source, near, n, mask) of pairs in the form of :func:`pair_codes`."""
    mask = F.expr("if(mask = 0, shiftleft(1L, cast(code & 63 as int)), mask)")
    return coded.select("source", "near", F.shiftright("code", 6).alias("n"), mask.alias("mask"))


def least_counts(words: DataFrame, support: int) -> np.ndarray:
    """By the low bits of an id, the step of the least ``n`` of the words that share them, of those in ``support`` blocks at least."""
    slot = F.col("id").bitwiseAND(F.lit((1 << LEAST_BITS) - 1).cast("bigint")).cast("int")
    step = F.least(F.floor(2 * F.log2("n")), F.lit(LEAST_STEPS - 1)).cast("tinyint")
    held = words.where((F.col("word") != "") & (F.col("n") >= support)).groupBy(slot.alias("slot")).agg(F.min(step).alias("step")).toArrow()
    out = np.zeros(1 << LEAST_BITS, np.uint8)
    out[held["slot"].to_numpy()] = held["step"].to_numpy()
    return out


class PairCells:
    """The cell of a pair in a sketch, and the class in NEEDS of the blocks that it needs to be an edge.

    What chance would give is at least the product of the source's count, which is known, the least count that the near
    word may have, and ``meet``. The near word is also in no fewer blocks than the pair.
    """

    def __init__(self, sources: Mapping[str, Mapping[str, int]], meet: Mapping[str, float], steps: np.ndarray, support: int, least: float) -> None:
        known = sorted((word_id(lang, w), n * meet[lang]) for lang, own in sources.items() for w, n in own.items())
        self.ids, self.steps = np.array([i for i, _ in known], np.int64), steps
        share = np.array([x for _, x in known], np.float64)[:, None]
        floor = 2.0 ** (np.arange(LEAST_STEPS) / 2)[None, :] * (1 - 1e-9)
        self.needs = np.full((len(known), LEAST_STEPS), -1, np.int8)
        for n in NEEDS - 1:
            chance = np.maximum(share * np.maximum(floor, n), 1e-300)
            with np.errstate(divide="ignore"):
                ratio = n * np.log(np.maximum(n, 1e-300) / chance) - (n - chance)
            self.needs += ~((n >= support) & (n >= 2 * chance * (1 - 1e-9)) & (ratio >= least - 1e-6))

    def __getstate__(self) -> tuple:
        """Packed, as each scan sends it to every worker by way of their disks."""
        return self.ids, self.needs.shape, *[pa.compress(x.tobytes(), "zstd", asbytes=True) for x in (self.needs, self.steps)], len(self.steps)

    def __setstate__(self, state: tuple) -> None:
        self.ids, shape, needs, steps, size = state
        self.needs = np.frombuffer(pa.decompress(needs, shape[0] * shape[1], "zstd", asbytes=True), np.int8).reshape(shape)
        self.steps = np.frombuffer(pa.decompress(steps, size, "zstd", asbytes=True), np.uint8)

    def keys(self, ids: np.ndarray):
        """A function of the numbers of sources and near words that gives cell and class in one number."""
        own = ids.view(np.uint64)
        left_mix, right_mix = own * np.uint64(0x9E3779B97F4A7C15), own * np.uint64(0xC2B2AE3D27D4EB4F)
        row = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        step = self.steps[ids & (len(self.steps) - 1)]

        def of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            mixed = left_mix[left] ^ right_mix[right]
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            return (mixed >> np.uint64(64 - CELL_BITS)).astype(np.int64) << 4 | self.needs[row[left], step[right]]

        return of


_CELLS = "region int, entries int, packed binary"
_SKETCH = "region int, passing binary, used binary"


def pack_cells(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Ordered keys with their counts, region by region: steps from key to key in two bytes (a longer one has entries of no count), then counts."""
    width = REGION_BITS + 4
    regions, starts = np.unique(keys >> width, return_index=True)
    rows = []
    for region, a, b in zip(regions.tolist(), starts, np.append(starts[1:], len(keys))):
        steps = np.diff(keys[a:b], prepend=region << width)
        ends = np.cumsum(steps // 0xFFFF + 1)
        gaps, held = np.full(ends[-1], 0xFFFF, np.uint16), np.zeros(ends[-1], np.uint32)
        gaps[ends - 1], held[ends - 1] = steps % 0xFFFF, counts[a:b]
        rows.append((region, len(gaps), pa.compress(gaps.tobytes() + held.tobytes(), "zstd", asbytes=True)))
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.record_batch(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["region", "entries", "packed"]
    )


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, passing, used): bits of the cells in which the pairs of some class come to what it needs, and used cells by class; rows come by region."""
    at, tables, waiting = None, [], 0

    def add_up() -> None:
        nonlocal waiting
        tables[:] = [_summed(tables)]
        waiting = 0

    def out() -> pa.RecordBatch:
        add_up()
        key, n, _ = tables[0]
        bits = np.zeros(1 << REGION_BITS, bool)
        bits[(key[n >= NEEDS[key & 15]] >> 4)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        used = np.bincount(key & 15, minlength=len(NEEDS)).astype(np.int64).tobytes()
        tables.clear()
        return pa.record_batch([pa.array([at], pa.int32()), pa.array([packed], pa.binary()), pa.array([used], pa.binary())], names=["region", "passing", "used"])

    for batch in batches:
        for region, n, packed in zip(*[c.to_pylist() for c in batch.columns]):
            if region != at and at is not None:
                yield out()
            at = region
            whole = pa.decompress(packed, n * 6, "zstd", asbytes=True)
            key, held = np.cumsum(np.frombuffer(whole, np.uint16, n), dtype=np.int64), np.frombuffer(whole, np.uint32, n, 2 * n)
            real = held > 0
            tables.append((key[real], held[real].astype(np.int64), np.zeros(int(real.sum()), np.uint8)))
            waiting += n
            if waiting >= max(HELD_PAIRS, len(tables[0][0])):
                add_up()
    if at is not None:
        yield out()


def _read_sketch(sketch: DataFrame) -> tuple[bytes, int]:
    """(packed bits of the cells that have a pair which may be an edge, different pairs), the latter by the share of used cells of each class."""
    rows = sketch.toArrow()
    bits, used = np.zeros(1 << CELL_BITS - 3, np.uint8), np.zeros(len(NEEDS), np.int64)
    size = 1 << REGION_BITS - 3
    for region, own, cells in zip(*[rows[c].to_pylist() for c in ("region", "passing", "used")]):
        bits[region * size : (region + 1) * size] = np.frombuffer(own, np.uint8)
        used += np.frombuffer(cells, np.int64)
    cells = 1 << CELL_BITS
    return pa.compress(bits.tobytes(), "zstd", asbytes=True), round(-cells * float(np.log1p(-np.minimum(used, cells - 1) / cells).sum()))


def _listed(
    sources: dict[str, frozenset[str]], usual: np.ndarray, frequent: np.ndarray, block: int, cells: PairCells | None, passing: bytes | None
):
    """What :func:`_near_words` gives; with ``cells`` but no ``passing`` the pairs' cells, as :func:`pack_cells` has them."""
    sketched = cells is not None and passing is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, parts, waiting = Book(), [], 0
        ids_of_sources = np.sort(np.array([word_id(lang, w) for lang, own in sources.items() for w in own], np.int64))
        tables: list[tuple[np.ndarray, ...]] = []
        may_pass = None if passing is None else np.frombuffer(pa.decompress(passing, 1 << CELL_BITS - 3, "zstd", asbytes=True), np.uint8)

        def add() -> None:
            nonlocal parts, waiting
            if not parts:
                return
            ids = book.id_array()
            is_near = has_bit(frequent, ids) & ~_among(ids, usual)
            is_source = _among(ids, ids_of_sources)
            numbers, blocks = _in_blocks(parts, block)
            bits = context_bits(ids[numbers], blocks)
            at = _last_of_each(numbers, blocks, len(ids))
            own = at[is_source[numbers[at]]]
            near = at[is_near[numbers[at]]]
            first = np.searchsorted(blocks[near], blocks[own], "left")
            each = np.searchsorted(blocks[near], blocks[own], "right") - first
            upto = np.cumsum(each)
            keys = cells.keys(ids) if cells is not None else None
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LISTED_PAIRS, "right")))
                n = each[a:b]
                other = near[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)]
                left, right = np.repeat(numbers[own[a:b]], n), numbers[other]
                taken = left != right
                if sketched:
                    key = keys(left[taken], right[taken])
                    tables.append(_summed([(key, np.ones(len(key), np.int64), np.zeros(len(key), np.uint8))]))
                else:
                    if keys is not None:
                        taken &= has_bit(may_pass, keys(left, right) >> 4)
                    key = (left * HELD_LIMIT + right)[taken]
                    tables.append(_summed([(key, np.ones(len(key), np.int64), bits[other][taken])]))
                a = b
            if sum(len(t[0]) for t in tables[1:]) >= HELD_PAIRS // 2:
                tables[:] = [_summed(tables)]
            parts, waiting = [], 0

        def flush() -> pa.RecordBatch:
            add()
            key, n, mask = _summed(tables) if tables else (_NO_IDS, _NO_IDS, _NO_IDS)
            if sketched:
                tables.clear()
                return pack_cells(key, n)
            ids = book.id_array()
            columns = [ids[key // HELD_LIMIT], ids[key % HELD_LIMIT], n, mask.view(np.int64)]
            tables.clear()
            return pa.record_batch([pa.array(c) for c in columns], names=["source", "near", "n", "mask"])

        for lang, text in _rows(batches):
            wanted = sources.get(lang)
            if not wanted:
                continue
            for words in _parts(text, block):
                if wanted.isdisjoint(words):
                    continue
                own = book.language(lang)
                for a in range(0, len(words), block):
                    some = words[a : a + block]
                    if not wanted.isdisjoint(some):
                        parts.append(_numbers(some, own))
                        waiting += len(some)
                if waiting >= CHUNK_WORDS:
                    add()
                if len(book) >= HELD_WORDS or sum(len(t[0]) for t in tables) >= HELD_PAIRS:
                    yield flush()
                    book = Book()
        yield flush()

    return run


def _near_words(
    sources: dict[str, frozenset[str]],
    usual: np.ndarray,
    frequent: np.ndarray,
    block: int,
    cells: PairCells | None = None,
    passing: bytes | None = None,
):
    """(source, near, n, mask): ids of words, the blocks that have both, and contexts of the second in them.

    ``sources`` has words by language. ``usual`` are ordered ids of words that are near to none. With ``cells`` and
    ``passing`` only pairs in a cell with its bit set.
    """
    return _listed(sources, usual, frequent, block, cells, passing)


def _pair_cells(sources: dict[str, frozenset[str]], usual: np.ndarray, frequent: np.ndarray, block: int, cells: PairCells):
    """All pairs of :func:`_near_words`, as counts of their cells."""
    return _listed(sources, usual, frequent, block, cells, None)


def _scans(sources: DataFrame, words: DataFrame) -> Iterator[dict[str, dict[str, int]]]:
    """The source words of each scan with their counts, by language; one scan at least. Those of a language follow one another, so that most scans need few.

    A scan has SCAN_SOURCES words and SCAN_SHARE of pairs at most, or one word. A word
    is taken to have as many pairs as its blocks have words on average.
    """
    totals = {r["lang"]: (r["n"], r["squares"] / r["n"]) for r in words.where("word = '' and n > 0").collect()}
    most = max(SCAN_PAIRS, SCAN_SHARE * sum(n for n, _ in totals.values()))
    parts, given = max(1, -(-sources.count() // SCAN_SOURCES)), False
    for k in range(parts):
        some = sources.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).join(words.select("id", "lang", "word", "n"), "id")
        held, own = 0.0, {}
        for r in sorted(some.collect(), key=lambda r: (r["lang"], r["word"])):
            pairs = r["n"] * totals[r["lang"]][1]
            if own and held + pairs > most:
                yield own
                held, own = 0.0, {}
            held += pairs
            own.setdefault(r["lang"], {})[r["word"]] = r["n"]
        if own:
            given = True
            yield own
    if not given:
        yield {}


def _counted_pairs(
    docs: DataFrame,
    words: DataFrame,
    sources: DataFrame,
    usual: np.ndarray,
    frequent: np.ndarray,
    steps: np.ndarray,
    block: int,
    support: int,
    folder: str,
    assumed: float,
) -> tuple[DataFrame, int]:
    """((source, near, n) of all pairs that may be edges, different pairs of all) where these are ``assumed`` at least."""
    meet = {r["lang"]: r["squares"] / r["n"] / r["n"] for r in words.where("word = '' and n > 0").collect()}
    found, pairs = None, 0
    for held in _scans(sources, words):
        some = {lang: frozenset(own) for lang, own in held.items()}
        cells = PairCells(held, meet, steps, support, 3.0 + math.log(max(1.0, assumed)))
        texts = docs.select(_language(docs), "text")
        texts = texts.where(F.col("lang").isin(sorted(some))) if 0 < len(some) <= FILTERED_LANGUAGES else texts
        packed = texts.mapInArrow(freeing(_pair_cells(some, usual, frequent, block, cells)), _CELLS)
        sketch = packed.repartition("region").sortWithinPartitions("region").mapInArrow(freeing(_add_cells), _SKETCH)
        passing, n = _read_sketch(cut(sketch, "pair-cells", folder))
        pairs += n
        counted = (
            texts.mapInArrow(freeing(_coded(_near_words(some, usual, frequent, block, cells, passing))), _PAIR_COUNTS)
            .repartition("source", "near")
            .transform(_decoded)
            .groupBy("source", "near")
            .agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"))
            .select("source", "near", _contexts(F.col("n"), F.col("mask")).alias("n"))
            .where(F.col("n") >= support)
        )
        part = cut(counted, "near-words", folder)
        found = part if found is None else found.unionByName(part)
    return found, pairs


def _edges(
    docs: DataFrame,
    words: DataFrame,
    sources: DataFrame,
    usual: np.ndarray,
    frequent: np.ndarray,
    steps: np.ndarray,
    block: int,
    support: int,
    folder: str,
) -> DataFrame:
    """(source, near, weight): shifted positive pointwise mutual information with each source.

    What chance would give is taken within the language, with the words a block
    has. Kept are pairs in ``support`` contexts at least, at twice chance or more,
    whose log-likelihood ratio passes ``3 + log(pairs)``, of all pairs that occur, so
    that chance makes about as few edges in a large corpus as in a small one.
    ``sources`` (id) is a written table, read in the parts of :func:`_scans`, two scans of the texts each: the first adds
    up all pairs in the cells of a sketch, the second shuffles those whose cell has as many as they need to pass.
    A cell has no fewer than a pair in it, so none that passes is left out. The sketch also tells how many
    different pairs occur, to some 1 in 10,000. It needs a number under that beforehand; where that was too large, all is done again.
    """
    mean = F.col("squares") / F.col("n")
    listed = sources.join(words.select("id", "lang", F.col("n").alias("own")), "id").join(F.broadcast(words.where("word = '' and n > 0").select("lang", mean.alias("mean"))), "lang")
    assumed = DISTINCT_SHARE * (listed.agg(F.sum(F.col("own") * F.col("mean"))).first()[0] or 0.0)
    found, pairs = _counted_pairs(docs, words, sources, usual, frequent, steps, block, support, folder, assumed)
    if pairs < assumed:
        found, pairs = _counted_pairs(docs, words, sources, usual, frequent, steps, block, support, folder, 0.99 * pairs)
    least = 3.0 + math.log(max(1, pairs))
    totals = words.where("word = ''").select("lang", (F.col("squares") / F.col("n") / F.col("n")).alias("meet"))
    source_n = sources.join(words.select("id", F.col("n").alias("source_n")), "id").withColumnRenamed("id", "source")
    near_n = words.where((F.col("n") >= support) & (F.col("word") != "")).select(F.col("id").alias("near"), "lang", F.col("n").alias("near_n"))
    pmi = F.log(F.col("n") / F.col("expected"))
    return (
        found.join(broadcast_if_small(source_n), "source")
        .join(near_n, "near")
        .join(broadcast_if_small(totals), "lang")
        .withColumn("expected", F.col("source_n") * F.col("near_n") * F.col("meet"))
        .where((pmi > math.log(2)) & (F.col("n") * pmi - (F.col("n") - F.col("expected")) >= least))
        .select("source", "near", pmi.alias("weight"))
    )


def _scored_terms(words: DataFrame) -> DataFrame:
    """``words`` in 3 labelled documents or more, with ``t`` toxic and ``c`` clean ones, ``rate``, ``ratio`` and ``least``, all by language."""
    totals = words.where("word = '' and toxic > 0 and clean > 0").select(
        "lang", (F.col("toxic") / (F.col("toxic") + F.col("clean"))).alias("rate")
    )
    t = F.least(F.col("toxic").cast("double"), _contexts(F.col("toxic"), F.col("mask")))
    c, rate = F.col("clean").cast("double"), F.col("rate")
    part = lambda x, r: F.when(x > 0, x * F.log(x / ((F.col("t") + c) * r))).otherwise(0.0)
    enough = words.where("word <> '' and toxic + clean >= 3")
    tried = enough.groupBy("lang").agg((3.0 + F.log(F.count("*"))).alias("least"))
    return (
        enough.join(broadcast_if_small(totals), "lang")
        .join(broadcast_if_small(tried), "lang")
        .withColumn("t", t)
        .withColumn("c", c)
        .withColumn("ratio", part(F.col("t"), rate) + part(c, 1 - rate))
    )


def _toxic_terms(scored: DataFrame) -> list[tuple[str, str, int]]:
    """All that pass; no more than the labelled sample has words."""
    up = scored.where("t >= 3 and t >= 0.8 * (t + c) and ratio >= least")
    return [(r["lang"], r["word"], r["n"]) for r in up.select("lang", "word", "n").collect()]


def _lent_terms(words: DataFrame, able: set[str]) -> list[tuple[str, str, int]]:
    """Toxic terms of all languages together, for each language but ``able`` that has them and whose own labels don't object."""
    languages = {r["lang"] for r in words.where("word = ''").select("lang").collect()}
    if len(languages) < 2 or languages <= able:
        return []
    sums = [F.sum(c).alias(c) for c in ("n", "clean", "toxic")]
    pooled = words.where("toxic + clean > 0").groupBy("word").agg(*sums, F.bit_or("mask").alias("mask")).withColumn("lang", F.lit(""))
    terms = [w for _, w, _ in _toxic_terms(_scored_terms(pooled))]
    if not terms:
        return []
    unable = words.sparkSession.createDataFrame([(x,) for x in sorted(languages - able)], "lang string")
    lent = words.where(F.col("word").isin(terms) & (F.col("toxic") >= 4 * F.col("clean"))).join(broadcast_if_small(unable), "lang")
    return [(r["lang"], r["word"], r["n"]) for r in lent.select("lang", "word", "n").collect()]


def seed_terms(words: DataFrame) -> dict[tuple[str, str], int]:
    """{(language, term): 1 toxic or -1 clean}, by the labelled documents that have the term.

    The test is the log-likelihood ratio against the language's share of toxic
    documents. Toxic seeds pass ``3 + log(the language's terms)``, and 80 % of
    their documents are toxic; clean seeds are as many terms, those furthest under the share
    and no more frequent than the toxic ones. A language in which no term passes,
    for want of labels, takes the terms that pass over all languages together.
    """
    scored = _scored_terms(words)
    rows = _toxic_terms(scored)
    rows += _lent_terms(words, {lang for lang, _, _ in rows})
    if not rows:
        return {}
    most: dict[str, tuple[int, int]] = {}
    for lang, _, n in rows:
        most[lang] = (max(most.get(lang, (0, 0))[0], n), most.get(lang, (0, 0))[1] + 1)
    limit = words.sparkSession.createDataFrame([(k, *v) for k, v in sorted(most.items())], "lang string, most bigint, seeds int")
    order = Window.partitionBy("lang").orderBy(F.desc("ratio"), "word")
    down = (
        scored.where("t < rate / 2 * (t + c)")
        .join(broadcast_if_small(limit), "lang")
        .where("n <= most")
        .withColumn("nth", F.row_number().over(order))
        .where("nth <= seeds")
    )
    return {(lang, word): 1 for lang, word, _ in rows} | {(r["lang"], r["word"]): -1 for r in down.select("lang", "word").collect()}


def _common_words(words: DataFrame) -> np.ndarray:
    """Ordered ids of the words in over half of a language's blocks: none of them can be near a word at twice chance.

    There are at most two blocks' words of these in a language.
    """
    totals = words.where("word = ''").select("lang", (F.col("squares") / F.col("n") / F.col("n")).alias("meet"))
    found = words.where("word <> ''").join(broadcast_if_small(totals), "lang").where("n * meet > 0.5").select("id").toArrow()
    return np.sort(found["id"].to_numpy())


def _walk(graph: DataFrame, seeds: DataFrame, steps: int, restart: float, folder: str) -> DataFrame:
    """(lang, id, p, q, up): masses of the walks from toxic and clean seeds after ``steps`` steps."""
    shares = cut(
        graph.join(graph.groupBy("a").agg(F.sum("weight").alias("all")), "a").select(
            "a", "b", (F.col("weight") / F.col("all")).alias("share")
        ),
        "walk",
        folder,
    )
    kinds = seeds.groupBy("lang").agg(
        F.sum(F.when(F.col("kind") > 0, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("kind") < 0, 1).otherwise(0)).alias("down")
    )
    start = cut(
        seeds.join(kinds, "lang").select(
            "lang",
            "id",
            F.when(F.col("kind") > 0, 1 / F.col("up")).otherwise(0.0).alias("p"),
            F.when(F.col("kind") < 0, 1 / F.col("down")).otherwise(0.0).alias("q"),
        ),
        "seeds",
        folder,
    )
    at = start
    for _ in range(steps):
        moved = at.withColumnRenamed("id", "a").join(shares, "a").select(
            "lang", F.col("b").alias("id"), *[((1 - restart) * F.col(x) * F.col("share")).alias(x) for x in ("p", "q")]
        )
        back = start.select("lang", "id", *[(restart * F.col(x)).alias(x) for x in ("p", "q")])
        at = moved.unionByName(back).groupBy("lang", "id").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return at.join(broadcast_if_small(kinds), "lang")


def induce_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    seeds: Mapping[tuple[str, str], int] | None = None,
    label_rows: int = 20_000,
    block: int = 256,
    support: int = 3,
    steps: int = 4,
    restart: float = 0.2,
    rings: int | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """((lang, word, polarity), labelled sample): polarity weights from walks over the word graph.

    Every text is counted. Nodes are the words of a language; an edge is the
    shifted positive pointwise mutual information of two words in blocks of
    ``block`` words. Repeats of a passage count once, by their contexts. Rows of
    the graph are made for the seeds of both kinds, then, ring by ring, for all
    words that they reach: ``rings`` of them, each a scan of the texts or more, beyond
    which words have only the edges back. None is as many as ``steps``: every word that
    a walk leaves has its row then. Two walks of ``steps`` steps that restart at the
    toxic or the clean seeds leave masses ``p`` and ``q`` at each word; its
    polarity is ``(p - q) / (p + q + e)``, with ``e`` a tenth of the restart mass
    of a toxic seed.
    """
    sample = _label_sample(docs, labels, label_rows)
    spark = docs.sparkSession
    with scratch(spark) as folder:
        known = docs.select(F.col("doc_id").cast("string").alias("labelled_id"), _language(docs), "text")
        known = known.join(_sample_rows(spark, sample), "labelled_id", "left").select("kind", "lang", "text")
        counted = known.mapInArrow(freeing(_count_words(block)), _WORD_COUNTS)
        sums = [F.sum(c).alias(c) for c in ("n", "squares", "clean", "toxic")]
        words = cut(
            counted.groupBy("lang", "word").agg(*sums, F.bit_or("mask").alias("mask")).select(_id_column().alias("id"), "*"), "words", folder
        )
        found = dict(seeds) if seeds is not None else seed_terms(words)
        if not any(s > 0 for s in found.values()):
            return spark.createDataFrame([], "lang string, word string, polarity double"), sample
        usual, frequent, least = _common_words(words), frequent_filter(words, support), least_counts(words, support)
        seed_rows = cut(
            spark.createDataFrame([(word_id(*k), k[0], s) for k, s in sorted(found.items())], "id bigint, lang string, kind int"), "seed-rows", folder
        )
        edges, done = None, seed_rows.select("id")
        fresh = done
        rings = steps if rings is None else rings
        for ring in range(rings):
            with scratch(spark) as within:
                own = cut(_edges(docs, words, fresh, usual, frequent, least, block, support, within), f"edges-{ring}", folder)
            edges = own if edges is None else edges.unionByName(own)
            if ring + 1 < rings:
                fresh = cut(own.select(F.col("near").alias("id")).distinct().join(done, "id", "left_anti"), f"ring-{ring}", folder)
                if fresh.isEmpty():
                    break
                done = done.unionByName(fresh)
        both = edges.select(F.col("source").alias("a"), F.col("near").alias("b"), "weight").unionByName(
            edges.select(F.col("near").alias("a"), F.col("source").alias("b"), "weight")
        )
        graph = cut(both.groupBy("a", "b").agg(F.max("weight").alias("weight")), "graph", folder)
        least = F.greatest(F.col("up"), F.lit(1))
        polarity = (F.col("p") - F.col("q")) / (F.col("p") + F.col("q") + 0.1 * restart / least)
        masses = _walk(graph, seed_rows, steps, restart, folder).select("id", F.round(polarity, 6).alias("polarity"))
        lexicon = cut(masses.join(words.where("word <> ''").select("id", "lang", "word"), "id").select("lang", "word", "polarity"), "lexicon")
    return lexicon, sample


def _hits_column(weights: dict[str, dict[str, int]], language: Column) -> Column:
    """The lexicon words of a text: place and weight of each in one number, in order of place."""

    @F.pandas_udf("array<bigint>")
    def hits(texts: pd.Series, languages: pd.Series) -> pd.Series:
        out = []
        for text, lang in zip(texts, languages):
            own, found, before = weights.get(lang), [], 0
            for piece in word_pieces(text) if own else ():
                get = own.get
                found += [before + i << 32 | w + (1 << 31) for i, w in enumerate(map(get, piece)) if w is not None]
                before += len(piece)
            out.append(found)
        return pd.Series(out, dtype="object")

    return hits(F.col("text"), language)


def _worst_passage(hits: Column) -> Column:
    """The largest sum of weights over any run of words; 0 where none is above."""
    zero = F.struct(F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("best"))

    def step(held: Column, hit: Column) -> Column:
        run = F.greatest(F.lit(0).cast("bigint"), held["run"] + hit.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31))
        return F.struct(run.alias("run"), F.greatest(held["best"], run).alias("best"))

    return F.aggregate(hits, zero, step)["best"]


def _slices(lexicon: DataFrame) -> Iterator[dict[str, dict[str, int]]]:
    """Weights of the strong words by language, at most about HELD_LEXICON words at a time."""
    used = lexicon.where(F.abs("polarity") >= LEAST_POLARITY)
    n = max(1, -(-used.count() // HELD_LEXICON))
    for k in range(n):
        held = used.where(F.pmod(_id_column(), F.lit(n)) == k).toArrow()
        weights: dict[str, dict[str, int]] = {}
        for lang, word, polarity in zip(*[held[c].to_pylist() for c in ("lang", "word", "polarity")]):
            weights.setdefault(lang, {})[word] = round(polarity * UNIT)
        yield weights


def score_documents(docs: DataFrame, lexicon: DataFrame, toxicity: str = "toxicity") -> DataFrame:
    """``docs`` with the toxicity of their worst passages: the largest sum of polarities over any run of words.

    Words of either sign count, so clean words end a passage; a text without
    toxic words has 0, however long it is. Only words above half of the full polarity count. Sums are of
    whole millionths, so the number of passes over the lexicon doesn't matter. A column named ``toxicity`` is replaced.
    """
    parts = [_hits_column(weights, _language(docs)) for weights in _slices(lexicon)]
    hits = parts[0] if len(parts) == 1 else F.array_sort(F.concat(*parts))
    return docs.withColumn(toxicity, _worst_passage(hits) / F.lit(float(UNIT)))


def fit_threshold(scores: Sequence[tuple[float, int]], default: float = 1.0) -> float:
    """The score from which a text is toxic: the middle of the gap with the best F1 on labelled scores."""
    ordered = sorted(scores, reverse=True)
    toxic = sum(k > 0 for _, k in ordered)
    if not toxic or toxic == len(ordered):
        return default
    best, threshold, hits = 0.0, default, 0
    for i, (score, kind) in enumerate(ordered):
        hits += kind > 0
        following = ordered[i + 1][0] if i + 1 < len(ordered) else 0.0
        f1 = 2 * hits / (i + 1 + toxic)
        if following < score and f1 > best + 1e-12 and score > 0:
            best, threshold = f1, (score + max(following, 0.0)) / 2
    return threshold


def _fitted(docs: DataFrame, labels: DataFrame, options: dict) -> tuple[DataFrame, float]:
    lexicon, sample = induce_lexicon(docs, labels, **options)
    labelled = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("labelled_id"), _language(docs), "text")
    scored = score_documents(labelled.join(_sample_rows(docs.sparkSession, sample), "labelled_id"), lexicon)
    return lexicon, _threshold(scored)


def _threshold(scored: DataFrame) -> float:
    return fit_threshold([(r["toxicity"], r["kind"]) for r in scored.select("toxicity", "kind").collect()])


def toxic_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, toxicity, threshold, toxic): the documents whose score reaches the threshold; toxic is true.

    The lexicon comes from :func:`induce_lexicon`; a document's toxicity is that
    of its worst passage, see :func:`score_documents`. The threshold fits
    the labelled sample of at most ``label_rows`` documents a language, of which
    the scores come to the driver. Without labels of both kinds, or seeds, nothing is toxic.

    Null and empty texts score 0 and are never toxic. Repeated rows are judged
    each. An id may be of any type and stays as it is; it meets the labels by its text. A null
    doc_id is judged too, but is in no sample. A null language is one of its own.
    Columns other than doc_id, lang and text are not read. An empty table gives no rows.
    """
    lexicon, sample = induce_lexicon(docs, labels, **options)
    every = score_documents(docs.where("text is not null").select("doc_id", _language(docs), "text"), lexicon)
    scores = cut(every.select("doc_id", "toxicity"), "toxicity-scores")
    known = scores.withColumn("labelled_id", F.col("doc_id").cast("string")).join(_sample_rows(docs.sparkSession, sample), "labelled_id")
    threshold = _threshold(known)
    return scores.where(F.col("toxicity") >= threshold).select(
        "doc_id", "toxicity", F.lit(threshold).alias("threshold"), F.lit(True).alias("toxic")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those of :func:`toxic_documents`, columns as they were; the texts are not shuffled.

    Null and empty texts stay, so do all rows where no seed is found; repeated
    rows stay or go together, as their texts are the same. An empty table stays empty. Columns
    may have any names.
    """
    small_batches(docs.sparkSession)
    lexicon, threshold = _fitted(docs, labels, options)
    score = free_name(docs, "toxicity")
    return score_documents(docs, lexicon, score).where(F.col(score) < threshold).drop(score)
