"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import bitmap_of, cut, freeing, may_be_among, scratch, small_batches, type_of, words_of
from loomtext.llm.groups import components

BITS = 128
#: Buckets of the document-frequency table; its size is the same for any corpus.
DF_BUCKETS = 1 << 16
CHUNK_CHARS = 2_000_000
#: Bits of the filter of documents that go; its size is the same for any corpus.
GONE_BITS = 1 << 26


def _bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & (DF_BUCKETS - 1)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_CHARS characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _coded(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of some texts, and for each text the places of its own."""
    place: dict[str, int] = {}
    own = [
        np.fromiter((place.setdefault(w, len(place)) for w in set(words_of(t))), dtype=np.int64)
        for t in texts
    ]
    return list(place), own


def _count_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros(DF_BUCKETS, dtype=np.int64), 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in _chunks(texts):
            words, own = _coded(texts[a:b])
            if words:
                bucket = np.fromiter(map(_bucket, words), dtype=np.int64, count=len(words))
                counts += np.bincount(bucket[np.concatenate(own)], minlength=DF_BUCKETS)
            docs += sum(len(x) > 0 for x in own)
    used = np.flatnonzero(counts)
    yield pa.record_batch(
        [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(counts[used], docs), pa.int64())],
        names=["bucket", "n"],
    )


def document_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by hash bucket of the word, from every text.

    At most DF_BUCKETS + 1 sums reach the driver. Words that share a bucket
    share a weight; only frequent words stand out from the others.
    """
    rows = (
        docs.select("text")
        .mapInArrow(freeing(_count_frequencies), "bucket int, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    found, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    total = int(n[found == -1].sum()) if len(found) else 0
    df = np.zeros(DF_BUCKETS)
    df[found[found >= 0]] = n[found >= 0]
    return np.log1p(max(total, 1) / np.maximum(df, 1.0)).astype(np.float32) - np.float32(np.log(2) * 0.99)


def fingerprint_texts(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, words) of each text: sign of the weighted sum of its distinct words' hash signs."""
    high, low = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    n_words = np.zeros(len(texts), np.int64)
    for a, b in _chunks(texts):
        words, own = _coded(texts[a:b])
        if not words:
            continue
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint8).reshape(-1, 16)
        signs = np.unpackbits(digests, axis=1).astype(np.float32)
        signs *= 2
        signs -= 1
        signs *= weights[np.fromiter(map(_bucket, words), np.int64, len(words))][:, None]
        for i, places in enumerate(own, a):
            if len(places):
                # whole-number sums don't depend on the order of the words
                total = np.rint(signs[np.sort(places)] * 4096).sum(axis=0, dtype=np.float64)
                packed = np.packbits(total > 0).view(">i8")
                high[i], low[i], n_words[i] = packed[0], packed[1], len(places)
    return high, low, n_words


def fingerprints(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, high, low) of the documents that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, n = fingerprint_texts(batch.column(1).to_pylist(), weights)
            kept = pa.array(n > 0)
            yield pa.record_batch(
                [batch.column(0).filter(kept), pa.array(high).filter(kept), pa.array(low).filter(kept)],
                names=["doc_id", "high", "low"],
            )

    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {type_of(docs, 'doc_id')}, high bigint, low bigint")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, counted from the low end."""
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _flipped(value: Column, width: int) -> Column:
    """``value`` and the values that differ from it in one of the ``width`` low bits."""
    flips = F.array(*[F.lit(x).cast("bigint") for x in [0, *(1 << j for j in range(width))]])
    return F.transform(flips, lambda x: value.bitwiseXOR(x))


def _ball_keys(prints: DataFrame, start: int, width: int) -> DataFrame:
    """(key, high, low): a table entry for each point of the ball of radius 1 in the segment of ``width`` bits from ``start``."""
    if start >= 64:
        value = F.shiftrightunsigned("high", start - 64)
    elif start + width <= 64:
        value = F.shiftrightunsigned("low", start)
    else:
        value = F.shiftrightunsigned("low", start).bitwiseOR(F.shiftleft("high", 64 - start))
    value = value.bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    return prints.select(F.explode(_flipped(value, width)).alias("key"), "high", "low")


def _forest(high: np.ndarray, low: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what pairs within the radius join; each point of a run is compared until it is reached."""
    edges, open_ = [], np.arange(len(high))
    while len(open_) > 1:
        frontier, open_ = [open_[0]], open_[1:]
        while frontier and len(open_):
            x = frontier.pop()
            near = (np.bitwise_count(high[open_] ^ high[x]) + np.bitwise_count(low[open_] ^ low[x])) <= radius
            if near.any():
                found = open_[near]
                edges.extend((x, y) for y in found)
                frontier.extend(found)
                open_ = open_[~near]
    return edges


def _match(radius: int):
    """Table matches of sorted keys with their complete distances verified; runs may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def edges(key, high, low):
            out: list[np.ndarray] = []
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(key))
            size = ends - starts
            two = starts[size == 2]
            near = (np.bitwise_count(high[two] ^ high[two + 1]) + np.bitwise_count(low[two] ^ low[two + 1])) <= radius
            if near.any():
                out.append(np.stack([two[near], two[near] + 1], axis=1))
            for a, b in zip(starts[size > 2], ends[size > 2]):
                found = _forest(high[a:b], low[a:b], radius)
                if found:
                    out.append(np.array(found) + a)
            pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            pairs.sort(axis=1)
            columns = [high[pairs[:, 0]], low[pairs[:, 0]], high[pairs[:, 1]], low[pairs[:, 1]]]
            unique = np.unique(np.stack(columns), axis=1) if len(pairs) else np.zeros((4, 0), np.uint64)
            return pa.record_batch(
                [pa.array(c.view(np.int64)) for c in np.ascontiguousarray(unique)], names=["high_a", "low_a", "high_b", "low_b"]
            )

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns[1:] = [c.view(np.uint64) for c in columns[1:]]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            last = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            if last:
                yield edges(*[c[:last] for c in columns])
            rest = [c[last:] for c in columns]
        if rest is not None and len(rest[0]):
            yield edges(*rest)

    return run


def near_duplicates(docs: DataFrame, segments: int = 6) -> DataFrame:
    """(doc_id, kept_id): each document of a group of near-duplicates but the one that stays.

    A text is the set of its lower-case words; each word counts by its inverse
    document frequency. Fingerprints of 128 bits are cut into ``segments``; each
    is entered in its segments' tables under every value at distance 0 or 1.
    Two fingerprints within ``3 * segments - 1`` bits differ by at most 2 bits in
    some segment, so their balls of radius 1 meet there: every such pair is
    found, and no other passes the check of the complete distance. Groups are
    the connected components; the least doc_id of a group stays.

    Words are runs of letters, so a text without blanks between words has one a run of its
    script and meets only texts that repeat its runs. A document without words (null, empty, marks or digits only) is no one's
    duplicate. An id may be of any type with an order. Repeated rows with one doc_id count as one document. A null
    doc_id can't be named and is not compared. Texts of the same words, in any
    order or case, have one fingerprint. Other columns are not read. An empty
    table gives no rows.
    """
    docs = docs.where("doc_id is not null")
    with scratch(docs.sparkSession) as folder:
        prints = cut(fingerprints(docs, document_weights(docs)), "fingerprints")
        distinct = cut(prints.groupBy("high", "low").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
        near = None
        for start, width in segment_bounds(segments):
            # one table at a time: its shuffle files go before the next one's are written
            sorted_keys = _ball_keys(distinct, start, width).repartition("key").sortWithinPartitions("key")
            met = sorted_keys.mapInArrow(freeing(_match(3 * segments - 1)), "high_a bigint, low_a bigint, high_b bigint, low_b bigint")
            part = cut(met, "near-fingerprints", folder)
            near = part if near is None else near.unionByName(part)
        near = near.distinct()
        side = lambda x: distinct.select(F.col("high").alias(f"high_{x}"), F.col("low").alias(f"low_{x}"), F.col("first").alias(x))
        edges = cut(near.join(side("a"), ["high_a", "low_a"]).join(side("b"), ["high_b", "low_b"]).select("a", "b"), "near-pairs", folder)
        roots = cut(components(edges, folder), "roots")
    return (
        prints.join(distinct, ["high", "low"])
        .join(roots, F.col("first") == roots["node"], "left")
        .select("doc_id", F.coalesce("root", "first").alias("kept_id"))
        .where("doc_id <> kept_id")
        .distinct()
    )


def drop_near_duplicates(docs: DataFrame, segments: int = 6) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of the least doc_id.

    Columns are as they were and may have any names. Rows that share a doc_id are one document: they
    stay or go together. A row without a doc_id stays. Only rows that a bitmap of fixed size
    can't tell from duplicates are shuffled. Other cases as in :func:`near_duplicates`.
    """
    small_batches(docs.sparkSession)
    gone = cut(near_duplicates(docs, segments).select(F.col("doc_id").alias("id")), "gone-documents")
    may = may_be_among(docs.sparkSession, bitmap_of(gone.select(F.xxhash64("id").alias("hash")), "hash", GONE_BITS))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = f"c{docs.columns.index('doc_id')}"
    marked = docs.toDF(*names).withColumn("may", may(F.xxhash64(own)))
    held = marked.where("may").join(gone, F.col(own) == F.col("id"), "left_anti")
    return marked.where("not may").select(*names).unionByName(held.select(*names)).toDF(*docs.columns)
