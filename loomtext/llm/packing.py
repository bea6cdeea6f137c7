"""Best-fit packing with the linear grouping scheme."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import broadcast_if_small, cut, hash60, type_of
from loomtext.llm.mixing import HASH_BITS, word_count

#: Items that one best-fit task takes, about; a bin's leftover room is only offered within its task.
CELL_ITEMS = 50_000
#: Pieces of one length that are numbered in one task, about.
RANGE_PIECES = 1_000_000
#: Bin numbers of whole pieces and of bins that best-fit opens start here.
WHOLE_BINS, OPENED_BINS = 1 << 61, 1 << 62


def pieces_of(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length): a document's tokens cut at the capacity."""
    tokens = docs.select("doc_id", word_count(F.col("text")).alias("tokens")).where("tokens > 0")
    last = F.expr(f"(tokens - 1) div {capacity}")
    return tokens.select(
        "doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")
    ).select(
        "doc_id",
        "piece",
        (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece") * capacity).alias("length"),
    )


def group_sizes(counts: list[tuple[int, int]], groups: int) -> list[tuple[int, int, int]]:
    """(size, first rank, ranks) of groups of equal cardinality, largest first.

    ``counts`` has (length, pieces). Ranks run from the longest piece; a group's
    size is its longest piece.
    """
    ordered = sorted(((n, c) for n, c in counts if c), reverse=True)
    total = sum(c for _, c in ordered)
    each = -(-total // groups) if total else 0
    out, seen, i = [], 0, 0
    for start in range(0, total, each or 1):
        while seen + ordered[i][1] <= start:
            seen += ordered[i][1]
            i += 1
        out.append((ordered[i][0], start, min(each, total - start)))
    return out


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        options = np.where(fits, value + best[np.maximum(room - sizes, 0)], -1.0)
        k = int(options.argmax())
        if options[k] > best[room - 1] + 1e-12:
            best[room], take[room] = options[k], k
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            pattern[take[room]] += 1
            room -= sizes[take[room]]
    return float(best[capacity]), pattern


def configurations(demand: dict[int, int], capacity: int) -> tuple[list[int], list[tuple[list[int], int]]]:
    """(sizes, [(pattern, bins)]): a cover of the demand by few kinds of bin.

    The linear programme over all patterns is solved by column generation, with
    an exact knapsack for the column of least reduced cost; bins are rounded up,
    which costs at most one bin a size above the optimum of the programme.
    """
    sizes = sorted(demand)
    if not sizes:
        return [], []
    size = np.array(sizes, dtype=np.int64)
    basis = np.diag(capacity // size).astype(float)
    amount = np.array([demand[s] for s in sizes], dtype=float) / np.diag(basis)
    for _ in range(200 * len(size)):
        dual = np.linalg.solve(basis.T, np.ones(len(size)))
        worth, pattern = _best_pattern(size, np.maximum(dual, 0.0), capacity)
        if worth <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(direction > 1e-12, amount / np.where(direction > 1e-12, direction, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * direction, 0.0)
        amount[out] = step
        basis[:, out] = pattern
    bins = np.ceil(amount - 1e-9).astype(np.int64)
    return sizes, [(np.rint(basis[:, k]).astype(int).tolist(), int(n)) for k, n in enumerate(bins) if n]


def slots_of(sizes: list[int], found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first slot, end slot, first bin, bins): the slots that each pattern has for a size."""
    out, first_bin = [], 0
    taken = dict.fromkeys(sizes, 0)
    for pattern, bins in found:
        for size, per_bin in zip(sizes, pattern):
            if per_bin:
                end = taken[size] + per_bin * bins
                out.append((size, taken[size], end, first_bin, bins))
                taken[size] = end
        first_bin += bins
    return out


class Rooms:
    """Bins by room left; the least room that fits is one bit search away."""

    def __init__(self, capacity: int) -> None:
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, bin_: int, room: int) -> None:
        if room > 0:
            self.bins[room].append(bin_)
            self.mask |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        """(bin, room) of the fullest bin with that room; it is taken out."""
        above = self.mask >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            self.mask ^= 1 << room
        return bin_, room


def best_fit(bins: list[tuple[int, int]], lengths: list[int], capacity: int, opened_from: int) -> list[int]:
    """The bin of each item; items go longest first, ties in the order given."""
    rooms, out = Rooms(capacity), [0] * len(lengths)
    for bin_, room in bins:
        rooms.add(bin_, room)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            found = (opened_from, capacity)
            opened_from += 1
        out[i] = found[0]
        rooms.add(found[0], found[1] - lengths[i])
    return out


def _fit_cell(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        is_bin = pc.is_valid(table["room"])
        bins = table.filter(is_bin).sort_by("bin_id")
        items = table.filter(pc.invert(is_bin)).sort_by(
            [("length", "descending"), ("order", "ascending"), ("start", "ascending")]
        )
        placed = best_fit(
            list(zip(bins["bin_id"].to_pylist(), bins["room"].to_pylist())),
            items["length"].to_pylist(),
            capacity,
            OPENED_BINS + (key[0].as_py() << 32),
        )
        return items.select(["doc_id", "piece", "start", "length"]).append_column("bin_id", pa.array(placed, pa.int64()))

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, small: float = 0.125, groups: int = 12) -> DataFrame:
    """(doc_id, piece, start, length, bin_id): every token in one bin, no bin over ``capacity``.

    A document longer than a bin is cut into pieces at multiples of the
    capacity; a whole piece is a bin. Of the others, those over ``small`` of the
    capacity are ranked by length and cut into ``groups`` of equal cardinality;
    each counts as long as the longest of its group. A linear programme over the
    patterns of these few sizes says how many bins of each kind to make; ranks
    then name the slots that actual pieces take, at their actual lengths. The
    room left takes the small pieces, best fit and longest first, in cells of
    about CELL_ITEMS pieces; where none fits a bin is opened.

    Tokens are runs of anything but white space. Documents without tokens (null
    or blank text) have no row. Repeated rows are packed once each; ids may be of any type, and
    null ids are packed as any other. Pieces of one length are ranked by the hash of their id.
    Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    spark, kind = docs.sparkSession, type_of(docs, "doc_id")
    pieces = cut(pieces_of(docs, capacity).withColumn("order", hash60(F.col("doc_id"))), "pieces")
    limit = int(capacity * small)
    histogram = [(r["length"], r["count"]) for r in pieces.groupBy("length").count().collect()]
    large = [(n, c) for n, c in histogram if limit < n < capacity]
    small_count = sum(c for n, c in histogram if n <= limit)
    ranked = group_sizes(large, groups)
    demand: dict[int, int] = {}
    for size, _, n in ranked:
        demand[size] = demand.get(size, 0) + n
    sizes, found = configurations(demand, capacity)
    slots = slots_of(sizes, found)

    above, ranks = 0, []
    for n, c in sorted(large, reverse=True):
        ranks.append((n, above))
        above += c
    # at most ``capacity`` rows, and a few for each size: neither grows with the corpus
    rank_rows = F.broadcast(spark.createDataFrame(ranks, "length bigint, above bigint"))
    starts: dict[int, int] = {}
    for s, first, _ in ranked:
        starts.setdefault(s, first)
    group_rows = F.broadcast(
        spark.createDataFrame(
            [(first, first + n, s, starts[s]) for s, first, n in ranked],
            "rank_from bigint, rank_to bigint, size bigint, size_from bigint",
        )
    )
    slot_rows = F.broadcast(
        spark.createDataFrame(slots, "slot_size bigint, slot_from bigint, slot_to bigint, bin_from bigint, bins bigint")
    )
    whole = pieces.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", (F.monotonically_increasing_id() + F.lit(WHOLE_BINS)).alias("bin_id")
    )
    # pieces of one length are numbered within ranges of their hash, about RANGE_PIECES each
    bits = max(0, max((c for _, c in large), default=0) // RANGE_PIECES).bit_length()
    span = F.shiftright("order", HASH_BITS - bits)
    between = pieces.where((F.col("length") > limit) & (F.col("length") < capacity)).withColumn("span", span)
    before = Window.partitionBy("length").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = between.groupBy("length", "span").count().select("length", "span", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    in_span = Window.partitionBy("length", "span").orderBy("order", "start", "doc_id")
    placed = cut(
        between.withColumn("nth", F.row_number().over(in_span) - 1)
        .join(broadcast_if_small(spans), ["length", "span"])
        .join(rank_rows, "length")
        .withColumn("rank", F.col("above") + F.col("before") + F.col("nth"))
        .join(group_rows, (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .withColumn("slot", F.col("rank") - F.col("size_from"))
        .join(
            slot_rows,
            (F.col("size") == F.col("slot_size"))
            & (F.col("slot") >= F.col("slot_from"))
            & (F.col("slot") < F.col("slot_to")),
        )
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            (F.col("bin_from") + (F.col("slot") - F.col("slot_from")) % F.col("bins")).alias("bin_id"),
        ),
        "placed-pieces",
    )
    cells = max(1, -(-(small_count + sum(b for _, b in found)) // CELL_ITEMS))
    rooms = (
        placed.groupBy("bin_id")
        .agg((F.lit(capacity) - F.sum("length")).alias("room"))
        .where("room > 0")
        .select(
            F.pmod(F.xxhash64("bin_id"), F.lit(cells)).alias("cell"),
            F.lit(None).cast(kind).alias("doc_id"),
            *[F.lit(None).cast("bigint").alias(c) for c in ("piece", "start", "length", "order")],
            "bin_id",
            "room",
        )
    )
    items = pieces.where(F.col("length") <= limit).select(
        F.pmod(F.xxhash64("order", "start"), F.lit(cells)).alias("cell"),
        "doc_id",
        "piece",
        "start",
        "length",
        "order",
        F.lit(None).cast("bigint").alias("bin_id"),
        F.lit(None).cast("bigint").alias("room"),
    )
    fitted = (
        rooms.unionByName(items)
        .groupBy("cell")
        .applyInArrow(_fit_cell(capacity), f"doc_id {kind}, piece bigint, start bigint, length bigint, bin_id bigint")
    )
    return whole.unionByName(placed).unionByName(fitted)


def bins_used(packed: DataFrame) -> DataFrame:
    """(bin_id, pieces, tokens) of each bin."""
    return packed.groupBy("bin_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
