"""Exact top-k search by tiled matrix products, and near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import broadcast_if_small, cut, scratch, type_of
from loomtext.llm.groups import components

#: Vectors a side of one tile, and rows of it that are compared at once.
TILE_ROWS, STRIP_ROWS = 32_768, 256
#: Similarities are compared and reported in units of 1e-6.
UNIT = 1_000_000


def usable_vectors(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """((row, vec_id, embedding), rows, dimensions): the vectors that have a direction.

    Ids may be of any type with an order. Left out are null ids, null vectors, vectors with a null or an element that
    is no finite number, those of length 0, and those of another number of
    dimensions than most (the larger number where two are as frequent).
    """
    known = vectors.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    ).where(
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    numbered = cut(known.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "vectors")
    sizes = numbered.groupBy(F.size("embedding").alias("d")).count().collect()
    n, d = max(((r["count"], r["d"]) for r in sizes), default=(0, 0))
    return numbered.where(F.size("embedding") == d), n, d


def _matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    values = flat.reshape(-1, dimensions)
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _tile_top(k: int, dimensions: int):
    """The ``k`` nearest of a tile's shard for each of its queries, by (similarity, id, row)."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table["query"].to_numpy()
        queries = table.filter(pa.array(is_query))
        shard = table.filter(pa.array(~is_query)).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        shard_no = int(table["shard"][0].as_py())
        out: list[pa.Table] = []
        if len(queries) and len(shard):
            left, right = _matrix(queries["embedding"], dimensions), _matrix(shard["embedding"], dimensions).T
            rows, own_rows = shard["row"].to_numpy(), queries["row"].to_numpy()
            order = np.arange(len(rows))
            for a in range(0, len(left), STRIP_ROWS):
                b = min(a + STRIP_ROWS, len(left))
                units = np.rint(left[a:b] @ right * UNIT).astype(np.int64)
                units <<= 21
                units -= order
                units[own_rows[a:b, None] == rows[None, :]] = np.iinfo(np.int64).min
                take = min(k, len(rows))
                best = np.argpartition(units, len(rows) - take, axis=1)[:, len(rows) - take :]
                value = np.take_along_axis(units, best, axis=1)
                kept = value > np.iinfo(np.int64).min
                where = np.broadcast_to(np.arange(a, b)[:, None], best.shape)[kept]
                place = best[kept]
                out.append(
                    pa.table(
                        {
                            "row": own_rows[where],
                            "vec_id": queries["vec_id"].take(pa.array(where)),
                            "shard": np.full(len(where), shard_no, np.int32),
                            "units": (value[kept] + place) >> 21,
                            "neighbor": shard["vec_id"].take(pa.array(place)),
                            "neighbor_row": rows[place],
                        }
                    )
                )
        if out:
            return pa.concat_tables(out)
        kind = table.schema.field("vec_id").type
        kinds = {"row": pa.int64(), "vec_id": kind, "shard": pa.int32(), "units": pa.int64(), "neighbor": kind, "neighbor_row": pa.int64()}
        return pa.table({c: pa.array([], t) for c, t in kinds.items()})

    return run


def exact_top_k(vectors: DataFrame, k: int = 10, fan_in: int = 8, asked: Column | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, similarity): the ``k`` nearest others of the queries, by cosine.

    Queries are the vectors for which ``asked`` (a condition on vec_id) holds, or all. Queries and
    vectors are dealt to blocks. Each query block meets each shard block in a
    tile: one matrix product in strips, of which each query keeps its ``k``
    best. The partial lists are merged ``fan_in`` shards at a time until each
    query has one list. No vector is skipped.

    Similarities are rounded to 6 digits, then compared; ties go to the lesser
    id, then to the earlier row. A row is not its own neighbour, but a repeated
    row is. Which vectors count is said at :func:`usable_vectors`; others are
    neither queries nor neighbours. With fewer others than ``k`` all are listed.
    Other columns are not read. An empty table gives no rows.
    """
    usable, n, dimensions = usable_vectors(vectors)
    spark, kind = vectors.sparkSession, type_of(usable, "vec_id")
    those = usable if asked is None else usable.where(asked)
    parts = max(1, -(-those.count() // TILE_ROWS))
    # at least enough tiles to keep every core busy
    blocks = max(1, -(-n // TILE_ROWS), min(-(-2 * spark.sparkContext.defaultParallelism // parts), -(-n // 1024)))
    own = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = those.select(own(parts).alias("part"), every(blocks).alias("shard"), F.lit(True).alias("query"), "row", "vec_id", "embedding")
    shards = usable.select(every(parts).alias("part"), own(blocks).alias("shard"), F.lit(False).alias("query"), "row", "vec_id", "embedding")
    lists = (
        queries.unionByName(shards)
        .groupBy("part", "shard")
        .applyInArrow(_tile_top(k, dimensions), f"row long, vec_id {kind}, shard int, units long, neighbor {kind}, neighbor_row long")
        .select("row", "vec_id", "shard", F.array(F.struct((-F.col("units")).alias("away"), "neighbor", "neighbor_row")).alias("best"))
    )
    while True:
        blocks = -(-blocks // fan_in)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        lists = lists.groupBy("row", "vec_id", F.expr(f"cast(shard div {fan_in} as int)").alias("shard")).agg(merged.alias("best"))
        if blocks <= 1:
            break
    return lists.select(F.col("vec_id").alias("query_id"), F.posexplode("best").alias("at", "found")).select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("found.neighbor").alias("neighbor_id"),
        (-F.col("found.away") / UNIT).alias("similarity"),
    )


def rotation(dimensions: int, seed: int = 11) -> np.ndarray:
    """A random rotation, so that no block holds more of a difference than the others by the data's design."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def block_edges(dimensions: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, dimensions)) for a in range(0, dimensions, width)]


def _cells(point: np.ndarray, radius: float, gridded: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, home): the own cell of each point on a grid of twice the radius, then later cells that its ball meets."""
    side = 2 * radius
    home = np.floor(point[:, :gridded] / side).astype(np.int64)
    other = np.where(point[:, :gridded] / side - home < 0.5, -1, 1)
    for step in np.ndindex(*([2] * gridded)):
        move = np.array(step) * other
        rows = np.arange(len(point))
        if any(step):
            rows = np.flatnonzero(move[rows, np.argmax(move != 0, axis=1)] > 0)
        if len(rows):
            yield rows, home[rows] + move[rows], not any(step)


def _radius(limit: float, width: int, dimensions: int) -> float:
    """The block's part of the squared distance, as a distance; a margin covers rounding."""
    return math.sqrt(limit * width / dimensions) + 1e-9


def _turned(dimensions: int):
    """(row, node, copies, point): unit vectors after the rotation."""
    turn = rotation(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                point = _matrix(pa.chunked_array([batch.column(3)]), dimensions) @ turn
                cuts = pa.array(np.arange(0, point.size + 1, dimensions), pa.int32())
                yield pa.record_batch([*batch.columns[:3], pa.ListArray.from_arrays(cuts, pa.array(point.ravel()))], names=["row", "node", "copies", "point"])

    return run


def _points(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().reshape(-1, dimensions)


def _names(cells: np.ndarray) -> pa.Array:
    return pa.array([" ".join(map(str, c)) for c in cells.tolist()], pa.string())


def _members(dimensions: int, width: int, limit: float, gridded: int, counted: bool):
    """(block, cell, home, row, node, copies, point) of each vector in each cell that it meets; ``counted``: (block, cell, n) instead."""
    edges = block_edges(dimensions, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            turned = _points(batch.column("point"), dimensions)
            for block, (a, b) in enumerate(edges):
                for rows, cells, home in _cells(turned[:, a:b], _radius(limit, b - a, dimensions), min(gridded, b - a)):
                    if counted:
                        some, n = np.unique(cells, axis=0, return_counts=True)
                        columns = [pa.array(np.full(len(some), block, np.int32)), _names(some), pa.array(n.astype(np.int64))]
                        yield pa.record_batch(columns, names=["block", "cell", "n"])
                        continue
                    columns = [pa.array(np.full(len(rows), block, np.int32)), _names(cells), pa.array(np.full(len(rows), home))]
                    own = [batch.column(c).take(pa.array(rows)) for c in ("row", "node", "copies", "point")]
                    yield pa.record_batch(columns + own, names=["block", "cell", "home", "row", "node", "copies", "point"])

    return run


def _candidates(point: np.ndarray, left: np.ndarray, right: np.ndarray, radius: float, axis: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may be within the radius: both sides are cut along one axis after the other until few are left."""
    if not len(left) or not len(right):
        return
    if len(left) * len(right) <= 1 << 14 or axis == point.shape[1]:
        for s in range(0, len(left), STRIP_ROWS):
            x = left[s : s + STRIP_ROWS]
            squares = ((point[x] ** 2).sum(axis=1)[:, None] + (point[right] ** 2).sum(axis=1)[None, :]) - 2 * point[x] @ point[right].T
            i, j = np.nonzero(squares <= radius * radius + 1e-9)
            yield x[i], right[j]
        return
    left = left[np.argsort(point[left, axis], kind="stable")]
    right = right[np.argsort(point[right, axis], kind="stable")]
    at = point[right, axis]
    for part in np.array_split(left, min(8, len(left))):
        low, high = point[part[0], axis] - radius, point[part[-1], axis] + radius
        yield from _candidates(point, part, right[np.searchsorted(at, low, "left") : np.searchsorted(at, high, "right")], radius, axis + 1)


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives what pairs join the least label of it."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (shorter := label[label] < label).any():
            label[shorter] = label[label][shorter]


def _close_in_block(least: float, limit: float, dimensions: int, width: int, gridded: int):
    """(row, n, a, b) of a tile: how many vectors each is near to, and links a - b that join what near pairs join.

    A pair is near if its whole cosine says so; it counts in the first block
    whose part of the squared distance it keeps, and there in one cell only.
    """
    edges = block_edges(dimensions, width)

    def run(table: pa.Table) -> pa.Table:
        mine, home, copies = (table[c].to_numpy() for c in ("mine", "home", "copies"))
        low, high, block = table["low"][0].as_py(), table["high"][0].as_py(), table["block"][0].as_py()
        row, point = table["row"].to_numpy(), _points(table["point"], dimensions)
        parts = [np.ascontiguousarray(point[:, a:b]) for a, b in edges[: block + 1]]
        budgets = [_radius(limit, b - a, dimensions) ** 2 for a, b in edges]
        axes = np.roll(parts[block], -gridded, axis=1)
        left = np.flatnonzero(mine == low)
        right = left if low == high else np.flatnonzero(mine == high)
        n, label = np.zeros(len(row), np.int64), np.arange(len(row))
        for i, j in _candidates(axes, left, right, math.sqrt(budgets[block])):
            kept = (home[i] | home[j]) & (row[i] < row[j] if low == high else row[i] != row[j])
            i, j = i[kept], j[kept]
            for a in range(0, len(i), 1 << 16):
                x, y = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                within = lambda k: ((parts[k][x] - parts[k][y]) ** 2).sum(axis=1) <= budgets[k]  # noqa: E731, B023
                first = within(block)
                for k in range(block):
                    first &= ~within(k)
                x, y = x[first], y[first]
                near = np.round((point[x] * point[y]).sum(axis=1), 6) >= least
                x, y = x[near], y[near]
                np.add.at(n, x, copies[y])
                np.add.at(n, y, copies[x])
                _unite(label, x, y)
        some, joined = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(row)))
        node = table["node"].combine_chunks()
        none = lambda k, kind: pa.nulls(k, kind)
        return pa.table(
            {
                "row": pa.concat_arrays([pa.array(row[some], pa.int64()), none(len(joined), pa.int64())]),
                "n": pa.concat_arrays([pa.array(n[some], pa.int64()), none(len(joined), pa.int64())]),
                "a": pa.concat_arrays([none(len(some), node.type), node.take(pa.array(joined))]),
                "b": pa.concat_arrays([none(len(some), node.type), node.take(pa.array(label[joined]))]),
            }
        )

    return run


def near_vector_classes(vectors: DataFrame, least: float = 0.98, width: int | None = None) -> DataFrame:
    """(vec_id, class_id, links): each vector's class of near-duplicates, and how many others are near to it.

    Near is a cosine of ``least`` or more, rounded to 6 digits. A class is what
    chains of near vectors join; its id is its least vec_id. ``links`` counts
    the near vectors, copies each; no pair is lost, none is listed.

    Equal vectors are folded to one that stands for them. Unit vectors of cosine c are at squared distance 2 - 2c. After a random
    rotation the vectors are cut into blocks of ``width`` dimensions (half as
    many as the table's size has bits), each with its proportional part of that budget: a pair within the
    whole is within its part in some block. In each block a range join on a grid
    of twice the radius finds the pairs within the part; inside a cell both sides
    are cut further along the other dimensions, and cells of more than TILE_ROWS members are
    split into tiles. Whole vectors are compared there and then, and a pair
    counts in the first block that finds it, so the result is exact and no list of pairs is moved.

    Rows that repeat id and vector are one. An id with two different vectors has a row
    for each. Which vectors count is said at :func:`usable_vectors`;
    others have no row. Other columns are not read. An empty table gives no rows.
    """
    usable, n, dimensions = usable_vectors(vectors)
    kind = type_of(usable, "vec_id")
    nothing = usable.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    if not n:
        return nothing.limit(0)
    spark = vectors.sparkSession
    limit = 2 * (1 - least) + 2e-6
    width = min(dimensions, width or max(2, math.ceil(math.log2(n) / 2)))
    # a third of a dimension's cells is about what a ball meets, so each further dimension makes cells of a third
    gridded = max(1, min(width, math.ceil(math.log(max(n / 8192, 1), 3))))
    key = [F.xxhash64("embedding").alias("key"), F.xxhash64(F.reverse("embedding")).alias("key2")]
    items = cut(usable.select(*key, "vec_id", "embedding").dropDuplicates(["key", "key2", "vec_id"]), "vector-items")
    with scratch(spark) as folder:
        same = items.groupBy("key", "key2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        # the row is one number for good, as the table is written
        folded = cut(same.withColumn("row", F.monotonically_increasing_id()), "folded-vectors")
        turned = cut(
            folded.select("row", "node", "copies", "embedding").mapInArrow(_turned(dimensions), f"row long, node {kind}, copies long, point array<double>"),
            "turned-vectors",
            folder,
        )
        many = cut(
            turned.select("row", "node", "copies", "point")
            .mapInArrow(_members(dimensions, width, limit, gridded, True), "block int, cell string, n long")
            .groupBy("block", "cell")
            .agg(F.ceil(F.sum("n") / TILE_ROWS).cast("int").alias("parts"))
            .where("parts > 1"),
            "large-cells",
            folder,
        )
        members = turned.mapInArrow(
            _members(dimensions, width, limit, gridded, False),
            f"block int, cell string, home boolean, row long, node {kind}, copies long, point array<double>",
        )
        tiles = (
            members.join(broadcast_if_small(many), ["block", "cell"], "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("mine", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
            .withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumns({"low": F.least("mine", "theirs"), "high": F.greatest("mine", "theirs")})
            .drop("parts", "theirs")
        )
        found = cut(
            tiles.groupBy("block", "cell", "low", "high").applyInArrow(
                _close_in_block(least, limit, dimensions, width, gridded), f"row long, n long, a {kind}, b {kind}"
            ),
            "near-vectors",
            folder,
        )
        links = found.where("row is not null").groupBy("row").agg(F.sum("n").alias("n"))
        roots = components(found.where("row is null").select("a", "b").distinct(), folder)
        known = (
            folded.select("key", "key2", "row", "node", "copies")
            .join(links, "row", "left")
            .join(roots, "node", "left")
            .where("copies > 1 or n is not null or root is not null")
            .select("key", "key2", F.coalesce("root", "node").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
        )
        known = cut(known, "vector-classes")
    return items.select("key", "key2", "vec_id").join(broadcast_if_small(known), ["key", "key2"], "left").select(
        "vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
