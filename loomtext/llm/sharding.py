"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import cut, free_name

#: ``monotonically_increasing_id`` keeps the partition above these bits, the row of it below.
ROW_BITS = 33
#: numpy's own sampler takes populations under this.
_SAMPLER_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` without replacement are good.

    Above numpy's limit the distribution is inverted: its terms within 12
    standard deviations of the mode, by the exact ratio of neighbours.
    """
    if good + bad < _SAMPLER_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    whole = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    spread = (drawn / whole * good * (bad / whole) * ((whole - drawn) / whole)) ** 0.5
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (whole + 2)))
    a, b = max(low, mode - int(12 * spread) - 20), min(high, mode + int(12 * spread) + 20)
    k = np.arange(a, b, dtype=float)
    ratio = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.exp(weight - weight.max())
    total = np.cumsum(weight)
    return a + int(np.searchsorted(total, rng.random() * total[-1], "right"))


def split_counts(rng: np.random.Generator, sizes: Sequence[int], drawn: int) -> list[int]:
    """A multivariate hypergeometric draw: how many of ``drawn`` rows go to each shard's free places."""
    out, rest = [], sum(sizes)
    for size in sizes:
        rest -= size
        x = hypergeometric(rng, size, rest, drawn)
        out.append(x)
        drawn -= x
    return out


def matrix_row(partition: int, before: Sequence[int], sizes: Sequence[int], seed: int) -> list[int]:
    """The matrix's row of a partition: exact counts for each shard.

    ``before[p]`` is the number of rows of partitions under p, with the total
    last. Halving the partitions, the shares of the left half are drawn from a
    generator that the halves name, so any task finds its own row in
    log(partitions) draws of a row, and all tasks agree on every draw.
    """
    low, high, free = 0, len(before) - 1, list(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, low, high]), free, before[middle] - before[low])
        if partition < middle:
            high, free = middle, left
        else:
            low, free = middle, [f - x for f, x in zip(free, left)]
    return free


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def shard_documents(docs: DataFrame, shards: int = 64, seed: int = 20_240, stable: bool = False) -> DataFrame:
    """``docs`` with ``shard`` and ``position``: a uniform random order in shards of exact sizes.

    Sizes differ by one at most. One pass counts the rows of each partition;
    then each partition permutes its rows and deals them by its row of the
    matrix; one exchange brings each shard together, where a second permutation
    orders it. Every order of all rows is as likely as any other, up to the
    generator. Only counts reach the driver, one a partition.

    ``stable`` says that each evaluation of ``docs`` has the same partitions, as
    a table scan does; otherwise ``docs`` is first written to the shared folder.
    Repeating a task gives the same rows the same places. Nulls, empty and
    repeated rows are rows as any other. Columns named ``shard`` or ``position``
    are replaced. With fewer rows than shards the last shards are empty; an
    empty table gives no rows.
    """
    docs = docs if stable else cut(docs, "shard-input")
    docs = docs.drop("shard", "position")
    row = F.monotonically_increasing_id()
    counted = docs.select(F.shiftright(row, ROW_BITS).alias("part")).groupBy("part").count().collect()
    rows = {r["part"]: r["count"] for r in counted}
    before = [0, *np.cumsum([rows.get(p, 0) for p in range(max(rows, default=-1) + 1)]).tolist()]
    sizes = shard_sizes(before[-1], shards)
    dealt: dict[int, np.ndarray] = {}

    @F.pandas_udf("int")
    def deal(ids: pd.Series) -> pd.Series:
        value = ids.to_numpy()
        out = np.empty(len(value), dtype=np.int32)
        for part in np.unique(value >> ROW_BITS).tolist():
            if part not in dealt:
                dealt.clear()
                slots = np.repeat(np.arange(shards, dtype=np.int32), matrix_row(part, before, sizes, seed))
                np.random.default_rng([seed, part]).shuffle(slots)
                dealt[part] = slots
            own = value >> ROW_BITS == part
            out[own] = dealt[part][value[own] & ((1 << ROW_BITS) - 1)]
        return pd.Series(out)

    columns, number = [c for c in docs.columns], free_name(docs, "shard_row")
    exchanged = (
        docs.withColumn(number, row)
        .withColumn("shard", deal(number))
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions(F.xxhash64(number, F.lit(seed)), number)
    )
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1).cast("bigint"))
    return exchanged.withColumn("position", place).select(*columns, "shard", "position")
