"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import cut, free_name, hash60

HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Tokens of a text: its runs of anything but white space; 0 for null or empty."""
    kept = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    return F.when(kept == "", F.lit(0)).otherwise(
        F.length(kept) - F.length(F.replace(kept, F.lit(" "), F.lit(""))) + 1
    ).cast("bigint")


def _totals(items: DataFrame) -> dict[str, int]:
    """Tokens by source; one row for each source comes to the driver."""
    rows = items.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()
    return {r["source"]: int(r["tokens"]) for r in rows}


def _level(totals: Mapping[str, int], share: Mapping[str, float], keep: float) -> float:
    """The size at which sources that give their share of it, or all they have, give ``keep`` of all tokens."""
    target, rest, level = keep * sum(totals[s] for s in share), sum(share.values()), 0.0
    for s in sorted(share, key=lambda x: (totals[x] / share[x], x)):
        level = totals[s] / share[s]
        if level * rest >= target:
            return target / rest
        target, rest = target - totals[s], rest - share[s]
    return level


def plan_budgets(
    totals: Mapping[str, int],
    weights: Mapping[str, float] | None,
    fractions: Sequence[float],
    alpha: float,
    keep: float = 0.0,
) -> list[tuple[str, int, int]]:
    """(source, tier, budget) for each source and nested budget.

    The largest mix is the one in which some source is used up and every source
    has its weight; tier t gets ``fractions[t]`` of it. Without ``weights`` a
    source weighs ``tokens ** alpha``. A source without weight gets nothing.
    The mix grows to ``keep`` of the tokens of weighted sources where it is
    smaller: used-up sources give all they have and the others, by weight, the rest.
    """
    raw = {s: (weights.get(s, 0.0) if weights is not None else n**alpha if n else 0.0) for s, n in totals.items()}
    whole = sum(raw.values())
    share = {s: w / whole for s, w in raw.items() if w > 0 and whole > 0}
    usable = [totals[s] / w for s, w in share.items() if totals[s] > 0]
    most = max(min(usable), _level(totals, share, keep)) if usable else 0.0
    return [
        (s, t, min(totals[s], int(most * w * f + 1e-9)))
        for s, w in sorted(share.items())
        for t, f in enumerate(sorted(fractions))
    ]


def hash_thresholds(items: DataFrame, budgets: list[tuple[str, int, int]], bits: int = 10) -> DataFrame:
    """(source, tier, threshold): rows with ``hash < threshold`` fit the budget.

    Each round sums tokens by source and by the next ``bits`` bits of the hash,
    in the one bucket that the last round left open for each budget, and moves
    to the bucket in which the running sum passes the budget. A round sends at
    most ``2 ** bits`` sums a budget to the driver, whatever the corpus holds.
    """
    spark = items.sparkSession
    low = {(s, t): 0 for s, t, _ in budgets}
    left = {(s, t): b for s, t, b in budgets}
    done: dict[tuple[str, int], int] = {}
    shift = HASH_BITS
    while len(done) < len(low) and shift > 0:
        step = min(bits, shift)
        shift -= step
        opened = sorted({(s, low[s, t]) for s, t in low if (s, t) not in done})
        frontier = spark.createDataFrame(opened, "source string, base bigint")
        sums = (
            items.withColumn("base", F.shiftleft(F.shiftright("hash", shift + step), shift + step))
            .join(F.broadcast(frontier), ["source", "base"])
            .groupBy("source", "base", F.shiftright(F.col("hash") - F.col("base"), shift).alias("bucket"))
            .agg(F.sum("tokens").alias("tokens"))
            .collect()
        )
        by: dict[tuple[str, int], dict[int, int]] = {}
        for r in sums:
            by.setdefault((r["source"], r["base"]), {})[r["bucket"]] = int(r["tokens"])
        for key in [k for k in low if k not in done]:
            base, room = low[key], left[key]
            for bucket, tokens in sorted(by.get((key[0], base), {}).items()):
                if tokens > room:
                    low[key], left[key] = base + (bucket << shift), room
                    break
                room -= tokens
            else:
                done[key] = base + (1 << (shift + step))
    for key in low:
        done.setdefault(key, low[key])
    rows = [(s, t, v) for (s, t), v in sorted(done.items())]
    return spark.createDataFrame(rows, "source string, tier int, threshold bigint")


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    fractions: Sequence[float] = (0.25, 0.5, 1.0),
    alpha: float = 0.7,
) -> DataFrame:
    """(doc_id, source, tokens, tier): the documents of nested mixes.

    Every document has a hash of its id; of each source those with the least
    hashes are taken while their tokens fit the budget, so a smaller mix is part
    of a larger one. ``tier`` is the smallest mix that has the document;
    documents of no mix are left out. Nothing is sorted: two or three sums by
    hash bucket find the threshold of each source and budget exactly.

    A null source counts as the source ''. Documents without tokens (null or
    blank text) are taken wherever their hash is under the threshold. Rows with
    one id share a hash and are taken or left together; null ids share one hash.
    Columns other than doc_id, text and source are not read. An empty table
    gives no rows.
    """
    items = cut(
        docs.select(
            "doc_id",
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            word_count(F.col("text")).alias("tokens"),
            hash60(F.col("doc_id")).alias("hash"),
        ),
        "mix-items",
    )
    return _taken(items, weights, fractions, alpha).select("doc_id", "source", "tokens", "tier")


def _limits(items: DataFrame, weights, fractions, alpha) -> DataFrame:
    found = hash_thresholds(items, plan_budgets(_totals(items), weights, fractions, alpha))
    return found.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("tier", "threshold"))).alias("limits")
    )


def _taken(items: DataFrame, weights, fractions, alpha) -> DataFrame:
    """One row a source is broadcast: its thresholds by tier."""
    limits = _limits(items, weights, fractions, alpha)
    fits = F.filter("limits", lambda x: F.col("hash") < x["threshold"])
    return (
        items.join(F.broadcast(limits), "source")
        .withColumn("tier", F.get(fits, F.lit(0))["tier"])
        .where(F.col("tier").isNotNull())
    )


def sample_to_weights(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    fraction: float = 1.0,
    alpha: float = 0.7,
    keep: float = 0.0,
) -> DataFrame:
    """The rows of ``docs`` in one mix, all columns as they were.

    The texts are not moved: a second scan compares each row's hash with its
    source's threshold. ``keep`` is that of :func:`plan_budgets`; defined cases are
    those of :func:`mix_sources`.
    """
    items = cut(
        docs.select(
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
            word_count(F.col("text")).alias("tokens"),
            hash60(F.col("doc_id")).alias("hash"),
        ),
        "mix-items",
    )
    found = hash_thresholds(items, plan_budgets(_totals(items), weights, [fraction], alpha, keep))
    own, limit = free_name(docs, "mix_source"), free_name(docs, "mix_limit")
    # a row a source
    limits = F.broadcast(found.select(F.col("source").alias(own), F.col("threshold").alias(limit)))
    return (
        docs.join(limits, F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(own))
        .where(hash60(F.col("doc_id")) < F.col(limit))
        .select(*[docs[c] for c in docs.columns])
    )
