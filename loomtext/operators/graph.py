"""Co-occurrence edges and points on a map."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of parts that are ordered on their own, about.
RANGES = 200
MAP_LABELS = ("CITY", "COUNTRY", "GPE", "LOC", "PLACE", "US-STATE")


def segment_nodes(records: DataFrame, nodes: Sequence[str] = ("PERSON", "GPE"), keys: Sequence[str] = ("fileId", "segId")) -> DataFrame:
    """(keys, node): distinct names of the wanted tags in each segment."""
    each = records.select(*keys, F.explode("entities").alias("e"))
    return each.where(F.col("e.tag").isin(*nodes)).select(*keys, F.col("e.token").alias("node")).distinct()


def global_ordinals(records: DataFrame, part: str = "fileId", order: str = "segId") -> DataFrame:
    """(part, order, ordinal): the place of a segment in the list of all, parts in order of name.

    Parts are cut into ranges of names at the names of RANGES parts of least
    hash; sizes are added up within a range, and ranges, a few rows, on the
    driver. No task sees all parts.
    """
    sizes = records.groupBy(part).agg(F.count("*").alias("n"), F.min(order).alias("least"))
    edges = sorted(r[0] for r in sizes.where(F.col(part).isNotNull()).select(part).orderBy(F.xxhash64(part), part).limit(RANGES).collect())
    cuts = F.array(*map(F.lit, edges)) if edges else F.array()
    ranged = sizes.withColumn("range", F.size(F.filter(cuts, lambda x: x <= F.col(part))) if edges else F.lit(0))
    above, offsets = 0, []
    for r in sorted(ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        offsets.append((r["range"], above))
        above += r["n"]
    own = Window.partitionBy("range").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(records.sparkSession.createDataFrame(offsets, "range int, above bigint"))
    placed = ranged.withColumn("within", F.coalesce(F.sum("n").over(own), F.lit(0))).join(starts, "range")
    placed = placed.select(part, "least", (F.col("above") + F.col("within")).alias("before"))
    return records.select(part, order).join(placed, part).select(part, order, (F.col("before") + F.col(order) - F.col("least")).alias("ordinal"))


def cooccurrence(found: DataFrame, window: int = 1, part: str | None = "fileId", order: str = "segId", sizes: DataFrame | None = None) -> DataFrame:
    """(u, v, w), u < v: in how many windows two names occur together.

    ``found`` has part, order and node, order being whole numbers without gaps.
    There is a window about each segment, ``window`` segments to either side,
    also about those without a name, but none beyond the first and last segment:
    ``sizes`` has part, low and high, or ``found`` has low and high itself; without them the segments that have names
    bound it. Each name goes to every window that holds it, once; names are then
    matched within windows by an equi-join, not by a range.
    """
    keys = [part] if part else []
    if {"low", "high"} <= set(found.columns):
        met = found
    else:
        bounds = sizes if sizes is not None else found.groupBy(*keys).agg(F.min(order).alias("low"), F.max(order).alias("high"))
        # without a part there is one row of bounds
        met = found.join(bounds, keys) if keys else found.crossJoin(F.broadcast(bounds))
    low, high = F.greatest(F.col(order) - window, F.col("low")), F.least(F.col(order) + window, F.col("high"))
    spread = met.select(*keys, F.explode(F.sequence(low, high)).alias("centre"), "node")
    in_window = spread.groupBy(*keys, "centre").agg(F.array_sort(F.collect_set("node")).alias("names"))
    left = in_window.select(F.posexplode("names").alias("at", "u"), "names")
    pairs = left.select("u", F.explode(F.slice("names", F.col("at") + 2, F.size("names"))).alias("v"))
    return pairs.groupBy("u", "v").agg(F.count("*").alias("w"))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Edges by weight, the largest first, then by names."""
    return edges.orderBy(F.desc("w"), "u", "v")


def place_mentions(records: DataFrame, labels: Sequence[str] = MAP_LABELS) -> DataFrame:
    """(fileId, segId, name, tag): each mention of a place."""
    each = records.select("fileId", "segId", F.explode("entities").alias("e")).where(F.col("e.tag").isin(*labels))
    return each.select("fileId", "segId", F.col("e.token").alias("name"), F.col("e.tag").alias("tag"))


def located(mentions: DataFrame, places: DataFrame | None = None, geocoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """``mentions`` with lat and lon; those that aren't found are dropped.

    ``places`` has name, lat and lon; a ``geocoder`` maps a column of names to
    (lat, lon) and sees each distinct name once.
    """
    if geocoder is not None:
        at = mentions.select("name").distinct().withColumn("at", geocoder(F.col("name")))
        places = at.select("name", "at.lat", "at.lon")
    if places is None:
        return mentions.withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon")}).where(F.lit(False))
    # Spark broadcasts the table if it is under spark.sql.autoBroadcastJoinThreshold
    known = places.select("name", F.col("lat").cast("double"), F.col("lon").cast("double")).where("lat is not null and lon is not null")
    return mentions.join(known.dropDuplicates(["name"]), "name")


def features(found: DataFrame) -> DataFrame:
    """``found`` with feature: a GeoJSON point for each row of :func:`located`."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    told = F.struct("name", "tag", "fileId", "segId")
    return found.withColumn("feature", F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), told.alias("properties")))


def centroid(found: DataFrame) -> DataFrame:
    """(lat, lon): the mean of all points; 0, 0 without any."""
    return found.agg(F.coalesce(F.avg("lat"), F.lit(0.0)).alias("lat"), F.coalesce(F.avg("lon"), F.lit(0.0)).alias("lon"))
