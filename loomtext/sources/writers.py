"""Annotations, events, pairs and edges to files."""

from __future__ import annotations

import html
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from loomtext.operators.events import event_table
from loomtext.sources.files import infer_format

_OUTSIDE_VERBS = "array<struct<`sent-id`:int,verb:string,subject:string,object:string,sentence:string>>"


def outside_names(df: DataFrame) -> DataFrame:
    """Verb frames with the field name that files have."""
    return df.withColumn("verb_data", F.col("verb_data").cast(_OUTSIDE_VERBS)) if "verb_data" in df.columns else df


def flat(df: DataFrame, in_order: bool = True) -> DataFrame:
    """Every list, map and struct as JSON text; columns in alphabetical order, or as they are."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in (sorted(df.columns) if in_order else df.columns)])


def save(df: DataFrame, path: str, fmt: str | None = None, single: bool = False, mode: str = "errorifexists", in_order: bool = True) -> None:
    """Writes a folder of part files: json or jsonl with an object a line, csv and tsv with a header.

    ``single`` writes one part; as json it is one array, made by one task, for
    results that a task can hold.
    """
    kind = infer_format(path, fmt)
    rows = outside_names(df)
    if kind in ("csv", "tsv"):
        out = flat(rows, in_order)
        out = out.coalesce(1) if single else out
        writer = out.write.mode(mode).option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        writer.option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "json" and single:
        whole = rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
        whole.write.mode(mode).text(path)
    else:
        (rows.coalesce(1) if single else rows).write.mode(mode).json(path)


def save_rows(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """Segments or pairs: JSON lines for a path that ends with jsonl, else a CSV table."""
    save(df, path, "jsonl" if path.lower().endswith(".jsonl") else "csv", single, mode)


def save_events(events: DataFrame, path: str, fmt: str | None = None, schema: str = "default", single: bool = False, mode: str = "errorifexists") -> str:
    """Events as JSON with their lists (json, jsonl, ndjson, geojson), or as a table of :func:`event_table`'s schema (csv, tsv); the path."""
    kind = (fmt or path.rsplit(".", 1)[-1]).lower()
    if kind in ("json", "jsonl", "ndjson", "geojson"):
        save(events, path, "json" if kind == "json" else "jsonl", single, mode)
    elif kind in ("csv", "tsv"):
        save(event_table(events, schema), path, kind, single, mode, in_order=False)
    else:
        raise ValueError(f"unknown format {kind!r}; one of json, jsonl, ndjson, geojson, csv, tsv")
    return path


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return outside_names(df).select(F.to_json(F.struct("*")).alias("value"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One row (value) with a GeoJSON collection of the rows of :func:`loomtext.operators.graph.features`."""
    every = F.coalesce(F.collect_list("feature"), F.array())
    return features.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), every.alias("features"))).alias("value"))


def map_page(features: DataFrame, centre: Mapping[str, float] | None = None) -> str:
    """An HTML page that lists a collection's points about its centre; for a map's worth of rows."""
    rows = features.select("name", "tag", "lat", "lon").collect()
    lat = centre["lat"] if centre else (sum(r["lat"] for r in rows) / len(rows) if rows else 0.0)
    lon = centre["lon"] if centre else (sum(r["lon"] for r in rows) / len(rows) if rows else 0.0)
    points = "".join(
        f'<circle cx="{r["lon"]:.5f}" cy="{-r["lat"]:.5f}" r="1"><title>{html.escape(str(r["name"]))} ({html.escape(str(r["tag"]))})</title></circle>'
        for r in rows
    )
    return f'<!doctype html><meta charset="utf-8"><svg viewBox="{lon - 60:.3f} {-lat - 30:.3f} 120 60">{points}</svg>'

