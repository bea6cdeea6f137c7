"""Text files, lists of texts and saved annotations as DataFrames."""

from __future__ import annotations

import glob as globbing
import json
import os
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.schemas import ANNOTATION, ENTITIES, REQUIRED, VERBS, conformed

FORMATS = ("json", "jsonl", "csv", "tsv")


def infer_format(path: str, fmt: str | None = None) -> str:
    """json, jsonl, csv or tsv: as named, else by the path's ending, else json."""
    kind = fmt.lower() if fmt else str(path).lower().rsplit(".", 1)[-1]
    kind = {"ndjson": "jsonl"}.get(kind, kind)
    if kind in FORMATS:
        return kind
    if fmt:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    return "json"


def decoded(content: Column, encoding: str = "utf-8") -> Column:
    """Bytes as text: what can't be decoded is dropped, and every line break becomes a newline."""
    if encoding.lower().replace("-", "") == "utf8":
        text = F.translate(F.make_valid_utf8(content.cast("string")), "�", "")
    else:
        text = _other_encoding(encoding)(content)
    return F.regexp_replace(text, r"\r\n?", "\n")


def _other_encoding(encoding: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: None if b is None else bytes(b).decode(encoding, "ignore"))

    return decode


def _stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def read_texts(
    spark: SparkSession,
    inputs: str | Sequence[str],
    pattern: str = "*.txt",
    recursive: bool = True,
    encoding: str = "utf-8",
) -> DataFrame:
    """(file, fileId, text) of files and folders, each file once.

    A file is taken whatever its name; of a folder those that fit the pattern, at
    any depth if ``recursive``. A path that isn't there is taken as a glob. A URL
    with a scheme is a folder if it ends with a slash, else a file or a glob.
    """
    paths = [inputs] if isinstance(inputs, str) else list(inputs)
    files: list[str] = []
    folders: list[str] = []
    for p in map(str, paths):
        if "://" in p:
            (folders if p.endswith("/") else files).append(p)
        elif os.path.isdir(p):
            folders.append(os.path.abspath(p))
        else:
            files.extend(map(os.path.abspath, [p] if os.path.exists(p) else filter(os.path.isfile, globbing.glob(p, recursive=True))))
    parts = []
    if files:
        parts.append(spark.read.format("binaryFile").load(sorted(set(files))))
    if folders:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        parts.append(found.option("recursiveFileLookup", str(recursive).lower()).load(sorted(set(folders))))
    if not parts:
        return spark.createDataFrame([], "file string, fileId string, text string")
    read = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).dropDuplicates(["path"])
    path = F.regexp_replace("path", r"^file:(?://)?(?=/)", "")
    return read.select(path.alias("file"), _stem(path).alias("fileId"), decoded(F.col("content"), encoding).alias("text"))


def read_texts_or_errors(
    spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8"
) -> DataFrame:
    """(file, fileId, text, error) of paths that executors can open; a file that can't be read has its error in place of a text."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["file"]:
                try:
                    with open(path, encoding=encoding, errors="ignore") as file:
                        rows.append((path, file.read(), None))
                except (OSError, LookupError) as error:
                    rows.append((path, None, repr(error)))
            yield pd.DataFrame(rows, columns=["file", "text", "error"])

    listed = spark.createDataFrame([(p,) for p in dict.fromkeys(map(str, paths))], "file string")
    return listed.mapInPandas(load, "file string, text string, error string").select("file", _stem(F.col("file")).alias("fileId"), "text", "error")


def texts_frame(spark: SparkSession, texts: Sequence[str], file_id: str | None = None, start: int = 1) -> DataFrame:
    """(segId, text) of a list, numbered from ``start``; with ``file_id`` also fileId and segCount."""
    df = spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "segId int, text string")
    return df if file_id is None else df.withColumns({"fileId": F.lit(file_id), "segCount": F.lit(len(texts))})


def read_segments_json(spark: SparkSession, path: str) -> DataFrame:
    """(fileId, segId, text) of a JSON array of strings, or of objects with text and perhaps fileId and segId.

    Without a segId segments are numbered from 1 within their file, in order.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("items"))
    each = raw.select(F.posexplode("items").alias("at", "item"))
    fields = F.from_json("item", "fileId string, segId int, text string")
    is_object = F.startswith(F.ltrim("item"), F.lit("{"))
    rows = each.select(
        "at",
        F.coalesce(F.when(is_object, fields["fileId"]), F.lit("segments")).alias("fileId"),
        F.when(is_object, fields["segId"]).alias("given"),
        F.when(is_object, fields["text"]).otherwise(F.col("item")).alias("text"),
    )
    order = Window.partitionBy("fileId").orderBy("at")
    return rows.withColumn("segId", F.coalesce("given", F.row_number().over(order))).select("fileId", "segId", "text")


def load_annotations(spark: SparkSession, path: str, fmt: str | None = None, ensure_columns: bool = True) -> DataFrame:
    """Saved annotations with the declared schema.

    Tables of text have their lists as JSON; an empty or missing list becomes an
    empty one. Without ``ensure_columns`` columns that the file lacks are left out.
    """
    kind = infer_format(path, fmt)
    if kind in ("json", "jsonl"):
        # ``sent-id`` is the name outside, ``sent_id`` the one inside
        outside = ANNOTATION.json().replace("sent_id", "sent-id")
        there = spark.read.option("multiLine", kind == "json").json(path).columns
        df = spark.read.schema(StructType.fromJson(json.loads(outside))).option("multiLine", kind == "json").json(path)
        df = df.withColumn("verb_data", F.col("verb_data").cast(VERBS))
    else:
        sep = "\t" if kind == "tsv" else ","
        df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
        there = df.columns
        outside_verbs = VERBS.replace("sent_id", "`sent-id`")
        decode = {
            "entities": lambda c: F.from_json(c, ENTITIES),
            "verb_data": lambda c: F.from_json(c, outside_verbs).cast(VERBS),
            "themes": lambda c: F.from_json(c, "array<string>"),
            "emotion_dist": lambda c: F.from_json(c, "map<string,double>"),
        }
        df = df.withColumns({c: f(F.col(c)) for c, f in decode.items() if c in there})
    keep = [f.name for f in ANNOTATION if f.name in there or (ensure_columns and f.name in REQUIRED)]
    out = conformed(df, ANNOTATION)
    return out.withColumns(
        {
            "entities": F.coalesce("entities", F.array().cast(ENTITIES)),
            "verb_data": F.coalesce("verb_data", F.array().cast(VERBS)),
        }
    ).select(*keep)
