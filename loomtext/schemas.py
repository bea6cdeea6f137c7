"""Declared schemas of annotation records, events, pairs and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

ENTITIES = "array<struct<start_char:int,token:string,tag:string>>"
VERBS = "array<struct<sent_id:int,verb:string,subject:string,object:string,sentence:string>>"


def _row(**columns: DataType) -> StructType:
    """A schema; no session is needed to state it."""
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_TEXT, _INT, _REAL, _FLAG, _TEXTS = StringType(), IntegerType(), DoubleType(), BooleanType(), ArrayType(StringType())
ANNOTATION = _row(
    file=_TEXT,
    fileId=_TEXT,
    segId=_INT,
    segCount=_INT,
    entities=ArrayType(_row(start_char=_INT, token=_TEXT, tag=_TEXT)),
    verb_data=ArrayType(_row(sent_id=_INT, verb=_TEXT, subject=_TEXT, object=_TEXT, sentence=_TEXT)),
    text=_TEXT,
    error=_TEXT,
    role=_TEXT,
    turnId=_INT,
    qaPairId=_INT,
    isQuestion=_FLAG,
    isAnswer=_FLAG,
    sentiment_label=_TEXT,
    sentiment_score=_REAL,
    emotion_label=_TEXT,
    emotion_score=_REAL,
    emotion_dist=MapType(_TEXT, _REAL),
    summary=_TEXT,
    interpretation=_TEXT,
    themes=_TEXTS,
)
#: Columns that a loaded annotation table always has.
REQUIRED = ("file", "fileId", "segId", "segCount", "entities", "verb_data", "text", "error")
EVENT = _row(
    fileId=_TEXT,
    eventId=_TEXT,
    event=_TEXT,
    sources=ArrayType(_INT),
    evidence=_TEXTS,
    category=_TEXT,
    place=_TEXT,
    date=_TEXT,
    persons=_TEXTS,
    others=_TEXTS,
    emotion=_TEXT,
    emotion_valence=_REAL,
    confidence=_REAL,
    count_mentions=_INT,
)
QA_PAIR = _row(fileId=_TEXT, pairId=_INT, q_speaker=_TEXT, q_text=_TEXT, a_speaker=_TEXT, a_text=_TEXT)
EDGE = _row(u=_TEXT, v=_TEXT, w=LongType())


def conformed(df: DataFrame, schema: StructType, missing: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with exactly the columns of a schema; absent ones are null or as ``missing`` says."""
    given = missing or {}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
