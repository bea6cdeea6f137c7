"""What the operators share: scratch tables, words and hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of letters; digits, marks and underscores separate words.
WORD = re.compile(r"[^\W\d_]+")
_NO_LETTER = re.compile(r"[\W\d_]")
#: The Latin-1 letters as they are, a blank for every other byte.
_LATIN_LETTERS = bytes(c if WORD.fullmatch(chr(c)) else ord(" ") for c in range(256))
#: Characters of a text that are split into words at once.
PIECE_CHARS = 1 << 20
#: Texts that a Python worker gets at once.
BATCH_ROWS = 500
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """No Python worker of this session gets more than BATCH_ROWS rows at once from now on.

    For what is computed after an operator has returned: by default 10,000 texts
    wait in the executor, go through its Arrow buffers and are held by the worker.
    """
    spark.conf.set(_BATCH_ROWS, str(min(int(spark.conf.get(_BATCH_ROWS)), BATCH_ROWS)))


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which memory that the worker has freed goes back to the system; workers stay for the stages to come."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where it is unset and the session is local is a folder made for it;
    a cluster without the setting is refused, as executors share no local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomtext-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str, folder: str = "") -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    This ends the lineage and survives the loss of any executor; unlike
    ``checkpoint()`` it doesn't compute the last stage twice. A result that is
    yet to be computed may read the table, so it stays until :func:`release`.
    Shuffle files behind it are of no more use and go at once.
    """
    spark = df.sparkSession
    path = f"{folder or scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (_SHUFFLE_CLEANUP, _BATCH_ROWS)}
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    spark.conf.set(_BATCH_ROWS, str(min(int(before[_BATCH_ROWS]), BATCH_ROWS)))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables are."""
    return f"{scratch_root(spark)}/loomtext-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for :func:`cut` that is deleted at the end; nothing that is computed later may read it."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        _delete(spark, folder)


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; results that haven't been computed are lost with them."""
    _delete(spark, scratch_folder(spark))


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has so few rows; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bitmap_of(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bit for each bigint ``key``, by its low bits; partial bitmaps reach the driver, ``bits`` (a power of two) in all at most."""
    bucket = F.col(key).bitwiseAND(F.lit(bits - 1).cast("bigint")) + 1
    parts = (
        keys.where(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(bucket).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bucket)).alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        at = (r["part"] - 1) * len(r["bits"])
        own = np.frombuffer(r["bits"], np.uint8)[: max(0, len(out) - at)]
        out[at : at + len(own)] = own
    return out


def has_bit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of a bitmap's; never false for one that is."""
    place = keys & (len(bitmap) * 8 - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def may_be_among(spark: SparkSession, bitmap: np.ndarray) -> Callable[[Column], Column]:
    """:func:`has_bit` as a column function; the bitmap is broadcast, its size is fixed."""
    held = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(has_bit(held.value, keys.to_numpy(np.int64)))

    return test


def hash60(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns' text, as a bigint; the same in any SQL engine."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("bigint")


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text; none for null. A text of Latin-1 only is split by a table of its letters, which is faster."""
    if not text:
        return []
    lower = text.lower()
    try:
        return lower.encode("latin-1").translate(_LATIN_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(lower)


def word_pieces(text: str | None) -> Iterator[list[str]]:
    """:func:`words_of` in pieces, so that a very long text's words aren't held at once."""
    at, size = 0, len(text or "")
    while at < size:
        end = at + PIECE_CHARS
        found = _NO_LETTER.search(text, end) if end < size else None
        end = found.start() if found else size
        yield words_of(text[at:end])
        at = end


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def type_of(df: DataFrame, column: str) -> str:
    """The column's type as DDL, for functions that pass it through unchanged."""
    return df.schema[column].dataType.simpleString()
