"""What the operators share: column picking, row-wise Arrow maps and held-out remainders."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that separate words: space and U+0009 to U+000D.
SPACES = "\\x20\\x09-\\x0D"

#: What a carried column's name begins with in an operator's result; no column of an operator does.
CARRIED = "in."

#: Bytes of an Arrow batch, and the setting as Spark has it where nobody chose one.
BATCH_SIZE, SPARKS_SIZE = "8m", "67108864b"

#: About as many bytes of a batch are rows and columns in Python at once.
PART_BYTES = 1 << 20


def remainder(id_col: Column | str, by: int) -> Column:
    """crc32(id as text) mod by; -1 for a null id, which so is never held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % by, F.lit(-1))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """The words of a text: runs of anything but SPACES; empty for a null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows, by a hash of the keys; the same rows however the table is dealt out.

    Of a larger table a hash filter first leaves about three times as many, so
    no task sends its own `most` rows to the one that picks.
    """
    n = df.count()
    h = F.xxhash64(*keys)
    part = 1 << 30
    few = df.where(F.pmod(h, F.lit(part)) < math.ceil(3 * most / n * part)) if n > 3 * most else df
    return few.orderBy(h, *keys).limit(most)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str) -> Iterator[None]:
    """Bounds the Arrow batches of the actions inside, for rows that carry whole sets; the session's own bounds return after them."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def release_memory() -> None:
    """Gives freed memory back, since idle Python workers stay beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Where the session leaves the bytes of an Arrow batch to Spark, they become BATCH_SIZE: a batch of whole texts stands in the JVM and in the worker of every core at once."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, SPARKS_SIZE) == SPARKS_SIZE:
        spark.conf.set(bound, BATCH_SIZE)


def map_rows(df: DataFrame, schema: str | StructType, start: Callable[[], Callable[[list[list]], Iterator[Sequence]]], block: int = 2_000) -> DataFrame:
    """mapInArrow by rows: start() runs once in a task and gives rows-in to rows-out, called with the columns of up to `block` rows.

    Output leaves in batches of at most `block` rows or so, so memory follows a
    block of texts, not the partition.
    """
    bound_batches(df.sparkSession)
    spark_schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(spark_schema)
        step = start()
        try:
            for batch in batches:
                many = max(1, min(block, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, many):
                    part = batch.slice(at, many)
                    rows = list(step([c.to_pylist() for c in part.columns]))
                    columns = list(zip(*rows)) if rows else [[] for _ in out_schema]
                    made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out_schema)], schema=out_schema)
                    part = rows = columns = None  # not beside the next part's
                    yield made
        finally:
            step = None
            release_memory()

    return df.mapInArrow(run, spark_schema)
