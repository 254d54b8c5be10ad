"""Helpers shared by the corpus operators: per-text Arrow maps and the library's shared tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.storage import discard, shared_dir, stash

__all__ = ["discard", "each", "host_of", "long_fields", "map_texts", "shared_dir", "stash", "string_fields", "table", "unused"]

#: Texts, and their bytes, held as Python strings at once in a worker.
SLICE_ROWS = 512
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[], Callable[[list[str]], list[tuple]]],
    fields: list[T.StructField],
    carry: bool = False,
) -> DataFrame:
    """One row per input row: the id and a value for each field; with ``carry``, all of its columns and then
    the fields, whose names must not be among them.

    ``make()`` gives a function from a list of texts to as many tuples; it runs once per task in the
    Python worker, so it may read a broadcast or build tables. Without ``carry`` only the two named columns
    reach Python; a null text counts as empty; ids, null or repeated, pass through.
    """
    kept = df.columns if carry else [id_col]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    arrow = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in _slices(batch, len(kept)):
                rows = work(part.column(len(kept)).to_pylist())
                columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=schema.names)

    texts = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(unused(df, "_text")))
    return texts.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of SLICE_ROWS rows, fewer where texts are long: about SLICE_BYTES but at least one row."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (at - start >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if sizes:
        yield batch.slice(start)


def each(work: Callable[[str], tuple]) -> Callable[[list[str]], list[tuple]]:
    return lambda texts: [work(text) for text in texts]


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.StringType(): pa.string(),
        T.BooleanType(): pa.bool_(),
        T.BinaryType(): pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return simple[kind]


def long_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.LongType()) for name in names]


def string_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def unused(df: DataFrame, stem: str) -> str:
    """``stem`` with as many underscores before it as no column of ``df`` begins with."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem = f"_{stem}"
    return stem
