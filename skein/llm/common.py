"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that the operators give to their own columns, so that a caller's columns never clash.
OWN = "_skein_"
#: Java regular expression of a word: a run without ASCII white space.
SPACE_CLASS = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of ``text`` as an array (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS, -1), lambda w: w != "")


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, Iterable]], schema: str, text_at: int | None = None, slice_bytes: int = 1 << 20) -> DataFrame:
    """``mapInArrow`` with a function from a batch to named columns; row order and batch bounds carry no meaning.

    ``text_at``: the column whose bytes bound the slices handed to ``make``
    (about ``slice_bytes``, one row at least), so that working memory follows
    the longest text and not the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text_at, slice_bytes):
                out = make(part)
                arrays = [x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x) for x in out.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    return df.mapInArrow(run, schema)


def keep_batches(df: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray], slice_bytes: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` for which ``keep`` of their texts is true; each row goes to Python once, as it is, and nothing is shuffled."""
    at = df.columns.index(text_col)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at, slice_bytes):
                kept = part.filter(pa.array(keep(part.column(at)), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return df.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, text_at: int | None, limit: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    if text_at is None:
        yield batch
        return
    sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column (null: empty) and the n+1 offsets of its rows, without copying rows one by one."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column])  # no slice offset
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]
