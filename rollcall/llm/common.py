"""Plumbing shared by the operators: checkpoints and row-wise Python maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.session import checkpoint_dir

ROWS_PER_SLICE = 256   # rows turned into Python objects at a time


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared checkpoint folder (at most ``files`` files) and read it back.

    For loops: unlike a checkpoint, the table's size is known as it is, where
    estimates multiplied from round to round would grow without bound.
    """
    if files is not None:
        df = df.coalesce(files)
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)


def map_slices(df: DataFrame, make: Callable[[], Callable[[list[tuple]], list[tuple]]], ddl: str) -> DataFrame:
    """Rows computed by Python workers from slices of at most ROWS_PER_SLICE input rows.

    ``make`` is called once per task; what it returns turns a list of input
    rows into a list of output rows.
    """
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_SLICE):
                part = batch.slice(at, ROWS_PER_SLICE)
                rows = fn(list(zip(*(c.to_pylist() for c in part.columns))))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """One output row per input row, see :func:`map_slices`."""
    def per_slice() -> Callable[[list[tuple]], list[tuple]]:
        fn = make()
        return lambda rows: [fn(*r) for r in rows]
    return map_slices(df, per_slice, ddl)


def pieces(df: DataFrame, text_col: str, piece_bytes: int) -> int:
    """How many pieces of about ``piece_bytes`` the texts make (one pass that returns a number)."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-int(total) // piece_bytes))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_aside_names(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns c0, c1, ..., the new name of a column, and what gives a frame of these its names back.

    No name of the caller's, whatever it is, can then clash with those of a computation.
    """
    names = docs.columns
    return (docs.toDF(*[f"c{i}" for i in range(len(names))]), lambda name: f"c{names.index(name)}",
            lambda df: df.select(*[f"c{i}" for i in range(len(names))]).toDF(*names))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition: the key columns agree, nulls included."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
