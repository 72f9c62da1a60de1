"""Small helpers of the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veil.functions.lineage import materialize

#: Words of `[^\x20\x09-\x0D]+` as a Java pattern.
NON_SPACE = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that a task works on at once.
SLICE = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, cut to `columns`."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that their Python workers can import it wherever it is installed."""
    sc = spark.sparkContext
    if getattr(sc, "_veil_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="veil-"), "veil.zip")  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "veil")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    sc.addPyFile(archive)
    sc._veil_shipped = True


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files go as soon as the write that made them ends; for steps whose result is a written table."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`materialize`, with the shuffle files of `df` removed once it is written."""
    with shuffles_dropped(df.sparkSession):
        return materialize(df, name)


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each part have about `most` bytes, or are one text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.binary())), 0).to_numpy()
        part = np.cumsum(size, dtype=np.int64) // most
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


def with_columns(df: DataFrame, text: str, added: StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]]) -> DataFrame:
    """`df` with columns computed from Arrow batches, cut by the size of `text`: `fn` gives for each batch the batch and
    one list per added column."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = list(to_arrow_schema(added))

    def run(batches):
        for batch, columns in fn(slices(batches, text)):
            arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, names=[*batch.schema.names, *(f.name for f in fields)])

    ship(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))
