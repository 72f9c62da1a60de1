"""Places of rows inside groups of any size, without a window that sorts a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from veil.functions.exprs import join_groups
from veil.functions.ordered import default_ranges, ranges_for
from veil.llm.common import ship, stored


def sorted_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Partitions that are ranges of `order` (nulls first), sorted; equal rows may fall into two of them."""
    keys = [*order, "__tie"]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys).drop("__tie")


def begins(batch: pa.RecordBatch, group: Sequence[str], last: list | None) -> np.ndarray:
    """Which rows differ in `group` from the row before; `last` holds the values before the first."""
    new = np.zeros(batch.num_rows, bool)
    for k, name in enumerate(group):
        values = batch.column(name)
        same = pc.fill_null(pc.equal(values[1:], values[:-1]), False).to_numpy(zero_copy_only=False)
        nulls = values.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (nulls[1:] & nulls[:-1]))
        new[0] |= last is None or values[0].as_py() != last[k]
    if last is None:
        new[0] = True
    return new


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, about: DataFrame | None = None) -> DataFrame:
    """`df` with `pos`, the place (from 0) of a row in its group by `order`, and `group_size`.

    `df` should be a written table, as it is read to find the ranges. `about` has one row per group, whose columns are
    added. Rows are placed inside ranges; what the ranges before hold of their group is one small row per group and range.
    """
    group = list(group)
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField("__part", IntegerType()), StructField("__local", LongType())])

    def run(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new, at = begins(batch, group, last), np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            local = np.where(start < 0, count + at, at - start)
            last, count = [batch.column(c)[n - 1].as_py() for c in group], int(local[-1]) + 1
            arrays = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "__part", "__local"])

    ranges = ranges_for(df.count())  # as many as keep a range at what a task can surely sort
    rows = stored(sorted_ranges(df, [*group, *order], ranges if ranges > default_ranges(df) else None).mapInArrow(run, schema), name)
    keys = [*group, "__part"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    offsets = sizes.select(
        *keys, (F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias("group_size")
    )
    if about is not None:
        offsets = join_groups(offsets, about, group)
    placed = join_groups(rows, offsets, keys)
    return placed.withColumn("pos", F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")
