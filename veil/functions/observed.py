"""Reports that are counted while their table is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation

from veil.functions.lineage import materialize


def written_with_counts(
    df: DataFrame, before: dict[str, Column], change: Callable[[DataFrame], DataFrame], after: dict[str, Column] | None = None, name: str = "observed"
) -> tuple[DataFrame, DataFrame]:
    """The written `change(df)`, and one row of aggregates over `df` and over the changed rows, from the one scan that writes them.

    `change` must be narrow (projections and filters): rows of a stage that is run again after a
    shuffle's loss would be counted again.
    """
    first, second = Observation(), Observation()
    out = change(df.observe(first, *[c.alias(n) for n, c in before.items()]))
    if after:
        out = out.observe(second, *[c.alias(n) for n, c in after.items()])
    table = materialize(out, name)
    found = {**first.get, **(second.get if after else {})}
    names = [*before, *(after or {})]
    shape = df.select(*[before[n].alias(n) for n in before]).schema.fields + (out.select(*[after[n].alias(n) for n in after]).schema.fields if after else [])
    schema = type(df.schema)(shape)
    return table, df.sparkSession.createDataFrame([tuple(found[n] for n in names)], schema)
