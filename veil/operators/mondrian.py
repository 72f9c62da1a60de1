"""Mondrian multidimensional partitioning.

A split depends on the quasi-identifiers only, so rows that agree on them never part. The rows are
therefore aggregated once into cells (one per distinct combination, with its row count) and all
partitioning runs on the cells. A partition of more cells than a task should hold is split level by
level: one aggregate measures every such partition, one join moves the cells to the child partitions,
and each level is written to the shared checkpoint folder. As soon as a partition is small enough, one
task finishes it, whatever its depth, all of them in one grouped pass. A combination that a third of
all rows share is one cell.

Partition ids are paths of bits: the root is "1", its children are "10" (left) and "11" (right).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.functions.exprs import join_groups, ratio
from veil.functions.lineage import materialize
from veil.functions.ordered import ROWS_PER_RANGE, ranges_for, running_sums
from veil.operators.diversity import frequency_distance_from_counts, rank_levels

ROOT = "1"
#: Cells of a partition that a task finishes, and levels of a sensitive attribute that are sent to it.
LOCAL_CELLS, LOCAL_LEVELS = 1 << 18, 10_000
#: Cells up to which rows are joined with their cell, whatever a cell's rows; rows of a cell up to which any number of cells is.
JOINED_CELLS, HOT_ROWS = 100_000, 100_000
SPLIT = "part_id string, j int, cut double, inclusive boolean"


@dataclass(frozen=True)
class Validity:
    """What both sides of a split must fulfil: k rows, l distinct sensitive values, distance <= t."""

    k: int = 3
    l: int | None = None
    t: float | None = None


@dataclass(frozen=True)
class Partitioning:
    """Cells with their final partition, and what is needed to go back to the rows.

    `cells` has the feature columns, their codes `__x<j>`, the row count `n`, `part_id`, and the
    sensitive column when a validity rule used it. `splits` (part_id, j, cut, inclusive) is the tree of
    the chosen splits, `depth` its height, `n_cells` the number of cells, `hottest` the most rows of a cell.
    """

    cells: DataFrame
    features: tuple[str, ...]
    categorical: tuple[str, ...]
    sensitive: str | None
    keyed_by_sensitive: bool
    splits: DataFrame
    depth: int
    n_cells: int
    hottest: int

    def assign(self, df: DataFrame, most_cells: int | None = None) -> DataFrame:
        """The partitioned rows with their `part_id`.

        The cells are joined on the features, null-safe: where they are few, and where none is hot, so
        that the join can shuffle. Else, beyond `most_cells` cells, rows go down the tree of splits
        (`route`): that table has one row per inner node, so it can be broadcast long after the cells
        cannot, and no hot combination meets in one task; but a level costs as much as a join.
        """
        if most_cells is None:
            most_cells = self.n_cells if self.hottest <= HOT_ROWS else JOINED_CELLS
        if self.n_cells > most_cells:
            return self.route(df)
        keys = [*self.features, *([self.sensitive] if self.keyed_by_sensitive else [])]
        return join_groups(df, self.cells.select(*keys, "part_id"), keys)

    def route(self, df: DataFrame) -> DataFrame:
        """Rows with their `part_id`, found level by level from the splits of a level, in one narrow stage while those are small.

        Values that the partitioned table does not have go where missing ones go.
        """
        rows, columns = df, list(df.columns)
        for j, c in enumerate(self.features):
            if c in self.categorical:
                codes = materialize(_level_codes(self.cells, c).withColumnRenamed("__code", f"__x{j}"), "codes")
                rows = rows.join(codes, F.col(f"`{c}`").cast("string") == F.col("__level"), "left").drop("__level")
            else:
                rows = rows.withColumn(f"__x{j}", F.col(f"`{c}`").cast("double"))
        rows = rows.withColumn("part_id", F.lit(ROOT))
        x = _feature_value(len(self.features))
        for d in range(self.depth):
            level = self.splits.where(F.length("part_id") == d + len(ROOT)).withColumnRenamed("part_id", "__parent")
            rows = rows.join(level, F.col("part_id") == F.col("__parent"), "left")
            side = F.expr(f"CASE WHEN j IS NULL THEN '' WHEN {goes_left(x)} THEN '0' ELSE '1' END")
            rows = rows.withColumn("part_id", F.concat("part_id", side)).drop("__parent", "j", "cut", "inclusive")
        return rows.select(*columns, "part_id")


def _feature_value(width: int) -> str:
    return "CASE j " + " ".join(f"WHEN {j} THEN `__x{j}`" for j in range(width)) + " END"


def split_types(df: DataFrame, features: Sequence[str], categorical: Sequence[str] | None) -> list[str]:
    """The categorical ones among the features: as told, else all strings and booleans."""
    if categorical is not None:
        return [c for c in features if c in categorical]
    return [f.name for f in df.schema if f.name in features and isinstance(f.dataType, (T.StringType, T.BooleanType))]


def _level_codes(cells: DataFrame, column: str) -> DataFrame:
    """(level, code): position of every distinct value in string order."""
    text = F.col(column).cast("string")
    levels = cells.where(text.isNotNull()).groupBy(text.alias("__level")).agg(F.lit(1).alias("__one"))
    ranked = running_sums(levels, "__level", ["__one"])
    return ranked.select("__level", (F.col("cum___one") - 1).cast("double").alias("__code"))


def encode_cells(df: DataFrame, features: Sequence[str], categorical: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per distinct combination with count `n` and a numeric code `__x<j>` per feature."""
    cells = df.groupBy(*features, *extra).agg(F.count(F.lit(1)).alias("n"))
    if categorical:
        cells = materialize(cells, "cells")
    for j, c in enumerate(features):
        if c in categorical:
            codes = _level_codes(cells, c).withColumnRenamed("__code", f"__x{j}")
            cells = cells.join(codes, F.col(c).cast("string") == F.col("__level"), "left").drop("__level")
        else:
            cells = cells.withColumn(f"__x{j}", F.col(c).cast("double"))
    return cells


def _long(cells: DataFrame, n_features: int, keep: Sequence[str]) -> DataFrame:
    """Cells once per feature: (keep..., n, j, x)."""
    parts = ", ".join(f"named_struct('j', {j}, 'x', `__x{j}`)" for j in range(n_features))
    return cells.selectExpr(*[f"`{c}`" for c in keep], "n", f"inline(array({parts}))")


def measure_splits(cells: DataFrame, n_features: int, is_cat: str, ranges: int) -> DataFrame:
    """Span, cut and side counts of every (part_id, feature).

    Numeric: the cut is the median; `<` goes left, or `<=` when the median is the minimum.
    Categorical: the first half of the levels goes left. Rows without a value go left and count
    neither in the span nor in the median. Left sides are prefixes of the sorted values, so running
    sums give all counts in one pass.
    """
    values = _long(cells, n_features, ["part_id"]).groupBy("part_id", "j", "x").agg(F.sum("n").alias("n"))
    weighed = values.selectExpr(
        "part_id", "j", "x", "if(x IS NULL, 0L, n) AS n", "if(x IS NULL, 0, 1) AS one", "if(x IS NULL, n, 0L) AS missing"
    )
    ranked = running_sums(weighed, "x", ["n", "one", "missing"], ["part_id", "j"], ranges)
    # value rows cover the ranks from cum_n - n to cum_n - 1; the median lies between two ranks
    low, high = ("{0}((total_n - 1) / 2) BETWEEN cum_n - n AND cum_n - 1".format(f) for f in ("floor", "ceil"))
    half = "cum_one = floor(total_one / 2)"
    aggregates = {
        "n_present": "max(total_n)", "n_levels": "max(total_one)", "n_missing": "max(total_missing)", "lo": "min(x)", "hi": "max(x)",
        "m_lo": f"max(if({low}, x, NULL))", "m_hi": f"max(if({high}, x, NULL))",
        "before_lo": f"max(if({low}, cum_n - n, NULL))", "upto_lo": f"max(if({low}, cum_n, NULL))",
        "n_first": "max(if(cum_one = 1, n, NULL))", "half_x": f"max(if({half}, x, NULL))", "half_n": f"max(if({half}, cum_n, NULL))",
    }
    stats = ranked.groupBy("part_id", "j").agg(*[F.expr(e).alias(c) for c, e in aggregates.items()])
    cuts = stats.selectExpr(
        "part_id", "j", "n_present", "n_missing",
        f"if({is_cat}, CAST(n_levels AS double), hi - lo) AS span",
        f"if({is_cat}, half_x, (m_lo + m_hi) / 2) AS cut",
        f"{is_cat} OR (m_lo + m_hi) / 2 = lo AS inclusive",
        f"coalesce(CASE WHEN {is_cat} THEN half_n WHEN (m_lo + m_hi) / 2 = lo THEN n_first WHEN m_lo = m_hi THEN before_lo ELSE upto_lo END, 0L) AS n_below",
    )
    return cuts.selectExpr(
        "part_id", "j", "span", "cut", "inclusive", "n_below + n_missing AS n_left", "n_present - n_below AS n_right",
        "n_present + n_missing AS n_part",
    )


def goes_left(x: str) -> str:
    """Side of a value under `cut` and `inclusive`; missing values go left."""
    return f"({x} IS NULL OR {x} < cut OR (inclusive AND {x} = cut))"


def _sensitive_rules(
    cells: DataFrame, splits: DataFrame, n_features: int, sensitive: str, rule: Validity, levels: DataFrame | None,
) -> DataFrame:
    """The splits whose both sides are diverse and close enough."""
    rows = _long(cells, n_features, ["part_id", sensitive])
    sided = rows.join(splits.select("part_id", "j", "cut", "inclusive"), ["part_id", "j"])
    counts = sided.groupBy("part_id", "j", F.expr(goes_left("x")).alias("left"), sensitive).agg(F.sum("n").alias("n"))
    by = ["part_id", "j", "left"]
    ok = splits
    if rule.l is not None:
        diverse = counts.groupBy(*by).agg(F.count(sensitive).alias("distinct")).groupBy("part_id", "j").agg(
            F.min("distinct").alias("__l")
        )
        ok = ok.join(diverse, ["part_id", "j"]).where(F.col("__l") >= rule.l).drop("__l")
    if rule.t is not None:
        # sides have at most one cell per level of the sensitive attribute
        few = ranges_for(levels.count()) == 1
        distance = frequency_distance_from_counts(counts, levels, by, sensitive, "n", 1 if few else None)
        close = distance.groupBy("part_id", "j").agg(F.max("distance").alias("__t"))
        ok = ok.join(close, ["part_id", "j"]).where(F.round("__t", 12) <= rule.t).drop("__t")
    return ok


def full_spans(cells: DataFrame, n_features: int, is_cat: str) -> DataFrame:
    """(j, full_span) over the whole table."""
    values = _long(cells, n_features, []).where(F.col("x").isNotNull()).groupBy("j", "x").agg(F.lit(1).alias("one"))
    spans = values.groupBy("j").agg(F.count(F.lit(1)).alias("levels"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return spans.selectExpr("j", f"if({is_cat}, CAST(levels AS double), hi - lo) AS full_span")


def relative_span() -> Column:
    """Span over the full-table span; a zero full span does not divide."""
    return F.coalesce(ratio(F.col("span"), F.col("full_span")), F.col("span"))


def choose_splits(valid: DataFrame) -> DataFrame:
    """Per partition the valid split with the largest relative span, ties in feature order."""
    pick = F.expr("min_by(struct(j, cut, inclusive), struct(-round(rel_span, 12), j))").alias("s")
    return valid.groupBy("part_id").agg(pick).select("part_id", "s.*")


def _is_categorical(features: Sequence[str], categorical: Sequence[str]) -> str:
    codes = ", ".join(str(j) for j, c in enumerate(features) if c in categorical)
    return f"j IN ({codes})" if codes else "false"


def finish_locally(
    width: int, nominal: set[int], full: dict[int, float], rule: Validity, sensitive: str | None, shares: dict | None, min_size: int | None,
    max_depth: int | None,
) -> Callable[[pa.Table], pa.Table]:
    """Splits the cells of one partition to the end, by the rules of the level-wise form; its first cell carries the splits.

    `full` are the spans of the whole table, `shares` the global shares of the sensitive values (for t).
    Everything the function needs is inside it, so it can be sent to tasks that lack this package.
    """
    k, l, t = rule.k, rule.l, rule.t  # plain values: a task without this package cannot load a Validity

    def rounded(x: float) -> Decimal:
        return Decimal(repr(float(x))).quantize(Decimal("1e-12"), ROUND_HALF_UP)

    def candidate(j, x, missing, n):
        """(span, cut, inclusive, rows left, rows right) of a split on feature j, or None."""
        known = ~missing
        values, place = np.unique(x[known], return_inverse=True)
        if not len(values):
            return None
        counts = np.bincount(place, n[known], len(values)).astype(np.int64)
        upto, absent = np.cumsum(counts), int(n[missing].sum())
        total = int(upto[-1])
        if j in nominal:
            half = len(values) // 2
            if not half:
                return None
            span, cut, inclusive, below = float(len(values)), values[half - 1], True, int(upto[half - 1])
        else:
            first, second = (int(np.searchsorted(upto, r, "right")) for r in ((total - 1) // 2, total // 2))
            cut = (values[first] + values[second]) / 2
            span, inclusive = float(values[-1] - values[0]), bool(cut == values[0])
            below = int(counts[0] if inclusive else upto[first] - counts[first] if first == second else upto[first])
        return span, float(cut), inclusive, below + absent, total - below

    def diverse_and_close(left, codes, n, g):
        farthest, seen = 0.0, False
        for side in (left, ~left):
            own = np.bincount(codes[side] + 1, n[side], len(g) + 1)
            if l is not None and np.count_nonzero(own[1:]) < l:
                return False
            if t is not None and own[1:].any():
                farthest, seen = max(farthest, float(np.abs(own[1:] / own.sum() - g).max())), True
        return t is None or (seen and rounded(farthest) <= Decimal(repr(t)))

    def run(cells: pa.Table) -> pa.Table:
        columns = [cells.column(f"__x{j}") for j in range(width)]
        missing = [c.is_null().to_numpy() for c in columns]
        xs = [np.where(m, 0.0, c.fill_null(0.0).to_numpy()) for c, m in zip(columns, missing)]
        n, root = cells.column("n").to_numpy(), cells.column("part_id")[0].as_py()
        codes, g = np.zeros(len(n), np.int64), np.zeros(1)
        if sensitive is not None:
            levels = list(shares) if shares is not None else [v for v in cells.column(sensitive).unique().to_pylist() if v is not None]
            place = {v: i for i, v in enumerate(levels)}
            codes = np.array([-1 if v is None else place[v] for v in cells.column(sensitive).to_pylist()], np.int64)
            g = np.array([shares[v] for v in levels]) if shares is not None else np.zeros(len(levels))
        ids, todo, splits = np.empty(len(n), object), [(root, np.arange(len(n)))], []
        while todo:
            name, own = todo.pop()
            best, size = None, n[own].sum()
            if (max_depth is None or len(name) - 1 < max_depth) and (min_size is None or size >= min_size):
                for j in range(width):
                    found = candidate(j, xs[j][own], missing[j][own], n[own])
                    if found is None or min(found[3:]) < max(k, 1):
                        continue
                    span, cut, inclusive = found[:3]
                    whole = full.get(j)
                    order = -rounded(span / whole if whole else span), j
                    if best is not None and order >= best[0]:
                        continue
                    x = xs[j][own]
                    left = missing[j][own] | (x < cut) | (inclusive & (x == cut))
                    if sensitive is None or diverse_and_close(left, codes[own], n[own], g):
                        best = order, left, {"part_id": name, "j": j, "cut": cut, "inclusive": inclusive}
            if best is None:
                ids[own] = name
            else:
                todo += [(name + "0", own[best[1]]), (name + "1", own[~best[1]])]
                splits.append(best[2])
        at = cells.schema.get_field_index("part_id")
        kind = pa.list_(pa.struct([("part_id", pa.string()), ("j", pa.int32()), ("cut", pa.float64()), ("inclusive", pa.bool_())]))
        made = pa.array([splits, *[None] * (len(n) - 1)], kind)
        return cells.set_column(at, "part_id", pa.array(ids, pa.string())).append_column("splits", made)

    return run


def partition(
    df: DataFrame, features: Sequence[str], rule: Validity = Validity(), sensitive: str | None = None,
    categorical: Sequence[str] | None = None, max_depth: int | None = None, min_size: int | None = None,
) -> Partitioning:
    """Greedy recursive partitioning of the rows into boxes that fulfil the validity rule.

    `max_depth` and `min_size` stop early. The driver only sees a few counts per level, and levels are
    only run for partitions of more than LOCAL_CELLS cells: the number of jobs does not depend on the
    depth of the boxes. With more levels of the sensitive attribute than LOCAL_LEVELS, or values that
    are no numbers, all is done by level.
    """
    features = list(features)
    categorical = split_types(df, features, categorical)
    uses_sensitive = rule.l is not None or rule.t is not None
    if uses_sensitive and sensitive is None:
        raise ValueError("l and t need a sensitive column")
    extra = [sensitive] if uses_sensitive else []
    is_cat = _is_categorical(features, categorical)
    width = len(features)
    active = materialize(encode_cells(df, features, categorical, extra).withColumn("part_id", F.lit(ROOT)), "mondrian")
    scale = materialize(full_spans(active, width, is_cat), "spans")
    levels = materialize(rank_levels(active, sensitive, "n"), "levels") if rule.t is not None else None
    columns = [*features, *extra, "n", *[f"__x{j}" for j in range(width)], "part_id"]
    active = active.select(*columns)
    odd = reduce(lambda a, b: a | b, [F.isnan(f"__x{j}") for j in range(width)])
    n_cells, n_odd, hottest = active.agg(F.count(F.lit(1)), F.count_if(odd), F.coalesce(F.max("n"), F.lit(0))).first()
    largest = n_cells
    finish, most = None, 0
    if not n_odd and (levels is None or levels.count() <= LOCAL_LEVELS):
        full = {r["j"]: r["full_span"] for r in scale.collect()}  # one row a feature
        shares = None if levels is None else {r["level"]: r["global_share"] for r in levels.collect()}  # at most LOCAL_LEVELS rows
        nominal = {j for j, c in enumerate(features) if c in categorical}
        finish = finish_locally(width, nominal, full, rule, sensitive if uses_sensitive else None, shares, min_size, max_depth)
        most = LOCAL_CELLS
    finals: list[DataFrame] = []
    trees: list[DataFrame] = []

    def finished(cells: DataFrame) -> None:
        schema = T.StructType([*cells.schema.fields, T.StructField("splits", T.ArrayType(T.StructType.fromDDL(SPLIT)))])
        done = materialize(cells.groupBy("part_id").applyInArrow(finish, schema), "finished")
        finals.append(done.select(*columns))
        trees.append(done.select(F.inline("splits")))

    depth = 0
    while active is not None and (max_depth is None or depth < max_depth):
        if largest <= most:
            finished(active)
            active = None
            break
        level, chosen = _split_level(active, columns, width, is_cat, rule, extra, scale, levels, min_size, largest, depth)
        trees.append(chosen.select("part_id", F.col("j").cast("int").alias("j"), "cut", "inclusive"))
        state = level.agg(F.count_if("split").alias("open"), F.count_if(~F.col("split")).alias("closed")).first()
        if state["closed"]:
            finals.append(level.where(~F.col("split")).select(*columns))
        active, largest = level.where("split").select(*columns), state["open"]
        depth += 1
        if not state["open"]:
            active = None
        elif most or largest * width > ROWS_PER_RANGE:
            # what one task has to sort is the largest partition, not the level
            sizes = materialize(active.groupBy("part_id").agg(F.count(F.lit(1)).alias("m")), "sizes")
            largest = sizes.agg(F.max("m")).first()[0]
            if most and (max_depth is None or depth < max_depth) and largest > most:
                finished(active.join(sizes.where(F.col("m") <= most).select("part_id"), "part_id", "left_semi").select(*columns))
                active = active.join(sizes.where(F.col("m") > most).select("part_id"), "part_id", "left_semi").select(*columns)
    if active is not None:
        finals.append(active)
    cells = finals[0] if len(finals) == 1 else materialize(reduce(DataFrame.unionByName, finals), "partitions")
    splits = materialize(reduce(DataFrame.unionByName, trees), "splits") if trees else df.sparkSession.createDataFrame([], SPLIT)
    height = splits.agg(F.max(F.length("part_id") - len(ROOT) + 1)).first()[0] or 0
    return Partitioning(cells, tuple(features), tuple(categorical), sensitive, uses_sensitive, splits, height, n_cells, hottest)


def _split_level(
    active: DataFrame, columns: Sequence[str], width: int, is_cat: str, rule: Validity, extra: Sequence[str], scale: DataFrame,
    levels: DataFrame | None, min_size: int | None, largest: int, depth: int,
) -> tuple[DataFrame, DataFrame]:
    """Cells in the children of their partitions, and whether the partition was split; and the splits. Both written."""
    splits = measure_splits(active, width, is_cat, ranges_for(largest * width))
    enough = f"cut IS NOT NULL AND least(n_left, n_right) >= {max(rule.k, 1)}"
    if min_size is not None:
        enough += f" AND n_part >= {min_size}"
    valid = splits.where(enough)
    if extra:
        valid = _sensitive_rules(active, materialize(valid, "splits"), width, extra[0], rule, levels)
    chosen = choose_splits(valid.join(scale, "j", "left").withColumn("rel_span", relative_span()))
    chosen = materialize(chosen, "chosen")  # one row a partition; its size is known to the join
    x = _feature_value(width)
    moved = active.withColumnRenamed("part_id", "parent").join(chosen.withColumnRenamed("part_id", "parent"), "parent", "left")
    moved = moved.selectExpr(
        *[f"`{c}`" for c in columns if c != "part_id"],
        f"concat(parent, CASE WHEN j IS NULL THEN '' WHEN {goes_left(x)} THEN '0' ELSE '1' END) AS part_id", "j IS NOT NULL AS split",
    )
    return materialize(moved, f"mondrian{depth}"), chosen


def spans(df: DataFrame, features: Sequence[str], categorical: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, span): max - min, or distinct values of categorical features.

    Values are counted per (group, feature, value) first, so distinct counts need no value sets.
    """
    categorical = split_types(df, features, categorical)
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("s"),
                 (F.lit(None).cast("double") if c in categorical else F.col(c).cast("double")).alias("x"))
        for c in features
    ]
    values = df.select(*by, F.inline(F.array(*entries))).groupBy(*by, "feature", "s").agg(F.min("x").alias("x"))
    return values.groupBy(*by, "feature").agg(
        F.when(F.col("feature").isin(categorical) if categorical else F.lit(False), F.count("s").cast("double"))
        .otherwise(F.max("x") - F.min("x")).alias("span")
    )


def single_level(df: DataFrame, features: Sequence[str], by: str | None = None, categorical: Sequence[str] | None = None,
                 extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cells of an existing partitioning (column `by`, default one partition) and their candidate splits."""
    categorical = split_types(df, features, categorical)
    rows = df.withColumn("part_id", F.col(by).cast("string") if by else F.lit(ROOT))
    cells = materialize(encode_cells(rows, features, categorical, ["part_id", *extra]), "cells")
    splits = measure_splits(cells, len(features), _is_categorical(features, categorical), ranges_for(cells.count() * len(features)))
    return cells, splits, categorical


def release_table(rows: DataFrame, p: Partitioning, sensitive: str, max_partitions: int | None = None) -> DataFrame:
    """One row per partition and sensitive value: means, joined sorted categories, row count.

    Means and category sets come from the cells. `max_partitions` keeps exactly that many
    partitions, in id order.
    """
    numeric = [c for c in p.features if c not in p.categorical]
    means = [ratio(F.sum(F.col(c) * F.col("n")), F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(c) for c in numeric]
    # a partition's set of levels is part of its released row
    sets = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in p.categorical]
    boxes = p.cells.groupBy("part_id").agg(*means, *sets)
    if max_partitions is not None:
        boxes = boxes.orderBy("part_id").limit(max_partitions)
    counts = p.assign(rows).groupBy("part_id", sensitive).agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col(sensitive).isNotNull()).join(boxes, "part_id").select("part_id", *p.features, sensitive, "count")


def micro_aggregate(rows: DataFrame, p: Partitioning) -> DataFrame:
    """Rows with numeric features replaced by the partition mean and categorical ones by its mode.

    Modes are found from counts per (partition, value), ties by the smallest value.
    """
    numeric = [c for c in p.features if c not in p.categorical]
    means = [ratio(F.sum(F.col(c) * F.col("n")), F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(f"__m_{c}") for c in numeric]
    values = p.cells.groupBy("part_id").agg(F.sum("n").alias("__size"), *means)
    if p.categorical:
        entries = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in p.categorical]
        counts = p.cells.select("part_id", "n", F.inline(F.array(*entries))).where(F.col("v").isNotNull()).groupBy("part_id", "c", "v").agg(F.sum("n").alias("n"))
        best = counts.groupBy("part_id", "c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        wide = best.groupBy("part_id").agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"__m_{c}") for c in p.categorical])
        values = values.join(wide, "part_id", "left")
    joined = p.assign(rows).join(values, "part_id")
    types = {f.name: f.dataType for f in rows.schema}
    replaced = {c: F.col(f"__m_{c}").cast(types[c] if c in p.categorical else "double").alias(c) for c in p.features}
    return joined.select(*[replaced.get(c, F.col(c)) for c in rows.columns])


def partition_bounds(p: Partitioning) -> DataFrame:
    """(part_id, feature, left, right): left is the minimum, right the next larger value in the table.

    Without a larger value right is the own maximum. Categorical features use level positions with
    right = last position + 1.
    """
    cells, width = p.cells, len(p.features)
    is_cat = _is_categorical(p.features, p.categorical)
    long = _long(cells, width, ["part_id"]).where(F.col("x").isNotNull())
    boxes = long.groupBy("part_id", "j").agg(F.min("x").alias("left"), F.max("x").alias("max"))
    # the next larger value is the one at the next rank among the distinct values of the feature
    values = long.groupBy("j", "x").agg(F.lit(1).alias("one"))
    ranked = materialize(running_sums(values, "x", ["one"], ["j"]).select("j", "x", F.col("cum_one").alias("r")), "values")
    following = ranked.select("j", (F.col("r") - 1).alias("r"), F.col("x").alias("next"))
    successors = ranked.join(following, ["j", "r"], "left").select("j", F.col("x").alias("max"), "next")
    right = F.when(F.expr(is_cat), F.col("max") + 1).otherwise(F.coalesce("next", "max"))
    names = F.element_at(F.array(*[F.lit(c) for c in p.features]), F.col("j") + 1)
    return boxes.join(successors, ["j", "max"]).select("part_id", names.alias("feature"), "left", right.alias("right"))


def partition_statistics(rows: DataFrame, p: Partitioning, sensitive: str) -> DataFrame:
    """(part_id, sensitive value, n, share inside the partition)."""
    counts = p.assign(rows).groupBy("part_id", sensitive).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("part_id").agg(F.sum("n").alias("__t"))
    return counts.join(totals, "part_id").select("part_id", sensitive, "n", F.round(ratio(F.col("n"), F.col("__t")), 6).alias("share"))


def compare_rules(df: DataFrame, features: Sequence[str], sensitive: str, rules: dict[str, Validity], **options) -> DataFrame:
    """Partitions, smallest and mean size per validity rule."""
    rows = []
    for name, rule in rules.items():
        p = partition(df, features, rule, sensitive, **options)
        sizes = p.cells.groupBy("part_id").agg(F.sum("n").alias("n"))
        rows.append(
            sizes.agg(F.count(F.lit(1)).alias("n_partitions"), F.min("n").alias("min_size"), F.round(F.avg("n"), 6).alias("mean_size"),
                      F.sum("n").alias("n_rows")).select(F.lit(name).alias("rule"), "*")
        )
    return reduce(DataFrame.unionByName, rows)
