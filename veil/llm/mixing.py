r"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Document rates between 0 and the most allowed are the ones nearest to even rates
(least relative entropy, a document's share of its bound being a probability) that meet every source's target. They are
exponentially tilted: the log-odds of a document's rate are its source's multiplier times its size. The multipliers
solve a convex dual; Newton steps for all sources at once are aggregates over (source, size) counts. From zero these
steps move towards the solution from one side, so they need no line search.

Rates become copies by a draw that is a function of the document: floor(rate + draw). What that leaves of a source's
target is closed by a factor on its rates, found by a search that compares many factors in each pass. So the copies of
a document follow from a few numbers of its source, in a projection without a shuffle, and reruns agree.

Defined cases: null is a source, the last one. A null text has size 0; documents of size 0 are taken 0 words, and 0
copies. A source of size 0 has target 0. Repeated rows get the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.llm.common import NON_SPACE, free_name, stored, table

WEIGHTS, TOTAL, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Newton ends at this share of a source's target. Each search pass compares so many factors, in a bracket that the
#: number of passes makes finer than the draws of any two documents.
EXACT, STEPS, FACTORS, PASSES = 1e-9, 60, 16, 8


def size(text: str = "text") -> Column:
    """Number of words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NON_SPACE)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, n).

    Weights repeat over the sources by code point, null last. Targets are the shares of `total` times all sizes; no
    target exceeds `most` times its source's size, and what that cuts off goes to the other sources by weight.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("source_size"))
    named = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.get(cycle, (F.row_number().over(named) - 1) % len(weights)))
    # water level: sources fill up in the order of limit by weight; the level is the highest that any start of that order gives
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(all_) * total - full) / open_weight)
    per = per.withColumn("level", F.max("level").over(all_))
    return per.select("source", "source_size", F.least(F.col("source_size") * most, F.col("weight") * F.col("level")).alias("target"))


def same_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on `source` in which nulls are equal."""
    b = b.withColumnRenamed("source", "__source")
    return a.join(b, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def rate(most: float = MOST) -> Column:
    """Rate of a document of `size` in a source with `multiplier`, `scale`, `source_size` and `target`."""
    return (
        F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0)
        .when(F.col("target") >= F.col("source_size") * most, most)
        .otherwise(most / (1 + F.exp(-F.col("multiplier") * F.col("size") / F.col("scale"))))
    )


def multipliers(sizes: DataFrame, goals: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """`goals` with each source's multiplier and scale (mean size of a word's document), from (source, size, n)."""
    scale = sizes.groupBy("source").agg(F.try_divide(F.sum(F.col("size").cast("double") ** 2 * F.col("n")), F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = same_source(goals, scale).withColumn("multiplier", F.lit(0.0)).withColumn("off", F.lit(1.0))
    state = stored(state, "multipliers")
    words = F.col("size") * F.col("n")
    r = rate(most)
    for _ in range(steps):
        sums = same_source(sizes, state).groupBy("source").agg(
            F.sum(words * r).alias("got"), F.sum(words * F.col("size") / F.col("scale") * r * (1 - r / most)).alias("slope")
        )
        free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most) & (F.col("slope") > 0)
        gap = F.col("target") - F.col("got")
        state = stored(
            same_source(state, sums).select(
                "source", "source_size", "target", "scale",
                F.when(free, F.col("multiplier") + gap / F.col("slope")).otherwise(F.col("multiplier")).alias("multiplier"),
                F.when(free, F.abs(gap) / F.col("target")).otherwise(0.0).alias("off"),
            ),
            "multipliers",
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= EXACT:
            break
    return state.drop("off")


def draw(text: str, *keys: str) -> Column:
    """A number in [0, 1) that follows from the document's key and text."""
    return F.shiftrightunsigned(F.xxhash64(*keys, text), 11).cast("double") / F.lit(float(1 << 53))


def copies(most: float = MOST) -> Column:
    """Copies of a document: its rate times its source's `factor`, rounded by its `draw`."""
    return F.floor(F.least(F.lit(most), rate(most) * F.col("factor")) + F.col("draw")).cast("long")


def factors(docs: DataFrame, state: DataFrame, most: float = MOST, passes: int = PASSES) -> DataFrame:
    """`state` with the factor of each source whose rounded copies come nearest its target, from (source, size, draw).

    Rounded words rise with the factor. Each pass compares evenly spaced factors and keeps the bracket between the last
    that falls short and the next one; the nearer end of the last bracket is taken.
    """
    state = state.withColumn("low", F.lit(0.0)).withColumn("high", F.lit(4.0))
    for _ in range(passes):
        joined = same_source(docs, state)
        width = F.col("high") - F.col("low")
        at = [F.col("low") + width * (i / FACTORS) for i in range(FACTORS + 1)]
        rated = joined.withColumn("rate", rate(most))
        got = [F.sum(F.col("size") * F.floor(F.least(F.lit(most), F.col("rate") * f) + F.col("draw"))).cast("double").alias(f"g{i}") for i, f in enumerate(at)]
        sums = same_source(state, rated.groupBy("source").agg(*got))
        grid = F.array(*(F.struct(f.alias("f"), F.col(f"g{i}").alias("g")) for i, f in enumerate(at)))
        short = F.filter(grid, lambda x: x["g"] <= F.col("target"))
        over = F.filter(grid, lambda x: x["g"] > F.col("target"))
        low, high = F.element_at(short, -1), F.get(over, F.lit(0))
        state = stored(
            sums.select(
                "source", "source_size", "target", "scale", "multiplier",
                F.coalesce(low["f"], F.col("low")).alias("low"), F.coalesce(high["f"], low["f"], F.col("high")).alias("high"),
                F.when((F.col("target") - low["g"]) <= (high["g"] - F.col("target")), low["f"]).otherwise(F.coalesce(high["f"], low["f"])).alias("factor"),
            ),
            "factors",
        )
    capped = F.col("target") >= F.col("source_size") * most
    return state.withColumn("factor", F.when(capped, 1.0).otherwise(F.coalesce("factor", F.lit(1.0)))).drop("low", "high")


def plan(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """What decides the copies of a source's documents, one row a source. docs: (source, size, draw)."""
    sizes = stored(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return factors(docs, multipliers(sizes, stored(targets(sizes, weights, total, most), "targets"), most), most)


def measured(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, draw) of every document, written once for all passes."""
    return stored(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size(text).alias("size"), draw(text, key).alias("draw")), "measured")


def mixed(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix: every document as often as it is taken, with the columns of `docs`."""
    sources = plan(measured(docs, key, source, text), weights, total, most)
    names = {c: free_name(docs, f"mix_{c}") for c in ("size", "draw", "copies")}
    sources = sources.select(F.col("source").alias("__mix_source"), F.struct("source_size", "target", "scale", "multiplier", "factor").alias("__mix"))
    joined = docs.join(sources, F.col(source).eqNullSafe(F.col("__mix_source")))
    inner = F.col("__mix")
    known = joined.withColumns({names["size"]: size(text), names["draw"]: draw(text, key)})
    r = (
        F.when((F.col(names["size"]) == 0) | (inner["target"] <= 0), 0.0)
        .when(inner["target"] >= inner["source_size"] * most, most)
        .otherwise(most / (1 + F.exp(-inner["multiplier"] * F.col(names["size"]) / inner["scale"])))
    )
    n = F.floor(F.least(F.lit(most), r * inner["factor"]) + F.col(names["draw"])).cast("int")
    repeated = known.withColumn(names["copies"], n).where(F.col(names["copies"]) > 0)
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = measured(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    taken = F.least(copies() * F.col("size"), F.lit(2) * F.col("size"))
    return same_source(docs, plan(docs)).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"))
