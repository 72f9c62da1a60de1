"""Differential privacy: randomized response, Laplace noise and estimation from noisy data."""

from __future__ import annotations

from collections.abc import Sequence
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.exprs import ratio
from veil.functions.lineage import materialize
from veil.functions.observed import written_with_counts
from veil.functions.rand import laplace_noise, least_not_below, md5_words, salt, uniform
from veil.operators.profile import histogram

Number = Column | float | str


def _c(x: Number) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def epsilon_likelihood(p: Number, q: Number) -> Column:
    """Budget of randomized response: log of the largest likelihood ratio of an output."""
    p, q = _c(p), _c(q)
    keep = F.lit(1.0) - p
    zero = ratio(keep + p * q, p * q)
    one = ratio(keep + p * (F.lit(1.0) - q), p * (F.lit(1.0) - q))
    # least/greatest skip nulls, so an impossible output leaves the other ratio; it means infinity
    unbounded = zero.isNull() | one.isNull()
    return F.when(unbounded, F.lit(float("inf"))).otherwise(F.log(F.greatest(zero, one)))


def epsilon_product(p: Number, q: Number, floor: float | None = None) -> Column:
    """Older budget formula -ln(p q); `floor` clips p and q to [floor, 1] first."""
    p, q = _c(p), _c(q)
    if floor is not None:
        p, q = (F.least(F.greatest(x, F.lit(floor)), F.lit(1.0)) for x in (p, q))
    return -F.log(p * q)


def compose(epsilon: Number, n: int) -> Column:
    """Basic composition over n releases."""
    return _c(epsilon) * n


def epsilon_value(p: float, q: float) -> float:
    """`epsilon_likelihood` of plain numbers."""
    return log(max((1 - p + p * q) / (p * q), (1 - p + p * (1 - q)) / (p * (1 - q))))


def randomized_response(column: str, key: str, p: Number, q: Number, seed: str, draw: int = 0) -> Column:
    """0/1 value that is replaced with probability p: by 0 with probability q, else by 1.

    Nulls stay null. Draws depend on seed, column, draw number and row key only.
    """
    replace = uniform(salt(seed, column, 2 * draw), key) < _c(p)
    noise = F.when(uniform(salt(seed, column, 2 * draw + 1), key) < _c(q), 0).otherwise(1)
    return F.when(F.col(column).isNotNull(), F.when(replace, noise).otherwise(F.col(column).cast("int")))


def respond_all(df: DataFrame, columns: Sequence[str], key: str, p: float, q: float, seed: str, suffix: str = "_dp") -> DataFrame:
    """Adds a randomized version `<c><suffix>` of every column; a narrow projection."""
    return df.select("*", *[randomized_response(c, key, p, q, seed).alias(f"{c}{suffix}") for c in columns])


def respond_all_written(df: DataFrame, columns: Sequence[str], key: str, p: float, q: float, seed: str, suffix: str = "_dp") -> tuple[DataFrame, DataFrame]:
    """`respond_all`, written, with its `drift_report` from the scan that writes it."""
    sums = {}
    for c in columns:
        for out, x in ((f"{c}|before", F.col(c)), (f"{c}|after", F.col(f"{c}{suffix}"))):
            sums |= {f"{out}|0": F.count_if(x == 0), f"{out}|1": F.count_if(x == 1)}
    before = {"rows": F.count(F.lit(1))}
    table, counts = written_with_counts(df, before, lambda rows: respond_all(rows, columns, key, p, q, seed, suffix), sums, "responses")
    entries = []
    for c in columns:
        zeros, ones = ({side: F.col(f"`{c}|{side}|{v}`") for side in ("before", "after")} for v in (0, 1))
        rate = {side: ratio(ones[side], zeros[side] + ones[side]) for side in zeros}
        entries.append(F.struct(
            F.lit(c).alias("column_name"), F.round(rate["before"], 6).alias("rate_before"), F.round(rate["after"], 6).alias("rate_after"),
            F.round(F.abs(rate["after"] - rate["before"]), 6).alias("abs_diff"), zeros["before"].alias("zeros_before"), ones["before"].alias("ones_before"),
            zeros["after"].alias("zeros_after"), ones["after"].alias("ones_after"),
        ))
    return table, counts.select(F.inline(F.array(*entries)))


def drift_report(df: DataFrame, columns: Sequence[str], suffix: str = "_dp") -> DataFrame:
    """Per column: rate before and after, absolute difference and counts of 0 and 1; one aggregate."""
    entries = []
    for c in columns:
        x, y = F.col(c), F.col(f"{c}{suffix}")
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"), F.round(F.avg(x), 6).alias("rate_before"), F.round(F.avg(y), 6).alias("rate_after"),
                F.round(F.abs(F.avg(y) - F.avg(x)), 6).alias("abs_diff"),
                F.count_if(x == 0).alias("zeros_before"), F.count_if(x == 1).alias("ones_before"),
                F.count_if(y == 0).alias("zeros_after"), F.count_if(y == 1).alias("ones_after"),
            ).alias(c)
        )
    return df.agg(*entries).select(F.inline(F.array(*columns)))


def posterior(p: Number, q: Number, prior: Number) -> Column:
    """Probability that the true value is 1 given that 1 was reported."""
    p, q, prior = _c(p), _c(q), _c(prior)
    return ratio((1 - p * q) * prior, (1 - p) * prior + p * (1 - q))


def estimate_rate(noisy: Number, p: Number, q: Number) -> Column:
    """Unbiased estimate of the true rate from the noisy rate; may leave [0, 1]."""
    noisy, p, q = _c(noisy), _c(p), _c(q)
    return ratio(noisy - p * (1 - q), 1 - p)


def estimate_variance(noisy: Number, n: Number, p: Number) -> Column:
    noisy, n, p = _c(noisy), _c(n), _c(p)
    return ratio(noisy * (1 - noisy), F.pow(1 - p, F.lit(2.0)) * n)


def estimate_groups(df: DataFrame, noisy: str, by: Sequence[str], p: float, q: float) -> DataFrame:
    """Noisy rate, estimate of the true rate and its variance per group (or overall)."""
    rates = df.groupBy(*by).agg(F.count(noisy).alias("n"), F.avg(noisy).alias("__r"))
    return rates.select(
        *by, "n", F.round("__r", 6).alias("noisy_rate"),
        F.round(estimate_rate(F.col("__r"), p, q), 6).alias("estimate"),
        F.round(estimate_variance(F.col("__r"), F.col("n"), p), 10).alias("variance"),
    )


#: Rows whose draws a task takes at once (enough for numpy, and few enough for a core's cache), and tasks for each core.
DRAWN_AT_ONCE, TASKS_A_CORE = 40_000, 4


def _replicate_counts(salt_text: str, replicates: int, p: float, q: float):
    """(rep, n, hits): rows of a task and the sum of their answers, for each replicate; both draws of a row come from one MD5."""
    less_p, less_q = (min(max(least_not_below(x), 0), 1 << 52) for x in (p, q))
    laid_out, digests = md5_words()
    at_once = DRAWN_AT_ONCE

    def answers(head, words, value):
        a, b, c, d = (w.byteswap().astype(np.uint64) for w in digests(head, words, len(value)))
        replaced = (a << np.uint64(20) | b >> np.uint64(12)) < np.uint64(less_p)
        noise = ((b & np.uint64(0xFFF)) << np.uint64(40) | c << np.uint64(8) | d >> np.uint64(24)) >= np.uint64(less_q)
        return int(np.where(replaced, noise, value).sum())

    def counted(hits, value, texts):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        heads = {len(h): [] for h in (f"{salt_text}|{r}|".encode() for r in range(replicates))}
        for r in range(replicates):
            heads[len(f"{salt_text}|{r}|".encode())].append(r)
        for size, reps in heads.items():
            blocks = (sizes + size + 72) // 64
            for count in np.unique(blocks).tolist():
                own = np.flatnonzero(blocks == count)
                width = int(sizes[own].max())
                tails = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in own.tolist()), np.uint8).reshape(len(own), width)
                words, values = laid_out(size, tails, sizes[own]), value[own]
                for r in reps:
                    hits[r] += answers(f"{salt_text}|{r}|".encode(), words, values)

    def run(batches):
        n, hits, values, texts = 0, [0] * replicates, [], []
        for batch in batches:
            values.append(batch.column(0).to_numpy().astype(np.int64))
            texts += batch.column(1).cast(pa.binary()).to_pylist()
            if len(texts) >= at_once:
                n += len(texts)
                counted(hits, np.concatenate(values), texts)
                values, texts = [], []
        if texts:
            n += len(texts)
            counted(hits, np.concatenate(values), texts)
        arrays = [pa.array(range(replicates), pa.int32()), pa.array([n] * replicates, pa.int64()), pa.array(hits, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["rep", "n", "hits"])

    return run


def simulate_estimates(df: DataFrame, column: str, key: str, p: float, q: float, seed: str, replicates: int) -> DataFrame:
    """Replicated response and estimation: (rep, noisy_rate, estimate, variance, normal_density).

    A task draws all replicates of its rows, many rows at a time, and returns one row a replicate. A narrow table may be one
    partition; two narrow columns of it are spread over more tasks than there are cores. The estimates, one row a replicate, are
    written before their mean is taken. The density is that of the normal limit around the mean estimate.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("int").alias("value"), text.alias("text"))
    rows = rows.where(F.col("value").isNotNull()).repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
    found = rows.mapInArrow(_replicate_counts(f"{seed}|{column}|pair", replicates, p, q), "rep int, n long, hits long")
    total = found.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    rates = total.where(F.col("n") > 0).select("rep", "n", (F.col("hits") / F.col("n")).alias("r"))
    estimates = rates.select(
        "rep", F.col("r"), estimate_rate(F.col("r"), p, q).alias("e"), estimate_variance(F.col("r"), F.col("n"), p).alias("v")
    )
    estimates = materialize(estimates, "estimates")
    centre = estimates.agg(F.avg("e").alias("m"))
    spread = F.lit(1.0) / F.sqrt(F.lit(2 * pi) * F.col("v"))
    density = spread * F.exp(-F.pow(F.col("e") - F.col("m"), F.lit(2.0)) / (2 * F.col("v")))
    return estimates.withColumn("m", centre.scalar()).select(
        "rep", F.round("r", 6).alias("noisy_rate"), F.round("e", 6).alias("estimate"), F.round("v", 10).alias("variance"),
        F.round(density, 4).alias("normal_density"),
    )


def suppress(df: DataFrame, key: str, p: float, seed: str) -> DataFrame:
    """Every row is left out with probability p; budget -ln p."""
    return df.where(uniform(salt(seed, "suppress"), key) >= F.lit(p))


def suppression_epsilon(p: Number) -> Column:
    return -F.log(_c(p))


def laplace_sample(key: str, scale: float, seed: str) -> Column:
    return laplace_noise(uniform(salt(seed, "laplace"), key), scale)


def laplace_density(x: Column, scale: float) -> Column:
    """Density at x of Laplace noise with mean 0 and scale b."""
    return F.exp(-F.abs(x) / F.lit(scale)) / F.lit(2 * scale)


def laplace_mechanism(
    df: DataFrame, columns: Sequence[str], key: str, epsilon: float | None, seed: str,
    bounds: dict[str, tuple[float, float]] | None = None, suffix: str = "_dp",
) -> DataFrame:
    """Adds `<c><suffix>` = value + Laplace noise of scale sensitivity / epsilon.

    With `bounds` the value is clipped to them and the sensitivity is their distance. Without, the
    sensitivity is max - min of the data (1 when that is 0), which reproduces the usual exercise but
    depends on the data itself and is therefore no strict guarantee. Without an epsilon no noise is
    added; one that is not positive is an error.
    """
    if epsilon is not None and not epsilon > 0:
        raise ValueError("epsilon must be positive")
    if epsilon is None:
        return df.select("*", *[F.col(c).cast("double").alias(f"{c}{suffix}") for c in columns])
    bounds = bounds or {}
    free = [c for c in columns if c not in bounds]
    if free:
        width = {c: (F.max(c) - F.min(c)).cast("double") for c in free}
        spans = df.agg(F.struct(*[F.coalesce(F.when(width[c] != 0, width[c]), F.lit(1.0)).alias(c) for c in free]).alias("s"))
        df_s = df.withColumn("__s", spans.scalar())
    else:
        df_s = df
    out = []
    for c in columns:
        u = uniform(salt(seed, c, 0), key)
        x = F.col(c).cast("double")
        if c in bounds:
            lo, hi = (float(b) for b in bounds[c])
            x = F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)
            scale = F.lit((hi - lo or 1.0) / epsilon)
        else:
            scale = F.col(f"__s.{c}") / F.lit(float(epsilon))
        out.append((x + laplace_noise(u, scale)).alias(f"{c}{suffix}"))
    return df_s.select(*df.columns, *out)


def compare_means(df: DataFrame, column: str, noisy: str) -> DataFrame:
    return df.agg(F.round(F.avg(column), 4).alias("true_mean"), F.round(F.avg(noisy), 4).alias("private_mean"))


def private_histogram(df: DataFrame, column: str, bins: int, epsilon: float, seed: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Histogram whose counts carry Laplace noise of scale 1/epsilon, drawn once per bin.

    With `bounds` values are clipped to them and they are the outer edges. Without, the edges are the
    exact minimum and maximum of the data, which the noise does not protect.
    """
    if not epsilon > 0:
        raise ValueError("epsilon must be positive")
    if bounds is None:
        bars = histogram(df, column, bins)
    else:
        lo, hi = (float(b) for b in bounds)
        x = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(column).cast("double")))
        place = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
        counted = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        bars = every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    noise = laplace_noise(uniform(salt(seed, column, 0), "bin"), 1.0 / epsilon)
    return bars.select("bin", "n", F.round(F.col("n") + noise, 6).alias("private_n"))
