import random
from math import inf

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veil.functions.exprs import bin_column
from veil.functions.lineage import materialize, shared_folder
from veil.functions.ordered import quantiles_from_counts, ranges_for, ranked_by_uniform, running_sums
from veil.functions.rand import laplace_noise, salt, uniform

AGES = [-1, 0, 14, 15, 18, 24, 25, 64, 65, 119, 120, None]


@pytest.mark.parametrize("closed", ["left", "right"])
def test_bins_match_pandas(spark, closed):
    edges, labels = [0, 15, 25, 45, 65, 120], ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(AGES)], "i int, age int")
    got = [r[0] for r in df.orderBy("i").select(bin_column(F.col("age"), edges, labels, closed)).collect()]
    expected = pd.cut(pd.Series(AGES, dtype="float"), edges, labels=labels, right=closed == "right")
    assert got == [None if pd.isna(v) else v for v in expected]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 200), min_size=1, max_size=60), st.lists(st.integers(-20, 150), min_size=3, max_size=6, unique=True))
def test_bins_match_pandas_random(spark, values, edges):
    edges = [-inf, *sorted(edges), inf]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    for closed in ("left", "right"):
        got = [r[0] for r in df.orderBy("i").select(bin_column(F.col("v"), edges, None, closed)).collect()]
        assert got == list(pd.cut(pd.Series(values, dtype=float), edges, labels=False, right=closed == "right"))


@pytest.mark.parametrize("ranges", [1, 3, 7, None])
def test_running_sums_numbers(spark, ranges):
    rng = random.Random(1)
    rows = [(g, float(v), rng.randint(1, 5)) for g in ("a", "b", None) for v in rng.sample(range(1000), 40)]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    got = running_sums(df, "v", ["n"], ["g"], ranges).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r["g"]]
        assert r["cum_n"] == sum(x[2] for x in mine if x[1] <= r["v"])
        assert r["total_n"] == sum(x[2] for x in mine)


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_running_sums_strings(spark, ranges):
    words = sorted({f"w{random.Random(i).randint(0, 10**6)}" for i in range(80)})
    df = spark.createDataFrame([(w, 1) for w in words], "w string, n bigint").repartition(5)
    got = {r["w"]: r["cum_n"] for r in running_sums(df, "w", ["n"], ranges=ranges).collect()}
    assert got == {w: i + 1 for i, w in enumerate(words)}


@pytest.mark.parametrize("ranges", [1, 4])
def test_quantiles_match_pandas(spark, ranges):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 10), 2) for _ in range(301)] + [0.0] * 150
    counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").count()
    row = quantiles_from_counts(counts, "v", "count", {"a": 0.1, "m": 0.5, "z": 0.99}, ranges=ranges).first()
    expected = pd.Series(values).quantile([0.1, 0.5, 0.99])
    assert [row["a"], row["m"], row["z"]] == pytest.approx(list(expected))


def test_rank_by_uniform_is_exact_in_a_hot_group(spark):
    df = spark.range(900).select("id", F.when(F.col("id") < 800, 0).otherwise(1).alias("g")).withColumn("u", uniform("x", "id"))
    ranked = ranked_by_uniform(df, "u", "id", ["g"], ranges=6).toPandas()
    for _, part in ranked.groupby("g"):
        part = part.sort_values("u")
        assert list(part["rank"]) == list(range(1, len(part) + 1))
        assert set(part["group_size"]) == {len(part)}


def test_uniforms_do_not_depend_on_partitioning(spark):
    df = spark.range(500)
    draws = [sorted(r[0] for r in df.repartition(n).select(uniform(salt("s", "c"), "id")).collect()) for n in (1, 7, 64)]
    assert draws[0] == draws[1] == draws[2]
    assert 0 < draws[0][0] and draws[0][-1] < 1
    other = df.select(F.corr(uniform(salt("s", "c"), "id"), uniform(salt("s", "d"), "id"))).first()[0]
    assert abs(other) < 0.2


def test_laplace_moments(spark):
    x = laplace_noise(uniform("lap", "id"), 2.0)
    mean, mean_abs = spark.range(40_000).agg(F.avg(x), F.avg(F.abs(x))).first()
    assert abs(mean) < 0.06 and abs(mean_abs - 2) < 0.06


def test_materialize_reads_back_the_same_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    again = materialize(df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_ranges_follow_the_size():
    assert ranges_for(0) == ranges_for(1_000_000) == 1
    assert ranges_for(1_000_001) == 2
    assert ranges_for(10**12) == 10**6


def test_scratch_of_a_session_can_be_dropped(spark, tmp_path, monkeypatch):
    from veil.functions import lineage

    monkeypatch.setattr(lineage, "shared_folder", lambda s: str(tmp_path))
    assert materialize(spark.range(3)).count() == 3
    assert any(tmp_path.iterdir())
    assert lineage.drop_scratch(spark)
    assert not any(p for p in tmp_path.iterdir() if not p.name.startswith("."))


@pytest.mark.parametrize("ranges", [None, 3])
def test_bracketed_quantiles_match_pandas(spark, ranges):
    from veil.functions import ordered

    rng = random.Random(8)
    data = pd.DataFrame({"a": [rng.gauss(0, 5) for _ in range(6000)], "hot": [7.0] * 2500 + [float(i) for i in range(3500)]})
    data.loc[:300, "a"] = None
    df = spark.createDataFrame([(None if pd.isna(a) else float(a), float(h), None) for a, h in data.itertuples(index=False)], "a double, hot double, none double").repartition(6)
    qs = {"low": 0.0, "q": 0.25, "m": 0.5, "z": 0.999, "high": 1.0}
    got = {r["column_name"]: r for r in ordered.exact_quantiles(df, ["a", "hot", "none"], qs, ranges=ranges).collect()}
    assert set(got) == {"a", "hot"}
    for c in got:
        assert [got[c][k] for k in qs] == pytest.approx(list(data[c].quantile(list(qs.values()))))


def test_a_missed_bracket_falls_back_to_sorting(spark):
    from veil.functions import ordered

    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    sketches = ordered.column_sketches(df, ["v"], {"m": 0.5})
    sketches["v"]["brackets"]["m"] = (900.0, 950.0)
    assert ordered.exact_quantiles(df, ["v"], {"m": 0.5}, sketches).first()["m"] == 499.5
