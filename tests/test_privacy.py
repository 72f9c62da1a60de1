import json

import pytest
from pyspark.sql import functions as F

from veil.operators import clean as C
from veil.operators import diversity as D
from veil.operators import dp as DP
from veil.operators import perturb as PT
from veil.operators import release as R
from veil.operators import risk as RK
from veil.plans.risk_queries import QUASI, SENSITIVE
from veil.roles import Roles
from veil.sources import views as V

SIZES = [1, 2, 4, 5, 14, 15, 16]


@pytest.fixture(scope="module")
def uniform_groups(spark):
    rows, i = [], 0
    for size in SIZES:
        for _ in range(size):
            rows.append((i, f"g{size}", 0, 7))
            i += 1
    for v in (0, 1, 1):
        rows.append((i, "mixed", v, 7))
        i += 1
    return spark.createDataFrame(rows, "id int, g string, flag int, fixed int")


def test_flips_per_class_size(uniform_groups):
    out = PT.enforce_diversity(uniform_groups, "id", ["g"], ["flag", "fixed"], "s", keep_before=True)
    flipped = {r["g"]: r["n"] for r in out.groupBy("g").agg(F.count_if(F.col("flag") != F.col("flag_before")).alias("n")).collect()}
    assert flipped == {"g1": 0, "g2": 1, "g4": 1, "g5": 1, "g14": 2, "g15": 3, "g16": 3, "mixed": 0}
    assert out.where("fixed <> fixed_before").count() == 0
    assert out.count() == uniform_groups.count()


def test_multi_valued_attribute_cycles_over_other_values(spark):
    rows = [(i, "same", 2) for i in range(20)] + [(100 + i, f"o{i}", v) for i, v in enumerate([1, 2, 3])]
    df = spark.createDataFrame(rows, "id int, g string, a int")
    out = PT.enforce_diversity(df, "id", ["g"], ["a"], "s", binary=[], keep_before=True)
    new = sorted(r["a"] for r in out.where("g = 'same' and a <> a_before").collect())
    assert new == [1, 1, 3]
    details = PT.perturbation_details(out, ["g"], ["a"]).collect()
    assert [(d["original_value"], d["new_value"], d["n_flipped"], d["class_size"]) for d in details] == [("2", "various", 3, 20)]


def test_enforced_table_is_diverse_and_classes_keep_their_size(spark, sf_dir):
    rows = V.clean_appointments(spark, sf_dir)
    out = PT.enforce_diversity(rows, "appointment_id", QUASI, SENSITIVE, "x", keep_before=True)
    small = D.class_diversity(out, QUASI, SENSITIVE).where("k >= 2 and min_l < 2").count()
    assert small == 0
    before = sorted(map(tuple, RK.class_sizes(rows, QUASI).collect()), key=str)
    assert before == sorted(map(tuple, RK.class_sizes(out, QUASI).collect()), key=str)
    report = PT.perturbation_report(out, QUASI, SENSITIVE).collect()
    n = rows.count()
    assert all(r["tvd"] <= r["n_changed"] / n + 1e-6 for r in report)


def test_missing_level_counts_as_zero(spark):
    rows = [("a", "x")] * 4 + [("a", "y")] * 4 + [("b", "x")] * 2 + [("b", "z")] * 10 + [("c", None)] * 2
    df = spark.createDataFrame(rows, "g string, s string")
    n = len(rows)
    share = {v: sum(r[1] == v for r in rows) / n for v in "xyz"}
    expected = {}
    for g in "ab":
        mine = [r[1] for r in rows if r[0] == g]
        expected[g] = max(abs(mine.count(v) / len(mine) - share[v]) for v in "xyz")
    for ranges in (1, 3, None):
        got = {r["g"]: r["distance"] for r in D.frequency_distance(df, ["g"], "s", ranges).collect()}
        assert got == pytest.approx(expected)


def test_two_distances_differ(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "z")], "g string, s string")
    pointwise = {r["g"]: r["distance"] for r in D.frequency_distance(df, ["g"], "s").collect()}
    assert pointwise["a"] == pytest.approx(0.5)
    tvd = D.total_variation(df.where("g = 'a'"), df.where("g = 'b'"), "s").first()["tvd"]
    assert tvd == 1.0


def test_response_moments_and_estimator(spark):
    p, q = 0.4, 0.7
    df = spark.range(20_000).withColumn("x", (F.col("id") % 4 == 0).cast("int"))
    noisy = df.withColumn("y", DP.randomized_response("x", "id", p, q, "t"))
    rate = noisy.agg(F.avg("y")).first()[0]
    assert rate == pytest.approx((1 - p) * 0.25 + p * (1 - q), abs=0.015)
    row = DP.estimate_groups(noisy, "y", [], p, q).first()
    assert abs(row["estimate"] - 0.25) < 4 * row["variance"] ** 0.5


def test_simulated_estimates_scatter_as_predicted(spark):
    df = spark.range(1500).withColumn("x", (F.col("id") % 5 == 0).cast("int"))
    sims = DP.simulate_estimates(df, "x", "id", 0.5, 0.5, "sim", 60).toPandas()
    sd = sims["variance"].mean() ** 0.5
    assert abs(sims["estimate"].mean() - 0.2) < 4 * sd / 60**0.5
    assert 0.6 < sims["estimate"].std() / sd < 1.5


def test_simulated_estimates_equal_draws_one_by_one(spark):
    """Keys of several lengths, repeated and null ones, digests of one and of two blocks, and values that are absent."""
    import hashlib

    keys = [None, "", "7", "12", "12", "é", "k" * 30, "k" * 31, "k" * 32, "k" * 33, "k" * 90, *map(str, range(95, 140))]
    rows = [(k, None if i == 3 else i % 2) for i, k in enumerate(keys)]
    seed, reps, p, q = "s" * 9, 12, 0.6, 0.3
    got = DP.simulate_estimates(spark.createDataFrame(rows, "id string, x int"), "x", "id", p, q, seed, reps).collect()

    def answer(rep, key, value):
        text = hashlib.md5(f"{seed}|x|pair|{rep}|{key or ''}".encode()).hexdigest()
        a, b = ((int(d, 16) + 0.5) / 2**52 for d in (text[:13], text[13:26]))
        return value if a >= p else 0 if b < q else 1

    held = [(k, v) for k, v in rows if v is not None]
    assert {r["rep"]: r["noisy_rate"] for r in got} == {t: round(sum(answer(t, k, v) for k, v in held) / len(held), 6) for t in range(reps)}
    assert DP.simulate_estimates(spark.createDataFrame([], "id string, x int"), "x", "id", p, q, seed, reps).count() == 0


def test_simulated_estimates_do_not_multiply_rows(spark, monkeypatch):
    """A row and a digest by Spark for each row and replicate is what a large table cannot afford."""
    def refuse(*_):
        raise AssertionError("rows are multiplied")

    monkeypatch.setattr(DP.F, "explode", refuse)
    df = spark.range(100).withColumn("x", (F.col("id") % 5 == 0).cast("int"))
    assert DP.simulate_estimates(df, "x", "id", 0.5, 0.5, "sim", 3).count() == 3


def test_epsilon_forms(spark):
    row = spark.range(1).select(
        DP.epsilon_likelihood(0.3, 0.5).alias("a"), DP.epsilon_product(0.3, 0.5).alias("b"), DP.epsilon_likelihood(0.3, 1.0).alias("c")
    ).first()
    assert row["a"] == pytest.approx(1.7346, abs=1e-4) == pytest.approx(DP.epsilon_value(0.3, 0.5), abs=1e-4)
    assert row["b"] == pytest.approx(1.8971, abs=1e-4)
    assert row["c"] == float("inf")


def test_laplace_without_epsilon_and_on_a_constant(spark):
    df = spark.range(50).withColumn("v", F.lit(3))
    same = DP.laplace_mechanism(df, ["v"], "id", None, "s").agg(F.min("v_dp"), F.max("v_dp")).first()
    assert tuple(same) == (3.0, 3.0)
    with pytest.raises(ValueError):
        DP.laplace_mechanism(df, ["v"], "id", 0.0, "s")
    noisy = DP.laplace_mechanism(df, ["v"], "id", 1.0, "s").agg(F.count_distinct("v_dp")).first()[0]
    assert noisy == 50


def test_drop_and_clamp_policies_keep_nulls(spark):
    df = spark.createDataFrame([(-3,), (5,), (130,), (None,)], "age int")
    kept, report = C.drop_failing(df, {"low": F.col("age") < 0, "high": F.col("age") > 120})
    assert [r[0] for r in kept.collect()] == [5, None]
    assert tuple(report.first()) == (4, 1, 1, 2)
    out = df.select(C.cap_high(C.clamp_low(F.col("age"), 0), 100).alias("a")).collect()
    assert [r[0] for r in out] == [0, 5, 100, None]


def test_lead_time_granularities(spark):
    df = spark.createDataFrame(
        [("2024-05-02 18:00:00", "2024-05-02 00:00:00"), ("2024-05-02 08:00:00", "2024-05-03 00:00:00"), ("bad", "2024-05-03 00:00:00")],
        "s string, a string",
    ).select(C.parse_timestamp(F.col("s")).alias("s"), C.parse_timestamp(F.col("a")).alias("a"))
    rows = df.select(C.lead_days_by_date(F.col("s"), F.col("a")), C.lead_days_by_time(F.col("s"), F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(0, -1), (1, 0), (None, None)]


def test_unmapped_values_and_default(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "n string")
    lookup = spark.createDataFrame([("a", "A")], "k string, v string")
    out = C.generalize(df, "n", lookup, "k", "v", "Other", "r").collect()
    assert {r["n"]: r["r"] for r in out} == {"a": "A", "b": "Other", None: "Other"}
    assert [r[0] for r in C.unmapped_values(df, "n", lookup, "k").collect()] == ["b"]


def test_one_hot_levels(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "c string, i int")
    out = C.one_hot(df, "c", "C", ["a", "b"], drop_first=True)
    assert out.columns == ["i", "C_b"]
    assert [r["C_b"] for r in out.orderBy("i").collect()] == [0, 1, 0]
    assert C.one_hot(df, "c", "C", ["a", "z"]).agg(F.sum("C_a"), F.sum("C_z")).first() == (1, 0)


ROLES = Roles(key="id", identifiers=["pid", "id"], quasi=["g"], sensitive=["flag"], target="y", group="pid")


def test_gate_and_release_sink(spark, tmp_path):
    rows = [(i, i % 7, "a" if i < 30 else "b", i % 2, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, pid int, g string, flag int, y boolean").withColumn("y", F.col("y").cast("int"))
    R.check_gate(df, ROLES, k=10, l=2)
    with pytest.raises(R.GateError):
        R.check_gate(df, ROLES, k=11)
    path = str(tmp_path / "release")
    with pytest.raises(R.GateError):
        R.write_release(df, ROLES, path, k=11, partition_by=["g"])
    R.write_release(df, ROLES, path, k=10, l=2, t=0.9, partition_by=["g"])
    unknown = df.withColumn("y", F.when(F.col("g") == "a", F.col("y")))
    with pytest.raises(R.GateError):
        R.check_gate(unknown, ROLES, k=10, t=1.0)
    back = spark.read.parquet(path)
    assert set(back.columns) == {"g", "flag", "y"} and back.count() == 40
    R.write_results(df.groupBy("g").count(), str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2


def test_release_is_published_whole_or_not_at_all(spark, tmp_path):
    rows = [(i, i % 7, "a" if i < 30 else "b", i % 2, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, pid int, g string, flag int, y boolean").withColumn("y", F.col("y").cast("int"))
    path = str(tmp_path / "release")
    # a task fails after others have written
    broken = df.withColumn("flag", F.when(F.col("id") == 39, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("flag")))
    with pytest.raises(Exception, match="broken"):
        R.write_release(broken, ROLES, path, k=10, verified=df)
    # what is written is not what was verified: rows are missing, or classes are cut below k
    for part in (df.where("id <> 3"), df.unionByName(df.limit(1)), df.withColumn("g", F.when(F.col("id") == 3, "c").otherwise(F.col("g")))):
        with pytest.raises(R.GateError):
            R.write_release(part, ROLES, path, k=10, verified=df)
    assert list(tmp_path.iterdir()) == []
    found = R.write_release(df, ROLES, path, k=10, l=2, partition_by=["g"])
    assert found == {"rows": 40, "min_k": 10, "classes": 2}
    assert [p.name for p in tmp_path.iterdir()] == ["release"]
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    assert manifest["rows"] == 40 and manifest["k"] == 10 and set(manifest["columns"]) == {"g", "flag", "y"}
    with pytest.raises(FileExistsError):
        R.write_release(df, ROLES, path, k=10)
    assert spark.read.parquet(path).count() == 40


def test_classes_beyond_t_are_withheld(spark):
    rows = [(i, i, g, i % 2, y) for i, (g, y) in enumerate([("a", 1)] * 10 + [("b", i % 2) for i in range(60)] + [("c", 1)])]
    df = spark.createDataFrame(rows, "id int, pid int, g string, flag int, y int")
    kept = {r["g"] for r in R.releasable_classes(df, ROLES, 2, 2, 0.2).collect()}
    assert kept == {"b"}
    with pytest.raises(R.GateError):
        R.check_gate(df, ROLES, k=2, l=2, t=0.2)
    b = df.where("g = 'b'")
    assert R.check_gate(b, ROLES, k=2, l=2, t=0.2, population=df) == {"k": 0, "l": 0, "t": 0}
    with pytest.raises(R.GateError):  # by the rate of the whole table, not by its own
        R.check_gate(b, ROLES, k=2, l=2, t=0.05, population=df)


def test_combined_protection_parts_are_optional(spark, sf_dir):
    df = V.health(spark, sf_dir).select("admission_id", "age", "hospital", "hours_hospitalized", "released_sameday", "has_diabetes")
    same = R.protect(df, "admission_id", ["hours_hospitalized"], ["released_sameday"], ["age", "hospital"], None, None, None, None)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, df.collect()))
    out = R.protect(df, "admission_id", ["hours_hospitalized"], ["released_sameday"], ["age", "hospital"], 1.0, 0.3, 0.5, 20)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.groupBy("age", "hospital").count().agg(F.min("count")).first()[0] >= 20
    assert set(r[0] for r in out.select("released_sameday").distinct().collect()) <= {0, 1}


def test_row_wise_protection_accepts_a_stream(spark, sf_dir, tmp_path):
    source = V.health(spark, sf_dir).select("admission_id", "age", "released_sameday")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))

    def noisy(df):
        df = DP.respond_all(df, ["released_sameday"], "admission_id", 0.3, 0.5, "s")
        return DP.laplace_mechanism(df, ["age"], "admission_id", 1.0, "s", {"age": (0, 100)})

    query = (
        noisy(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    batch = sorted(map(tuple, noisy(source).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == batch
