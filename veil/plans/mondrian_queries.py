"""Queries of the Mondrian group (M, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.rand import salt, uniform  # noqa: F401
from veil.operators import mondrian as M
from veil.plans.registry import ADULT, HEALTH, query
from veil.sources import views as V

FEATURES = ["age", "hours_per_week"]
DEPTH = 32  # levels written out in the SQL; the queries have no limit, so a difference shows if these were too few


def partition_sql(source: str, key: str, numeric: list[str], categorical: list[str], order: list[str], k: int, depth: int,
                  sensitive: str | None = None, l: int | None = None, t: float | None = None) -> str:
    """Row-level Mondrian as a chain of CTEs ending in `part(key, pid)`, one block per level."""
    feats = order
    ctes = [f"r0 AS MATERIALIZED (SELECT *, '1' AS pid, true AS act FROM {source})"]
    full = ", ".join(
        f"count(DISTINCT {c})::DOUBLE AS fs_{c}" if c in categorical else f"(max({c}) - min({c}))::DOUBLE AS fs_{c}" for c in feats
    )
    ctes.append(f"fs AS MATERIALIZED (SELECT {full} FROM {source})")
    if t is not None:
        ctes.append(f"gl AS MATERIALIZED (SELECT {sensitive} AS lv, count(*)::DOUBLE / (SELECT count(*) FROM {source}) AS g FROM {source} GROUP BY 1)")
    for i in range(depth):
        stats = ["pid"]
        for c in feats:
            if c in categorical:
                stats.append(f"count(DISTINCT {c})::DOUBLE AS sp_{c}")
            else:
                stats.append(f"(max({c}) - min({c}))::DOUBLE AS sp_{c}, median({c}) AS md_{c}, min({c}) AS mn_{c}")
        ctes.append(f"s{i} AS MATERIALIZED (SELECT {', '.join(stats)} FROM r{i} WHERE act GROUP BY pid)")
        sides = []
        for c in feats:
            if c in categorical:
                sides.append(f"dense_rank() OVER (PARTITION BY r{i}.pid ORDER BY {c}) <= floor(sp_{c} / 2) AS lf_{c}")
            else:
                sides.append(f"CASE WHEN md_{c} = mn_{c} THEN {c} <= md_{c} ELSE {c} < md_{c} END AS lf_{c}")
        ctes.append(f"d{i} AS MATERIALIZED (SELECT r{i}.*, {', '.join(sides)} FROM r{i} JOIN s{i} ON r{i}.pid = s{i}.pid WHERE act)")
        cands = []
        for j, c in enumerate(feats):
            rule = f"count(*) FILTER (WHERE lf_{c}) >= {k} AND count(*) FILTER (WHERE NOT lf_{c}) >= {k}"
            if l is not None:
                rule += f" AND count(DISTINCT {sensitive}) FILTER (WHERE lf_{c}) >= {l} AND count(DISTINCT {sensitive}) FILTER (WHERE NOT lf_{c}) >= {l}"
            if t is not None:
                rule += f""" AND pid NOT IN (SELECT pid FROM (SELECT b.pid, b.lf, max(abs(coalesce(x.n, 0)::DOUBLE / b.n - g)) AS dist
                    FROM (SELECT pid, lf_{c} AS lf, count(*) AS n FROM d{i} GROUP BY 1, 2) b CROSS JOIN gl
                    LEFT JOIN (SELECT pid, lf_{c} AS lf, {sensitive} AS lv, count(*) AS n FROM d{i} GROUP BY 1, 2, 3) x ON x.pid = b.pid AND x.lf = b.lf AND x.lv = gl.lv
                    GROUP BY 1, 2) WHERE round(dist, 12) > {t})"""
            cands.append(
                f"SELECT pid, {j} AS j, (SELECT sp_{c} FROM s{i} z WHERE z.pid = d{i}.pid) / (SELECT CASE WHEN fs_{c} = 0 THEN 1 ELSE fs_{c} END FROM fs) AS rel"
                f" FROM d{i} GROUP BY pid HAVING {rule}"
            )
        ctes.append(f"c{i} AS MATERIALIZED (SELECT pid, arg_min(j, (-round(rel, 12), j)) AS j FROM ({' UNION ALL '.join(cands)}) GROUP BY pid)")
        lf = "CASE c.j " + " ".join(f"WHEN {j} THEN lf_{c}" for j, c in enumerate(feats)) + " END"
        cols = ", ".join(["d." + x for x in dict.fromkeys([key, *feats, *([sensitive] if sensitive else [])])])
        base = ", ".join(dict.fromkeys([key, *feats, *([sensitive] if sensitive else [])]))
        ctes.append(
            f"r{i + 1} AS MATERIALIZED (SELECT {base}, pid, act FROM r{i} WHERE NOT act UNION ALL"
            f" SELECT {cols}, CASE WHEN c.j IS NULL THEN d.pid WHEN {lf} THEN d.pid || '0' ELSE d.pid || '1' END, c.j IS NOT NULL"
            f" FROM d{i} d LEFT JOIN c{i} c ON d.pid = c.pid)"
        )
    ctes.append(f"part AS MATERIALIZED (SELECT {key}, pid FROM r{depth})")
    return ", ".join(ctes)


def adult(spark, sf):
    return V.adult(spark, sf)


def health(spark, sf):
    return V.health(spark, sf)


KA = 150  # k of the checked runs; small enough for several levels at every scale factor
ADULT_PART = f"{ADULT}, {partition_sql('adult', 'person_id', FEATURES, [], FEATURES, KA, DEPTH, 'income')}"
HEALTH_FEATURES = ["age", "hospital", "marital_status"]
HEALTH_PART = (
    f"{HEALTH}, {partition_sql('health', 'admission_id', ['age'], ['hospital', 'marital_status'], HEALTH_FEATURES, 100, 4, 'has_diabetes')}"
)


def adult_partitioning(spark, sf):
    return M.partition(adult(spark, sf), FEATURES, M.Validity(KA), "income")


def health_partitioning(spark, sf):
    return M.partition(health(spark, sf), HEALTH_FEATURES, M.Validity(100), "has_diabetes", max_depth=4)


@query(
    "m1_full_spans",
    f"""WITH {HEALTH} SELECT 'age' AS feature, (max(age) - min(age))::DOUBLE AS span FROM health UNION ALL SELECT 'hospital', count(DISTINCT hospital)::DOUBLE FROM health
    UNION ALL SELECT 'marital_status', count(DISTINCT marital_status)::DOUBLE FROM health""",
)
def m1(spark, sf):
    return M.spans(health(spark, sf), HEALTH_FEATURES)


@query(
    "m1_relative_spans",
    f"""WITH {HEALTH} SELECT hospital, feature, round(span / full_span, 6) AS relative_span FROM
    (SELECT hospital, 'age' AS feature, (max(age) - min(age))::DOUBLE AS span, (SELECT (max(age) - min(age))::DOUBLE FROM health) AS full_span FROM health GROUP BY 1
    UNION ALL SELECT hospital, 'marital_status', count(DISTINCT marital_status)::DOUBLE, (SELECT count(DISTINCT marital_status)::DOUBLE FROM health) FROM health GROUP BY 1)""",
)
def m1b(spark, sf):
    features = ["age", "marital_status"]
    whole = M.spans(health(spark, sf), features).withColumnRenamed("span", "full_span")
    parts = M.spans(health(spark, sf), features, by=["hospital"])
    return parts.join(whole, "feature").select("hospital", "feature", F.round(M.relative_span(), 6).alias("relative_span"))


@query(
    "m2_split_points",
    f"""WITH {HEALTH}, m AS (SELECT hospital, median(age) AS md, min(age) AS mn FROM health GROUP BY 1),
    q AS (SELECT hospital, marital_status AS ms, dense_rank() OVER (PARTITION BY hospital ORDER BY marital_status) AS rk FROM health),
    c AS (SELECT hospital, count(DISTINCT ms) AS n FROM q GROUP BY 1)
    SELECT h.hospital AS part_id, 'age' AS feature, count(*) FILTER (WHERE CASE WHEN md = mn THEN age <= md ELSE age < md END) AS n_left,
    count(*) FILTER (WHERE NOT CASE WHEN md = mn THEN age <= md ELSE age < md END) AS n_right, md::DOUBLE AS cut FROM health h JOIN m USING (hospital) GROUP BY ALL
    UNION ALL SELECT hospital, 'marital_status', count(*) FILTER (WHERE rk <= n // 2), count(*) FILTER (WHERE rk > n // 2), (max(n // 2) - 1)::DOUBLE FROM q JOIN c USING (hospital) GROUP BY 1""",
)
def m2(spark, sf):
    features = ["age", "marital_status"]
    _, splits, _ = M.single_level(health(spark, sf), features, by="hospital")
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("j") + 1)
    return splits.select("part_id", name.alias("feature"), "n_left", "n_right", "cut")


def _validity_sql(rule: str, extra: str = "") -> str:
    return f"""WITH {ADULT}, m AS (SELECT workclass, median(age) AS md, min(age) AS mn FROM adult GROUP BY 1),
    d AS (SELECT a.*, CASE WHEN md = mn THEN age <= md ELSE age < md END AS lf FROM adult a JOIN m USING (workclass)){extra}
    SELECT workclass AS part_id, {rule} AS valid FROM d GROUP BY 1"""


K3 = 1450


@query("m3_valid_k", _validity_sql(f"count(*) FILTER (WHERE lf) >= {K3} AND count(*) FILTER (WHERE NOT lf) >= {K3}"))
def m3(spark, sf):
    _, splits, _ = M.single_level(adult(spark, sf), ["age"], by="workclass")
    return splits.select("part_id", ((F.col("n_left") >= K3) & (F.col("n_right") >= K3)).alias("valid"))


def _rule_flags(spark, sf, rule, sensitive):
    from veil.operators.diversity import rank_levels

    cells, splits, _ = M.single_level(adult(spark, sf), ["age"], by="workclass", extra=[sensitive])
    levels = rank_levels(cells, sensitive, "n")
    kept = M._sensitive_rules(cells, splits, 1, sensitive, rule, levels).select("part_id", F.lit(True).alias("ok"))
    return splits.select("part_id").join(kept, "part_id", "left").select("part_id", F.coalesce("ok", F.lit(False)).alias("valid"))


@query("m4_valid_l", _validity_sql("count(DISTINCT native_country) FILTER (WHERE lf) >= 25 AND count(DISTINCT native_country) FILTER (WHERE NOT lf) >= 25"))
def m4(spark, sf):
    return _rule_flags(spark, sf, M.Validity(l=25), "native_country")


@query(
    "m5_valid_t",
    f"""WITH {ADULT}, m AS (SELECT workclass, median(age) AS md, min(age) AS mn FROM adult GROUP BY 1),
    d AS (SELECT a.*, CASE WHEN md = mn THEN age <= md ELSE age < md END AS lf FROM adult a JOIN m USING (workclass)),
    g AS (SELECT education AS lv, count(*)::DOUBLE / (SELECT count(*) FROM adult) AS g FROM adult GROUP BY 1), b AS (SELECT workclass, lf, count(*) AS n FROM d GROUP BY 1, 2),
    x AS (SELECT workclass, lf, education AS lv, count(*) AS n FROM d GROUP BY 1, 2, 3),
    y AS (SELECT b.workclass, b.lf, max(abs(coalesce(x.n, 0)::DOUBLE / b.n - g)) AS dist FROM b CROSS JOIN g LEFT JOIN x ON x.workclass = b.workclass AND x.lf = b.lf AND x.lv = g.lv GROUP BY 1, 2)
    SELECT workclass AS part_id, max(dist) <= 0.02 AS valid FROM y GROUP BY 1""",
)
def m5(spark, sf):
    return _rule_flags(spark, sf, M.Validity(t=0.02), "education")


@query("m6_partition_k", f"WITH {ADULT_PART} SELECT pid AS part_id, count(*) AS n, min(age) AS min_age, max(age) AS max_age, min(hours_per_week) AS min_hours, max(hours_per_week) AS max_hours FROM part JOIN adult USING (person_id) GROUP BY 1")
def m6(spark, sf):
    p = adult_partitioning(spark, sf)
    return p.cells.groupBy("part_id").agg(
        F.sum("n").alias("n"), F.min("age").alias("min_age"), F.max("age").alias("max_age"),
        F.min("hours_per_week").alias("min_hours"), F.max("hours_per_week").alias("max_hours"),
    )


ADULT_PART_3 = f"{ADULT}, {partition_sql('adult', 'person_id', FEATURES, [], FEATURES, 3, DEPTH)}"


@query("m6_partition_k3", f"WITH {ADULT_PART_3} SELECT pid AS part_id, count(*) AS n FROM part GROUP BY 1")
def m6b(spark, sf):
    p = M.partition(adult(spark, sf), FEATURES, M.Validity(3))
    return p.cells.groupBy("part_id").agg(F.sum("n").alias("n"))


ADULT_PART_L = f"{ADULT}, {partition_sql('adult', 'person_id', FEATURES, [], FEATURES, 30, DEPTH, 'income', l=2)}"
ADULT_PART_T = f"{ADULT}, {partition_sql('adult', 'person_id', FEATURES, [], FEATURES, 30, DEPTH, 'income', t=0.05)}"


@query("m6_partition_kl", f"WITH {ADULT_PART_L} SELECT pid AS part_id, count(*) AS n FROM part GROUP BY 1")
def m6c(spark, sf):
    p = M.partition(adult(spark, sf), FEATURES, M.Validity(30, l=2), "income")
    return p.cells.groupBy("part_id").agg(F.sum("n").alias("n"))


@query("m6_partition_kt", f"WITH {ADULT_PART_T} SELECT pid AS part_id, count(*) AS n FROM part GROUP BY 1")
def m6d(spark, sf):
    p = M.partition(adult(spark, sf), FEATURES, M.Validity(30, t=0.05), "income")
    return p.cells.groupBy("part_id").agg(F.sum("n").alias("n"))


@query("m7_partition_bounded", f"WITH {HEALTH_PART} SELECT pid AS part_id, count(*) AS n FROM part GROUP BY 1")
def m7(spark, sf):
    p = health_partitioning(spark, sf)
    return p.cells.groupBy("part_id").agg(F.sum("n").alias("n"))


ADULT_PART_LT = f"{ADULT}, {partition_sql('adult', 'person_id', FEATURES, [], FEATURES, 50, DEPTH, 'income', l=2, t=0.2)}"


@query("m8_composed_rules", f"WITH {ADULT_PART_LT} SELECT pid AS part_id, count(*) AS n FROM part GROUP BY 1")
def m8(spark, sf):
    p = M.partition(adult(spark, sf), FEATURES, M.Validity(50, l=2, t=0.2), "income")
    return p.cells.groupBy("part_id").agg(F.sum("n").alias("n"))


@query(
    "m9_release_table",
    f"""WITH {ADULT_PART}, pa AS (SELECT * FROM part JOIN adult USING (person_id)), b AS (SELECT pid, round(avg(age), 6) AS age, round(avg(hours_per_week), 6) AS hours_per_week FROM pa GROUP BY 1)
    SELECT pa.pid AS part_id, b.age, b.hours_per_week, income, count(*) AS count FROM pa JOIN b ON pa.pid = b.pid GROUP BY ALL""",
)
def m9(spark, sf):
    out = M.release_table(adult(spark, sf), adult_partitioning(spark, sf), "income")
    return out.withColumns({c: F.round(c, 6) for c in FEATURES})


@query(
    "m9_release_table_limited",
    f"""WITH {HEALTH_PART}, pa AS (SELECT * FROM part JOIN health USING (admission_id)), b AS (SELECT pid, round(avg(age), 6) AS age, string_agg(DISTINCT hospital, ',' ORDER BY hospital) AS hospital,
    string_agg(DISTINCT marital_status, ',' ORDER BY marital_status) AS marital_status FROM pa GROUP BY 1 ORDER BY pid LIMIT 5)
    SELECT pa.pid AS part_id, b.age, b.hospital, b.marital_status, has_diabetes, count(*) AS count FROM pa JOIN b ON pa.pid = b.pid GROUP BY ALL""",
)
def m9b(spark, sf):
    out = M.release_table(health(spark, sf), health_partitioning(spark, sf), "has_diabetes", max_partitions=5)
    return out.withColumn("age", F.round("age", 6))


@query(
    "m10_micro_aggregation",
    f"""WITH {HEALTH_PART}, pa AS (SELECT * FROM part JOIN health USING (admission_id)), b AS (SELECT pid, avg(age) AS age FROM pa GROUP BY 1),
    h AS (SELECT pid, arg_min(v, (-n, v)) AS v FROM (SELECT pid, hospital AS v, count(*) AS n FROM pa GROUP BY 1, 2) GROUP BY 1),
    ms AS (SELECT pid, arg_min(v, (-n, v)) AS v FROM (SELECT pid, marital_status AS v, count(*) AS n FROM pa GROUP BY 1, 2) GROUP BY 1)
    SELECT pa.admission_id, round(b.age, 6) AS age, h.v AS hospital, ms.v AS marital_status, hours_hospitalized, has_diabetes
    FROM pa JOIN b ON pa.pid = b.pid JOIN h ON pa.pid = h.pid JOIN ms ON pa.pid = ms.pid""",
)
def m10(spark, sf):
    rows = health(spark, sf).select("admission_id", *HEALTH_FEATURES, "hours_hospitalized", "has_diabetes")
    return M.micro_aggregate(rows, health_partitioning(spark, sf)).withColumn("age", F.round("age", 6))


@query(
    "m11_partition_bounds",
    f"""WITH {HEALTH_PART}, pa AS (SELECT pid, age::DOUBLE AS age, (dense_rank() OVER (ORDER BY hospital) - 1)::DOUBLE AS hospital, (dense_rank() OVER (ORDER BY marital_status) - 1)::DOUBLE AS marital_status
     FROM part JOIN health USING (admission_id)), b AS (SELECT pid, min(age) AS l, max(age) AS r FROM pa GROUP BY 1)
    SELECT pid AS part_id, 'age' AS feature, l AS "left", coalesce((SELECT min(age)::DOUBLE FROM health WHERE age > b.r), r) AS "right" FROM b
    UNION ALL SELECT pid, 'hospital', min(hospital), max(hospital) + 1 FROM pa GROUP BY 1 UNION ALL SELECT pid, 'marital_status', min(marital_status), max(marital_status) + 1 FROM pa GROUP BY 1""",
)
def m11(spark, sf):
    return M.partition_bounds(health_partitioning(spark, sf))


@query(
    "m12_partition_statistics",
    f"""WITH {ADULT_PART} SELECT pid AS part_id, income, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY pid), 6) AS share FROM part JOIN adult USING (person_id) GROUP BY 1, 2""",
)
def m12(spark, sf):
    return M.partition_statistics(adult(spark, sf), adult_partitioning(spark, sf), "income")


def _compare_sql() -> str:
    parts = []
    for name, options in {"k": {}, "k+l": {"l": 2}, "k+t": {"t": 0.2}}.items():
        chain = partition_sql("adult", "person_id", FEATURES, [], FEATURES, 30, DEPTH, "income", **options)
        parts.append(
            f"SELECT '{name}' AS rule, * FROM (WITH {ADULT}, {chain}, z AS (SELECT pid, count(*) AS n FROM part GROUP BY 1)"
            " SELECT count(*) AS n_partitions, min(n) AS min_size, round(avg(n), 6) AS mean_size, CAST(sum(n) AS BIGINT) AS n_rows FROM z)"
        )
    return " UNION ALL ".join(parts)


@query("m13_compare_rules", _compare_sql())
def m13(spark, sf):
    rules = {"k": M.Validity(30), "k+l": M.Validity(30, l=2), "k+t": M.Validity(30, t=0.2)}
    return M.compare_rules(adult(spark, sf), FEATURES, "income", rules)


@query(
    "j7_row_to_partition",
    f"WITH {ADULT_PART} SELECT person_id, pid AS part_id FROM part",
)
def j7(spark, sf):
    return adult_partitioning(spark, sf).assign(adult(spark, sf)).select("person_id", "part_id")
