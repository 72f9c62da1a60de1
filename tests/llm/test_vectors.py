import numpy as np
import pytest
from pyspark.sql import functions as F

from veil.llm import vectors

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, similarity=0.98):
    """id -> (links, least id reachable) of rows (id, vector, label) whose ids are unique."""
    usable = [(i, np.array(v, float), c) for i, v, c in rows if c is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _, _ in rows}
    links = dict.fromkeys(parent, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, v, c) in enumerate(usable):
        for j, w, d in usable[:n]:
            if c == d and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= similarity:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in parent}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for c in range(12):
        centre = rng.standard_normal(24)
        for _ in range(6):
            out.append((centre + 0.13 * rng.standard_normal(24) * rng.random(), c % 3))
    out += [(out[0][0] * 2, 0), (out[0][0], 0), (out[0][0], 1)]
    data = [(i, [float(np.float32(x)) for x in v], c) for i, (v, c) in enumerate(out)]
    bad = [None, [], [0.0] * 24, [None, *[1.0] * 23], [float("nan"), *[1.0] * 23], [float("inf"), *[1.0] * 23]]
    data += [(1000 + i, v, 0) for i, v in enumerate(bad)] + [(1100, data[0][1], None), (1101, data[0][1][:12], 0)]
    return data


@pytest.mark.parametrize("block", [1024, 3])  # small blocks split every bucket
def test_links_equal_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    out = vectors.near_duplicates(spark.createDataFrame(rows, KIND), recall=1 - 1e-9).collect()
    assert len(out) == len(rows)
    expected = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == expected
    assert all(r.kept == (r.component_id == r.vec_id) for r in out)
    assert sum(n for n, _ in expected.values()) > 50


def test_repeated_rows_link_and_ids_may_be_null(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0), (7, [-1.0, 5.0], 0)], KIND).withColumns({c: F.lit("x") for c in ("rid", "n", "size", "codes", "component_id")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (7, 0, 7, True)], key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_one_group_holds_most_vectors(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal(16)
    data = [(i, [float(x) for x in centre + 0.01 * rng.standard_normal(16)], 1) for i in range(400)]
    out = vectors.near_duplicates(spark.createDataFrame(data, KIND)).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(399, 0)}


def test_tables_grow_slowly():
    assert vectors.shape(100)[0] == 4 and vectors.shape(10**9)[0] > 20
    bits, tables = vectors.shape(10**6)
    assert 1 - (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables >= 0.999


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.op5_embedding_dedup(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_doubles_are_compared_as_doubles(spark):
    """Two vectors at a cosine that single precision would put on the other side of the least similarity."""
    a, least = np.array([1.0, 0.0]), 0.98
    for delta in (1e-11, -1e-11):
        c = least + delta
        b = np.array([c, np.sqrt(1 - c * c)])
        df = spark.createDataFrame([(1, a.tolist(), 0), (2, b.tolist(), 0)], "vec_id long, embedding array<double>, label int")
        assert {r.n_links for r in vectors.near_duplicates(df, recall=1 - 1e-9).collect()} == {int(delta > 0)}


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(8)
    data = [(i, rng.standard_normal(8).tolist() if i % 3 else [1.0] * 8, 0) for i in range(300)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(data, KIND), recall=1 - 1e-9).collect()}
    assert got == brute([(i, [float(np.float32(x)) for x in v], c) for i, v, c in data])
