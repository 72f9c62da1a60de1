import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veil.llm import simhash
from veil.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, radius):
    """Least position reachable, by brute force."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint_equals_the_plain_rule():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aB é\n\t.") for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text), repr(text)


def test_fingerprint_agrees_with_spark(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert simhash.fingerprint(b"One two\nthree  FOUR") == row.h & (2**64 - 1)


@pytest.mark.parametrize("bundle", [1 << 20, 4000])  # the small one refines prefixes up to all 64 bits
def test_components_equal_brute_force(spark, bundle):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    for v in values[:25]:
        for _ in range(3):
            flips = rng.sample(range(64), rng.choice([1, 3, 4, 4, 5, 6]))
            values.append(v ^ sum(1 << f for f in flips))
    values = list(dict.fromkeys(values))
    signed = [(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(signed, "node long, least long")
    links = simhash.links(nodes.select(F.col("node").alias("fp")), 4, bundle=bundle)
    got = {r.node: r.component for r in components(links, nodes).collect()}
    assert [got.get(s, i) for (s, i) in signed] == roots(values, 4)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    nodes = spark.range(2000).select(F.col("id").alias("node"), (F.lit(5000) - F.col("id")).alias("least"))
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star, "a long, b long"), nodes).collect()}
    assert {got[i] for i in range(301)} == {4700} and {got[i] for i in range(1000, 1400)} == {3601} and len(got) == 701


def test_awkward_rows(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    blank = {r.doc_id: r for r in rows if r.fp == 0}
    assert set(blank) == {None, 1, 2, 3} and {r.component_id for r in blank.values()} == {1}
    assert {r.component_id for r in rows if r.doc_id == 4} == {4}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6]
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_one_copy_stays_whatever_the_group(documents):
    copies = documents([(i, "one two three four five six seven", "en", "hot") for i in range(200)] + [(500, "something else of which there is one", "en", "s")])
    assert sorted(r.doc_id for r in simhash.keep_one(copies).collect()) == [0, 500]


def test_query_over_the_tables_equals_brute_force(spark, sf_dir):
    rows = simhash.op3_simhash(spark, sf_dir).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    values = [plain_fingerprint(d.text) for d in docs]
    assert [r.fingerprint for r in rows] == [f"{v:016x}" for v in values]
    assert [r.component_id for r in rows] == [docs[i].doc_id for i in roots(values, 4)]


def test_repeated_ids_with_other_texts_keep_one_row_of_each_component(documents):
    a, b = "one two three four five six seven", "a wholly unrelated text about the weather of tomorrow"
    lost = documents([(3, a), (5, a), (5, b)])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(lost).collect()) == [(3, a), (5, b)]
    # one fingerprint, two texts: upper case is folded
    both = documents([(4, a), (4, a.upper()), (9, b)])
    assert sorted(r.doc_id for r in simhash.keep_one(both).collect()) == [4, 9]


def test_an_odd_radius_links_no_pair_beyond_it(spark):
    rng = random.Random(3)
    link = lambda values, radius: {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius).collect()}
    assert link([0, 0b1111], 3) == set() and link([0, 0b111], 3) == {(0, 7)}
    values = sorted({rng.getrandbits(40) for _ in range(5)} | {rng.getrandbits(7) for _ in range(40)})
    for radius in (1, 3):
        found, least = link(values, radius), roots(values, radius)
        assert all((a ^ b).bit_count() <= radius for a, b in found)
        parent = {v: v for v in values}
        for _ in values:
            for a, b in found:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert [parent[v] for v in values] == [values[i] for i in least]
