import random
import re

import pytest

from veil.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    """(words, hit words, sorted ids) of a document."""
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[i : i + n]:
                    hit.update(range(at, at + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    vocabulary = "a B é c-d E3 the Of 漢".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(3, "one two three four"), (None, "zero nine")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(60)]
    for _ in range(60):
        cut = rng.choice(items)[1].split()
        a = rng.randint(0, len(cut))
        texts.append(" ".join(rng.choices(vocabulary, k=4) + cut[a : a + rng.randint(0, 30)] + rng.choices(vocabulary, k=4)))
    return items, texts + ["x One, two; THREE four y", "zero nine", "", None]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_hits_equal_brute_force(spark, documents, cases, block_bytes):
    items, texts = cases
    docs = documents([(i, t, None, None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.matches(docs, bench, block_bytes=block_bytes).select("doc_id", "hits", D.n_hit().alias("n")).collect()}
    for i, t in enumerate(texts):
        n, hit, names = brute(t, items)
        assert (got[i].hits.words, got[i].n) == (n, hit), t
        assert got[i].hits["items"] == [x for x in names if x != "None"]


def test_longest_match_and_its_place(spark, documents):
    item = " ".join(f"w{i}" for i in range(40))
    part = " ".join(f"w{i}" for i in range(7, 32))
    docs = documents([(1, f"before it {part} after", None, None), (2, "w1 w2 w3", None, None)])
    rows = {r.doc_id: r.hits for r in D.matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert (rows[1].longest, rows[1].longest_item, rows[1].longest_at) == (25, "9", 2)
    assert rows[2].longest == 0 and rows[2].longest_item is None


def test_suffix_array_sorts_by_depth():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        codes = rng.integers(0, 3, n)
        order = D.suffix_array(codes, 10)
        assert sorted(order) == list(range(n))
        heads = [tuple(codes[i : i + 10]) for i in order]
        assert heads == sorted(heads)


def test_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "quick brown fox the"), (2, None), (None, ""), (None, None)], "item_id long, text string")
    clean = D.decontaminated(awkward, bench)
    assert clean.columns == awkward.columns
    assert clean.count() == awkward.count() - 1 and clean.where("doc_id = 5").isEmpty()
    assert D.decontaminated(awkward, bench.limit(0)).count() == awkward.count()
    assert D.decontaminated(awkward.limit(0), bench).count() == 0
    long = D.matches(awkward.where("doc_id = 5"), bench, name="found").select("found.words", D.n_hit("found").alias("n")).first()
    assert (long.words, long.n) == (80_000, 79_996)


def test_query_over_the_tables_equals_brute_force(spark, sf_dir):
    import hashlib

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    for name, t in items:
        v = words(t)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            windows.setdefault(tuple(v[i : i + n]), set()).add(str(name))
    sizes = {len(w) for w in windows}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = D.op1_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        w, hit, names = words(texts[r.doc_id]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_items_that_share_a_text(spark, documents):
    """A text that a third of all items share is searched once; blocks are bounded; all ids are listed."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, others = words(15), [words(12) for _ in range(60)]
    items = [(f"c{i}", shared) for i in range(30)] + [(f"o{i}", t) for i, t in enumerate(others)] + [(None, shared), ("c1", shared), ("x", None)]
    items = spark.createDataFrame(items, "item_id string, text string")
    blocks, copies = D.item_blocks(items.withColumnRenamed("item_id", "id"), 1000)
    sizes = {}
    for r in blocks.collect():
        sizes[r["block"]] = sizes.get(r["block"], 0) + len(r["text"])
    assert len(sizes) > 3 and max(sizes.values()) <= 1000 + 150 and copies.count() == 29
    docs = documents([(1, f"a {shared} b"), (2, f"{others[0]} and {others[59]}"), (3, words(40)), (4, None), (1, f"{shared} {others[7]}")])
    for size in (1 << 24, 1000):
        got = [(r["doc_id"], sorted(r["hits"]["items"]) == r["hits"]["items"], set(r["hits"]["items"])) for r in D.matches(docs, items, block_bytes=size).collect()]
        every = {f"c{i}" for i in range(30)}
        assert sorted(got, key=str) == sorted([(1, True, every), (2, True, {"o0", "o59"}), (3, True, set()), (4, True, set()), (1, True, every | {"o7"})], key=str)
