import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from veil.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, window=20):
    """{doc_id: (n_words, removed word places, kept text)} for distinct ids."""
    seen, out = set(), {}
    for id_, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out[id_] = (len(words), gone, " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def result(df):
    return {r.doc_id: (r.n_words, {i for s in r.repeats for i in range(s.begin, s.end)}, bytes(r.kept).decode()) for r in df.collect()}


def corpus(rng, n):
    """Words of a small vocabulary, long shared passages, copies, texts of one word."""
    vocabulary = ["a", "b", "é漢", "the", "x" * 30]
    passage = [" ".join(rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(k)) for k in (19, 20, 21, 60)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.4 else " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        texts.append("\t ".join(parts))
    texts += [texts[3]] * 5 + ["one " * 300, "one " * 19, None, "", " \n"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("group", "chunk"), [(1 << 20, 1 << 19), (50, 200), (3, 1)])
def test_random_corpus(documents, group, chunk):
    rows = corpus(random.Random(group), 150)
    random.Random(1).shuffle(rows)
    assert result(repeats.deduplicated(documents(rows), group=group, chunk=chunk)) == expected(rows)


def test_one_passage_in_a_third_of_all_rows(documents):
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + (" " + passage if i % 3 == 0 else "")) for i in range(400)]
    got = result(repeats.deduplicated(documents(rows), group=100, chunk=500))
    assert got == expected(rows)
    assert sum(len(gone) for _, gone, _ in got.values()) == 60 * 133


def test_query_over_the_tables(spark, sf_dir):
    assert compare(spark, connect(sf_dir), repeats.op13_substring_dedup, repeats.ORACLE, sf_dir) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, len(gone), hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in expected(rows).items()}
    assert {r[0]: tuple(r[1:]) for r in repeats.op13_substring_dedup(spark, sf_dir).collect()} == want


def test_prefixes_cover_each_suffix_once(spark, documents):
    rows = corpus(random.Random(3), 60)
    placed = repeats.placed(documents(rows), "doc_id", "text")
    found = {r.prefix: r.n for r in repeats.prefixes(placed, "text", 20, 5).collect()}
    names = sorted(found)
    assert len({len(p) for p in names}) > 1 and not any(b.startswith(a) for a, b in zip(names, names[1:]))
    windows = {tuple(w[i : i + 20]) for _, t in rows for w in [WORD.findall(t or "")] for i in range(len(w) - 19)}
    assert sum(found.values()) == len(windows)


def test_bounds_of_prefixes():
    words = [b" ".join(f"{i * k}".encode() for i in range(400)) for k in (1, 2, 3)]
    s = repeats.Suffixes(words, np.array([0, 400, 800]), 20)
    paths = [f"{h:016x}{low:08x}" for h, low in zip(s.high.tolist(), s.low.tolist())]
    assert paths == sorted(paths)
    for prefix in ("", "0", "8", "fff", "7a", paths[100][:20], paths[17], "f" * 24):
        inside = [i for i, p in enumerate(paths) if p.startswith(prefix)]
        assert s.end(prefix) - s.bound(prefix) == len(inside) and (not inside or s.bound(prefix) == inside[0])
    for depth in (0, 12, 48, 60, 84):
        assert s.digits(0, len(paths), depth).tolist() == [int(p[depth // 4 : depth // 4 + 3], 16) for p in paths]


def test_awkward_rows(awkward):
    docs = awkward.withColumn("kept", F.lit(1))
    out = repeats.deduplicated(docs)
    assert out.columns == [*docs.columns, "n_words", "repeats", "_kept"] and out.count() == docs.count()
    long = next(r for r in out.collect() if r.doc_id == 5)
    assert (long.n_words, long.repeats, bytes(long._kept)) == (80_000, [(4, 80_000)], b"the quick brown fox")
    assert repeats.deduplicated(docs.limit(0)).count() == 0


def test_repeated_ids_and_rows(documents):
    text = " ".join(f"w{i}" for i in range(25))
    got = sorted((r.doc_id or 0, len(r.repeats)) for r in repeats.deduplicated(documents([(7, text), (7, text), (None, text + " x"), (8, text)])).collect())
    assert got == [(0, 0), (7, 1), (7, 1), (8, 1)]
