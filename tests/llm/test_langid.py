import zlib

from pyspark.sql import functions as F

from veil.llm import langid


def brute(text):
    """Counts of n-grams of lower-cased words padded by a boundary."""
    counts, word = {}, []
    words = []
    for c in text.lower() + " ":
        if c.isalpha():
            word.append(ord(c))
        elif word:
            words.append(word)
            word = []
    for w in words:
        padded = [1, *w, 1]
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if n == 1 and gram == [1]:
                    continue
                key = 0
                for g in gram:
                    key = key << 21 | g
                counts[key] = counts.get(key, 0) + 1
    return counts


def test_ngrams_equal_brute_force():
    for text in ("the Cat, sat", "a", "..a b..", "Éé 漢字 x1y", "", "12 !"):
        keys, counts = langid.ngrams(text)
        assert dict(zip(keys.tolist(), counts.tolist())) == brute(text), text


def test_equal_counts_share_their_place():
    import numpy as np

    keys, places = langid.ranked(np.array([5, 7, 9, 11], np.uint64), np.array([1, 4, 1, 1]))
    assert keys.tolist() == [7, 5, 9, 11] and places.tolist() == [0, 2, 2, 2]


def test_held_out_accuracy_and_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_documents_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    a, b = (langid.learn(d.where(~langid.held_out())) for d in (docs, spoiled))
    assert a.languages == b.languages and (a.keys == b.keys).all() and (a.places == b.places).all()


def test_awkward_rows(spark, awkward):
    profiles = langid.learn(awkward)
    out = langid.identify(awkward, profiles, lang="pred", score="how_sure")
    rows = {r.doc_id: (r.pred, r.how_sure) for r in out.collect() if r.doc_id is not None}
    assert rows[1] == rows[2] == rows[3] == ("und", 0.0) and rows[5][0] == "en"
    assert langid.accepted(awkward, profiles).columns == awkward.columns
    assert langid.accepted(awkward, profiles).where("doc_id IN (1, 2, 3)").isEmpty()
    empty = langid.learn(awkward.limit(0))
    assert {r.pred for r in langid.identify(awkward, empty, lang="pred", score="how_sure").collect()} == {"und"}
    assert langid.identify(awkward.limit(0), profiles, lang="pred", score="how_sure").count() == 0


def test_a_text_that_shares_no_ngram_is_not_accepted(documents):
    docs = documents([(i, "the quick brown fox jumps over a lazy dog", "en", "s") for i in range(5)])
    profiles = langid.learn(docs)
    more = documents([(10, "漢字仮名", None, "s"), (11, "the dog", None, "s")])
    assert [r.doc_id for r in langid.accepted(more, profiles).collect()] == [11]


def test_query_equals_plain_ranking(spark, sf_dir):
    """Profiles, distances and the choice of language, recomputed over the tables with dicts."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2
    totals = {}
    for d in docs:
        if d["lang"] is not None and d["text"] is not None and not held(d):
            own = totals.setdefault(d["lang"], {})
            for key, n in brute(d["text"]).items():
                own[key] = own.get(key, 0) + n
    top = lambda counts: sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:300]
    profiles = {lang: {key: i for i, (key, _) in enumerate(top(counts))} for lang, counts in totals.items()}
    expected = {}
    for d in docs:
        grams = top(brute(d["text"] or ""))
        if not grams:
            expected[d["doc_id"]] = (held(d), "und", 0.0)
            continue
        shared = {}
        for i, (_, n) in enumerate(grams):
            shared.setdefault(n, []).append(i)
        place = {n: sum(at) / len(at) for n, at in shared.items()}
        distance = {lang: sum(abs(p[key] - place[n]) if key in p else 300 for key, n in grams) / len(grams) / 300 for lang, p in profiles.items()}
        lang = min(sorted(distance), key=lambda x: distance[x])
        expected[d["doc_id"]] = (held(d), lang, 1 - distance[lang])
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.op7_language_id(spark, sf_dir).collect()}
    assert set(got) == set(expected)
    for doc_id, want in expected.items():
        assert got[doc_id][:2] == want[:2] and abs(got[doc_id][2] - want[2]) < 1e-9, doc_id
