import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from veil.llm import quality


def auc(rows):
    ordered = sorted(rows, key=lambda r: r[0])
    good, wins = 0, 0
    for _, y in ordered[::-1]:
        good += y
        wins += 0 if y else good
    n = sum(y for _, y in rows)
    return wins / (n * (len(rows) - n))


def test_held_out_ranking_and_split(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.op10_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert auc(held) > 0.85
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.9


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    spoiled = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.learn(docs.where(~quality.held_out()), x.where(~quality.held_out())) for x in (labels, spoiled))
    assert a == b


def test_curve_is_the_likeliest():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    a, b = quality.curve(x, y, np.ones(2000))
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert abs((y - p).sum()) < 1e-3 and abs(((y - p) * x).sum()) < 1e-2


def test_long_texts_are_scored_like_their_parts():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    text = " ".join(rng.choices(words, k=4000)).encode()
    good = quality.dictionary([" ".join(rng.choices(words, k=300)).encode() for _ in range(300)])
    bad = quality.dictionary([" ".join("".join(rng.choices("xyz&!", k=4)) for _ in range(300)).encode() for _ in range(300)])
    meter = quality.Meter(good, bad)
    assert meter.difference(text * 10) > 0.5 * meter.difference(text[: quality.PIECE]) > 0
    assert meter.difference(b"") == 0


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 5), (99, 1), (5, 1)], "doc_id long, quality int")
    model = quality.learn(awkward, labels)
    out = quality.differences(awkward, model, name="d").withColumn("s", quality.score(F.col("d"), model))
    assert out.count() == awkward.count() and out.where("s < 0 OR s > 1 OR s IS NULL").isEmpty()
    none = quality.learn(awkward, labels.limit(0))
    assert quality.differences(awkward, none, name="d").select(quality.score(F.col("d"), none).alias("s")).distinct().collect()[0].s == 0.5
    assert quality.differences(awkward.limit(0), model, name="d").count() == 0


def test_query_equals_plain_recomputation(spark, sf_dir):
    """Sizes under both dictionaries, difference, curve and decision of every document, one compressor call at a time."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs.where(~quality.held_out()), labels.where(~quality.held_out()))
    assert model.good and model.bad and model.slope != 0

    def size(text, dictionary):
        total = 0
        for i in range(0, len(text), quality.PIECE):
            given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            total += len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=given, write_content_size=False).compress(text[i : i + quality.PIECE]))
        return total

    got = {r.doc_id: r for r in quality.op10_quality(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        text = (r.text or "").encode()
        good, bad, plain = (size(text, d) for d in (model.good, model.bad, b""))
        score = 1 / (1 + np.exp(-(model.offset + model.slope * ((bad - good) / plain if plain else 0.0))))
        own = got[r.doc_id]
        assert abs(own.score - score) < 1e-9 and own.predicted == int(score >= 0.3)
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_a_hot_label_is_cut_before_it_is_ranked(spark):
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.when(F.col("id") % 50 == 0, 0).otherwise(1).alias("label"))
    likely = {r["label"]: r["n"] for r in quality._likely(rows, 1000, {0: 400, 1: 19_600}, "key").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert likely[0] == 400 and 800 < likely[1] < 1200
