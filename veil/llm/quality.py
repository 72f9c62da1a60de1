"""Quality classifier by compression.

Two zstandard dictionaries are built from pieces of good and of bad labelled texts. A text is compressed, in pieces of
bounded length so that a long text does not become its own dictionary, with either dictionary and with none; the
difference of its compressed sizes over the plain compressed size says which kind it resembles. A logistic curve, fitted
on labelled texts that the dictionaries have not seen, turns that into the probability of label 1.

Learning takes bounded samples: the FIT pieces and the CALIBRATE documents of each label whose keys hash lowest; the
curve weighs the labels by how often they occur among all labelled rows. Texts are scored whole.

Defined cases: a null text is empty, and an empty text has difference 0. Labels other than 0 and 1, and labels without
a document, teach nothing; a document with several label rows counts with each. If a label has no documents, every
score is the share of label 1 (one half without any label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veil.llm.common import crc32_mod, ship, slices, stored, table, texts, with_columns

PIECE, DICTIONARY, LEVEL = 2048, 64 << 10, 3
FIT, CALIBRATE = 3000, 3000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text (empty: none could be built), and the curve: offset and slope."""

    good: bytes
    bad: bytes
    offset: float
    slope: float


class Meter:
    """Compressed sizes under a model's dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        of = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False)
        self.coders = [of(good), of(bad), of(b"")]

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / plain size."""
        good, bad, plain = (sum(len(c.compress(text[i : i + PIECE])) for i in range(0, len(text), PIECE)) for c in self.coders)
        return (bad - good) / plain if plain else 0.0


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Offset and slope of a weighted logistic regression, by Newton steps."""
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (weight * (y - p)) - ridge * np.array([0, w[1]])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-9, ridge])
        step = np.clip(np.linalg.solve(hessian, gradient), -20, 20)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def _pieces(batches):
    for batch in slices(batches, "text"):
        label, own = batch.column("label").to_pylist(), texts(batch, "text")
        rows = [(y, t[i : i + PIECE]) for y, t in zip(label, own) for i in range(0, len(t), PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "piece"])


def _likely(df: DataFrame, n: int, sizes: dict[int, int], key: str) -> DataFrame:
    """About `n` rows of each label or all, by hash: so a label that has most rows is cut before its rows meet in one task."""
    share = F.lit(0.0)
    for label, size in sizes.items():
        share = F.when(F.col("label") == label, F.lit(n * (1 << 30) / max(1, size))).otherwise(share)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("cut")), F.lit(1 << 30)) < share)


def _lowest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The `n` rows of each label whose keys hash lowest, of tables of bounded size."""
    order = Window.partitionBy("label").orderBy(F.xxhash64(*keys), *keys)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit: int = FIT, calibrate: int = CALIBRATE) -> Model:
    """A model from the rows of `labels` and their documents. Half of the labels (by hash) build dictionaries, half the curve."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    half = F.pmod(F.xxhash64(F.col("key"), F.lit("half")), F.lit(2)) == 0
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    # a half has about half the rows of a label, so four times the sample of the whole is twice that of the half
    fits, curves = (_lowest(_likely(known.where(own), 4 * n, counts, "key"), n, "key") for own, n in ((half, fit), (~half, calibrate)))
    chosen = fits.withColumn("use", F.lit(0)).unionByName(curves.withColumn("use", F.lit(1)))
    sample = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(stored(chosen, "chosen"), "key"), "labelled")
    pieces = sample.where("use = 0").select("label", "text").mapInArrow(_pieces, "label int, piece binary")
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for r in _lowest(pieces, fit, "piece").collect():  # `fit` pieces of a label
        found[r["label"]].append(bytes(r["piece"]))
    good, bad = dictionary(found[1]), dictionary(found[0])
    offset = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1 - 1e-6)))
    blank = Model(good, bad, offset, 0.0)
    if not good or not bad:
        return blank
    measured = differences(_lowest(sample.where("use = 1"), calibrate, "key"), blank).select("label", "difference").collect()  # `calibrate` numbers of a label
    x, y = np.array([r["difference"] for r in measured]), np.array([r["label"] for r in measured])
    if len(set(y.tolist())) < 2:
        return blank
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    return Model(good, bad, *curve(x, y, weight))


def dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary of the pieces; of few or short ones as much as they give, none if they are too few."""
    pieces = sorted(p for p in pieces if len(p) >= 8)
    total = sum(map(len, pieces))
    for size in (DICTIONARY, DICTIONARY // 4, DICTIONARY // 16, 1024):
        if total >= 8 * size and len(pieces) >= 8:
            try:
                return zstandard.train_dictionary(size, pieces).as_bytes()
            except zstandard.ZstdError:  # the builder refuses samples that repeat too little
                continue
    return b""


def differences(docs: DataFrame, model: Model, text: str = "text", name: str = "difference") -> DataFrame:
    """`docs` with the normalised difference of compressed sizes of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches):
        meter = Meter(shared.value.good, shared.value.bad)
        for batch in batches:
            yield batch, [[meter.difference(t) for t in texts(batch, text)]]

    return with_columns(docs, text, StructType([StructField(name, DoubleType(), False)]), run)


def score(difference: Column, model: Model) -> Column:
    """Probability of label 1."""
    return 1 / (1 + F.exp(-(F.lit(model.offset) + F.lit(model.slope) * difference)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept from learning: crc32(doc_id as text) mod 5 is 0."""
    return crc32_mod(doc_id, 5) == 0


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; held-out labels are not learned from."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = learn(docs.where(~held_out()), labels.where(~held_out()))
    scored = differences(docs, model).withColumn("score", score(F.col("difference"), model))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
