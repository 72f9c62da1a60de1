"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words padded by a boundary) in the
order of their counts. A text is ranked the same way; its distance to a language is the mean number of places by which
its n-grams are out of place in the language's profile, an absent one counting as the whole profile. The nearest
language wins.

Profiles are learned from a bounded sample of the labelled documents: the SAMPLE of each language whose keys hash
lowest. Texts are read whole, in training and in prediction.

Defined cases: a text that is null or has no letter is `und` with score 0. Of equally near languages the first by
code point wins. Without any labelled text every document is `und`. N-grams of one count share their mean place.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from veil.llm.bpe import LETTER, character_classes
from veil.llm.common import crc32_mod, ship, slices, stored, table, texts, with_columns

ORDERS, PROFILE, SAMPLE = 3, 300, 2000
UNKNOWN = "und"
EDGE = np.uint64(1)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of a text, keys ascending: 21 bits a letter, 1 for a word boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = character_classes()[points] == LETTER
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.r_[EDGE, np.where(letter, points, 1), EDGE].astype(np.uint64)
    edge = at == EDGE
    at = at[~edge | np.r_[True, ~edge[:-1]]]
    keys, gram, inner = [at[at != EDGE]], at, np.ones(len(at), bool)
    for _ in range(ORDERS - 1):
        gram = gram[:-1] << np.uint64(21) | at[len(at) - len(gram) + 1 :]
        keys.append(gram[inner[: len(gram)]])
        # an n-gram that goes on behind a boundary is none
        inner = inner[:-1] & (at[len(at) - len(gram) : ] != EDGE)[: len(inner) - 1]
    return np.unique(np.concatenate(keys), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys and their places; equal counts share the mean of their places."""
    order = np.argsort(-counts, kind="stable")[:size]
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]])
    size_of = np.diff(np.r_[first, len(counts)])
    return keys, np.repeat(first + (size_of - 1) / 2, size_of)


class Profiles:
    """Places of the n-grams of all languages, as one table: sorted keys by languages."""

    def __init__(self, rows: Iterable[tuple[str, int, int]], size: int = PROFILE):
        """rows: (language, key, place)."""
        rows = list(rows)
        self.size = size
        self.languages = sorted({r[0] for r in rows})
        self.keys = np.unique(np.array([r[1] for r in rows], np.uint64))
        self.places = np.full((len(self.keys) + 1, len(self.languages)), -1.0)
        number = {name: i for i, name in enumerate(self.languages)}
        for name, key, place in rows:
            self.places[np.searchsorted(self.keys, np.uint64(key)), number[name]] = place

    def predict(self, text: str) -> tuple[str, float]:
        """Nearest language, and one minus its distance."""
        keys, places = ranked(*ngrams(text), self.size)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.places[np.where(self.keys[at] == keys, at, len(self.keys))]
        out_of_place = np.where(known < 0, self.size, np.abs(known - places[:, None]))
        distance = out_of_place.mean(axis=0) / self.size
        best = int(np.argmin(distance))
        return self.languages[best], float(np.clip(1 - distance[best], 0, 1))


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in `lang`, from `sample` documents of each."""
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    # about twice the sample of each language is shuffled, whatever the language's size
    sizes = stored(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("lang", "__lang"), "sizes")
    likely = labelled.join(sizes, F.col("lang") == F.col("__lang")).where(F.pmod("h", F.lit(1 << 30)) < F.lit(2.0 * sample * (1 << 30)) / F.col("rows"))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = likely.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def counted(batches):
        for batch in slices(batches, "text"):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            found = texts(batch, "text")
            for name in sorted(set(langs)):
                grams = [ngrams(found[i].decode("utf-8", "replace")) for i in np.flatnonzero(langs == name)]
                keys, place = np.unique(np.concatenate([k for k, _ in grams]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c for _, c in grams]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], schema=schema)

    totals = chosen.mapInArrow(counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    rows = totals.withColumn("place", F.row_number().over(top) - 1).where(F.col("place") < size).collect()  # `size` rows a language
    return Profiles(((r["lang"], r["key"], r["place"]) for r in rows), size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the predicted language of each whole text and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # a few hundred rows a language

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t.decode("utf-8", "replace")) for t in texts(batch, text)]
            yield batch, [[f[0] for f in found], [f[1] for f in found]]

    return with_columns(docs, text, StructType([StructField(lang, StringType(), False), StructField(score, DoubleType(), False)]), run)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept from learning: crc32(doc_id as text) mod 4 is 2."""
    return crc32_mod(doc_id, 4) == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; held-out labels are not learned from."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, profiles: Profiles, languages: Iterable[str] | None = None, least: float = 0.0, text: str = "text") -> DataFrame:
    """The documents whose predicted language is one of `languages` (default: any learned one) with at least that score.

    A text that shares no n-gram with any profile has score 0 and no nearest language, so it is not accepted."""
    languages = list(profiles.languages if languages is None else languages)
    named = identify(docs, profiles, text, "__lang_pred", "__score")
    return named.where(F.col("__lang_pred").isin(languages) & (F.col("__score") >= least) & (F.col("__score") > 0)).drop("__lang_pred", "__score")
