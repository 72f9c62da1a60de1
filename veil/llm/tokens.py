"""Token counts of whole texts under a public byte-level BPE vocabulary.

Defined cases: a null or empty text has no bytes and no tokens; special strings of the vocabulary count as one token
each; rows are counted on their own, whatever their doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veil.llm.bpe import count, load
from veil.llm.common import free_name, table, texts, with_columns

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def token_counts(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens", specials: bool = True) -> DataFrame:
    """`docs` with the number of tokens of `text`. The vocabulary at `path` is read by the driver and broadcast (its
    size does not depend on the data)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        for batch in batches:
            yield batch, [count(vocabulary.value, [t.decode("utf-8", "replace") for t in texts(batch, text)], specials)]

    return with_columns(docs, text, StructType([StructField(free_name(docs, name), LongType(), False)]), run)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path(VOCABULARY))
    return counted.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
