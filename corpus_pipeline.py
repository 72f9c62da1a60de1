"""The corpus pipeline: language ID, SimHash near-duplicates, decontamination, mixing, token output.

Each stage takes the documents that the stage before kept, written and read again, and returns those that it keeps
with the columns of `documents`; the last one returns the index of the shards it writes.

- `language_id` learns its profiles from the labelled documents it is given and drops texts that share no n-gram with them, as those without letters do.
- `near_duplicates` keeps, of each class of linked documents, the one with the least id.
- `decontamination` drops documents with words inside an occurrence of a benchmark window.
- `mixing` repeats or leaves out documents so that the sources meet their targets; a document taken twice is two rows.
- `token_output` writes the token ids in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veil.llm import decontaminate, langid, mixing, output, simhash
from veil.llm.common import stored, table

#: Some stages are not expressible in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return output.written(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
