"""Scans: driver Parquet tables and delimited text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
    sep: str = ",", strings: Sequence[str] = (), null_value: str | None = None,
) -> DataFrame:
    """Delimited scan with a header.

    With a schema nothing is inferred. Without one, types are inferred from the data and the columns
    in `strings` are kept as text, since numeric inference loses digits of long identifiers.
    """
    reader = spark.read.option("header", header).option("sep", sep)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if schema is not None:
        return reader.schema(schema).csv(path)
    inferred = reader.option("inferSchema", True).csv(path)
    if not strings:
        return inferred
    fields = [
        T.StructField(f.name, T.StringType() if f.name in strings else f.dataType, True)
        for f in inferred.schema
    ]
    return reader.schema(T.StructType(fields)).csv(path)


def read_delimited(
    spark: SparkSession, path: str, names: Sequence[str], types: dict[str, T.DataType] | None = None, sep: str = ", "
) -> DataFrame:
    """Headerless scan with a list of column names; the separator may have several characters."""
    types = types or {}
    schema = T.StructType([T.StructField(n, types.get(n, T.StringType()), True) for n in names])
    return spark.read.option("header", False).option("sep", sep).schema(schema).csv(path)


# column names of the headerless census file, in file order
ADULT_COLUMNS = [
    "age", "workclass", "fnlwgt", "education", "education-num", "marital-status", "occupation",
    "relationship", "race", "sex", "capital-gain", "capital-loss", "hours-per-week",
    "native-country", "income",
]
ADULT_NUMERIC = ["age", "fnlwgt", "education-num", "capital-gain", "capital-loss", "hours-per-week"]


def read_adult(spark: SparkSession, path: str, sep: str = ", ", numeric_income: bool = False) -> DataFrame:
    numeric = ADULT_NUMERIC + (["income"] if numeric_income else [])
    return read_delimited(spark, path, ADULT_COLUMNS, {c: T.DoubleType() for c in numeric}, sep)
