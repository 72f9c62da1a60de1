"""Reports counted by the scan that writes: equal to those of a second scan, and the source is read once."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from veil.operators import clean as C
from veil.operators import dp as DP


@pytest.fixture
def source(spark, tmp_path):
    """Rows that leave a file behind whenever they are computed."""
    folder = str(tmp_path)

    def mark(batches):
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        yield from batches

    rows = spark.createDataFrame([(i, i - 5 if i % 7 else None, i % 2, "x" if i % 11 == 0 else str(i)) for i in range(200)], "id int, a int, flag int, t string")
    return rows.coalesce(1).mapInArrow(mark, rows.schema), lambda: len(os.listdir(folder))


def test_drop_report(source):
    df, scans = source
    failures = {"low": F.col("a") < 0, "high": F.col("a") > 150}
    kept, report = C.drop_failing_written(df, failures)
    got = kept.count(), report.first()
    assert scans() == 1
    rows, second = C.drop_failing(df, failures)
    assert got == (rows.count(), second.first()) and got[1].rows_out == got[0] < 200


def test_cap_and_coercion_reports(source):
    df, scans = source
    capped, report = C.cap_high_written(df, "a", 100)
    assert report.first() == (94 - sum(1 for i in range(106, 200) if i % 7 == 0), 100) and capped.where("a > 100").isEmpty() and scans() == 1
    table, nulls = C.coerce_numeric_written(df, ["a", "t"])
    assert dict(nulls.collect()) == {"a": 29, "t": 19} and dict(table.dtypes) == {"id": "int", "a": "bigint", "flag": "int", "t": "double"} and scans() == 2


def test_drift_report(source):
    df, scans = source
    table, report = DP.respond_all_written(df, ["flag"], "id", 0.3, 0.5, "s")
    got = report.first()
    assert scans() == 1 and table.count() == 200
    assert got == DP.drift_report(DP.respond_all(df, ["flag"], "id", 0.3, 0.5, "s"), ["flag"]).first()


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, a int")
    kept, report = C.drop_failing_written(df, {"low": F.col("a") < 0})
    assert kept.count() == 0 and report.first() == (0, 0, 0)
