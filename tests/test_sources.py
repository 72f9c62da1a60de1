from pyspark.sql import types as T

from veil.sources.tables import ADULT_COLUMNS, read_adult, read_csv, read_delimited


def test_text_scan_keeps_long_ids(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("PatientId,Age\n29872499824296000001,3\n5,\n")
    df = read_csv(spark, str(path), strings=["PatientId"])
    assert dict(df.dtypes) == {"PatientId": "string", "Age": "int"}
    assert [tuple(r) for r in df.orderBy("Age").collect()] == [("5", None), ("29872499824296000001", 3)]


def test_two_character_and_space_separators(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("39, State-gov, ?\n50, Private, x\n")
    b.write_text("39 State-gov ?\n")
    names, types = ["age", "work", "flag"], {"age": T.IntegerType()}
    rows = [tuple(r) for r in read_delimited(spark, str(a), names, types, ", ").orderBy("age").collect()]
    assert rows == [(39, "State-gov", "?"), (50, "Private", "x")]
    assert tuple(read_delimited(spark, str(b), names, types, " ").first()) == (39, "State-gov", "?")


def test_census_file(spark, tmp_path):
    path = tmp_path / "adult.txt"
    path.write_text("39, State-gov, 77516, Bachelors, 13, Never-married, Adm, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50k\n")
    row = read_adult(spark, str(path)).first()
    assert len(row) == len(ADULT_COLUMNS) and row["age"] == 39.0 and row["income"] == "<=50k"
