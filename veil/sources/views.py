"""Record-level views over the driver tables that play the part of the missing input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.exprs import bin_column
from veil.sources.tables import table

# fixed values: age strata of the generalized quasi-identifier, left-closed
AGE_EDGES = [0, 15, 25, 45, 65, 120]
AGE_LABELS = ["0-14", "15-24", "25-44", "45-64", "65+"]
AGE_CAP = 100


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _customer_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw appointment rows, outliers included."""
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(_customer_geography(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    hour = F.make_dt_interval(hours=(key % 24).cast("int"))
    days = F.make_dt_interval(days=((key * 37) % 61 - 2).cast("int"))
    return joined.select(
        F.col("o_custkey").alias("patient_id"),
        key.alias("appointment_id"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        (F.col("o_orderdate") + hour).alias("scheduled_ts"),
        (F.col("o_orderdate") + days).alias("appointment_ts"),
        F.floor(F.col("c_acctbal") / 90).cast("int").alias("age"),
        F.col("n_name").alias("neighbourhood"),
        F.col("r_name").alias("region"),
        _flag(F.col("c_mktsegment") == "HOUSEHOLD").alias("scholarship"),
        _flag(F.col("o_orderpriority") == "1-URGENT").alias("hypertension"),
        _flag(key % 13 == 0).alias("diabetes"),
        _flag(key % 211 == 0).alias("alcoholism"),
        F.when(key % 50 == 0, 1 + key % 4).otherwise(0).cast("int").alias("handcap"),
        _flag(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM")).alias("sms_received"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("no_show"),
    )


def adult(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census-shaped rows."""
    orders = table(spark, sf_dir, "orders")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.col("o_orderkey").alias("person_id"),
        (17 + F.col("o_custkey") % 74).cast("int").alias("age"),
        (1 + (F.col("o_orderkey") * 31) % 99).cast("int").alias("hours_per_week"),
        F.col("o_orderpriority").alias("workclass"),
        F.col("c_mktsegment").alias("education"),
        F.col("n_name").alias("native_country"),
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("sex"),
        F.col("o_totalprice").alias("income_numerical"),
        F.when(F.col("o_totalprice") > 375000, ">50k").otherwise("<=50k").alias("income"),
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hospital-admission-shaped rows; `lab_value` determines the target and is not a feature."""
    status = F.when(F.col("event_id") % 4 == 0, "single").when(F.col("event_id") % 4 == 1, "married")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("admission_id"),
        F.col("ts").alias("admitted_ts"),
        (F.col("user_id") % 95).cast("int").alias("age"),
        F.col("event_type").alias("hospital"),
        status.when(F.col("event_id") % 4 == 2, "divorced").otherwise("widowed").alias("marital_status"),
        F.col("value").alias("lab_value"),
        (F.col("user_id") % 24).cast("int").alias("hours_hospitalized"),
        _flag(F.col("event_id") % 3 == 0).alias("released_sameday"),
        _flag(F.col("value") > 10).alias("has_diabetes"),
    )


def lead_days() -> Column:
    """Whole days from scheduling to appointment, at date granularity."""
    return F.datediff(F.to_date("appointment_ts"), F.to_date("scheduled_ts"))


def clean_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, generalized appointments: the unperturbed baseline of every risk measure."""
    raw = appointments(spark, sf_dir).withColumn("lead_days", lead_days())
    capped = F.when(F.col("age") > AGE_CAP, AGE_CAP).otherwise(F.col("age"))
    return raw.where((F.col("age") >= 0) & (F.col("lead_days") >= 0)).select(
        "patient_id", "appointment_id", "gender",
        capped.alias("age"),
        bin_column(F.col("age"), AGE_EDGES, AGE_LABELS).alias("age_group"),
        "neighbourhood", "region", "scholarship", "hypertension", "diabetes", "alcoholism", "handcap",
        (F.col("handcap") > 0).cast("int").alias("handcap_binary"),
        "sms_received",
        "lead_days",
        F.weekday("appointment_ts").alias("appt_dow"),
        F.month("appointment_ts").alias("appt_month"),
        F.weekday("scheduled_ts").alias("sched_dow"),
        F.hour("scheduled_ts").alias("sched_hour"),
        (F.col("no_show") == "Yes").cast("int").alias("noshow"),
    )


def scored_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed score column for the metric operators: (appointment_id, label, score)."""
    from veil.functions.rand import uniform

    label = (F.col("no_show") == "Yes").cast("int")
    score = F.round(0.55 * uniform("s", "appointment_id") + 0.25 * label + 0.1, 4)
    return appointments(spark, sf_dir).select("appointment_id", label.alias("label"), score.alias("score"))
