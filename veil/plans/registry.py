"""Registry of named queries and of the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def uniform_sql(salt: str, key: str) -> str:
    """Keyed uniform in the oracle dialect."""
    return (
        f"((('0x'||substr(md5('{salt}|'||CAST({key} AS VARCHAR)),1,13))::BIGINT + 0.5::DOUBLE)"
        " / 4503599627370496.0::DOUBLE)"
    )


APPT = """appt AS (
 SELECT o.o_custkey AS patient_id, o.o_orderkey AS appointment_id,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  o.o_orderdate + INTERVAL '1' HOUR * CAST(o.o_orderkey % 24 AS INT) AS scheduled_ts,
  o.o_orderdate + INTERVAL '1' DAY * CAST((o.o_orderkey * 37) % 61 - 2 AS INT) AS appointment_ts,
  CAST(floor(c.c_acctbal / 90) AS INT) AS age,
  n.n_name AS neighbourhood, r.r_name AS region,
  CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS scholarship,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS hypertension,
  CASE WHEN o.o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS diabetes,
  CASE WHEN o.o_orderkey % 211 = 0 THEN 1 ELSE 0 END AS alcoholism,
  CAST(CASE WHEN o.o_orderkey % 50 = 0 THEN 1 + (o.o_orderkey % 4) ELSE 0 END AS INT) AS handcap,
  CASE WHEN o.o_orderpriority IN ('2-HIGH','3-MEDIUM') THEN 1 ELSE 0 END AS sms_received,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS no_show
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

AGE_CASE = (
    "CASE WHEN age >= 0 AND age < 15 THEN '0-14' WHEN age >= 15 AND age < 25 THEN '15-24'"
    " WHEN age >= 25 AND age < 45 THEN '25-44' WHEN age >= 45 AND age < 65 THEN '45-64'"
    " WHEN age >= 65 AND age < 120 THEN '65+' END"
)

CLEAN = (
    APPT
    + f""", clean AS (
 SELECT patient_id, appointment_id, gender, CASE WHEN age > 100 THEN 100 ELSE age END AS age,
  {AGE_CASE} AS age_group, neighbourhood, region, scholarship, hypertension, diabetes, alcoholism, handcap,
  CAST(handcap > 0 AS INT) AS handcap_binary, sms_received,
  date_diff('day', CAST(scheduled_ts AS DATE), CAST(appointment_ts AS DATE)) AS lead_days,
  CAST(isodow(appointment_ts) - 1 AS INT) AS appt_dow, CAST(month(appointment_ts) AS INT) AS appt_month,
  CAST(isodow(scheduled_ts) - 1 AS INT) AS sched_dow, CAST(hour(scheduled_ts) AS INT) AS sched_hour,
  CAST(no_show = 'Yes' AS INT) AS noshow
 FROM appt WHERE age >= 0
  AND date_diff('day', CAST(scheduled_ts AS DATE), CAST(appointment_ts AS DATE)) >= 0)"""
)

ADULT = """adult AS (
 SELECT o.o_orderkey AS person_id, CAST(17 + o.o_custkey % 74 AS INT) AS age,
  CAST(1 + (o.o_orderkey * 31) % 99 AS INT) AS hours_per_week, o.o_orderpriority AS workclass,
  c.c_mktsegment AS education, n.n_name AS native_country,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
  o.o_totalprice AS income_numerical, CASE WHEN o.o_totalprice > 375000 THEN '>50k' ELSE '<=50k' END AS income
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

HEALTH = """health AS (
 SELECT event_id AS admission_id, ts AS admitted_ts, CAST(user_id % 95 AS INT) AS age, event_type AS hospital,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'single' WHEN 1 THEN 'married' WHEN 2 THEN 'divorced' ELSE 'widowed' END AS marital_status,
  value AS lab_value, CAST(user_id % 24 AS INT) AS hours_hospitalized,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS released_sameday,
  CASE WHEN value > 10 THEN 1 ELSE 0 END AS has_diabetes
 FROM events)"""

SCORED = (
    APPT
    + f""", scored AS (
 SELECT appointment_id, CAST(no_show = 'Yes' AS INT) AS label,
  round(0.55::DOUBLE * {uniform_sql('s', 'appointment_id')} + 0.25::DOUBLE * CAST(no_show = 'Yes' AS INT) + 0.1::DOUBLE, 4) AS score
 FROM appt)"""
)
