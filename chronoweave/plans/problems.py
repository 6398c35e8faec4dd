"""Queries of the general data-processing problems 1, 2 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.history import SINGLE_VALUED, change_rates, counting, fact_history
from chronoweave.operators.intervals import coverage
from chronoweave.operators.sessions import event_sessions
from chronoweave.plans.registry import Registry
from chronoweave.session import table

registry = Registry()

#: Predicates whose statements may overlap (fixed values of the data model).
PERIOD_PREDICATES = ("assigned_to", "on_duty_for", "qualified_for", "reserved_by", "under_contract_with")

_COUNT = """recorded_to IS NULL AND polarity = 'positive' AND assertion_status IN ('observed', 'confirmed')
    AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)"""
_FOLD = "lower(upper(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')))"

_P1 = f"""
WITH words AS (SELECT name, unnest(aliases) AS alias, canonical_value FROM vocabulary_values),
names AS (SELECT name, {_FOLD.format("alias")} AS alias, min({_FOLD.format("canonical_value")}) AS canonical FROM words GROUP BY 1, 2),
rows_ AS (SELECT subject_id, predicate, valid_from, valid_to, recorded_from, {_FOLD.format("json_extract_string(object_value, '$.value')")} AS raw
    FROM facts WHERE {_COUNT} AND predicate IN ({", ".join(f"'{p}'" for p in SINGLE_VALUED)})),
valued AS (SELECT r.*, coalesce(n.canonical, r.raw) AS value FROM rows_ r LEFT JOIN names n ON n.name = r.predicate AND n.alias = r.raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, valid_from ORDER BY recorded_from DESC, value DESC NULLS LAST, valid_to DESC NULLS FIRST) AS rn FROM valued),
ends AS (SELECT subject_id, predicate, value, epoch_us(valid_from) AS f,
    least(coalesce(epoch_us(valid_to), 9000000000000000000), coalesce(epoch_us(lead(valid_from) OVER w), 9000000000000000000)) AS t
    FROM ranked WHERE rn = 1 WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY valid_from)),
flags AS (SELECT *, CASE WHEN lag(t) OVER w = f AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS fresh
    FROM ends WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY f)),
nums AS (SELECT *, sum(fresh) OVER (PARTITION BY subject_id, predicate ORDER BY f) AS no FROM flags)
SELECT subject_id, predicate, min(f) AS from_us, CASE WHEN max(t) = 9000000000000000000 THEN -1 ELSE max(t) END AS to_us
FROM nums GROUP BY subject_id, predicate, no"""


@registry.add("p1_found", _P1)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_history(table(spark, sf_dir, "facts"), table(spark, sf_dir, "vocabulary_values")).select("subject_id", "predicate", "from_us", "to_us")


_RATES = f"""SELECT predicate, sum(n) AS n_rows, count(*) AS n_entities, round(sum(n) / count(*), 6) AS rows_per_entity, CASE WHEN sum(n) / count(*) >= 8 THEN 'fast' ELSE 'slow' END AS satellite
FROM (SELECT predicate, subject_id, count(*) AS n FROM facts WHERE {_COUNT} AND predicate IN ({", ".join(f"'{p}'" for p in SINGLE_VALUED)}) GROUP BY 1, 2) GROUP BY 1"""


@registry.add("p1_change_rates", _RATES)
def p1_change_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each attribute is asserted anew, and the satellite that follows from it."""
    rows = counting(table(spark, sf_dir, "facts")).filter(F.col("predicate").isin(*SINGLE_VALUED))
    return change_rates(rows, "subject_id", "predicate").withColumn("rows_per_entity", F.round("rows_per_entity", 6))


_P2 = """
WITH firsts AS (SELECT event_id, scope, observed_at, excluded_from_recall,
    row_number() OVER (PARTITION BY event_id ORDER BY recorded_at, wal_offset) AS rn FROM event_log),
live AS (SELECT scope, epoch_us(observed_at) AS us FROM firsts WHERE rn = 1 AND event_id IS NOT NULL AND NOT coalesce(excluded_from_recall, FALSE) AND observed_at IS NOT NULL),
flags AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS fresh FROM live WINDOW w AS (PARTITION BY scope ORDER BY us)),
nums AS (SELECT *, sum(fresh) OVER (PARTITION BY scope ORDER BY us) AS no FROM flags)
SELECT scope, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM nums GROUP BY scope, no"""


@registry.add("p2_found", _P2)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_sessions(table(spark, sf_dir, "event_log")).select("scope", "start_us", "end_us", "n_events")


_P4 = f"""
WITH rows_ AS (SELECT DISTINCT subject_id, predicate, epoch_us(valid_from) AS f, coalesce(epoch_us(valid_to), 9000000000000000000) AS t
    FROM facts WHERE {_COUNT} AND predicate IN ({", ".join(f"'{p}'" for p in PERIOD_PREDICATES)})),
reach AS (SELECT *, max(t) OVER (PARTITION BY subject_id, predicate ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rows_),
nums AS (SELECT *, sum(CASE WHEN before IS NULL OR f > before THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, predicate ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS no FROM reach),
periods AS (SELECT subject_id, predicate, no, min(f) AS f, max(t) AS t FROM nums GROUP BY 1, 2, 3),
nexts AS (SELECT *, lead(f) OVER (PARTITION BY subject_id, predicate ORDER BY f) AS nf FROM periods)
SELECT subject_id, predicate, 'period' AS kind, f AS from_us, CASE WHEN t = 9000000000000000000 THEN -1 ELSE t END AS to_us FROM periods
UNION ALL SELECT subject_id, predicate, 'gap' AS kind, t AS from_us, nf AS to_us FROM nexts WHERE nf IS NOT NULL"""


@registry.add("p4_found", _P4)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counting(table(spark, sf_dir, "facts")).filter(F.col("predicate").isin(*PERIOD_PREDICATES))
    rows = rows.select("subject_id", "predicate", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"))
    return coverage(rows, ["subject_id", "predicate"], "from_us", "to_us")
