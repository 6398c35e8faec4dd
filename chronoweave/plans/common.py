"""What the core queries share: the tables with repeated rows taken once, and fixed parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.facts import once
from chronoweave.session import table

#: A scope with a large part of the rows, and fixed points in time: no query reads the clock.
SCOPE = "org:norvane/fab2/etch:K417/user:shiftlog"
AREA = "org:norvane/fab2"
THEN, LATER, NOW = "2025-06-01 00:00:00", "2025-09-01 00:00:00", "2026-06-01 00:00:00"


#: What queries ask of facts.
ASKED = ["fact_id", "scope", "subject_id", "predicate", "object_type", "object_entity_id", "valid_from", "valid_to", "recorded_from", "recorded_to", "polarity", "assertion_status"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, repeated rows once. A row of facts never changes, so repeated rows are equal: they are grouped by what queries
    ask of them, which is pushed below that into the scan, and of the other columns only those that are used are read."""
    return table(spark, sf_dir, "facts").filter(F.col("fact_id").isNotNull()).dropDuplicates(ASKED)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, each as its last update left it."""
    return once(table(spark, sf_dir, "entities"), "entity_id", latest=("updated_at",))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, each as it was delivered first."""
    return once(table(spark, sf_dir, "event_log"), "event_id", first=("recorded_at", "wal_offset"))


def edges_of(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] | None = None) -> DataFrame:
    from chronoweave.operators.graph import edges

    return edges(facts(spark, sf_dir).filter(F.col("recorded_to").isNull()), True, predicates)


FACTS = "(SELECT DISTINCT * FROM facts WHERE fact_id IS NOT NULL)"
_ENTITY_ORDER = "updated_at scope canonical_name entity_type description identity_context context_key embedding merged_into merge_confidence created_at"
ENTITIES = f"(SELECT * FROM entities WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in _ENTITY_ORDER.split())}) = 1)"
EVENTS = "(SELECT * FROM event_log WHERE event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY recorded_at NULLS FIRST, wal_offset NULLS FIRST) = 1)"
CAUSAL_SQL = "('affects','cascades_to','caused_by','contributes_to','correlates_with','has_symptom','led_to','suggests','symptom_of','triggers')"
ELIGIBLE_SQL = f"(polarity = 'positive' AND predicate NOT IN ('ruled_out','contradicts','no_correlation') AND CASE WHEN predicate IN {CAUSAL_SQL} THEN assertion_status = 'confirmed' ELSE assertion_status IN ('observed','confirmed') END)"
EDGES_SQL = f"(SELECT fact_id, subject_id AS src, predicate, object_entity_id AS dst FROM {FACTS} WHERE recorded_to IS NULL AND object_type = 'entity' AND object_entity_id IS NOT NULL AND {ELIGIBLE_SQL})"


def ts(t: str) -> str:
    return f"TIMESTAMPTZ '{t}+00'"
