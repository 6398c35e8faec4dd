"""Queries over scopes, time axes, supersession and vocabularies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import temporal
from chronoweave.functions.ontology import SINGLE_FALLBACK, assertion, graph_eligible
from chronoweave.functions.scopes import in_view, parent, prefixes
from chronoweave.functions.text import fact_text
from chronoweave.functions.temporal import micros
from chronoweave.operators.facts import belief_log, coerce, conflicts, literal, supersede, superseding, with_names
from chronoweave.operators.history import SINGLE_VALUED
from chronoweave.operators.ordered import Ordered
from chronoweave.plans.common import AREA, CAUSAL_SQL, ELIGIBLE_SQL, ENTITIES, EVENTS, FACTS, LATER, SCOPE, THEN, entities, events, facts, ts
from chronoweave.plans.registry import Registry
from chronoweave.sources.ingest import missing_scopes, scopes_of
from chronoweave.session import table

registry = Registry()


def _view(name: str, scope: str, view: str, where: str) -> None:
    @registry.add(name, f"SELECT scope, count(*) AS n_facts, count(DISTINCT subject_id) AS n_subjects FROM {FACTS} WHERE {where} GROUP BY scope")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return facts(spark, sf_dir).filter(in_view("scope", scope, view)).groupBy("scope").agg(F.count(F.lit(1)).alias("n_facts"), F.countDistinct("subject_id").alias("n_subjects"))


_view("scope_local", SCOPE, "local", f"scope = '{SCOPE}'")
_view("scope_holistic", SCOPE, "holistic", f"scope IN ('org:norvane', 'org:norvane/fab2', 'org:norvane/fab2/etch:K417', '{SCOPE}')")
_view("scope_descend", AREA, "descend", f"(scope = '{AREA}' OR starts_with(scope, '{AREA}/'))")


@registry.add("scope_structured", f"SELECT 'facts' AS layer, count(*) AS n FROM {FACTS} WHERE scope = '{SCOPE}' UNION ALL SELECT 'entities', count(*) FROM {ENTITIES} WHERE scope = '{SCOPE}'")
def scope_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured view: derived layers without the events."""
    here = [df(spark, sf_dir).filter(in_view("scope", SCOPE)).agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n")) for name, df in (("facts", facts), ("entities", entities))]
    return here[0].unionByName(here[1])


_PREFIXES = """SELECT DISTINCT list_aggregate(list_slice(string_split(scope, '/'), 1, i), 'string_agg', '/') AS scope_path
    FROM ({src}) s, unnest(range(1, len(string_split(scope, '/')) + 1)) AS u(i) WHERE scope IS NOT NULL"""


@registry.add("scope_prefixes", f"SELECT scope_path, CASE WHEN contains(scope_path, '/') THEN regexp_replace(scope_path, '/[^/]*$', '') END AS parent_path FROM ({_PREFIXES.format(src='SELECT DISTINCT scope FROM facts')})")
def scope_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "facts").select("scope").distinct().select(F.explode(prefixes("scope")).alias("scope_path")).distinct()
    return paths.withColumn("parent_path", parent("scope_path"))


@registry.add("scopes_list", f"SELECT scope_path FROM ({_PREFIXES.format(src='SELECT scope FROM facts UNION SELECT scope FROM event_log UNION SELECT scope FROM entities')})")
def scopes_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes_of(*[table(spark, sf_dir, t) for t in ("facts", "event_log", "entities")]).select("scope_path")


@registry.add(
    "scope_provision",
    f"SELECT scope_path FROM ({_PREFIXES.format(src='SELECT scope FROM event_log')}) WHERE scope_path NOT IN (SELECT scope_path FROM ({_PREFIXES.format(src='SELECT scope FROM facts WHERE scope IS NOT NULL')}))",
)
def scope_provision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of events that no fact has provisioned: ancestors first, an anti join against what is known."""
    known = scopes_of(table(spark, sf_dir, "facts"))
    return missing_scopes(scopes_of(table(spark, sf_dir, "event_log")), known).select("scope_path")


def _when(name: str, rule: Callable[[], Column], where: str) -> None:
    @registry.add(name, f"SELECT fact_id, predicate, epoch_us(valid_from) AS valid_from_us, coalesce(epoch_us(valid_to), -1) AS valid_to_us FROM {FACTS} WHERE {where}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return facts(spark, sf_dir).filter(rule()).select("fact_id", "predicate", micros("valid_from").alias("valid_from_us"), F.coalesce(micros("valid_to"), F.lit(-1)).alias("valid_to_us"))


_A, _B = ts(THEN), ts(LATER)
_VALID = f"valid_from <= {_A} AND (valid_to IS NULL OR {_A} < valid_to)"
_when("facts_now", temporal.current, "valid_to IS NULL AND recorded_to IS NULL")
_when("facts_still_valid", temporal.still_valid, "valid_to IS NULL")
_when("facts_as_of", lambda: temporal.as_of(THEN), f"{_VALID} AND recorded_to IS NULL")
_when("facts_bitemporal", lambda: temporal.as_of(THEN, True), f"{_VALID} AND recorded_from <= {_A} AND (recorded_to IS NULL OR {_A} < recorded_to)")
_when("facts_as_known", lambda: temporal.as_known(THEN), f"recorded_from <= {_A} AND (recorded_to IS NULL OR {_A} < recorded_to)")
_when("facts_listed_as_of", lambda: temporal.listed_as_of(THEN, True), f"{_VALID} AND recorded_from <= {_A}")
_when("facts_valid_during", lambda: temporal.overlaps("valid", THEN, LATER), f"valid_from <= {_B} AND (valid_to IS NULL OR valid_to >= {_A})")
_when("facts_recorded_during", lambda: temporal.overlaps("recorded", THEN, LATER), f"recorded_from <= {_B} AND (recorded_to IS NULL OR recorded_to >= {_A})")


@registry.add("facts_phrase_window", f"SELECT fact_id FROM {FACTS} WHERE valid_from >= {ts('2025-05-02 00:00:00')} AND valid_from < {ts(THEN)}")
def facts_phrase_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that began in the time a phrase names ("last month" before a reference date)."""
    from datetime import datetime

    start, end = temporal.phrase_window(" Last Month ", datetime.fromisoformat(THEN))
    at = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return facts(spark, sf_dir).filter((F.col("valid_from") >= at(start)) & (F.col("valid_from") < at(end))).select("fact_id")


_SINGLE = ", ".join(f"'{p}'" for p in SINGLE_VALUED)
_ASSERT = f"(SELECT * FROM {FACTS} WHERE polarity = 'positive' AND assertion_status IN ('observed', 'confirmed') AND predicate IN ({_SINGLE}) AND valid_from IS NOT NULL)"


def _supersede_sql(where: str) -> str:
    return f"""WITH a AS (SELECT * FROM {_ASSERT} WHERE {where}),
    last AS (SELECT scope, subject_id, predicate, valid_from, arg_max(fact_id, (recorded_from, fact_id)) AS assertion_id, arg_max(valid_to, (recorded_from, fact_id)) FILTER (WHERE valid_to IS NOT NULL) AS explicit FROM a GROUP BY 1, 2, 3, 4)
    SELECT scope, subject_id, predicate, assertion_id, epoch_us(valid_from) AS from_us,
        coalesce(epoch_us(least(explicit, lead(valid_from) OVER (PARTITION BY scope, subject_id, predicate ORDER BY valid_from))), -1) AS to_us FROM last"""


def _assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).filter(superseding(F.col("predicate").isin(*SINGLE_VALUED)))
    return rows.select("scope", "subject_id", "predicate", F.col("fact_id").alias("assertion_id"), "valid_from", "valid_to", "recorded_from", literal().alias("value"))


def _superseded(rows: DataFrame) -> DataFrame:
    return rows.select("scope", "subject_id", "predicate", "assertion_id", micros("valid_from").alias("from_us"), F.coalesce(micros("valid_to"), F.lit(-1)).alias("to_us"))


@registry.add("facts_superseded", _supersede_sql("TRUE"))
def facts_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current belief of every single-valued fact, from assertions in any order of arrival."""
    return _superseded(supersede(_assertions(spark, sf_dir), ["scope", "subject_id", "predicate"]))


@registry.add("facts_superseded_known", _supersede_sql(f"recorded_from <= {_A}"))
def facts_superseded_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same belief as it was at an earlier time."""
    return _superseded(supersede(_assertions(spark, sf_dir), ["scope", "subject_id", "predicate"], F.lit(THEN).cast("timestamp")))


@registry.add("facts_belief_log")
def facts_belief_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version that was ever believed and when: the ordered fold over arrivals."""
    rows = _assertions(spark, sf_dir)
    for c in ("valid_from", "valid_to", "recorded_from"):
        rows = rows.withColumn(c, micros(c))
    return belief_log(rows, ["scope", "subject_id", "predicate"])


@registry.add(
    "facts_timeline",
    f"SELECT subject_id, predicate, fact_id, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from, recorded_from, fact_id) AS version FROM {FACTS} WHERE predicate IN ('has_status', 'qual_level') AND recorded_to IS NULL",
)
def facts_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).filter(F.col("predicate").isin("has_status", "qual_level") & F.col("recorded_to").isNull()).withColumn("one", F.lit(1))
    numbered = Ordered(rows.select("subject_id", "predicate", "valid_from", "recorded_from", "fact_id", "one"), ["subject_id", "predicate"], ["valid_from", "recorded_from", "fact_id"]).running_sum("one", "version")
    return numbered.result().select("subject_id", "predicate", "fact_id", "version")


@registry.add(
    "conflict_detect",
    f"""SELECT scope, subject_id, predicate, count(DISTINCT concat_ws(':', object_type, coalesce(object_entity_id, json_extract_string(object_value, '$.value'), ''))) AS n_objects, count(*) AS n_facts
    FROM {FACTS} WHERE valid_to IS NULL AND recorded_to IS NULL AND predicate IN ({_SINGLE}) GROUP BY 1, 2, 3 HAVING n_objects > 1""",
)
def conflict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = facts(spark, sf_dir).filter(temporal.current() & F.col("predicate").isin(*SINGLE_VALUED))
    return conflicts(live, ["scope", "subject_id", "predicate"])


_NAMED = f"""SELECT f.*, s.canonical_name AS subject_name, CASE WHEN f.object_type = 'entity' THEN o.canonical_name ELSE json_extract_string(f.object_value, '$.value') END AS object_text
    FROM {FACTS} f JOIN {ENTITIES} s ON s.entity_id = f.subject_id LEFT JOIN {ENTITIES} o ON o.entity_id = f.object_entity_id"""


@registry.add("fact_texts", f"SELECT fact_id, concat_ws(' ', coalesce(subject_name, '?'), predicate, object_text) AS fact_text, greatest(1, length(concat_ws(' ', coalesce(subject_name, '?'), predicate, object_text)) // 3) AS tokens FROM ({_NAMED}) WHERE recorded_to IS NULL")
def fact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_names(facts(spark, sf_dir).filter(F.col("recorded_to").isNull()), entities(spark, sf_dir))
    text = fact_text()
    return rows.select("fact_id", text.alias("fact_text"), F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("long").alias("tokens"))


@registry.add("graph_eligible", f"SELECT predicate, polarity, assertion_status, {ELIGIBLE_SQL} AS eligible, count(*) AS n FROM {FACTS} GROUP BY 1, 2, 3, 4")
def graph_eligible_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("predicate", "polarity", "assertion_status", graph_eligible().alias("eligible")).agg(F.count(F.lit(1)).alias("n"))


_SEM = f"""CASE WHEN predicate = 'ruled_out' THEN 'negative' WHEN predicate IN ('contradicts', 'no_correlation') THEN 'positive' ELSE polarity END AS polarity_out,
    CASE WHEN predicate = 'ruled_out' THEN 'ruled_out' WHEN predicate IN ('contradicts', 'no_correlation') THEN coalesce(assertion_status, 'observed')
    WHEN predicate IN {CAUSAL_SQL} THEN CASE WHEN polarity = 'negative' OR assertion_status IN ('ruled_out', 'rejected') THEN 'ruled_out'
        WHEN assertion_status = 'confirmed' AND trim(coalesce(evidence_span, '')) <> '' THEN 'confirmed' ELSE 'hypothesized' END
    ELSE coalesce(assertion_status, 'observed') END AS status_out"""


@registry.add("assertion_semantics", f"SELECT fact_id, {_SEM} FROM {FACTS}")
def assertion_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarity and status that each fact gets if it is stated again by a trusted source."""
    rows = facts(spark, sf_dir).withColumn("negation", F.lit(False)).withColumn("trusted", F.lit(True)).withColumn("source_text", F.lit(None).cast("string"))
    polarity, status = assertion()
    return rows.select("fact_id", polarity.alias("polarity_out"), status.alias("status_out"))


_WORDS = "(SELECT name, unnest(list_distinct(list_append(aliases, canonical_value))) AS word, canonical_value FROM vocabulary_values)"


@registry.add(
    "vocab_coerce_closed",
    f"""SELECT f.fact_id, w.c AS coerced FROM (SELECT fact_id, predicate, json_extract_string(object_value, '$.value') AS v FROM {FACTS} WHERE predicate IN (SELECT name FROM vocabulary_values)) f
    LEFT JOIN (SELECT name, word, min(canonical_value) AS c FROM {_WORDS} GROUP BY 1, 2) w ON w.name = f.predicate AND w.word = f.v""",
)
def vocab_coerce_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = table(spark, sf_dir, "vocabulary_values")
    rows = facts(spark, sf_dir).join(vocabulary.select(F.col("name").alias("predicate")).distinct(), "predicate", "left_semi").withColumn("v", literal())
    return coerce(rows.select("fact_id", "predicate", "v"), vocabulary, "v", "predicate").select("fact_id", "coerced")


@registry.add(
    "vocab_coerce_open",
    f"""SELECT f.fact_id, coalesce(w.c, CASE WHEN f.predicate NOT IN (SELECT name FROM vocabulary_values) THEN f.v END) AS coerced FROM (SELECT fact_id, predicate, json_extract_string(object_value, '$.value') AS v FROM {FACTS} WHERE object_type = 'literal') f
    LEFT JOIN (SELECT name, word, min(canonical_value) AS c FROM {_WORDS} GROUP BY 1, 2) w ON w.name = f.predicate AND w.word = f.v""",
)
def vocab_coerce_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all predicates: those without a vocabulary keep their value."""
    rows = facts(spark, sf_dir).filter(F.col("object_type") == "literal").withColumn("v", literal())
    return coerce(rows.select("fact_id", "predicate", "v"), table(spark, sf_dir, "vocabulary_values"), "v", "predicate").select("fact_id", "coerced")


@registry.add("vocab_quarantine", f"SELECT f.fact_id, f.predicate, f.v AS raw_object, 'unknown_closed_value' AS reason FROM (SELECT fact_id, predicate, json_extract_string(object_value, '$.value') AS v FROM {FACTS} WHERE predicate IN (SELECT name FROM vocabulary_values WHERE kind = 'closed')) f WHERE f.v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_WORDS} w WHERE w.name = f.predicate AND w.word = f.v)")
def vocab_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a closed vocabulary doesn't know, as diagnostics; they aren't dropped silently."""
    vocabulary = table(spark, sf_dir, "vocabulary_values").filter(F.col("kind") == "closed")
    rows = facts(spark, sf_dir).join(vocabulary.select(F.col("name").alias("predicate")).distinct(), "predicate", "left_semi").withColumn("v", literal()).filter(F.col("v").isNotNull())
    out = coerce(rows.select("fact_id", "predicate", "v"), vocabulary, "v", "predicate").filter(F.col("coerced").isNull())
    return out.select("fact_id", "predicate", F.col("v").alias("raw_object"), F.lit("unknown_closed_value").alias("reason"))


_FALLBACK = ", ".join(f"'{p}'" for p in SINGLE_FALLBACK)


@registry.add(
    "single_value_flag",
    f"SELECT p.predicate, coalesce(v.s, p.predicate IN ({_FALLBACK})) AS is_single FROM (SELECT DISTINCT predicate FROM facts) p LEFT JOIN (SELECT name, bool_or(cardinality = 'single') AS s FROM vocabulary_values GROUP BY 1) v ON v.name = p.predicate",
)
def single_value_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "vocabulary_values").groupBy(F.col("name").alias("predicate")).agg(F.max(F.col("cardinality") == "single").alias("s"))
    rows = table(spark, sf_dir, "facts").select("predicate").distinct()
    return rows.join(known, "predicate", "left").select("predicate", F.coalesce("s", F.col("predicate").isin(*SINGLE_FALLBACK)).alias("is_single"))


@registry.add("vocab_nested", "SELECT name, kind, count(*) AS n_values, string_agg(canonical_value, ',' ORDER BY canonical_value) AS canonical_values, sum(len(aliases)) AS n_aliases FROM vocabulary_values GROUP BY 1, 2")
def vocab_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "vocabulary_values").groupBy("name", "kind")
    return rows.agg(F.count(F.lit(1)).alias("n_values"), F.array_join(F.array_sort(F.collect_list("canonical_value")), ",").alias("canonical_values"), F.sum(F.size("aliases")).alias("n_aliases"))


@registry.add("layer_counts", f"SELECT 'events' AS layer, count(*) AS n FROM {EVENTS} UNION ALL SELECT 'facts', count(*) FROM {FACTS} UNION ALL SELECT 'entities', count(*) FROM {ENTITIES}")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [df(spark, sf_dir).agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n")) for name, df in (("events", events), ("facts", facts), ("entities", entities))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
