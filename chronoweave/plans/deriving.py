"""Extraction end to end, forgetting with redaction, cases and concepts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.ontology import SINGLE_FALLBACK, vocabulary
from chronoweave.functions.temporal import current
from chronoweave.operators import beliefs as belief_ops
from chronoweave.functions.vectors import enriched
from chronoweave.operators import episodes as episode_ops
from chronoweave.operators import extraction, tables
from chronoweave.operators import governance as gov
from chronoweave.operators.history import SINGLE_VALUED
from chronoweave.plans.common import AREA, ENTITIES, EVENTS, FACTS, NOW, SCOPE, entities, events, facts, ts
from chronoweave.plans.knowledge import _MEMBERS, _TOPICS
from chronoweave.plans.registry import Registry
from chronoweave.session import checkpointed, table
from chronoweave.sources.ingest import scopes_of

registry = Registry()


def _extracted(spark: SparkSession, sf_dir: str, reader=None) -> extraction.Extracted:
    return extraction.extract(events(spark, sf_dir), entities(spark, sf_dir), table(spark, sf_dir, "entity_aliases"), table(spark, sf_dir, "vocabulary_values"), reader)


_AT = "json_extract_string(content, '$.triple.{}')"
_TOLD = f"""told AS (SELECT event_id, scope, {_AT.format('subject')} AS subject, {_AT.format('predicate')} AS predicate, {_AT.format('object')} AS object, coalesce(CAST({_AT.format('confidence')} AS DOUBLE), 0.9) AS confidence, observed_at, recorded_at
    FROM {EVENTS} WHERE json_extract_string(content, '$.kind') = 'triple' AND trim({_AT.format('subject')}) <> '' AND trim({_AT.format('predicate')}) <> ''),
words AS (SELECT name, w, min(canonical_value) AS canonical FROM (SELECT name, canonical_value, unnest(list_append(coalesce(aliases, []), canonical_value)) AS w FROM vocabulary_values) GROUP BY 1, 2),
closed AS (SELECT name, max(CASE WHEN kind = 'closed' THEN 1 ELSE 0 END) AS closed FROM vocabulary_values GROUP BY 1),
coerced AS (SELECT t.*, coalesce(w.canonical, CASE WHEN coalesce(c.closed, 0) = 0 THEN t.object END) AS value FROM told t LEFT JOIN words w ON w.name = t.predicate AND w.w = t.object LEFT JOIN closed c ON c.name = t.predicate),
live AS (SELECT entity_id, scope, canonical_name FROM {ENTITIES} WHERE merged_into IS NULL),
names AS (SELECT scope, name, min(entity_id) AS entity_id FROM (SELECT scope, lower(trim(canonical_name)) AS name, entity_id FROM live UNION SELECT l.scope, lower(trim(a.alias)), l.entity_id FROM entity_aliases a JOIN live l USING (entity_id)) WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT entity_id) = 1),
linked AS (SELECT c.*, coalesce(s.entity_id, sha256(c.scope || '|' || lower(trim(c.subject)))) AS subject_id, o.entity_id AS object_id FROM coerced c LEFT JOIN names s ON s.scope = c.scope AND s.name = lower(trim(c.subject))
    LEFT JOIN names o ON o.scope = c.scope AND o.name = lower(trim(c.value)) WHERE c.value IS NOT NULL),
found AS (SELECT sha256(concat_ws('|', scope, subject_id, predicate, coalesce(object_id, value), event_id)) AS fact_id, *, coalesce(observed_at, recorded_at) AS valid_from FROM linked)"""


@registry.add("extract_facts", f"WITH {_TOLD} SELECT DISTINCT fact_id, scope, subject_id, predicate, object_id AS object_entity_id, CASE WHEN object_id IS NULL THEN value END AS value, epoch_us(valid_from) AS valid_from_us, confidence FROM found")
def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that statements in events add: coerced, linked, with ids."""
    out = _extracted(spark, sf_dir).facts
    return out.select("fact_id", "scope", "subject_id", "predicate", "object_entity_id", F.get_json_object("object_value", "$.value").alias("value"), F.unix_micros("valid_from").alias("valid_from_us"), "confidence")


@registry.add("extract_quarantine", f"WITH {_TOLD} SELECT event_id, predicate, object AS value, concat_ws(' ', subject, predicate, object) AS evidence, 'given' AS model FROM coerced WHERE value IS NULL AND object IS NOT NULL")
def extract_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that a closed vocabulary doesn't know, with event, evidence and model."""
    return _extracted(spark, sf_dir).quarantine.select("event_id", "predicate", "value", "evidence", "model")


@registry.add("extract_entities", f"WITH {_TOLD} SELECT subject_id AS entity_id, scope, min(subject) AS canonical_name FROM found WHERE subject_id NOT IN (SELECT entity_id FROM live) GROUP BY 1, 2")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that statements in events are the first to name."""
    return _extracted(spark, sf_dir).entities


_ONE = ", ".join(f"'{p}'" for p in sorted({*SINGLE_VALUED, *SINGLE_FALLBACK}))
_AFTER = f"""{_TOLD}, believed AS (SELECT fact_id, scope, subject_id, predicate, valid_from, valid_to, recorded_from, polarity, assertion_status FROM {FACTS} WHERE recorded_to IS NULL),
every_ AS (SELECT * FROM believed UNION ALL SELECT DISTINCT fact_id, scope, subject_id, predicate, valid_from, NULL::TIMESTAMPTZ, recorded_at, 'positive', 'observed' FROM found WHERE fact_id NOT IN (SELECT fact_id FROM believed)),
taking AS (SELECT * FROM every_ WHERE predicate IN ({_ONE}) AND polarity = 'positive' AND assertion_status IN ('observed', 'confirmed') AND valid_from IS NOT NULL),
last_ AS (SELECT scope, subject_id, predicate, valid_from, arg_max(fact_id, (recorded_from, fact_id)) AS fact_id, arg_max(valid_to, (recorded_from, fact_id)) FILTER (WHERE valid_to IS NOT NULL) AS explicit_to FROM taking GROUP BY 1, 2, 3, 4),
ended AS (SELECT fact_id, predicate, least(explicit_to, lead(valid_from) OVER (PARTITION BY scope, subject_id, predicate ORDER BY valid_from)) AS valid_to FROM last_),
after AS (SELECT * FROM ended UNION ALL SELECT fact_id, predicate, valid_to FROM every_ WHERE fact_id NOT IN (SELECT fact_id FROM taking))"""


def _single():
    return F.col("predicate").isin(*sorted({*SINGLE_VALUED, *SINGLE_FALLBACK}))


@registry.add("extract_merged", f"WITH {_AFTER} SELECT predicate, count(*) AS n, count(valid_to) AS n_ended, max(epoch_us(valid_to)) AS last_us FROM after GROUP BY 1")
def extract_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is believed after the new facts came to the old ones, by predicate."""
    after = extraction.merged(facts(spark, sf_dir), _extracted(spark, sf_dir).facts, _single())
    return after.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count("valid_to").alias("n_ended"), F.max(F.unix_micros("valid_to")).alias("last_us"))


@registry.add("extract_beliefs")
def extract_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beliefs that the facts read from all events, statements and texts, may change, made anew."""
    from chronoweave.functions.text import extract_triples

    got = _extracted(spark, sf_dir, extract_triples)
    new = checkpointed(got.facts)
    names = entities(spark, sf_dir).select("entity_id", "canonical_name").unionByName(got.entities.select("entity_id", "canonical_name"))
    return extraction.revised(facts(spark, sf_dir), new, names, _single())


_GONE = f"(scope = '{SCOPE}' AND (recorded_to IS NOT NULL OR predicate = 'has_status'))"


@registry.add("forget_redact", f"SELECT count(*) FILTER (WHERE e.event_id IN (SELECT unnest(supports) FROM {FACTS} WHERE {_GONE}) AND e.scope = '{SCOPE}') AS redacted, count(*) AS n, (SELECT count(*) FROM {FACTS} WHERE {_GONE}) AS closed FROM {EVENTS} e")
def forget_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forgetting a predicate in a scope, with the events behind facts of the scope that are believed no longer."""
    log = events(spark, sf_dir).withColumn("content", F.lit("x"))
    held = facts(spark, sf_dir)
    none = spark.createDataFrame([], "scope string, about_entity_id string, recorded_to timestamp")
    after, _, left = gov.forget_scope(held, none, log, SCOPE, NOW, predicate="has_status", redact=True)
    closed = after.filter((F.col("scope") == SCOPE) & F.col("recorded_to").isNotNull()).agg(F.count(F.lit(1)).alias("closed"))
    return left.agg(F.count_if(F.col("content") == "{}").alias("redacted"), F.count(F.lit(1)).alias("n")).crossJoin(closed)  # one row each


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of cases, made of the events that name one."""
    rows = events(spark, sf_dir).filter(F.col("case_id").isNotNull())
    per = rows.groupBy("case_id").agg(F.min("scope").alias("scope"), F.min("observed_actor").alias("equipment"), F.count(F.lit(1)).alias("n_events"))
    return per.select("case_id", "scope", F.concat(F.lit("Case "), "case_id").alias("title"), "equipment", F.lit(None).cast("string").alias("root_cause"), F.lit(None).cast("string").alias("resolution"), F.when(F.col("n_events") > 2, "investigating").otherwise("open").alias("status"), F.lit("observation").alias("phase"), "n_events")


_CASES = f"(SELECT case_id, min(scope) AS scope, 'Case ' || case_id AS title, min(observed_actor) AS equipment, CASE WHEN count(*) > 2 THEN 'investigating' ELSE 'open' END AS status, count(*) AS n_events FROM {EVENTS} WHERE case_id IS NOT NULL GROUP BY case_id)"


@registry.add("case_find", f"SELECT case_id, scope, n_events FROM {_CASES} WHERE status = 'investigating' AND (contains(lower(title), 'a') OR contains(lower(coalesce(equipment, '')), 'a'))")
def case_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by status and by text in any of their fields."""
    return tables.find_cases(_cases(spark, sf_dir), text="A", status="investigating").select("case_id", "scope", "n_events")


@registry.add("case_changes", f"SELECT case_id, CASE WHEN n_events > 3 THEN 'resolved' ELSE status END AS status, CASE WHEN n_events > 3 THEN 'remediation' ELSE 'observation' END AS phase FROM {_CASES}")
def case_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of cases after checked changes: resolved ones, and one of an unknown phase that is rejected."""
    rows = _cases(spark, sf_dir).select("case_id", "status", "phase", "n_events")
    asked = rows.withColumn("phase", F.when(F.col("n_events") > 3, "remediation").otherwise("no such phase")).withColumn("status", F.lit("resolved"))
    return tables.upsert(rows, tables.checked_cases(asked)[0], ["case_id"]).select("case_id", "status", "phase")


@registry.add("concepts_list", f"SELECT scope, topic, summary FROM ({_TOPICS}) WHERE scope = '{SCOPE}' ORDER BY topic LIMIT 20")
def concepts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first concepts of a scope (a listing of twenty)."""
    names = entities(spark, sf_dir)
    live = facts(spark, sf_dir).filter(current())
    return belief_ops.topics(belief_ops.revise(live, names), live, names).filter(F.col("scope") == SCOPE).orderBy("topic").limit(20).select("scope", "topic", "summary")


@registry.add("scopes_prefix", "WITH RECURSIVE up AS (SELECT DISTINCT scope AS s FROM event_log WHERE scope IS NOT NULL UNION SELECT regexp_replace(s, '/[^/]*$', '') FROM up WHERE contains(s, '/')) SELECT s AS scope_path FROM up WHERE starts_with(s, 'org:norvane/fab2')")
def scopes_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes by the beginning of their path."""
    return scopes_of(table(spark, sf_dir, "event_log")).filter(F.col("scope_path").startswith(AREA)).select("scope_path")


@registry.add("refcount_all", f"{_MEMBERS}, links AS (SELECT scope, event_id FROM (SELECT DISTINCT fact_id, scope, unnest(supports) AS event_id FROM {FACTS}) UNION ALL SELECT scope, event_id FROM members) SELECT e.scope, e.event_id, count(l.event_id) AS refcount FROM {EVENTS} e LEFT JOIN links l ON l.scope = e.scope AND l.event_id = e.event_id GROUP BY 1, 2")
def refcount_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts and episodes rest on each event."""
    log = events(spark, sf_dir)
    return gov.reference_counts(log, facts(spark, sf_dir), episode_ops.episodes(log)[0])


@registry.add("vocab_seed", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in vocabulary()) + ") AS t(predicate, cardinality)")
def vocab_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates of the ontology with their cardinality, as rows to seed a vocabulary with."""
    return spark.createDataFrame(vocabulary(), "predicate string, cardinality string")


@registry.add("phrase_changes", "SELECT * FROM (VALUES ('last week', '-P14D..P0D'), ('last month', '-P30D..P0D'), ('this shift', '-PT8H..P0D')) AS t(name, expression)")
def phrase_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time phrases after an upsert by lower-case name: one changed, one added."""
    rows = spark.createDataFrame([("last week", "-P7D..P0D"), ("last month", "-P30D..P0D")], "name string, expression string")
    changes = spark.createDataFrame([("Last Week", "-P14D..P0D"), ("This shift", "-PT8H..P0D")], rows.schema)
    return tables.upsert(rows, changes.withColumn("name", F.lower("name")), ["name"])


@registry.add("pack_cache", f"SELECT scope AS key, arg_max(event_id, (recorded_at, event_id)) AS value FROM {EVENTS} WHERE recorded_at <= {ts(NOW)} AND recorded_at > {ts(NOW)} - INTERVAL 31536000 SECONDS GROUP BY 1")
def pack_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of a cache per key that hasn't expired."""
    cache = events(spark, sf_dir).select(F.col("scope").alias("key"), F.col("recorded_at").alias("created_at"), F.col("event_id").alias("value"))
    return tables.unexpired(cache, NOW, 31_536_000).select("key", "value")


@registry.add("lifecycle_emit", f"SELECT kind, count(DISTINCT event_id) AS n, max(epoch_us(ts)) AS last_us FROM (SELECT event_id, 'captured' AS kind, observed_at AS ts FROM {EVENTS} UNION ALL SELECT event_id, 'indexed', recorded_at FROM {EVENTS}) WHERE ts IS NOT NULL GROUP BY 1")
def lifecycle_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle that events leave behind, emitted twice and kept once."""
    log = events(spark, sf_dir)
    rows = tables.emitted(log, "captured", "event_id", "observed_at").unionByName(tables.emitted(log, "indexed", "event_id", "recorded_at"))
    return rows.unionByName(rows).dropDuplicates(["lifecycle_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ts")).alias("last_us"))


@registry.add("entities_enriched", f"SELECT entity_id, 64 AS n FROM {ENTITIES} WHERE embedding IS NULL AND merged_into IS NULL AND canonical_name IS NOT NULL ORDER BY entity_id LIMIT 100")
def entities_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred entities to embed (one round of the worker), with their vectors' sizes."""
    return enriched(entities(spark, sf_dir)).select("entity_id", F.size("embedding").cast("long").alias("n"))


@registry.add("concepts_named", f"SELECT scope, count(*) AS n FROM ({_TOPICS}) WHERE contains(lower(topic), 'e') GROUP BY 1")
def concepts_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many concepts of each scope have a text in their name."""
    names, live = entities(spark, sf_dir), facts(spark, sf_dir).filter(current())
    found = belief_ops.topics(belief_ops.revise(live, names), live, names)
    return found.filter(F.contains(F.lower("topic"), F.lit("e"))).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


_PHASES = "CASE WHEN embed_status = 'done' THEN 'completed' WHEN embed_status = 'pending' THEN 'enumerate' ELSE 'delete' END"


@registry.add("erasure_status", f"SELECT scope, phase, count(*) AS n FROM (SELECT event_id, scope, CASE WHEN event_id = (SELECT min(event_id) FROM {EVENTS} WHERE embed_status = 'pending') THEN 'cancelled' ELSE {_PHASES} END AS phase FROM {EVENTS}) WHERE phase <> 'completed' GROUP BY 1, 2")
def erasure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open erasure jobs (one for each event here) by scope and phase, after the first of them was cancelled."""
    status = F.col("embed_status")
    jobs = events(spark, sf_dir).select(F.col("event_id").alias("erasure_id"), "scope", F.when(status == "done", "completed").when(status == "pending", "enumerate").otherwise("delete").alias("phase"), F.col("recorded_at").alias("requested_at"))
    first = jobs.filter(F.col("phase") == "enumerate").agg(F.min("erasure_id")).first()[0]
    return tables.erasure_jobs(tables.cancelled(jobs, first or ""), ("enumerate", "delete", "cancelled")).groupBy("scope", "phase").agg(F.count(F.lit(1)).alias("n"))
