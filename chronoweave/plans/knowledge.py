"""Queries over ingestion, episodes, the graph, beliefs and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.temporal import current, micros
from chronoweave.functions.text import CONTEXT_FIELDS, NARROW, SENSITIVE_TYPES, TYPE_FIELDS, WIDE, context_key, identity_patterns, identity_tokens, may_be_same
from chronoweave.functions.vectors import cosine, usable
from chronoweave.operators import beliefs as belief_ops
from chronoweave.operators import episodes as episode_ops
from chronoweave.operators import graph as graph_ops
from chronoweave.operators.facts import merged_once, with_names
from chronoweave.plans.common import EDGES_SQL, ENTITIES, EVENTS, FACTS, SCOPE, edges_of, entities, events, facts
from chronoweave.plans.registry import Registry
from chronoweave.session import table
from chronoweave.sources import ingest

registry = Registry()


# Ingestion.


@registry.add(
    "ingest_idempotent",
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN first_value(modality || content || coalesce(context, '')) OVER w = modality || content || coalesce(context, '') THEN 'duplicate' ELSE 'conflict' END AS status
    FROM event_log WHERE idempotency_key IS NOT NULL WINDOW w AS (PARTITION BY scope, idempotency_key ORDER BY wal_offset)) GROUP BY status""",
)
def ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append-only log does with repeated deliveries of a key."""
    rows = table(spark, sf_dir, "event_log").filter(F.col("idempotency_key").isNotNull())
    return ingest.admitted(rows, ["wal_offset"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@registry.add("ingest_conflicts", "SELECT scope, idempotency_key, count(DISTINCT modality || content || coalesce(context, '')) AS n_bodies FROM event_log WHERE idempotency_key IS NOT NULL GROUP BY 1, 2 HAVING n_bodies > 1")
def ingest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.key_conflicts(table(spark, sf_dir, "event_log"))


@registry.add(
    "import_progress",
    """SELECT scope, count(*) AS total, count(*) FILTER (WHERE rn = 1) AS accepted, count(*) FILTER (WHERE rn > 1 AND body <> head) AS failed FROM (SELECT scope, modality || content || coalesce(context, '') AS body,
    first_value(modality || content || coalesce(context, '')) OVER w AS head, row_number() OVER w AS rn FROM event_log WHERE idempotency_key IS NOT NULL WINDOW w AS (PARTITION BY scope, idempotency_key ORDER BY wal_offset)) GROUP BY scope""",
)
def import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "event_log").filter(F.col("idempotency_key").isNotNull())
    return ingest.progress(ingest.admitted(rows, ["wal_offset"]))


@registry.add(
    "import_jsonl",
    """SELECT json_extract_string(raw, '$.scope') AS scope, json_extract_string(raw, '$.modality') AS modality, json_extract_string(raw, '$.idempotency_key') AS idempotency_key, json_extract_string(raw, '$.content.kind') AS kind, length(json_extract_string(raw, '$.content.text')) AS n_chars
    FROM (SELECT CASE WHEN json_valid(raw) THEN raw END AS raw FROM incident_envelopes) WHERE raw IS NOT NULL""",
)
def import_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes from raw JSON records; invalid ones are left out."""
    lines = table(spark, sf_dir, "incident_envelopes").select(F.col("raw").alias("value"))
    out = ingest.from_jsonl(lines, SCOPE, "{scope}", ("scope",))
    return out.select("scope", "modality", "idempotency_key", F.get_json_object("content", "$.kind").alias("kind"), F.length(F.get_json_object("content", "$.text")).cast("long").alias("n_chars"))


@registry.add("import_mem0", f"SELECT '{SCOPE}/src:' || coalesce(source, '{{source}}') AS scope, 'conversation' AS modality, 'message' AS kind, coalesce(title, '') AS text, source AS intent FROM documents")
def import_mem0(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("title").alias("memory"), F.col("created_at").cast("string").alias("timestamp"), F.array(F.col("lang")).alias("labels"), F.col("source").alias("intent"), "source")
    out = ingest.from_mem0(docs, SCOPE, SCOPE + "/src:{source}")
    return out.select("scope", "modality", F.get_json_object("content", "$.kind").alias("kind"), F.get_json_object("content", "$.text").alias("text"), F.get_json_object("context", "$.intent").alias("intent"))


@registry.add("import_letta", "SELECT 'org:norvane' AS scope, 'document' AS modality, coalesce(title, '') AS text, source AS intent FROM documents")
def import_letta(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select(F.col("title").alias("text"), F.col("source").alias("label"))
    return ingest.from_letta(blocks, "org:norvane").select("scope", "modality", F.get_json_object("content", "$.text").alias("text"), F.get_json_object("context", "$.intent").alias("intent"))


@registry.add("import_openai", "SELECT 'observation' AS modality, CAST(doc_id AS VARCHAR) AS idempotency_key, coalesce(title, '') AS text FROM documents")
def import_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("title").alias("content"))
    return ingest.from_openai(memories, "org:norvane").select("modality", "idempotency_key", F.get_json_object("content", "$.text").alias("text"))


_TEXT = "sha256(coalesce(text, '')) AS text_hash, CAST(length(coalesce(text, '')) AS BIGINT) AS n_characters"


def _hashed(envelopes: DataFrame, *columns: str) -> DataFrame:
    """Columns of envelopes, and hash and length of their text as it comes out of the JSON again."""
    text = F.get_json_object("content", "$.text")
    return envelopes.select(*columns, F.sha2(text, 256).alias("text_hash"), F.length(text).cast("long").alias("n_characters"))


@registry.add("import_mem0_texts", f"SELECT '{SCOPE}/src:' || coalesce(source, '{{source}}') AS scope, 'conversation' AS modality, {_TEXT} FROM documents")
def import_mem0_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through an importer."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("memory"), F.col("created_at").cast("string").alias("timestamp"), F.array(F.col("lang")).alias("labels"), F.col("source").alias("intent"), "source")
    return _hashed(ingest.from_mem0(docs, SCOPE, SCOPE + "/src:{source}"), "scope", "modality")


@registry.add("import_letta_texts", f"SELECT 'org:norvane' AS scope, 'document' AS modality, {_TEXT} FROM documents")
def import_letta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select("text", F.col("source").alias("label"))
    return _hashed(ingest.from_letta(blocks, "org:norvane"), "scope", "modality")


@registry.add("import_openai_texts", f"SELECT 'observation' AS modality, CAST(doc_id AS VARCHAR) AS idempotency_key, {_TEXT} FROM documents")
def import_openai_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return _hashed(ingest.from_openai(memories, "org:norvane"), "modality", "idempotency_key")


_ZEP = f"SELECT s.canonical_name AS subject, f.predicate, o.canonical_name AS object, f.valid_from, f.valid_to, f.confidence FROM {FACTS} f JOIN {ENTITIES} s ON s.entity_id = f.subject_id JOIN {ENTITIES} o ON o.entity_id = f.object_entity_id WHERE f.object_type = 'entity'"


@registry.add(
    "import_zep",
    f"SELECT sha256('org:norvane|' || lower(trim(subject))) AS subject_id, predicate, sha256('org:norvane|' || lower(trim(object))) AS object_entity_id, epoch_us(coalesce(valid_from, TIMESTAMPTZ '2026-01-01 00:00:00+00')) AS valid_from_us, coalesce(epoch_us(valid_to), -1) AS valid_to_us FROM ({_ZEP})",
)
def import_zep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bi-temporal statements become facts with their own periods."""
    rows = with_names(facts(spark, sf_dir).filter(F.col("object_type") == "entity"), entities(spark, sf_dir)).filter(F.col("object_text").isNotNull())
    statements = rows.select(F.col("subject_name").alias("subject"), "predicate", F.col("object_text").alias("object"), "valid_from", "valid_to", "confidence")
    return ingest.from_zep(statements, "org:norvane")[0].select("subject_id", "predicate", "object_entity_id", micros("valid_from").alias("valid_from_us"), F.coalesce(micros("valid_to"), F.lit(-1)).alias("valid_to_us"))


@registry.add("triple_direct", f"SELECT event_id, json_extract_string(content, '$.triple.subject') AS subject, json_extract_string(content, '$.triple.predicate') AS predicate, coalesce(CAST(json_extract_string(content, '$.triple.confidence') AS DOUBLE), 0.9) AS confidence FROM {EVENTS} WHERE json_extract_string(content, '$.kind') = 'triple' AND json_extract_string(content, '$.triple.subject') IS NOT NULL AND json_extract_string(content, '$.triple.predicate') IS NOT NULL")
def triple_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.triples(events(spark, sf_dir)).select("event_id", "subject", "predicate", "confidence")


@registry.add(
    "export_rows",
    f"SELECT 'event' AS kind, count(*) AS n, min(epoch_us(observed_at)) AS first_us, max(epoch_us(observed_at)) AS last_us FROM {EVENTS} WHERE NOT coalesce(excluded_from_recall, FALSE) UNION ALL SELECT 'fact', count(*), min(epoch_us(valid_from)), max(epoch_us(valid_from)) FROM {FACTS} WHERE recorded_to IS NULL",
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ingest.export_lines(events(spark, sf_dir), facts(spark, sf_dir)).filter(F.get_json_object("line", "$.type") == F.col("kind"))
    return lines.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal_us").alias("first_us"), F.max("ordinal_us").alias("last_us"))


@registry.add("memory_list", f"SELECT event_id, modality, epoch_us(observed_at) AS observed_us FROM {EVENTS} WHERE scope = '{SCOPE}' ORDER BY observed_at DESC NULLS LAST, event_id LIMIT 50")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events of a scope (a top-k report)."""
    rows = events(spark, sf_dir).filter(F.col("scope") == SCOPE)
    return rows.orderBy(F.desc_nulls_last("observed_at"), "event_id").limit(50).select("event_id", "modality", micros("observed_at").alias("observed_us"))


# Episodes.

_LIVE = f"(SELECT *, epoch_us(observed_at) AS us FROM {EVENTS} WHERE NOT coalesce(excluded_from_recall, FALSE) AND observed_at IS NOT NULL)"
_MEMBERS = f"""WITH flags AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY scope ORDER BY us, event_id) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM {_LIVE} WHERE case_id IS NULL),
    nums AS (SELECT *, sum(fresh) OVER (PARTITION BY scope ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS no FROM flags),
    members AS (SELECT scope, case_id, event_id, observed_actor, context, us, 'time' || no AS g FROM nums UNION ALL SELECT scope, case_id, event_id, observed_actor, context, us, 'case' || case_id FROM {_LIVE} WHERE case_id IS NOT NULL)"""


@registry.add("episodes_all", f"{_MEMBERS} SELECT scope, case_id, min(us) AS started_us, max(us) AS ended_us, count(*) AS n_events, coalesce(string_agg(DISTINCT observed_actor, ',' ORDER BY observed_actor), '') AS actors FROM members GROUP BY scope, case_id, g")
def episodes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by case and by activity, with their actors."""
    return episode_ops.episodes(events(spark, sf_dir))[1].drop("episode_id")


@registry.add("episodes_causal_chain", f"{_MEMBERS}, links AS (SELECT scope, g, event_id AS to_id, unnest(CAST(json_extract(context, '$.preceded_by') AS VARCHAR[])) AS from_id FROM members) SELECT DISTINCT l.from_id, l.to_id FROM links l JOIN members m ON m.scope = l.scope AND m.g = l.g AND m.event_id = l.from_id")
def episodes_causal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_ops.causal_chains(episode_ops.episodes(events(spark, sf_dir))[0]).select("from_id", "to_id")


@registry.add(
    "case_detail",
    f"""WITH m AS (SELECT scope, case_id, event_id FROM {_LIVE} WHERE case_id IS NOT NULL), links AS (SELECT fact_id, valid_from, unnest(supports) AS event_id FROM {FACTS}),
    hit AS (SELECT DISTINCT m.scope, m.case_id, l.fact_id, l.valid_from FROM m JOIN links l USING (event_id))
    SELECT scope, case_id, fact_id, row_number() OVER (PARTITION BY scope, case_id ORDER BY valid_from DESC NULLS LAST, fact_id) AS rank FROM hit QUALIFY rank <= 50""",
)
def case_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts behind each case, newest first (50 per case are the feature)."""
    return episode_ops.case_facts(episode_ops.episodes(events(spark, sf_dir))[0], facts(spark, sf_dir))


@registry.add("case_search", f"SELECT scope, case_id, count(*) AS n_events FROM {_LIVE} WHERE case_id IS NOT NULL AND contains(lower(json_extract_string(content, '$.text')), 'pump') GROUP BY 1, 2")
def case_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter(F.col("case_id").isNotNull() & ~F.coalesce("excluded_from_recall", F.lit(False)) & F.col("observed_at").isNotNull())
    return rows.filter(F.contains(F.lower(F.get_json_object("content", "$.text")), F.lit("pump"))).groupBy("scope", "case_id").agg(F.count(F.lit(1)).alias("n_events"))


# Graph.

_SEEDS = f"(SELECT DISTINCT src AS seed FROM {EDGES_SQL} WHERE predicate = 'part_of')"


def _seeds(graph: DataFrame) -> DataFrame:
    return graph.filter(F.col("predicate") == "part_of").select(F.col("src").alias("seed")).distinct()


def _bfs(hops: int) -> None:
    sql = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES_SQL}), walk AS (SELECT seed, seed AS at, [seed] AS visited, NULL::VARCHAR AS fact_id, 0 AS hop FROM {_SEEDS}
        UNION ALL SELECT w.seed, e.dst, list_append(w.visited, e.dst), e.fact_id, w.hop + 1 FROM walk w JOIN e ON e.src = w.at WHERE w.hop < {hops} AND NOT list_contains(w.visited, e.dst))
        SELECT seed, fact_id, min(hop) AS hop FROM walk WHERE hop > 0 GROUP BY 1, 2"""

    @registry.add(f"graph_bfs_{hops}", sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = edges_of(spark, sf_dir)
        return graph_ops.paths(graph, _seeds(graph), hops)


for _n in (1, 2, 3):
    _bfs(_n)


@registry.add(
    "graph_reachable",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {EDGES_SQL}), walk AS (SELECT seed, seed AS node, 0 AS hop FROM {_SEEDS} UNION SELECT w.seed, e.dst, w.hop + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.hop < 3)
    SELECT seed, node, min(hop) AS hop FROM walk WHERE node <> seed GROUP BY 1, 2""",
)
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = edges_of(spark, sf_dir)
    return graph_ops.reachable(graph, _seeds(graph), 3)


@registry.add("graph_predicate_filter", f"SELECT src AS seed, dst AS node, 1 AS hop FROM {EDGES_SQL} WHERE predicate IN ('part_of', 'located_in') AND src <> dst GROUP BY 1, 2")
def graph_predicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = edges_of(spark, sf_dir, ("part_of", "located_in"))
    return graph_ops.reachable(graph, graph.select(F.col("src").alias("seed")).distinct(), 1)


@registry.add("graph_reverse", f"SELECT dst AS object_id, src AS subject_id, count(*) AS n FROM {EDGES_SQL} WHERE predicate = 'located_in' GROUP BY 1, 2")
def graph_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stands in a relation to each object."""
    return edges_of(spark, sf_dir, ("located_in",)).groupBy(F.col("dst").alias("object_id"), F.col("src").alias("subject_id")).agg(F.count(F.lit(1)).alias("n"))


@registry.add("graph_incident", f"SELECT node, direction, predicate, count(*) AS n FROM (SELECT src AS node, 'out' AS direction, predicate FROM {EDGES_SQL} UNION ALL SELECT dst, 'in', predicate FROM {EDGES_SQL}) GROUP BY 1, 2, 3")
def graph_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ops.incident(edges_of(spark, sf_dir)).groupBy("node", "direction", "predicate").agg(F.count(F.lit(1)).alias("n"))


@registry.add("graph_ghosts", f"SELECT DISTINCT n AS entity_id FROM (SELECT src AS n FROM {EDGES_SQL} UNION SELECT dst FROM {EDGES_SQL}) WHERE n NOT IN (SELECT entity_id FROM {ENTITIES} WHERE merged_into IS NULL)")
def graph_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ops.ghosts(edges_of(spark, sf_dir), entities(spark, sf_dir))


@registry.add("entity_edges", f"SELECT subject_id, predicate, coalesce(object_text, '') AS object_text, fact_id FROM (SELECT f.subject_id, f.predicate, f.fact_id, CASE WHEN f.object_type = 'entity' THEN o.canonical_name ELSE json_extract_string(f.object_value, '$.value') END AS object_text FROM {FACTS} f JOIN {ENTITIES} s ON s.entity_id = f.subject_id LEFT JOIN {ENTITIES} o ON o.entity_id = f.object_entity_id WHERE f.valid_to IS NULL AND f.recorded_to IS NULL AND f.scope = '{SCOPE}')")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).filter(current() & (F.col("scope") == SCOPE))
    return with_names(rows, entities(spark, sf_dir)).select("subject_id", "predicate", F.coalesce("object_text", F.lit("")).alias("object_text"), "fact_id")


@registry.add("entities_resolved", f"SELECT entity_id, coalesce(merged_into, entity_id) AS resolved_id FROM {ENTITIES}")
def entities_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_once(entities(spark, sf_dir))


# Beliefs.

CURRENT_SQL = "recorded_to IS NULL AND valid_to IS NULL"


def input_sql(seen: str = CURRENT_SQL) -> str:
    """Statements that bear on an entity, of the facts that are seen."""
    return f"""(SELECT *, subject_id AS about, FALSE AS against FROM {FACTS} WHERE {seen} AND predicate NOT IN ('contradicts', 'no_correlation')
    UNION ALL SELECT *, object_entity_id, TRUE FROM {FACTS} WHERE {seen} AND predicate = 'contradicts' AND object_entity_id IS NOT NULL)"""


def beliefs_sql(seen: str = CURRENT_SQL) -> str:
    return f"""WITH sided AS (SELECT *, CASE WHEN assertion_status = 'hypothesized' AND NOT against THEN 'h' WHEN against OR polarity = 'negative' OR assertion_status IN ('ruled_out', 'rejected') THEN 'o'
        WHEN polarity = 'positive' AND assertion_status IN ('observed', 'confirmed') THEN 's' END AS side FROM {input_sql(seen)}),
    ev AS (SELECT scope, about, side, count(DISTINCT e) AS n FROM (SELECT scope, about, side, unnest(supports) AS e FROM sided WHERE side IS NOT NULL) GROUP BY 1, 2, 3),
    per AS (SELECT scope, about, side, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(18, 9))) AS DOUBLE) AS w, min(valid_from) AS first FROM sided WHERE side IS NOT NULL GROUP BY 1, 2, 3),
    wide AS (SELECT p.scope, p.about, coalesce(max(p.n) FILTER (side = 's'), 0) AS sn, coalesce(max(w) FILTER (side = 's'), 0) AS sw, coalesce(max(p.n) FILTER (side = 'o'), 0) AS os, coalesce(max(w) FILTER (side = 'o'), 0) AS ow,
        coalesce(max(p.n) FILTER (side = 'h'), 0) AS hn, coalesce(max(w) FILTER (side = 'h'), 0) AS hw, coalesce(max(ev.n) FILTER (side = 's'), 0) AS se, coalesce(max(ev.n) FILTER (side = 'o'), 0) AS oe, min(first) AS first
        FROM per p LEFT JOIN ev USING (scope, about, side) GROUP BY 1, 2),
    named AS (SELECT w.*, e.canonical_name, (hn > 0 OR (sn > 0 AND os > 0)) AS mixed FROM wide w JOIN {ENTITIES} e ON e.entity_id = w.about)
    SELECT scope, about AS about_entity_id, CASE WHEN mixed THEN 'uncertain' WHEN os > 0 THEN 'likely_false' ELSE 'likely_true' END AS stance,
    round(CASE WHEN mixed THEN greatest(0.1, abs(sw - ow) / greatest(0.0001, sw + ow + 0.5 * hw)) WHEN sn > 0 THEN least(0.95, sw / sn + least(0.15, 0.05 * greatest(0, se - 1))) ELSE least(0.95, ow / os + least(0.15, 0.05 * greatest(0, oe - 1))) END + 1e-9, 3) AS confidence,
    canonical_name || ' has ' || sn || ' supporting, ' || os || ' opposing, and ' || hn || ' hypothesized current assertions' AS claim, epoch_us(first) AS valid_from_us FROM named"""


_INPUT, _BELIEFS = input_sql(), beliefs_sql()


def _beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief_ops.revise(facts(spark, sf_dir).filter(current()), entities(spark, sf_dir))


@registry.add("export_beliefs", f"SELECT 'belief' AS kind, count(*) AS n, min(valid_from_us) AS first_us, max(valid_from_us) AS last_us FROM ({_BELIEFS})")
def export_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of beliefs in an export with beliefs, counted as in ``export_rows``."""
    lines = ingest.export_lines(events(spark, sf_dir), facts(spark, sf_dir), _beliefs(spark, sf_dir)).filter((F.col("kind") == "belief") & (F.get_json_object("line", "$.type") == "belief"))
    return lines.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal_us").alias("first_us"), F.max("ordinal_us").alias("last_us"))


@registry.add("belief_revision", _BELIEFS)
def belief_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beliefs(spark, sf_dir)


@registry.add("belief_why", f"SELECT DISTINCT about AS from_id, fact_id AS to_id, 'supported_by' AS relation FROM {_INPUT} UNION SELECT DISTINCT fact_id, e, 'extracted_from' FROM (SELECT fact_id, unnest(supports) AS e FROM {_INPUT})")
def belief_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph from each belief over its facts to their events."""
    return belief_ops.support_graph(facts(spark, sf_dir).filter(current()))


@registry.add("belief_impacted", f"SELECT DISTINCT scope, about AS about_entity_id FROM {_INPUT} WHERE extracted_at >= TIMESTAMPTZ '2025-12-01 00:00:00+00'")
def belief_impacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs to revise after the facts of the last weeks."""
    return belief_ops.impacted(facts(spark, sf_dir).filter(current() & (F.col("extracted_at") >= F.lit("2025-12-01").cast("timestamp"))))


_TOPICS = f"""WITH b AS ({_BELIEFS}), n AS (SELECT b.*, e.canonical_name AS topic FROM b JOIN {ENTITIES} e ON e.entity_id = b.about_entity_id),
    first AS (SELECT scope, topic FROM (SELECT DISTINCT scope, topic FROM n) QUALIFY row_number() OVER (PARTITION BY scope ORDER BY topic) <= 5),
    c AS (SELECT n.scope, n.topic, n.claim FROM n JOIN first USING (scope, topic) QUALIFY row_number() OVER (PARTITION BY n.scope, n.topic ORDER BY claim, about_entity_id) <= 3),
    s AS (SELECT scope, topic, topic || ': ' || string_agg(claim, '; ' ORDER BY claim) AS summary FROM c GROUP BY 1, 2),
    f AS (SELECT x.scope, e.canonical_name AS topic, x.fact_id FROM {FACTS} x JOIN {ENTITIES} e ON e.entity_id = x.subject_id JOIN first ON first.scope = x.scope AND first.topic = e.canonical_name WHERE x.valid_to IS NULL AND x.recorded_to IS NULL QUALIFY row_number() OVER (PARTITION BY x.scope, e.canonical_name ORDER BY x.fact_id) <= 5)
    SELECT s.scope, s.topic, s.summary, coalesce((SELECT string_agg(fact_id, ',' ORDER BY fact_id) FROM f WHERE f.scope = s.scope AND f.topic = s.topic), '') AS supports FROM s"""


@registry.add("synthesize", _TOPICS)
def synthesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts per scope from beliefs: five topics, three claims and five facts each are the feature."""
    return belief_ops.topics(_beliefs(spark, sf_dir), facts(spark, sf_dir).filter(current()), entities(spark, sf_dir))


@registry.add("coverage", f"SELECT e.entity_type AS topic, count(*) AS n, round(CAST(sum(CAST(b.confidence AS DECIMAL(18, 3))) AS DOUBLE) / count(*) + 1e-9, 6) AS mean_confidence FROM ({_BELIEFS}) b JOIN {ENTITIES} e ON e.entity_id = b.about_entity_id GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = entities(spark, sf_dir).select(F.col("entity_id").alias("about_entity_id"), F.col("entity_type").alias("topic"))
    return _beliefs(spark, sf_dir).join(kinds, "about_entity_id").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("confidence").cast("decimal(18,3)")).cast("double") / F.count(F.lit(1)) + 1e-9, 6).alias("mean_confidence"))


# Identity.


@registry.add("entity_exact", f"SELECT scope, entity_type, lower(trim(canonical_name)) AS name, count(*) AS n, min(entity_id) AS first_id FROM {ENTITIES} WHERE merged_into IS NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def entity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entities that an exact match of scope, type and name can't tell apart."""
    live = entities(spark, sf_dir).filter(F.col("merged_into").isNull())
    return live.groupBy("scope", "entity_type", F.lower(F.trim("canonical_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first_id")).filter(F.col("n") > 1)


@registry.add("entity_alias", f"SELECT DISTINCT a.entity_id, e.entity_id AS other_id FROM entity_aliases a JOIN {ENTITIES} e ON e.scope = a.scope AND lower(trim(e.canonical_name)) = lower(trim(a.alias)) AND e.entity_id <> a.entity_id WHERE e.merged_into IS NULL")
def entity_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that are the canonical name of another live entity of the scope."""
    names = entities(spark, sf_dir).filter(F.col("merged_into").isNull()).select(F.col("entity_id").alias("other_id"), "scope", F.lower(F.trim("canonical_name")).alias("name"))
    aliases = table(spark, sf_dir, "entity_aliases").select("entity_id", "scope", F.lower(F.trim("alias")).alias("name")).distinct()
    return aliases.join(names, ["scope", "name"]).filter(F.col("entity_id") != F.col("other_id")).select("entity_id", "other_id").distinct()


def _asked(key: str):
    return F.conv(F.right(key, F.lit(8)), 16, 10).cast("long") % 100 == 0


_VEC = f"(SELECT entity_id, scope, entity_type, coalesce(context_key, '{{}}') AS context_key, CAST(embedding AS DOUBLE[]) AS v FROM {ENTITIES} WHERE merged_into IS NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"


@registry.add(
    "entity_knn",
    f"""SELECT a.entity_id, b.entity_id AS candidate_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, row_number() OVER (PARTITION BY a.entity_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.entity_id) AS rank
    FROM {_VEC} a JOIN {_VEC} b ON a.scope = b.scope AND a.entity_type = b.entity_type AND a.context_key = b.context_key AND a.entity_id <> b.entity_id WHERE CAST('0x' || right(a.entity_id, 8) AS BIGINT) % 100 = 0 QUALIFY rank <= 5""",
)
def entity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for linking: the five nearest live entities of equal scope, type and context. The filter comes before the top-k.

    Queries are the entities whose id is divisible by 100 (the last eight hexadecimal digits as a number); all entities
    are candidates.
    """
    rows = entities(spark, sf_dir).filter(F.col("merged_into").isNull() & usable("embedding", 64)).select("entity_id", "scope", "entity_type", F.coalesce("context_key", F.lit("{}")).alias("context_key"), "embedding")
    q = rows.filter(_asked("entity_id")).select("scope", "entity_type", "context_key", F.col("entity_id").alias("q_id"), F.col("embedding").alias("q"))
    pairs = rows.join(q, ["scope", "entity_type", "context_key"]).filter(F.col("entity_id") != F.col("q_id")).withColumn("similarity", F.round(cosine("q", "embedding"), 6))
    w = Window.partitionBy("q_id").orderBy(F.desc("similarity"), "entity_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5).select(F.col("q_id").alias("entity_id"), F.col("entity_id").alias("candidate_id"), "similarity", "rank")


@registry.add(
    "entity_link_branch",
    f"""SELECT entity_id, CASE WHEN s >= 0.85 THEN 'reuse' WHEN s >= 0.3 THEN 'ask' ELSE 'new' END AS branch FROM (SELECT a.entity_id, max(round(list_cosine_similarity(a.v, b.v), 6)) AS s
    FROM {_VEC} a LEFT JOIN {_VEC} b ON a.scope = b.scope AND a.entity_type = b.entity_type AND a.context_key = b.context_key AND a.entity_id <> b.entity_id WHERE CAST('0x' || right(a.entity_id, 8) AS BIGINT) % 100 = 0 GROUP BY 1)""",
)
def entity_link_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What linking does with each queried entity: reuse a candidate, ask, or keep it as new."""
    rows = entities(spark, sf_dir).filter(F.col("merged_into").isNull() & usable("embedding", 64)).select("entity_id", "scope", "entity_type", F.coalesce("context_key", F.lit("{}")).alias("context_key"), "embedding")
    q = rows.filter(_asked("entity_id")).select("scope", "entity_type", "context_key", F.col("entity_id").alias("q_id"), F.col("embedding").alias("q"))
    best = q.join(rows, ["scope", "entity_type", "context_key"]).filter(F.col("entity_id") != F.col("q_id")).groupBy("q_id").agg(F.max(F.round(cosine("q", "embedding"), 6)).alias("s"))
    out = q.select("q_id").join(best, "q_id", "left")
    return out.select(F.col("q_id").alias("entity_id"), F.when(F.col("s") >= 0.85, "reuse").when(F.col("s") >= 0.3, "ask").otherwise("new").alias("branch"))


def context_sql() -> str:
    """The key from its statement: fields in order of their names, the first source that isn't blank, in one spelling, and
    only if they matter to the type."""
    fields = []
    for name, sources in sorted(CONTEXT_FIELDS.items()):
        found = ", ".join(f"CASE WHEN trim(json_extract_string(c, '$.{x}')) <> '' THEN json_extract_string(c, '$.{x}') END" for x in sources)
        kinds = ", ".join(f"'{t}'" for types, names in TYPE_FIELDS.items() if name in names for t in types)
        value = f"CASE WHEN lower(trim(entity_type)) IN ({kinds}) THEN lower(trim(regexp_replace(coalesce({found}), '\\s+', ' ', 'g'))) END"
        fields.append(f"""'"{name}":' || to_json(nullif({value}, ''))""")
    return f"SELECT entity_id, '{{' || concat_ws(',', {', '.join(fields)}) || '}}' AS key FROM (SELECT *, CASE WHEN json_valid(identity_context) THEN identity_context END AS c FROM {ENTITIES})"


@registry.add("context_keys", context_sql())
def context_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity key of every entity's context, by type."""
    return entities(spark, sf_dir).select("entity_id", context_key("identity_context", "entity_type").alias("key"))


def _tok(column: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    low = f"lower(replace(translate({column}, {quoted(WIDE)}, {quoted(NARROW)}), '\u2103', '°c'))"
    return "list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all({low}, '({p})', 1)" for p in identity_patterns()) + ")))"


_SENSITIVE = ", ".join(f"'{t}'" for t in SENSITIVE_TYPES)


@registry.add("identity_tokens", f"SELECT entity_id, array_to_string({_tok('canonical_name')}, '|') AS tokens FROM {ENTITIES} WHERE lower(trim(entity_type)) IN ({_SENSITIVE})")
def identity_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities(spark, sf_dir).filter(F.lower(F.trim("entity_type")).isin(*SENSITIVE_TYPES))
    return rows.select("entity_id", F.array_join(identity_tokens("canonical_name"), "|").alias("tokens"))


def compatible_sql(name: str, other: str, kind: str) -> str:
    return f"(coalesce(lower(trim({kind})), '') NOT IN ({_SENSITIVE}) OR {_tok(name)} = {_tok(other)})"


@registry.add("alias_compatible", f"SELECT DISTINCT a.entity_id, a.alias, {compatible_sql('e.canonical_name', 'a.alias', 'e.entity_type')} AS compatible FROM entity_aliases a JOIN {ENTITIES} e USING (entity_id)")
def alias_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an alias may mean its entity: sensitive types need equal identity tokens."""
    rows = table(spark, sf_dir, "entity_aliases").select("entity_id", "alias").distinct().join(entities(spark, sf_dir).select("entity_id", "canonical_name", "entity_type"), "entity_id")
    return rows.select("entity_id", "alias", may_be_same("canonical_name", "alias", "entity_type").alias("compatible"))
