"""Queries over texts, retrieval, maintenance, the job queue and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.temporal import current, micros
from chronoweave.functions.text import chunk_documents, extract_triples, query_names, token_estimate, trigram_similarity, words
from chronoweave.operators import governance as gov
from chronoweave.operators import identity, tables
from chronoweave.operators import retrieval as ret
from chronoweave.operators.facts import with_names
from chronoweave.operators.history import SINGLE_VALUED
from chronoweave.plans.common import EDGES_SQL, ENTITIES, EVENTS, FACTS, NOW, SCOPE, edges_of, entities, events, facts, ts
from chronoweave.plans.knowledge import CURRENT_SQL, compatible_sql, context_sql
from chronoweave.plans.problems import PERIOD_PREDICATES
from chronoweave.plans.registry import Registry
from chronoweave.session import shared_folder, table
from chronoweave.sources.ingest import chunk_envelopes
from chronoweave.streaming import pipelines

registry = Registry()

QUERY = "pump current"
ANCHOR = "2026-01-01 00:00:00"
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '([\p{{L}}\p{{N}}]+)', 1)"


# Texts.


@registry.add(
    "doc_bm25",
    f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), q AS (SELECT unnest(['pump', 'current']) AS q), whole AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
    hits AS (SELECT doc_id, q, len(list_filter(w, lambda x: x = q)) AS tf, len(w) AS l FROM d, q), h AS (SELECT * FROM hits WHERE tf > 0), df AS (SELECT q, count(*) AS df FROM h GROUP BY q)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 4) AS score FROM h JOIN df USING (q), whole GROUP BY doc_id""",
)
def doc_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ret.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QUERY)
    return found.select("doc_id", F.round("score", 4).alias("score"))


@registry.add("doc_words", f"SELECT doc_id, len({_WORDS.format('text')}) AS n_words, len(list_distinct({_WORDS.format('text')})) AS n_distinct FROM documents")
def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words("text")).cast("long").alias("n_words"), F.size(F.array_distinct(words("text"))).cast("long").alias("n_distinct"))


@registry.add("doc_match_all", f"SELECT doc_id FROM documents WHERE list_has_all({_WORDS.format('text')}, ['pump', 'current'])")
def doc_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all words of a query."""
    from chronoweave.functions.text import has_all_words

    return table(spark, sf_dir, "documents").filter(has_all_words("text", F.lit(QUERY))).select("doc_id")


@registry.add("doc_chunks")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by headings or paragraphs, with path and depth."""
    return chunk_documents(table(spark, sf_dir, "documents"))


@registry.add("mock_triples")
def mock_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that the rule-based extractor finds in the events' texts."""
    rows = events(spark, sf_dir).select("event_id", F.get_json_object("content", "$.text").alias("text")).filter(F.col("text").isNotNull())
    return extract_triples(rows)


@registry.add("token_estimate", "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 3) AS tokens FROM documents")
def token_estimate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate("text").cast("long").alias("tokens"))


@registry.add("blob_dedup", "SELECT 'blob_' || sha256(text) AS blob_id, octet_length(encode(any_value(text))) AS n_bytes, count(*) AS n_documents FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by content address."""
    rows = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    keyed = rows.select(F.concat(F.lit("blob_"), F.sha2("text", 256)).alias("blob_id"), F.octet_length("text").cast("long").alias("n"))
    return keyed.groupBy("blob_id").agg(F.max("n").alias("n_bytes"), F.count(F.lit(1)).alias("n_documents"))


@registry.add("query_names", f"SELECT DISTINCT unnest(regexp_extract_all(canonical_name, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,2}})\\b', 1)) AS name FROM {ENTITIES} WHERE entity_type = 'organization' AND regexp_matches(canonical_name, '\\b[A-Z][a-z]+\\b')")
def query_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised names in the names of organisations."""
    rows = entities(spark, sf_dir).filter((F.col("entity_type") == "organization") & F.rlike("canonical_name", F.lit(r"\b[A-Z][a-z]+\b")))
    return rows.select(F.explode(query_names("canonical_name")).alias("name")).distinct()


_GRAMS = r"(SELECT list_distinct(flatten(list_transform(" + _WORDS + r", lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))))"


@registry.add(
    "trigram_sim",
    f"""SELECT entity_id, alias, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM (SELECT DISTINCT a.entity_id, a.alias, {_GRAMS.format('a.alias')} AS x, {_GRAMS.format('e.canonical_name')} AS y
    FROM entity_aliases a JOIN {ENTITIES} e USING (entity_id)) WHERE len(list_distinct(list_concat(x, y))) > 0""",
)
def trigram_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each alias and its entity's name are."""
    rows = table(spark, sf_dir, "entity_aliases").select("entity_id", "alias").distinct().join(entities(spark, sf_dir).select("entity_id", "canonical_name"), "entity_id")
    return rows.select("entity_id", "alias", F.round(trigram_similarity("alias", "canonical_name"), 6).alias("similarity"))


# Retrieval.

def live_sql(seen: str = CURRENT_SQL) -> str:
    return f"(SELECT * FROM {FACTS} WHERE {seen})"


def named_sql(live: str) -> str:
    return f"""(SELECT f.*, s.canonical_name AS subject_name, CASE WHEN f.object_type = 'entity' THEN o.canonical_name ELSE json_extract_string(f.object_value, '$.value') END AS object_text,
    concat_ws(' ', coalesce(s.canonical_name, '?'), f.predicate, CASE WHEN f.object_type = 'entity' THEN o.canonical_name ELSE json_extract_string(f.object_value, '$.value') END) AS t
    FROM {live} f JOIN {ENTITIES} s ON s.entity_id = f.subject_id LEFT JOIN {ENTITIES} o ON o.entity_id = f.object_entity_id)"""


_PROBE = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def near_sql(k: int = 5) -> str:
    return f"""(SELECT entity_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM {ENTITIES}, {_PROBE} WHERE merged_into IS NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY 2, 1 LIMIT {k})"""


_LIVE = live_sql()
_NAMED, _NEAR = named_sql(_LIVE), near_sql()


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).filter(current())


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_names(_live(spark, sf_dir), entities(spark, sf_dir))


def vector_sql(live: str = _LIVE, k: int = 5, limit: int = 40) -> str:
    near = near_sql(k)
    return f"""SELECT fact_id, 'vector' AS channel, row_number() OVER (ORDER BY d, fact_id) AS rank FROM (SELECT fact_id, min(distance) AS d FROM (SELECT f.fact_id, n.distance FROM {live} f JOIN {near} n ON n.entity_id = f.subject_id
    UNION ALL SELECT f.fact_id, n.distance FROM {live} f JOIN {near} n ON n.entity_id = f.object_entity_id) GROUP BY 1) QUALIFY rank <= {limit}"""


_CHAN_VECTOR = vector_sql()


@registry.add("chan_vector", _CHAN_VECTOR)
def chan_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.vector_channel(_live(spark, sf_dir), entities(spark, sf_dir), _probe(spark, sf_dir))


@registry.add("vector_topk", f"SELECT entity_id, distance FROM {_NEAR}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.nearest_entities(entities(spark, sf_dir), _probe(spark, sf_dir))


def _lexical_sql(*asked: str, named: str = _NAMED, limit: int = 40) -> str:
    listed = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(asked)) + "]"
    return f"""SELECT fact_id, 'lexical' AS channel, row_number() OVER (ORDER BY score DESC, fact_id) AS rank FROM (WITH d AS (SELECT fact_id, t, {_WORDS.format('t')} AS w FROM {named}), q AS (SELECT unnest({listed}) AS q),
    whole AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), h AS (SELECT * FROM (SELECT fact_id, q, len(list_filter(w, lambda x: x = q)) AS tf, len(w) AS l FROM d, q) WHERE tf > 0), df AS (SELECT q, count(*) AS df FROM h GROUP BY q),
    s AS (SELECT fact_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM h JOIN df USING (q), whole GROUP BY fact_id)
    SELECT d.fact_id, coalesce(score, 0) AS score FROM d LEFT JOIN s USING (fact_id) WHERE list_has_all(w, {listed}) OR contains(lower(t), '{" ".join(asked)}')) QUALIFY rank <= {limit}"""


_CHAN_LEXICAL = _lexical_sql("status", "alarm")


@registry.add("chan_lexical", _CHAN_LEXICAL)
def chan_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.lexical_channel(_named(spark, sf_dir), "status alarm")


def graph_sql(edges: str = EDGES_SQL, limit: int = 40) -> str:
    return f"""SELECT fact_id, 'graph' AS channel, row_number() OVER (ORDER BY hop, fact_id) AS rank FROM (WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {edges}), walk AS (SELECT entity_id AS at, [entity_id] AS visited, NULL::VARCHAR AS fact_id, 0 AS hop FROM {_NEAR}
    UNION ALL SELECT e.dst, list_append(w.visited, e.dst), e.fact_id, w.hop + 1 FROM walk w JOIN e ON e.src = w.at WHERE w.hop < 2 AND NOT list_contains(w.visited, e.dst)) SELECT fact_id, min(hop) AS hop FROM walk WHERE hop > 0 GROUP BY 1) QUALIFY rank <= {limit}"""


_CHAN_GRAPH = graph_sql()


@registry.add("chan_graph", _CHAN_GRAPH)
def chan_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = ret.nearest_entities(entities(spark, sf_dir), _probe(spark, sf_dir)).select(F.col("entity_id").alias("seed"))
    return ret.graph_channel(edges_of(spark, sf_dir), seeds)


def _synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vocabulary_values").select(F.col("canonical_value").alias("term"), "aliases")


@registry.add("chan_synonym", f"SELECT fact_id, 'synonym' AS channel, row_number() OVER (ORDER BY fact_id) AS rank FROM {_NAMED} WHERE list_has_any({_WORDS.format('t')}, (SELECT list_transform(list_append(aliases, canonical_value), lambda a: lower(a)) FROM vocabulary_values WHERE canonical_value = 'alarm')) QUALIFY rank <= 40")
def chan_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.synonym_channel(_named(spark, sf_dir), _synonyms(spark, sf_dir), "alarm")


def name_sql(asked: list[str], live: str = _LIVE, limit: int = 40) -> str:
    return f"""WITH names AS (SELECT entity_id, canonical_name AS name FROM {ENTITIES} UNION ALL SELECT a.entity_id, a.alias FROM entity_aliases a), asked AS (SELECT unnest({asked!r}) AS asked),
    g AS (SELECT entity_id, asked, name, {_GRAMS.format('name')} AS x, {_GRAMS.format('asked')} AS y FROM names, asked), m AS (SELECT *, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS sim FROM g),
    best AS (SELECT asked, entity_id, max(sim) AS sim FROM m WHERE contains(lower(name), lower(asked)) OR sim > 0.3 GROUP BY 1, 2), top AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY asked ORDER BY sim DESC, entity_id) <= 5),
    near AS (SELECT entity_id, min(1 - sim) AS distance FROM top GROUP BY 1)
    SELECT fact_id, 'name' AS channel, row_number() OVER (ORDER BY round(d, 6), fact_id) AS rank FROM (SELECT fact_id, min(distance) AS d FROM (SELECT f.fact_id, n.distance FROM {live} f JOIN near n ON n.entity_id = f.subject_id
    UNION ALL SELECT f.fact_id, n.distance FROM {live} f JOIN near n ON n.entity_id = f.object_entity_id) GROUP BY 1) QUALIFY rank <= {limit}"""


_CHAN_NAME = name_sql(["Who", "Process Engineering"])


@registry.add("chan_entity_name", _CHAN_NAME)
def chan_entity_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.name_channel(_live(spark, sf_dir), entities(spark, sf_dir), table(spark, sf_dir, "entity_aliases"), "Who works with Process Engineering")


def recent_sql(live: str = _LIVE, limit: int = 40, anchor: str = ANCHOR) -> str:
    return f"SELECT fact_id, 'recency' AS channel, row_number() OVER (ORDER BY valid_from DESC, fact_id) AS rank FROM {live} WHERE valid_from >= {ts(anchor)} - INTERVAL 30 DAYS QUALIFY rank <= {limit}"


_CHAN_RECENT = recent_sql()


@registry.add("chan_temporal", _CHAN_RECENT)
def chan_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.recency_channel(_live(spark, sf_dir), ANCHOR)


@registry.add("rrf_fuse", f"SELECT fact_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS n_channels FROM ({_CHAN_VECTOR} UNION ALL {_CHAN_LEXICAL} UNION ALL {_CHAN_GRAPH} UNION ALL {_CHAN_RECENT}) GROUP BY fact_id")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.fuse([chan_vector(spark, sf_dir), chan_lexical(spark, sf_dir), chan_graph(spark, sf_dir), chan_temporal(spark, sf_dir)])


@registry.add("salience", f"SELECT fact_id, round(max(access_count) / 10.0, 6) AS bonus FROM (SELECT fact_id, unnest(supports) AS event_id FROM {FACTS}) JOIN {EVENTS} USING (event_id) GROUP BY fact_id")
def salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ret.salience(facts(spark, sf_dir), events(spark, sf_dir))


_BACK = " OR ".join(f"contains(lower(text), '{w}')" for w in ("last", "previous", "earlier", "before", "yesterday", "history"))


@registry.add("question_route", f"SELECT doc_id, CASE WHEN {_BACK} OR length(text) - length(replace(text, ' ', '')) >= 8 THEN 'multi' ELSE 'single' END AS kind FROM documents WHERE text IS NOT NULL")
def question_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", ret.question_type("text").alias("kind"))


@registry.add(
    "pack_budget",
    f"SELECT scope, fact_id, rank FROM (SELECT scope, fact_id, row_number() OVER w AS rank, sum(greatest(1, length(t) // 3)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM {_NAMED} WINDOW w AS (PARTITION BY scope ORDER BY valid_from DESC, fact_id)) WHERE rank = 1 OR used <= 200",
)
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest facts of every scope that fit a token budget."""
    from chronoweave.functions.text import fact_text

    rows = _named(spark, sf_dir).withColumn("tokens", token_estimate(fact_text()))
    return ret.within_budget(rows, [F.desc("valid_from"), F.col("fact_id")], "tokens", 200, ["scope"]).select("scope", "fact_id", "rank")


# Maintenance.

_SELECT = f"scope = '{SCOPE}' AND predicate = 'has_status'"


@registry.add("forget_selector", f"SELECT predicate, count(*) FILTER (WHERE recorded_to IS NULL AND NOT ({_SELECT})) AS still_believed, count(*) FILTER (WHERE recorded_to IS NULL AND {_SELECT}) AS forgotten FROM {FACTS} GROUP BY 1")
def forget_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir)
    chosen = (F.col("scope") == SCOPE) & (F.col("predicate") == "has_status")
    after = gov.forget(rows.withColumn("was_open", F.col("recorded_to").isNull()), chosen, NOW)
    return after.groupBy("predicate").agg(F.count_if(F.col("recorded_to").isNull()).alias("still_believed"), F.count_if(F.col("was_open") & F.col("recorded_to").isNotNull()).alias("forgotten"))


_LINKS = f"(SELECT DISTINCT fact_id, scope, unnest(supports) AS event_id FROM {FACTS})"


@registry.add("refcount", f"SELECT e.scope, e.event_id, count(l.fact_id) AS refcount FROM {EVENTS} e LEFT JOIN {_LINKS} l ON l.scope = e.scope AND l.event_id = e.event_id GROUP BY 1, 2")
def refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.reference_counts(events(spark, sf_dir), facts(spark, sf_dir))


_MANIFEST = f"""(SELECT e.scope, e.event_id, count(l.fact_id) AS refcount, CASE WHEN count(l.fact_id) > 0 THEN 'redact' ELSE 'delete' END AS action FROM {EVENTS} e LEFT JOIN {_LINKS} l ON l.scope = e.scope AND l.event_id = e.event_id WHERE e.scope = '{SCOPE}' GROUP BY 1, 2)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = events(spark, sf_dir).filter(F.col("scope") == SCOPE)
    return gov.erasure_manifest(mine, facts(spark, sf_dir).filter(F.col("scope") == SCOPE), mine.select("event_id"))


@registry.add("erasure_preview", f"SELECT * FROM {_MANIFEST}")
def erasure_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


@registry.add(
    "erasure_execute",
    f"""SELECT 'events' AS layer, count(*) AS n, count(*) FILTER (WHERE m.action = 'redact') AS touched FROM {EVENTS} e LEFT JOIN {_MANIFEST} m USING (scope, event_id) WHERE coalesce(m.action, '') <> 'delete'
    UNION ALL SELECT 'facts', count(*), count(*) FILTER (WHERE fact_id IN (SELECT fact_id FROM {_LINKS} JOIN {_MANIFEST} USING (scope, event_id))) FROM {FACTS}""",
)
def erasure_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after an erasure: events without the deleted ones, facts without the erased supports."""
    before = facts(spark, sf_dir)
    kept, cleaned = gov.erase(events(spark, sf_dir), before.withColumn("n_before", F.size(F.array_distinct("supports"))), _manifest(spark, sf_dir))
    a = kept.agg(F.lit("events").alias("layer"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("content") == "{}").alias("touched"))
    b = cleaned.agg(F.lit("facts").alias("layer"), F.count(F.lit(1)).alias("n"), F.count_if(F.size(F.array_distinct("supports")) < F.col("n_before")).alias("touched"))
    return a.unionByName(b)


@registry.add("methylation", f"SELECT event_id FROM {EVENTS} WHERE NOT coalesce(excluded_from_recall, FALSE) AND coalesce(access_count, 0) = 0 AND observed_at < {ts(NOW)} - INTERVAL 30 DAYS")
def methylation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("before", F.coalesce("excluded_from_recall", F.lit(False)))
    return gov.methylate(rows, NOW).filter(F.col("excluded_from_recall") & ~F.col("before")).select("event_id")


@registry.add(
    "consolidation",
    f"""SELECT fact_id FROM (SELECT *, row_number() OVER (w ORDER BY valid_from DESC NULLS LAST, fact_id) AS rn, count(*) FILTER (WHERE extracted_at < {ts(NOW)} - INTERVAL 24 HOURS) OVER w AS old
    FROM (SELECT *, coalesce(object_entity_id, '') AS oe, coalesce(json_extract_string(object_value, '$.value'), '') AS ov FROM {_LIVE}) WINDOW w AS (PARTITION BY scope, subject_id, predicate, object_type, oe, ov)) WHERE old > 1 AND rn > 1""",
)
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live facts that repeat a newer one."""
    return gov.consolidate(facts(spark, sf_dir), NOW)


# The job queue, with the event log as its jobs.


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("embed_status") == "pending", "queued").when(F.col("embed_status") == "done", "completed").otherwise("running")
    rows = events(spark, sf_dir)
    return rows.select(F.col("event_id").alias("job_id"), state.alias("status"), F.coalesce("access_count", F.lit(0)).alias("attempts"), F.lit(3).alias("max_attempts"), F.coalesce("access_count", F.lit(0)).alias("priority"), F.col("recorded_at").alias("run_after"), F.col("recorded_at").alias("created_at"), F.col("recorded_at").alias("locked_at"), "scope")


_JOBS = f"(SELECT event_id AS job_id, CASE WHEN embed_status = 'pending' THEN 'queued' WHEN embed_status = 'done' THEN 'completed' ELSE 'running' END AS status, coalesce(access_count, 0) AS attempts, coalesce(access_count, 0) AS priority, recorded_at, scope FROM {EVENTS})"


@registry.add("queue_claim", f"SELECT job_id, priority FROM {_JOBS} WHERE status = 'queued' AND recorded_at <= {ts(NOW)} ORDER BY priority DESC, recorded_at, job_id LIMIT 100")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred jobs (a top-k)."""
    return gov.claimable(_jobs(spark, sf_dir), NOW, 100).select("job_id", "priority")


@registry.add("queue_retry", f"SELECT CASE WHEN status = 'running' AND attempts >= 3 THEN 'failed' WHEN status = 'running' THEN 'queued' ELSE status END AS status, count(*) AS n, max(CASE WHEN status = 'running' AND attempts < 3 THEN CAST(epoch_us({ts(NOW)}) + pow(2, attempts) * 1000000 AS BIGINT) END) AS latest_us FROM {_JOBS} GROUP BY 1")
def queue_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _jobs(spark, sf_dir)
    after = gov.after_failure(before.withColumn("was", F.col("status")), NOW)
    again = F.when((F.col("was") == "running") & (F.col("status") == "queued"), F.unix_micros("run_after"))
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max(again).alias("latest_us"))


@registry.add("queue_reap", f"SELECT CASE WHEN status = 'running' AND recorded_at < {ts(NOW)} - INTERVAL 300 SECONDS THEN 'queued' ELSE status END AS status, count(*) AS n FROM {_JOBS} GROUP BY 1")
def queue_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.reap(_jobs(spark, sf_dir), NOW).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@registry.add("admin_metrics", f"SELECT scope, count(*) AS n_jobs, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'completed') AS completed FROM {_JOBS} GROUP BY scope")
def admin_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _jobs(spark, sf_dir).groupBy("scope").agg(F.count(F.lit(1)).alias("n_jobs"), is_("queued"), is_("running"), is_("completed"))


@registry.add("stage_latency", f"SELECT event_id, epoch_us(recorded_at) - epoch_us(observed_at) AS latency_us FROM {EVENTS} WHERE observed_at IS NOT NULL")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time from observation to record, as two stages of a lifecycle stream."""
    rows = events(spark, sf_dir)
    cycle = rows.filter(F.col("observed_at").isNotNull()).select("event_id", F.lit("captured").alias("kind"), F.col("observed_at").alias("ts")).unionByName(rows.select("event_id", F.lit("indexed").alias("kind"), F.col("recorded_at").alias("ts")))
    return gov.stage_latency(cycle)


_CYCLE = f"""(SELECT event_id, scope, 'captured' AS kind, observed_at AS ts, 'c-' || event_id AS lifecycle_id FROM {EVENTS} WHERE observed_at IS NOT NULL UNION ALL SELECT event_id, scope, 'indexed', recorded_at, 'i-' || event_id FROM {EVENTS})"""


def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    a = rows.filter(F.col("observed_at").isNotNull()).select("event_id", "scope", F.lit("captured").alias("kind"), F.col("observed_at").alias("ts"), F.concat(F.lit("c-"), "event_id").alias("lifecycle_id"))
    return a.unionByName(rows.select("event_id", "scope", F.lit("indexed").alias("kind"), F.col("recorded_at").alias("ts"), F.concat(F.lit("i-"), "event_id").alias("lifecycle_id")))


@registry.add("lifecycle_latest", f"SELECT event_id, arg_max(kind, (ts, lifecycle_id)) AS kind, max(epoch_us(ts)) AS ts_us FROM {_CYCLE} GROUP BY 1")
def lifecycle_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest_stage(_cycle(spark, sf_dir)).select("event_id", "kind", F.unix_micros("ts").alias("ts_us"))


@registry.add("lifecycle_read", f"SELECT lifecycle_id, kind FROM {_CYCLE} WHERE ts > {ts('2026-02-15 00:00:00')} AND scope = '{SCOPE}' ORDER BY ts, lifecycle_id LIMIT 100")
def lifecycle_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page of a scope's lifecycle after a cursor."""
    return tables.lifecycle_after(_cycle(spark, sf_dir), "2026-02-15 00:00:00", "~", 100, SCOPE).select("lifecycle_id", "kind")


@registry.add("erasure_breakdown", f"SELECT scope, count(*) FILTER (WHERE action = 'delete') AS events_to_delete, count(*) FILTER (WHERE action = 'redact') AS events_to_redact FROM {_MANIFEST} GROUP BY 1")
def erasure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a)
    return _manifest(spark, sf_dir).groupBy("scope").agg(count("delete").alias("events_to_delete"), count("redact").alias("events_to_redact"))


@registry.add(
    "vocab_changes",
    "SELECT name, canonical_value, CASE WHEN name = 'qual_level' THEN 'open' ELSE kind END AS kind, len(aliases) AS n_aliases FROM vocabulary_values WHERE name <> 'running_recipe' UNION ALL SELECT 'deal_stage', 'signed', 'closed', 1",
)
def vocab_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary after changes: one opened, one removed, a value added."""
    rows = table(spark, sf_dir, "vocabulary_values").select("name", "canonical_value", "kind", "aliases")
    opened = rows.filter(F.col("name") == "qual_level").withColumn("kind", F.lit("open"))
    added = spark.createDataFrame([("deal_stage", "signed", "closed", ["won"])], rows.schema)
    out = tables.upsert(rows, opened.unionByName(added), ["name", "canonical_value"])
    gone = rows.filter(F.col("name") == "running_recipe")
    return tables.remove(out, gone, ["name"]).select("name", "canonical_value", "kind", F.size("aliases").cast("long").alias("n_aliases"))


@registry.add("queries_union", f"SELECT fact_id, min(rank) AS rank FROM ({_CHAN_LEXICAL} UNION ALL {_lexical_sql('part', 'of')}) GROUP BY 1")
def queries_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several forms of a question: each fact once, at its best rank."""
    named = _named(spark, sf_dir)
    return ret.best_ranks([ret.lexical_channel(named, "status alarm"), ret.lexical_channel(named, "part of")])


_FIT = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_RESOLVED = f"""WITH m AS (SELECT e.scope, coalesce(e.entity_type, '') AS kind, k.key, lower(trim(e.canonical_name)) AS folded, e.created_at, e.canonical_name AS name, e.embedding FROM {ENTITIES} e JOIN ({context_sql()}) k USING (entity_id) WHERE e.merged_into IS NOT NULL),
asked AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY scope, kind, key, folded ORDER BY created_at NULLS FIRST, name NULLS FIRST, embedding NULLS FIRST) = 1),
live AS (SELECT entity_id, scope, coalesce(entity_type, '') AS kind, coalesce(context_key, '{{}}') AS e_key, canonical_name, embedding AS e_vec FROM {ENTITIES} WHERE merged_into IS NULL),
names AS (SELECT entity_id, lower(trim(canonical_name)) AS folded FROM live UNION SELECT entity_id, lower(trim(alias)) FROM entity_aliases),
known AS (SELECT l.entity_id, l.scope, l.kind, l.e_key, n.folded FROM names n JOIN live l USING (entity_id)),
counted AS (SELECT a.scope, a.kind, a.key, a.folded, count(*) AS n, count(*) FILTER (WHERE e_key = key) AS n_same, min(entity_id) FILTER (WHERE e_key = key) AS same, min(entity_id) AS one, max(e_key) AS one_key
    FROM asked a JOIN known k ON k.scope = a.scope AND k.kind = a.kind AND k.folded = a.folded GROUP BY 1, 2, 3, 4),
decided AS (SELECT a.*, c.n, CASE WHEN a.key <> '{{}}' AND n_same = 1 THEN same WHEN a.key = '{{}}' AND n = 1 THEN one END AS exact, CASE WHEN a.key <> '{{}}' AND n_same = 0 AND n = 1 AND one_key = '{{}}' THEN one END AS adopted FROM asked a LEFT JOIN counted c USING (scope, kind, key, folded)),
pairs AS (SELECT d.scope, d.kind, d.key, d.folded, d.name, l.entity_id, l.canonical_name, round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(l.e_vec AS DOUBLE[])), 6) AS sim FROM decided d JOIN live l ON l.scope = d.scope AND l.kind = d.kind AND l.e_key = d.key
    WHERE d.n IS NULL AND {_FIT.format('d.embedding')} AND {_FIT.format('l.e_vec')}),
best AS (SELECT scope, kind, key, folded, max(sim) AS sim, arg_max(entity_id, (sim, entity_id)) AS entity_id FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY scope, kind, key, folded ORDER BY sim DESC, entity_id) <= 5) WHERE {compatible_sql('name', 'canonical_name', 'kind')} GROUP BY 1, 2, 3, 4)
SELECT d.scope, d.kind AS entity_type, d.key AS context_key, d.name, coalesce(exact, adopted, CASE WHEN sim >= 0.85 THEN b.entity_id END, sha256(concat_ws('|', d.scope, d.kind, d.key, d.folded))) AS entity_id,
    CASE WHEN exact IS NOT NULL THEN 'exact' WHEN adopted IS NOT NULL THEN 'adopted' WHEN sim >= 0.85 THEN 'reuse' WHEN sim >= 0.3 THEN 'ask' ELSE 'new' END AS branch, sim AS similarity FROM decided d LEFT JOIN best b USING (scope, kind, key, folded)"""


@registry.add("entity_resolve", _RESOLVED)
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What linking makes of the entities that were merged away, taken as new mentions: the branch and the live entity."""
    things = entities(spark, sf_dir)
    gone = things.filter(F.col("merged_into").isNotNull())
    mentions = gone.select("scope", F.col("canonical_name").alias("name"), "entity_type", F.col("identity_context").alias("context"), "embedding", F.unix_micros("created_at").alias("ordinal"))
    return identity.resolve(mentions, things, table(spark, sf_dir, "entity_aliases"))


@registry.add("chunk_ingest")
def chunk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of the documents' chunks."""
    return chunk_envelopes(chunk_documents(table(spark, sf_dir, "documents")), SCOPE)


# Streams, run to the end of what there is.


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pipelines.event_stream(spark, sf_dir, name)


_KEYS = ["subject_id", "predicate"]


def _collected(stream: DataFrame, mode: str) -> DataFrame:
    return pipelines.run_once(stream, mode, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}")


@registry.add("stream_dedup", "SELECT DISTINCT event_id FROM event_log WHERE event_id IS NOT NULL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(pipelines.deduplicated(_stream(spark, sf_dir, "event_log"), "3650 days").select("event_id"), "append").select("event_id")


_STREAM_SESSIONS = """WITH live AS (SELECT scope, epoch_us(observed_at) AS us FROM event_log WHERE NOT coalesce(excluded_from_recall, FALSE) AND observed_at IS NOT NULL),
    flags AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY scope ORDER BY us) > 1800000000 THEN 1 ELSE 0 END AS fresh FROM live), nums AS (SELECT *, sum(fresh) OVER (PARTITION BY scope ORDER BY us) AS no FROM flags)
    SELECT scope, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM nums GROUP BY scope, no"""


@registry.add("stream_sessions", _STREAM_SESSIONS)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of deliveries as session windows of a stream, all of them at the end (complete mode)."""
    return _collected(pipelines.session_stream(_stream(spark, sf_dir, "event_log")), "complete").drop("batch")


_IN = f"predicate IN ({', '.join(repr(x) for x in PERIOD_PREDICATES)}) AND recorded_to IS NULL AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)"


@registry.add(
    "stream_intervals",
    f"""WITH r AS (SELECT DISTINCT subject_id, predicate, epoch_us(valid_from) AS f, coalesce(epoch_us(valid_to), 9223372036854775807) AS t FROM facts WHERE {_IN}),
    x AS (SELECT *, max(t) OVER (PARTITION BY subject_id, predicate ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    n AS (SELECT *, sum(CASE WHEN before IS NULL OR f > before THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, predicate ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS no FROM x)
    SELECT subject_id, predicate, min(f) AS from_us, max(t) AS to_us FROM n GROUP BY subject_id, predicate, no""",
)
def stream_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of the keyed interval maps: the periods of each subject and predicate."""
    rows = _stream(spark, sf_dir, "facts").filter(F.col("predicate").isin(*PERIOD_PREDICATES) & F.col("recorded_to").isNull() & F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
    merged = pipelines.interval_stream(rows.select(*_KEYS, micros("valid_from").alias("from_us"), micros("valid_to").alias("to_us")), _KEYS)
    last = _collected(merged, "update").groupBy(*_KEYS).agg(F.max_by(F.arrays_zip("starts", "ends"), "n_rows").alias("p"))
    return last.select(*_KEYS, F.explode("p").alias("p")).select(*_KEYS, F.col("p.starts").alias("from_us"), F.col("p.ends").alias("to_us"))


_SINGLE = ", ".join(repr(x) for x in SINGLE_VALUED)


@registry.add(
    "stream_supersede",
    f"""WITH a AS (SELECT subject_id, predicate, epoch_us(valid_from) AS f, arg_max(fact_id, (recorded_from, fact_id)) AS assertion_id, arg_max(epoch_us(valid_to), (recorded_from, fact_id)) FILTER (valid_to IS NOT NULL) AS e
    FROM {FACTS} WHERE predicate IN ({_SINGLE}) AND recorded_to IS NULL AND polarity = 'positive' AND valid_from IS NOT NULL GROUP BY 1, 2, 3)
    SELECT subject_id, predicate, f AS from_us, coalesce(least(e, lead(f) OVER (PARTITION BY subject_id, predicate ORDER BY f)), -1) AS to_us, assertion_id FROM a""",
)
def stream_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that hold, from keyed state, whatever the order of arrival."""
    rows = _stream(spark, sf_dir, "facts").filter(F.col("predicate").isin(*SINGLE_VALUED) & F.col("recorded_to").isNull() & (F.col("polarity") == "positive"))
    rows = rows.select(*_KEYS, *[micros(c).alias(c) for c in ("valid_from", "valid_to", "recorded_from")], F.col("fact_id").alias("assertion_id"))
    held = _collected(pipelines.supersession_stream(rows, _KEYS), "update").groupBy(*_KEYS).agg(F.max_by(F.arrays_zip("starts", "ends", "assertion_ids"), "version").alias("v"))
    return held.select(*_KEYS, F.explode("v").alias("v")).select(*_KEYS, F.col("v.starts").alias("from_us"), F.coalesce("v.ends", F.lit(-1)).alias("to_us"), F.col("v.assertion_ids").alias("assertion_id"))


# Analytics on the stream table, with what Spark has built in.


@registry.add("events_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.unix_micros("w.start").alias("hour_us"), "event_type", "n", "total")


@registry.add("events_rollup", "SELECT event_type, user_id % 7 AS dept, count(*) AS n FROM events GROUP BY ROLLUP (event_type, dept)")
def events_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("dept", F.col("user_id") % 7).rollup("event_type", "dept").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "orders_as_of",
    """SELECT n_name, o_orderstatus, count(*) AS n FROM (SELECT o_custkey, o_orderstatus, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders)
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND (until IS NULL OR until > TIMESTAMP '1998-06-01') GROUP BY 1, 2""",
)
def orders_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each customer at a point in time, by nation: single-valued facts from the orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    states = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", F.lead("o_orderdate").over(w).alias("until"))
    at = F.lit("1998-06-01").cast("timestamp_ntz")
    held = states.filter((F.col("o_orderdate") <= at) & (F.col("until").isNull() | (F.col("until") > at)))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return held.join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@registry.add("lineitem_repeats", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS n_bodies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def lineitem_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys delivered repeatedly, and with how many bodies."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("n_bodies")).filter(F.col("n") > 1)


