"""Recall and evidence packs, now and in the past, with their SQL composed from that of the channels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.scopes import in_view, prefix_list
from chronoweave.functions.temporal import seen
from chronoweave.operators import beliefs as belief_ops
from chronoweave.operators import packs
from chronoweave.operators import retrieval as ret
from chronoweave.operators.facts import with_names
from chronoweave.operators.graph import edges
from chronoweave.plans.common import ELIGIBLE_SQL, ENTITIES, EVENTS, LATER, SCOPE, entities, events, facts, ts
from chronoweave.plans.knowledge import CURRENT_SQL, beliefs_sql
from chronoweave.plans.recalling import _WORDS, ANCHOR, _lexical_sql, _probe, _synonyms, graph_sql, live_sql, name_sql, named_sql, recent_sql, vector_sql
from chronoweave.plans.registry import Registry
from chronoweave.session import checkpointed, table

registry = Registry()

QUESTION = "Which tools have the status alarm and are part of a chamber"
THEN_SQL = f"valid_from <= {ts(LATER)} AND (valid_to IS NULL OR {ts(LATER)} < valid_to) AND recorded_to IS NULL"
KNOWN_THEN_SQL = f"valid_from <= {ts(LATER)} AND (valid_to IS NULL OR {ts(LATER)} < valid_to) AND recorded_from <= {ts(LATER)} AND (recorded_to IS NULL OR {ts(LATER)} < recorded_to)"
ABOVE_SQL = f"{CURRENT_SQL} AND scope IN ({', '.join(repr(p) for p in prefix_list(SCOPE))})"
DURING = ("2025-08-01 00:00:00", "2025-09-01 00:00:00")
DURING_SQL = f"recorded_to IS NULL AND valid_from <= {ts(DURING[1])} AND (valid_to IS NULL OR valid_to >= {ts(DURING[0])})"


def synonym_sql(asked: list[str], named: str, limit: int) -> str:
    return f"""WITH q AS (SELECT unnest({asked!r}) AS q), o AS (SELECT q, list_distinct(list_append(coalesce(flatten(list(list_transform(v.aliases, lambda a: lower(a))) FILTER (WHERE v.aliases IS NOT NULL)), []), q)) AS opts
    FROM q LEFT JOIN vocabulary_values v ON lower(v.canonical_value) = q GROUP BY q), g AS (SELECT list(opts) AS g, max(len(opts)) AS widest FROM o)
    SELECT fact_id, 'synonym' AS channel, row_number() OVER (ORDER BY fact_id) AS rank FROM (SELECT fact_id, {_WORDS.format('t')} AS w FROM {named}), g WHERE widest > 1 AND len(list_filter(g, lambda x: NOT list_has_any(w, x))) = 0 QUALIFY rank <= {limit}"""


def recall_sql(question: str, where: str) -> str:
    """The whole recall over the facts that ``where`` lets through: six channels, fusion, reranking."""
    live, limit = live_sql(where), ret.route_limit(question)
    named, asked = named_sql(live), list(dict.fromkeys(re.findall(r"\w+", question.lower())))
    graph = f"(SELECT fact_id, subject_id AS src, predicate, object_entity_id AS dst FROM {live} WHERE object_type = 'entity' AND object_entity_id IS NOT NULL AND {ELIGIBLE_SQL})"
    names = re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b", question)
    channels = [vector_sql(live, limit, limit), _lexical_sql(*re.findall(r"\w+", question.lower()), named=named, limit=limit), graph_sql(graph, limit), name_sql(names, live, limit), recent_sql(live, limit), synonym_sql(asked, named, limit)]
    union = " UNION ALL ".join(f"(SELECT fact_id, channel, rank FROM ({c}))" for c in channels)
    return f"""WITH fused AS (SELECT fact_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ({union}) GROUP BY fact_id),
    first AS (SELECT n.*, score, round(len(list_intersect({asked!r}, {_WORDS.format('t')})) / {len(asked)}, 6) AS relevance FROM {named} n JOIN fused USING (fact_id) ORDER BY score DESC, fact_id LIMIT {limit})
    SELECT *, row_number() OVER (ORDER BY relevance DESC, score DESC, fact_id) AS rank FROM first WHERE relevance >= 0.1 QUALIFY rank <= 25
    UNION ALL SELECT *, row_number() OVER (ORDER BY score DESC, fact_id) AS rank FROM first WHERE (SELECT max(relevance) FROM first) < 0.1 QUALIFY rank <= 10"""


class World:
    """What several channels read, made once: the facts that are seen, the entities, and the facts with names."""

    def __init__(self, spark: SparkSession, sf_dir: str, where) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.entities = checkpointed(entities(spark, sf_dir))
        self.facts = checkpointed(facts(spark, sf_dir).filter(where))
        self.named = checkpointed(with_names(self.facts, self.entities))

    def pack(self, question: str = QUESTION) -> DataFrame:
        args = (self.facts, self.entities, table(self.spark, self.sf_dir, "entity_aliases"), edges(self.facts), self.named)
        return checkpointed(ret.recall(*args, question, _probe(self.spark, self.sf_dir), ANCHOR, synonyms=_synonyms(self.spark, self.sf_dir)))

    def layers(self, pack: DataFrame, **limits) -> DataFrame:
        believed = belief_ops.revise(self.facts, self.entities)
        return packs.layers(pack, believed, events(self.spark, self.sf_dir).filter(~F.coalesce("excluded_from_recall", F.lit(False))), **limits)


_SHOWN = ("rank", "fact_id", "score", "relevance", "subject_name", "predicate", "object_text")
_SHOWN_SQL = "SELECT rank, fact_id, score, relevance, subject_name, predicate, object_text"


@registry.add("recall_pack", f"{_SHOWN_SQL} FROM ({recall_sql(QUESTION, CURRENT_SQL)})")
def recall_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for a question: six channels, fused and reranked."""
    return World(spark, sf_dir, seen()).pack().select(*_SHOWN)


@registry.add("recall_as_of", f"{_SHOWN_SQL} FROM ({recall_sql(QUESTION, THEN_SQL)})")
def recall_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question about an earlier time, as now believed."""
    return World(spark, sf_dir, seen(LATER)).pack().select(*_SHOWN)


@registry.add("recall_as_known", f"{_SHOWN_SQL} FROM ({recall_sql(QUESTION, KNOWN_THEN_SQL)})")
def recall_as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question about an earlier time, as then believed."""
    return World(spark, sf_dir, seen(LATER, True)).pack().select(*_SHOWN)


@registry.add("recall_during", f"{_SHOWN_SQL} FROM ({recall_sql(QUESTION, DURING_SQL)})")
def recall_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question about what was true at some time of a window."""
    return World(spark, sf_dir, seen(valid_during=DURING)).pack().select(*_SHOWN)


_LAYERS = f"""WITH pack AS ({recall_sql(QUESTION, ABOVE_SQL)}), kept AS (SELECT * FROM pack WHERE rank <= 10),
    about AS (SELECT subject_id, min(rank) AS of FROM kept GROUP BY 1), b AS (SELECT 'beliefs' AS layer, row_number() OVER (ORDER BY of, about_entity_id, scope) AS rank, scope || '|' || about_entity_id AS id FROM ({beliefs_sql(ABOVE_SQL)}) x JOIN about ON subject_id = about_entity_id QUALIFY rank <= 5),
    links AS (SELECT event_id, min(rank) AS of FROM (SELECT rank, unnest(supports) AS event_id FROM kept) GROUP BY 1), e AS (SELECT 'events' AS layer, row_number() OVER (ORDER BY of, event_id) AS rank, event_id AS id FROM {EVENTS} JOIN links USING (event_id) WHERE NOT coalesce(excluded_from_recall, FALSE) QUALIFY rank <= 5)
    SELECT * FROM b UNION ALL SELECT 'facts', rank, fact_id FROM kept UNION ALL SELECT * FROM e"""


@registry.add("get_context", _LAYERS)
def get_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known from a scope and above it: ten facts, five beliefs about their subjects, five events behind them."""
    world = World(spark, sf_dir, seen() & in_view("scope", SCOPE, "holistic"))
    return world.layers(world.pack(), facts=10, most_beliefs=5).select("layer", "rank", "id")


_SAID = """SELECT coalesce(string_agg('[' || rank || '] ' || t, '; ' ORDER BY rank) FILTER (WHERE rank <= {0}), '') AS text, coalesce(string_agg('[' || rank || ']=' || fact_id, ',' ORDER BY rank), '') AS citations FROM ({1})"""


@registry.add("answer_text", f"SELECT text AS context_block, citations FROM ({_SAID.format(6, recall_sql(QUESTION, CURRENT_SQL))})")
def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context block of a pack with its citations."""
    return packs.context_block(World(spark, sf_dir, seen()).pack())


@registry.add("answer_short", f"SELECT CASE WHEN text = '' THEN 'Nothing is remembered.' ELSE 'From memory: ' || text || '.' END AS answer, citations FROM ({_SAID.format(4, recall_sql(QUESTION, THEN_SQL))})")
def answer_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.short_answer(World(spark, sf_dir, seen(LATER)).pack())


@registry.add("pack_events")
def pack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack within a budget of tokens as an ordered stream."""
    world = World(spark, sf_dir, seen())
    pack = world.pack()
    return packs.stream(pack, world.layers(pack, max_tokens=2000), packs.context_block(pack, "block_at_end"))
