"""Queries of the problems on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import groups, mixing, names, neighbours, packing, quality, splitting, tokens
from chronoweave.plans.registry import Registry
from chronoweave.session import checkpointed, table

registry = Registry()

_P3 = """
WITH texts AS (SELECT 'event_log' AS item_table, event_id AS item_id, CASE WHEN json_valid(content) THEN json_extract_string(content, '$.text') END AS text FROM event_log WHERE event_id IS NOT NULL
    UNION ALL SELECT 'incident_envelopes', file_name, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.content.text') END FROM incident_envelopes)
SELECT DISTINCT item_table, item_id FROM texts WHERE length(text) > 2000"""


@registry.add("p3_found", _P3)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.oversized_pieces(table(spark, sf_dir, "event_log"), table(spark, sf_dir, "incident_envelopes"))
    return cut.filter(F.col("piece_no") == 0).select("item_table", "item_id")


@registry.add("p3_pieces")
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its place and the strength of the boundary at its end."""
    return splitting.oversized_pieces(table(spark, sf_dir, "event_log"), table(spark, sf_dir, "incident_envelopes"))


@registry.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(names.link_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_aliases")))


@registry.add("p5_groups")
def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every entity with variants."""
    return names.link_names(table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_aliases"))


_P6 = """
WITH RECURSIVE links AS (SELECT DISTINCT e.entity_id AS a, e.merged_into AS b FROM entities e
    WHERE e.merged_into <> e.entity_id AND e.merged_into IN (SELECT entity_id FROM entities)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS entity_id, a AS node FROM both_ UNION SELECT r.entity_id, x.b FROM reach r JOIN both_ x ON x.a = r.node)
SELECT entity_id, min(node) AS group_id FROM reach GROUP BY entity_id"""


@registry.add("p6_found", _P6)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.merged_groups(table(spark, sf_dir, "entities")).select("entity_id", "group_id")


@registry.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.neighbour_pairs(table(spark, sf_dir, "entities"), "entity_id", "embedding")
    return found.select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


@registry.add("p7_neighbours")
def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest entities of every entity, with similarity and rank."""
    return neighbours.nearest(table(spark, sf_dir, "entities"), "entity_id", "embedding")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(tokens.with_tokens(table(spark, sf_dir, "documents"), "doc_id", ["source"]))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = [(r["window_name"], r["capacity_tokens"]) for r in table(spark, sf_dir, "context_windows").orderBy("window_name").collect()]
    return packing.pack(_sized(spark, sf_dir), windows)


@registry.add("p8_packed")
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every text, or piece of an oversized one, in the containers of every context window."""
    return _packed(spark, sf_dir)


@registry.add("p8_report")
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_packed(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_targets").orderBy("source").collect()]
    return mixing.mix(_sized(spark, sf_dir), targets)


@registry.add("p9_mixture")
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their numbers of uses."""
    return _mixture(spark, sf_dir)


@registry.add("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpointed(quality.document_statistics(table(spark, sf_dir, "documents")))
    return quality.outlierness(stats, quality.robust_fit(stats))


@registry.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_scored(spark, sf_dir)).select("doc_id")


@registry.add("p10_statistics")
def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, distance from prose and each statistic's part in it, for every document with text."""
    return _scored(spark, sf_dir)
