"""Traversal of the graph that entity facts form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.ontology import graph_eligible
from chronoweave.session import checkpointed


def edges(facts: DataFrame, eligible: bool = True, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """``fact_id``, ``src``, ``predicate``, ``dst`` of facts between entities. Filters are applied once, before any hop."""
    rows = facts.filter((F.col("object_type") == "entity") & F.col("object_entity_id").isNotNull())
    if eligible:
        rows = rows.filter(graph_eligible())
    if predicates is not None:
        rows = rows.filter(F.col("predicate").isin(*predicates))
    return rows.select("fact_id", F.col("subject_id").alias("src"), "predicate", F.col("object_entity_id").alias("dst"))


def paths(graph: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``seed``, ``fact_id``, ``hop``: the edges on paths of at most ``hops`` edges from each seed that visit no node twice.

    ``seeds`` has a column ``seed``. Each hop is one join of the frontier; the paths are cut off by a checkpoint, since
    their number can grow with every hop.
    """
    frontier = seeds.select("seed", F.col("seed").alias("at"), F.array("seed").alias("visited")).distinct()
    found = None
    for hop in range(1, hops + 1):
        step = frontier.join(graph, frontier["at"] == graph["src"]).filter(~F.array_contains("visited", F.col("dst")))
        step = checkpointed(step.select("seed", "fact_id", F.col("dst").alias("at"), F.concat("visited", F.array("dst")).alias("visited"), F.lit(hop).alias("hop")))
        hit = step.select("seed", "fact_id", "hop")
        found = hit if found is None else found.unionByName(hit)
        frontier = step.select("seed", "at", "visited")
    return found.groupBy("seed", "fact_id").agg(F.min("hop").alias("hop"))


def reachable(graph: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``seed``, ``node``, ``hop``: nodes within ``hops`` edges and the least number of them; the seed itself isn't listed.

    Only new (seed, node) pairs go on to the next hop, so that the frontier is bounded by the pairs there are.
    """
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(graph, frontier["node"] == graph["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.filter(F.col("hop") > 0)


def incident(graph: DataFrame) -> DataFrame:
    """Every edge from both of its ends: ``node``, ``direction``, ``predicate``, ``other``, ``fact_id``."""
    out = graph.select(F.col("src").alias("node"), F.lit("out").alias("direction"), "predicate", F.col("dst").alias("other"), "fact_id")
    return out.unionByName(graph.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), "predicate", F.col("src").alias("other"), "fact_id"))


def ghosts(graph: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends of edges that are no live entity (merged away or not there at all)."""
    ends = graph.select(F.col("src").alias("entity_id")).unionByName(graph.select(F.col("dst").alias("entity_id"))).distinct()
    return ends.join(entities.filter(F.col("merged_into").isNull()).select("entity_id"), "entity_id", "left_anti")


def related(concepts: DataFrame, start: str, relation: str | None = None, depth: int = 2, limit: int = 20) -> DataFrame:
    """Concepts reached over ``related`` (array of name, relation) by name within ``depth`` steps, nearest first."""
    links = concepts.select("concept_id", "scope", F.explode("related").alias("r")).filter(F.lit(True) if relation is None else F.col("r.relation") == relation)
    ids = concepts.groupBy("scope", F.col("name").alias("to_name")).agg(F.min("concept_id").alias("dst"))
    graph = links.select("concept_id", "scope", F.col("r.name").alias("to_name")).join(ids, ["scope", "to_name"]).select(F.col("concept_id").alias("src"), "dst", F.lit("related").alias("predicate"), F.lit("").alias("fact_id"))
    seeds = concepts.filter(F.col("concept_id") == start).select(F.col("concept_id").alias("seed"))
    return reachable(graph, seeds, depth).select(F.col("node").alias("concept_id"), "hop").orderBy("hop", "concept_id").limit(limit)
