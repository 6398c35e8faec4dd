"""Pairwise links consolidated into groups: connected components by alternating large-star and small-star rewrites.

An edge is kept as (hi, lo) with hi > lo. Large-star links every larger neighbour of a node to the smallest node of
its neighbourhood; small-star links a node and its smaller neighbours to the smallest of them. Both are one
aggregation with map-side combination and one join on a table with at most one row per node. When neither changes the
edges, every node is linked to its component's smallest node (Kiveris et al., Connected Components in MapReduce, 2014).

A hub that is an end of a large part of all edges is no problem for the aggregations, and its rows in the joins are
split off by :func:`skew_safe_lookup`. Between rounds the edges are written to the shared folder; those of the round before
are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ordered import MIN_HOT_ROWS, skew_safe_lookup
from chronoweave.session import discard, written


def _directed(edges: DataFrame) -> DataFrame:
    """Edges as (hi, lo), once each, without loops and nulls."""
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def large_star(edges: DataFrame, min_rows: int = MIN_HOT_ROWS, n_rows: int | None = None) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "lo")
    return skew_safe_lookup(edges, least, ["lo"], min_rows, n_rows=n_rows).select("hi", F.coalesce("m", "lo").alias("lo")).distinct()


def small_star(edges: DataFrame, min_rows: int = MIN_HOT_ROWS, n_rows: int | None = None) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    met = skew_safe_lookup(edges, least, ["hi"], min_rows, "inner", n_rows)
    return met.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()


def connected_groups(pairs: DataFrame, a: str, b: str, max_rounds: int = 60, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """``id`` and ``group_id`` (the smallest id of the group) of every id in a group of two or more.

    Pairs count in either direction and once however often they are repeated; a pair with itself or with null links
    nothing; other columns are ignored. An empty table gives no rows. The ids may be of any type that has an order.
    """
    measure = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    edges, folder = written(_directed(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    mark = measure(edges)
    for _ in range(max_rounds):
        # Neither rewrite adds edges, so the count rules hot keys out for the whole round.
        last, (edges, folder) = folder, written(small_star(large_star(edges, min_rows, mark[0]), min_rows, mark[0]))
        discard(pairs.sparkSession, last)
        before, mark = mark, measure(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    roots = edges.select("lo").distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("group_id")).unionByName(roots.select(F.col("lo").alias("id"), F.col("lo").alias("group_id")))


def merged_groups(entities: DataFrame) -> DataFrame:
    """Groups of entities over entity_id and merged_into; a merged_into that is no entity_id links nothing."""
    links = entities.select("entity_id", "merged_into").filter(F.col("merged_into").isNotNull()).distinct()
    known = entities.select(F.col("entity_id").alias("merged_into")).distinct()
    there = skew_safe_lookup(links, known, ["merged_into"], how="inner")
    return connected_groups(there, "entity_id", "merged_into").withColumnRenamed("id", "entity_id")
