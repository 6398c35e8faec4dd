"""Episodes: events grouped by case or by activity, with actors and causal chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def episodes(events: DataFrame, gap_seconds: int = 1800, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, episodes) of events that aren't excluded and, with ``taken``, not yet in an episode.

    Events with a case form one episode per scope and case, whatever the time between them; the others are split
    where more than ``gap_seconds`` lie between two events of a scope. ``events`` has one row per event_id.
    membership: ``episode_id``, ``event_id``, scope and case. Episode ids are hashes of what defines them.

    Times without case are reduced to bins of the gap's width before the window (see :mod:`sessions`), and the events
    find their episode through their bin.
    """
    rows = events.filter(~F.coalesce("excluded_from_recall", F.lit(False)) & F.col("observed_at").isNotNull())
    if taken is not None:
        rows = rows.join(taken.select("event_id"), "event_id", "left_anti")
    rows = rows.withColumn("__us", F.unix_micros(F.col("observed_at").cast("timestamp")))
    width = gap_seconds * 1_000_000
    timed = rows.filter(F.col("case_id").isNull()).withColumn("__bin", F.expr(f"floor(__us / {width}D)"))
    bins = timed.groupBy("scope", "__bin").agg(F.min("__us").alias("first"), F.max("__us").alias("last"))
    w = Window.partitionBy("scope").orderBy("__bin")
    before = F.lag("last").over(w)
    starts = bins.withColumn("start", F.when(before.isNull() | (F.col("first") - before > width), F.col("first")))
    starts = starts.withColumn("start", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = starts.select(F.col("scope").alias("__scope"), F.col("__bin").alias("__b"), "start")
    free = timed.join(found, F.col("scope").eqNullSafe(F.col("__scope")) & (F.col("__bin") == F.col("__b"))).withColumn("episode_id", F.sha2(F.concat_ws("|", F.lit("time"), "scope", F.col("start").cast("string")), 256))
    cases = rows.filter(F.col("case_id").isNotNull()).withColumn("episode_id", F.sha2(F.concat_ws("|", F.lit("case"), "scope", "case_id"), 256))
    columns = ["episode_id", "event_id", "scope", "case_id", "observed_actor", "context", "__us"]
    members = free.select(*columns).unionByName(cases.select(*columns))
    summary = members.groupBy("episode_id", "scope", "case_id").agg(
        F.min("__us").alias("started_us"), F.max("__us").alias("ended_us"), F.count(F.lit(1)).alias("n_events"), F.array_join(F.array_sort(F.collect_set("observed_actor")), ",").alias("actors")
    )
    return members, summary


def causal_chains(members: DataFrame) -> DataFrame:
    """``episode_id``, ``from_id``, ``to_id``: preceded_by links of the context between events of one episode."""
    named = members.select("episode_id", F.col("event_id").alias("to_id"), F.explode(F.from_json(F.get_json_object("context", "$.preceded_by"), "array<string>")).alias("from_id"))
    return named.join(members.select("episode_id", F.col("event_id").alias("from_id")), ["episode_id", "from_id"]).select("episode_id", "from_id", "to_id").distinct()


def case_facts(members: DataFrame, facts: DataFrame, most: int = 50) -> DataFrame:
    """The facts that events of each case support, newest first, ``most`` per case."""
    links = facts.select("fact_id", "valid_from", F.explode("supports").alias("event_id"))
    hit = members.filter(F.col("case_id").isNotNull()).select("scope", "case_id", "event_id").join(links, "event_id").select("scope", "case_id", "fact_id", "valid_from").distinct()
    w = Window.partitionBy("scope", "case_id").orderBy(F.desc_nulls_last("valid_from"), "fact_id")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("scope", "case_id", "fact_id", "rank")
