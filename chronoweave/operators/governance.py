"""Forgetting, erasure, maintenance and the state of the job queue. Every change is a new version of a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.facts import object_key
from chronoweave.operators.ordered import MIN_HOT_ROWS, skew_safe_lookup


def forget(facts: DataFrame, selector: Column, at: str | datetime) -> DataFrame:
    """Facts with the belief in the selected ones ended at ``at``; what was ended before stays."""
    return facts.withColumn("recorded_to", F.coalesce("recorded_to", F.when(selector, F.lit(at).cast("timestamp"))))


def forget_scope(facts: DataFrame, beliefs: DataFrame, events: DataFrame, scope: str, at: str | datetime, predicate: str | None = None, about: str | None = None, confirm_all: bool = False, redact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, beliefs, events) after forgetting in a scope, by predicate or subject (``about``); all of it only if confirmed.

    The belief in the selected facts ends at ``at``; beliefs (with ``recorded_to``) end only if ``about`` is given. With
    ``redact`` the events of the scope behind any of its facts that are no longer believed are emptied and excluded.
    """
    if predicate is None and about is None and not confirm_all:
        raise ValueError("to forget a whole scope must be confirmed")
    chosen = F.col("scope") == scope
    if predicate is not None:
        chosen = chosen & (F.col("predicate") == predicate)
    if about is not None:
        chosen = chosen & (F.col("subject_id") == about)
    after = forget(facts, chosen, at)
    if about is not None:
        ended = (F.col("scope") == scope) & (F.col("about_entity_id") == about)
        beliefs = beliefs.withColumn("recorded_to", F.coalesce("recorded_to", F.when(ended, F.lit(at).cast("timestamp"))))
    if redact:
        behind = support_links(after.filter((F.col("scope") == scope) & F.col("recorded_to").isNotNull())).select("scope", "event_id").distinct().withColumn("__red", F.lit(True))
        red = F.col("__red").isNotNull()
        marked = events.join(behind, ["scope", "event_id"], "left")
        events = marked.withColumn("content", F.when(red, "{}").otherwise(F.col("content"))).withColumn("excluded_from_recall", red | F.coalesce("excluded_from_recall", F.lit(False))).drop("__red").select(*events.columns)
    return after, beliefs, events


def support_links(facts: DataFrame) -> DataFrame:
    """``fact_id``, ``scope``, ``event_id``: each supporting event once per fact."""
    return facts.select("fact_id", "scope", F.explode(F.array_distinct("supports")).alias("event_id"))


def reference_counts(events: DataFrame, facts: DataFrame, *more: DataFrame) -> DataFrame:
    """``event_id``, ``refcount``: how many facts (and rows of further frames with scope, event_id) rest on each event."""
    links = support_links(facts).select("scope", "event_id")
    for other in more:
        links = links.unionByName(other.select("scope", "event_id"))
    counts = links.groupBy("scope", "event_id").agg(F.count(F.lit(1)).alias("refcount"))
    return events.select("scope", "event_id").join(counts, ["scope", "event_id"], "left").select("scope", "event_id", F.coalesce("refcount", F.lit(0)).alias("refcount"))


def erasure_manifest(events: DataFrame, facts: DataFrame, selected: DataFrame) -> DataFrame:
    """What erasing the selected event_ids means: redact those that facts rest on, delete the others."""
    counts = reference_counts(events.join(selected.select("event_id").distinct(), "event_id", "left_semi"), facts)
    return counts.withColumn("action", F.when(F.col("refcount") > 0, "redact").otherwise("delete"))


def erase(events: DataFrame, facts: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, facts) without what the manifest names: deleted rows are gone, redacted ones empty and excluded, and no
    fact's supports name either. To be written as new tables; the old files must be removed to be rid of the data."""
    marks = manifest.select("scope", "event_id", "action")
    left = events.join(marks, ["scope", "event_id"], "left").filter(F.coalesce("action", F.lit("")) != "delete")
    red = F.coalesce(F.col("action") == "redact", F.lit(False))
    kept = left.withColumn("content", F.when(red, "{}").otherwise(F.col("content"))).withColumn("excluded_from_recall", red | F.coalesce("excluded_from_recall", F.lit(False))).drop("action")
    gone = support_links(facts).join(marks, ["scope", "event_id"], "left_semi").groupBy("fact_id").agg(F.collect_set("event_id").alias("__gone"))
    cleaned = facts.join(gone, "fact_id", "left").withColumn("supports", F.when(F.col("__gone").isNull(), F.col("supports")).otherwise(F.array_except("supports", "__gone"))).drop("__gone")
    return kept, cleaned


def methylate(events: DataFrame, now: str | datetime, days: int = 30) -> DataFrame:
    """Events never accessed and older than ``days`` are excluded and stamped."""
    at = F.lit(now).cast("timestamp")
    due = ~F.coalesce("excluded_from_recall", F.lit(False)) & (F.coalesce("access_count", F.lit(0)) == 0) & (F.col("observed_at") < at - F.expr(f"INTERVAL {int(days)} DAYS"))
    due = F.coalesce(due, F.lit(False))
    return events.withColumn("methylated_at", F.when(due, at).otherwise(F.col("methylated_at"))).withColumn("excluded_from_recall", due | F.coalesce("excluded_from_recall", F.lit(False)))


def consolidate(facts: DataFrame, now: str | datetime, min_age_hours: int = 24, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """``fact_id`` of live facts that repeat a newer one: same scope, subject, predicate and object. Groups with a fact
    extracted before ``now`` less the age twice or more are treated; their newest valid_from stays (ties: smallest id).
    ``facts`` has one row per fact_id. The newest comes from an aggregation, so that no triple is sorted in one task.
    """
    at = F.lit(now).cast("timestamp")
    live = facts.filter(F.col("recorded_to").isNull() & F.col("valid_to").isNull() & F.col("scope").isNotNull() & F.col("subject_id").isNotNull() & F.col("predicate").isNotNull())
    triple = ["scope", "subject_id", "predicate", "__o"]
    rows = live.withColumn("__o", object_key()).withColumn("__age", F.struct(F.coalesce(-F.unix_micros("valid_from"), F.lit(2**63 - 1)).alias("u"), "fact_id"))
    old = F.col("extracted_at") < at - F.expr(f"INTERVAL {int(min_age_hours)} HOURS")
    newest = rows.groupBy(*triple).agg(F.min("__age").alias("__newest"), F.count_if(old).alias("__old")).filter(F.col("__old") > 1)
    met = skew_safe_lookup(rows.select(*triple, "fact_id"), newest, triple, min_rows, "inner")
    return met.filter(F.col("fact_id") != F.col("__newest.fact_id")).select("fact_id")


def claimable(jobs: DataFrame, now: str | datetime, n: int) -> DataFrame:
    """The next n jobs: queued and due, by priority, due time, creation and id."""
    at = F.lit(now).cast("timestamp")
    return jobs.filter((F.col("status") == "queued") & (F.col("run_after") <= at)).orderBy(F.desc("priority"), "run_after", "created_at", "job_id").limit(n)


def after_failure(jobs: DataFrame, now: str | datetime, base_seconds: float = 2.0) -> DataFrame:
    """Running jobs after a failure: failed at their last attempt, else queued again after base to the power of attempts."""
    at = F.lit(now).cast("timestamp")
    run = F.col("status") == "running"
    spent = F.col("attempts") >= F.col("max_attempts")
    again = F.timestamp_micros((F.unix_micros(at) + F.pow(F.lit(base_seconds), F.col("attempts")) * 1_000_000).cast("long"))
    return jobs.withColumn("run_after", F.when(run & ~spent, again).otherwise(F.col("run_after"))).withColumn("status", F.when(run & spent, "failed").when(run, "queued").otherwise(F.col("status")))


def reap(jobs: DataFrame, now: str | datetime, timeout_seconds: int = 300) -> DataFrame:
    """Running jobs locked longer than the timeout are queued again."""
    at = F.lit(now).cast("timestamp")
    dead = (F.col("status") == "running") & (F.col("locked_at") < at - F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS"))
    return jobs.withColumn("status", F.when(dead, "queued").otherwise(F.col("status"))).withColumn("locked_at", F.when(~F.coalesce(dead, F.lit(False)), F.col("locked_at")))


def stage_latency(lifecycle: DataFrame, first: str = "captured", last: str = "indexed") -> DataFrame:
    """``event_id``, ``latency_us`` from the first to the last stage of each event that reached both."""
    at = lambda kind, pick: pick(F.when(F.col("kind") == kind, F.unix_micros("ts")))
    per = lifecycle.groupBy("event_id").agg(at(first, F.min).alias("a"), at(last, F.max).alias("b"))
    return per.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("event_id", (F.col("b") - F.col("a")).alias("latency_us"))
