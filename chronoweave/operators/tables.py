"""Changes of small tables (vocabularies, phrases, cases, packs, erasure jobs) as new versions, and lifecycle streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data model.
PHASES = ("observation", "scoping", "investigation", "correlation", "root_cause", "remediation", "regression")
STATUSES = ("open", "investigating", "resolved", "closed")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``changes`` in place of rows with the same key; of several changes of a key the largest row
    holds. Null keys are equal. Columns that the changes lack are null in changed rows."""
    kept = [c for c in rows.columns if c not in keys]
    both = rows.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    best = both.groupBy(*keys).agg(F.max(F.struct("__new", *kept)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in kept]).select(*rows.columns)


def remove(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def checked_cases(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) changes of cases: phase and status must be null or known; ``reason`` tells what isn't."""
    phase = F.when(F.col("phase").isNotNull() & ~F.col("phase").isin(*PHASES), "unknown phase")
    status = F.when(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "unknown status")
    marked = changes.withColumn("reason", F.coalesce(phase, status))
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def find_cases(cases: DataFrame, text: str | None = None, status: str | None = None, equipment: str | None = None) -> DataFrame:
    """Cases by status, equipment and text in title, root cause, equipment or resolution (any case)."""
    out = cases
    if status is not None:
        out = out.filter(F.col("status") == status)
    if equipment is not None:
        out = out.filter(F.col("equipment") == equipment)
    if text is not None:
        hit: Column = F.lit(False)
        for c in ("title", "root_cause", "equipment", "resolution"):
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        out = out.filter(hit)
    return out


def unexpired(cache: DataFrame, now: str | datetime, seconds: int = 60) -> DataFrame:
    """The newest cached row per ``key`` made within the last ``seconds``."""
    at = F.lit(now).cast("timestamp")
    fresh = cache.filter((F.col("created_at") <= at) & (F.col("created_at") > at - F.expr(f"INTERVAL {int(seconds)} SECONDS")))
    return fresh.groupBy("key").agg(F.max(F.struct("created_at", "value")).alias("b")).select("key", "b.created_at", "b.value")


def lifecycle_after(lifecycle: DataFrame, ts: str | datetime, last_id: str, n: int, scope: str | None = None, kind: str | None = None) -> DataFrame:
    """The next n lifecycle events after a cursor of time and id: a total order, so that none is missed or repeated."""
    at = F.lit(ts).cast("timestamp")
    rows = lifecycle.filter((F.col("ts") > at) | ((F.col("ts") == at) & (F.col("lifecycle_id") > last_id)))
    if scope is not None:
        rows = rows.filter(F.col("scope") == scope)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return rows.orderBy("ts", "lifecycle_id").limit(n)


def latest_stage(lifecycle: DataFrame) -> DataFrame:
    """The last lifecycle event of each event: ``event_id``, ``kind``, ``ts``."""
    return lifecycle.groupBy("event_id").agg(F.max(F.struct("ts", "lifecycle_id", "kind")).alias("b")).select("event_id", "b.kind", "b.ts")


def emitted(rows: DataFrame, kind: str, key: str, at: str, scope: str = "scope") -> DataFrame:
    """Lifecycle events of one kind for rows: ``lifecycle_id`` (a hash of kind, key and time: emitting twice adds nothing
    new), ``event_id``, ``scope``, ``kind``, ``ts``. Rows without a time have none."""
    told = rows.filter(F.col(at).isNotNull())
    name = F.sha2(F.concat_ws("|", F.lit(kind), key, F.unix_micros(at).cast("string")), 256)
    return told.select(name.alias("lifecycle_id"), F.col(key).alias("event_id"), F.col(scope).alias("scope"), F.lit(kind).alias("kind"), F.col(at).alias("ts"))


def erasure_jobs(jobs: DataFrame, phases: tuple[str, ...] | None = None) -> DataFrame:
    """Erasure jobs (erasure_id, scope, phase, requested_at), newest first, of some phases only if asked."""
    rows = jobs if phases is None else jobs.filter(F.col("phase").isin(*phases))
    return rows.orderBy(F.desc_nulls_last("requested_at"), "erasure_id")


def cancelled(jobs: DataFrame, erasure_id: str) -> DataFrame:
    """``jobs`` with one cancelled, which only a job in its first two phases can be."""
    may = (F.col("erasure_id") == erasure_id) & F.col("phase").isin("enumerate", "delete")
    return jobs.withColumn("phase", F.when(may, "cancelled").otherwise(F.col("phase")))
