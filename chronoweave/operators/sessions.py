"""Sessions of activity separated by inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_delivery(events: DataFrame) -> DataFrame:
    """One row per event_id: of repeated deliveries the one recorded first (ties: the smaller wal_offset) holds.

    Only the columns that sessions need are kept, so that no more is read or shuffled. Null event_ids are dropped.
    """
    kept = F.struct("recorded_at", "wal_offset", "scope", "observed_at", "excluded_from_recall")
    return events.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min(kept).alias("e")).select("event_id", "e.scope", "e.observed_at", "e.excluded_from_recall")


def sessions(events: DataFrame, keys: list[str], time: str = "observed_at", gap_seconds: int = 1800) -> DataFrame:
    """Sessions of each key: ``session_no`` (from 1), ``start_us``, ``end_us``, ``duration_us``, ``n_events``.

    A new session starts where more than ``gap_seconds`` lie between two events; exactly the gap does not split.
    Rows without a time belong to no session; null keys form one group; each row counts once (callers deduplicate).

    Events of one key in one half-open bin of the gap's width are less than the gap apart, so they always share a
    session. The rows are therefore reduced to one per key and bin (with map-side combination) before the window:
    a lag flags the gaps, a running sum of the flags numbers the sessions. The largest window partition has one row
    per bin of the calendar, however many events a hot key has.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    width = gap_seconds * 1_000_000
    bins = (
        events.filter(F.col(time).isNotNull())
        .select(*keys, us.alias("__us"))
        .groupBy(*keys, F.expr(f"floor(__us / {width}D)").alias("__bin"))
        .agg(F.min("__us").alias("__first"), F.max("__us").alias("__last"), F.count(F.lit(1)).alias("__n"))
    )
    w = Window.partitionBy(*keys).orderBy("__bin")
    before = F.lag("__last").over(w)
    flagged = bins.withColumn("__new", F.when(before.isNull() | (F.col("__first") - before > width), 1).otherwise(0))
    numbered = flagged.withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "session_no").agg(F.min("__first").alias("start_us"), F.max("__last").alias("end_us"), F.sum("__n").alias("n_events"))
    return out.withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def event_sessions(event_log: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions per scope of an event log with repeated deliveries; excluded events count in none."""
    live = first_delivery(event_log).filter(~F.coalesce("excluded_from_recall", F.lit(False)))
    return sessions(live, ["scope"], "observed_at", gap_seconds)
