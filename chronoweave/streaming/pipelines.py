"""The incremental counterparts of the batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chronoweave.operators.intervals import OPEN, IntervalMap
from chronoweave.session import table


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A stream over parquet files with the schema of a batch frame (never inferred)."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Everything that is there now, written to ``folder`` (shared by all executors) and read back, with the number of the
    micro-batch as ``batch``; in complete mode only the last one. A batch that is repeated overwrites itself."""
    target = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if query.lastProgress is None and query.recentProgress == []:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", target).parquet(f"{target}/*")
    if mode == "complete":
        out = out.filter(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out


def deduplicated(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Each event_id once; the state of an id is dropped when the watermark on ``recorded_at`` has passed it."""
    return events.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["event_id"])


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per scope as windows of inactivity. A gap of exactly the length doesn't split, as in the batch operator.
    Late events within the watermark merge sessions."""
    rows = events.filter(~F.coalesce("excluded_from_recall", F.lit(False)) & F.col("observed_at").isNotNull()).withWatermark("observed_at", late)
    out = rows.groupBy("scope", F.session_window("observed_at", gap).alias("w")).agg(F.min("observed_at").alias("start"), F.max("observed_at").alias("end"), F.count(F.lit(1)).alias("n_events"))
    return out.select("scope", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_events")


def interval_stream(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Merged periods per key as a stream (update mode): ``keys``, ``n_rows`` so far, ``starts`` and ``ends`` of the
    periods after each micro-batch.

    ``rows``: keys, ``from_us``, ``to_us`` (null: open). Keyed state holds the ordered map of disjoint intervals; each
    insertion finds its overlaps by binary search. State has no time limit: late intervals are never dropped.
    """
    kinds = dict(rows.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, starts, ends = state.get if state.exists else (0, (), ())
        held = IntervalMap(starts, ends)
        for batch in batches:
            for start, end in zip(batch["from_us"], batch["to_us"], strict=True):
                if not pd.isna(start):
                    held.insert(int(start), OPEN if pd.isna(end) else int(end))
                    n += 1
        state.update((n, held.starts, held.ends))
        yield pd.DataFrame([(*key, n, held.starts, held.ends)], columns=[*keys, "n_rows", "starts", "ends"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_rows long, starts array<long>, ends array<long>"
    # Exact longs survive pandas only as nullable integers, so null ends become the open end before.
    whole = rows.select(*keys, "from_us", F.coalesce("to_us", F.lit(OPEN)).alias("to_us")).filter(F.col("from_us").isNotNull())
    return whole.groupBy(*keys).applyInPandasWithState(step, schema, "n long, starts array<long>, ends array<long>", "update", "NoTimeout")


def supersession_stream(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Current versions per key after each micro-batch (update mode), late arrivals included: ``version`` (one more with
    each change of the key), ``starts``, ``ends`` (null: open) and ``assertion_ids``.

    ``assertions``: keys, ``valid_from``, ``valid_to``, ``recorded_from`` (longs), ``assertion_id`` string. As in the closed
    form, of equal starts the last recorded assertion holds, with the last explicit end; a version ends there or at the
    next start, whichever is first. State holds that much per start.
    """
    kinds = dict(assertions.dtypes)
    never = (-(2**63), "")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        version, *lists = state.get if state.exists else (0, (), (), (), (), (), ())
        held = {s: [(r, a), (er, ea), e] for s, r, a, er, ea, e in zip(*lists, strict=True)}
        for batch in batches:
            for start, end, recorded, assertion in zip(batch["valid_from"], batch["valid_to"], batch["recorded_from"], batch["assertion_id"], strict=True):
                row = held.setdefault(int(start), [never, never, OPEN])
                at = (int(recorded), assertion)
                row[0] = max(row[0], at)
                if int(end) != OPEN and at >= row[1]:
                    row[1], row[2] = at, int(end)
        starts = sorted(held)
        rows = [held[s] for s in starts]
        state.update((version + 1, starts, [r[0][0] for r in rows], [r[0][1] for r in rows], [r[1][0] for r in rows], [r[1][1] for r in rows], [r[2] for r in rows]))
        ends = [min(r[2], after) for r, after in zip(rows, [*starts[1:], OPEN], strict=True)]
        yield pd.DataFrame([(*key, version + 1, starts, ends, [r[0][1] for r in rows])], columns=[*keys, "version", "starts", "ends", "assertion_ids"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", version long, starts array<long>, ends array<long>, assertion_ids array<string>"
    kept = "version long, starts array<long>, recorded array<long>, ids array<string>, e_recorded array<long>, e_ids array<string>, explicit array<long>"
    rows = assertions.filter(F.col("valid_from").isNotNull()).select(*keys, "valid_from", F.coalesce("valid_to", F.lit(OPEN)).alias("valid_to"), "recorded_from", "assertion_id")
    out = rows.groupBy(*keys).applyInPandasWithState(step, schema, kept, "update", "NoTimeout")
    return out.withColumn("ends", F.transform("ends", lambda e: F.when(e != OPEN, e)))


def derive_layers(spark: SparkSession, events: DataFrame, derive: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run ``derive(batch, number)`` over each micro-batch of new events: the worker of the pipeline. A batch that failed
    is repeated with the same number, so that ``derive`` can leave out what it wrote already."""
    writer = events.writeStream.foreachBatch(derive).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_stream(spark: SparkSession, sf_dir: str, name: str = "event_log") -> DataFrame:
    """The event log as a stream, file or folder."""
    like = table(spark, sf_dir, name)
    return spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(f"{sf_dir}/{name}.parquet*")
