"""Periods that overlap, nest or leave gaps, merged into continuous ones."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ordered import CHUNK, MIN_HOT_ROWS, Ordered

OPEN = 2**63 - 1


class IntervalMap:
    """An ordered map of disjoint half-open intervals. Insertions merge what overlaps or touches."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: Sequence[int] = (), ends: Sequence[int] = ()):
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        if end <= start:
            return
        i = bisect_left(self.ends, start)  # the first that ends at the start or later
        j = bisect_right(self.starts, end)  # the first that starts after the end
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def fold_maps(keys: Sequence[str], with_gaps: bool):
    """A function for mapInPandas: rows arrive clustered by ``keys``; each key has a map as its state until the next key."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, out = None, IntervalMap(), []

        def close() -> None:
            if current is not None:
                out.extend((*current, "period", a, b) for a, b in state.periods())
                if with_gaps:
                    out.extend((*current, "gap", a, b) for a, b in state.gaps())

        columns = [*keys, "kind", "from_us", "to_us"]
        for batch in batches:
            whole = batch.astype(object).where(batch.notna(), None)
            for *key, start, end in zip(*(whole[k] for k in keys), batch["__from"], batch["__to"], strict=True):
                if key != current:
                    close()
                    current, state = key, IntervalMap()
                state.insert(start, end)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        close()
        yield pd.DataFrame(out, columns=columns)

    return fold


def coverage(rows: DataFrame, keys: list[str], start: str, end: str, min_rows: int = MIN_HOT_ROWS, chunk_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Largest continuous periods and the gaps between them: ``keys``, ``kind``, ``from_us``, ``to_us`` (-1: open).

    ``start`` and ``end`` are longs; a null end is open; rows without a start, or not ending after it, cover nothing.
    Periods that touch are one. Null keys form one group. Other columns are ignored, an empty table gives no rows.

    Equal starts are combined before the shuffle (the latest end covers the others). Then every key's rows are folded
    into an :class:`IntervalMap`, in order of their starts, so that each insertion is at the end of the map. A hot key is cut along ``start`` into chunks that are folded apart; the few disjoint
    periods that remain of each chunk are joined over the chunk borders by a running maximum of the ends.
    """
    clean = rows.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    clean = clean.groupBy(*keys, F.col(start).alias("__from")).agg(F.max(F.coalesce(F.col(end), F.lit(OPEN))).alias("__to"))
    cut = Ordered(clean, keys, ["__from"], min_rows, chunk_rows)
    schema = lambda cols: ", ".join(f"`{c}` {dict(cut.df.dtypes)[c]}" for c in cols) + ", kind string, from_us long, to_us long"
    plain = cut.df if not cut.chunked else cut.df.filter(F.col(CHUNK) < 0).drop(CHUNK)
    folded = plain.repartition(*keys).sortWithinPartitions(*keys, "__from").mapInPandas(fold_maps(keys, True), schema(keys))
    if cut.chunked:
        parts = [*keys, CHUNK]
        hot = cut.df.filter(F.col(CHUNK) >= 0).repartition(*parts).sortWithinPartitions(*parts, "__from").mapInPandas(fold_maps(parts, False), schema(parts))
        stitched = cut.map_rows(lambda _: hot.drop("kind"), ["from_us"]).max_before("to_us", "__reach")
        stitched = stitched.map_rows(lambda d: d.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("from_us") > F.col("__reach")), 1).otherwise(0)))
        islands = stitched.running_sum("__new", "__no").df.groupBy(*keys, "__no").agg(F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"))
        ends = islands.select(*keys, "__no", F.col("to_us").alias("__a"), F.lit(None).cast("long").alias("__b"))
        starts = islands.select(*keys, (F.col("__no") - 1).alias("__no"), F.lit(None).cast("long").alias("__a"), F.col("from_us").alias("__b"))
        gaps = ends.unionByName(starts).groupBy(*keys, "__no").agg(F.max("__a").alias("from_us"), F.max("__b").alias("to_us")).filter(F.col("from_us").isNotNull() & F.col("to_us").isNotNull())
        both = islands.withColumn("kind", F.lit("period")).drop("__no").unionByName(gaps.withColumn("kind", F.lit("gap")).drop("__no"))
        folded = folded.unionByName(both)
    return folded.withColumn("to_us", F.when(F.col("to_us") == OPEN, F.lit(-1)).otherwise(F.col("to_us")))
