"""Window operations over groups of any size.

A window sorts each group in one task. A group that holds a large part of all rows (a hot key) must not go that
way, so it is cut along its order column at quantiles into chunks; each chunk is a window partition of its own and
what crosses a chunk border (the previous row, a running sum or maximum) comes from a summary of one row per chunk.

Only keys with more than ``max(min_rows, N / MAX_HOT)`` of the ``N`` rows are cut. There can be at most ``MAX_HOT``
of them, and at most ``N / chunk_rows + MAX_HOT`` chunks, so the list of hot keys and the summaries have a proven
bound and may be broadcast. When there is no hot key the plan is one ordinary window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HOT = 10_000
MIN_HOT_ROWS = 2_000_000
CHUNK = "__chunk"


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = MIN_HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame | None:
    """The keys with more than ``max(min_rows, N / max_hot)`` rows and their counts (``__n``), or None if there are none.

    One aggregation with map-side combination; at most ``max_hot`` rows come to the driver. Null keys form a group.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.filter(F.col("__n") > min_rows)
    found = top.orderBy(F.desc("__n"), *keys).limit(max_hot).collect()
    if not found:
        return None
    least = max(min_rows, df.count() // max_hot)
    found = [r for r in found if r["__n"] > least]
    return df.sparkSession.createDataFrame(found, top.schema) if found else None


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns, for a join that keeps the group of null keys."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


class Ordered:
    """Rows grouped by ``keys`` and ordered by ``order`` (a total order: the caller adds tie-breakers)."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], min_rows: int = MIN_HOT_ROWS, chunk_rows: int = MIN_HOT_ROWS):
        self.keys, self.order = list(keys), list(order)
        hot = hot_keys(df, keys, min_rows)
        self.chunked = hot is not None
        self.df = self._cut(df, hot, chunk_rows) if hot is not None else df

    def _cut(self, df: DataFrame, hot: DataFrame, chunk_rows: int) -> DataFrame:
        first = self.order[0]
        most = hot.agg(F.max("__n")).first()[0]
        parts = min(10_000, -(-most // chunk_rows))
        marks = [i / parts for i in range(1, parts)]
        there = df.join(F.broadcast(hot), same_key(df, hot, self.keys), "left_semi")
        bounds = there.groupBy(*self.keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(first, F.array(*map(F.lit, marks)), 10_000 if parts < 1000 else 100_000))).alias("__bounds"))
        bounds = bounds.select(*[F.col(k).alias(f"__b_{k}") for k in self.keys], "__bounds")
        match = reduce(lambda a, b: a & b, (df[k].eqNullSafe(bounds[f"__b_{k}"]) for k in self.keys))
        chunk = F.when(F.col("__bounds").isNull(), F.lit(-1)).otherwise(F.size(F.filter("__bounds", lambda b: b < F.col(first))))
        return df.join(F.broadcast(bounds), match, "left").withColumn(CHUNK, chunk.cast("int")).drop("__bounds", *[f"__b_{k}" for k in self.keys])

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else self.keys

    def _window(self, backwards: bool = False):
        return Window.partitionBy(*self.parts).orderBy(*[F.col(c).desc() if backwards else F.col(c).asc() for c in self.order])

    def _carry(self, df: DataFrame, summary: Column, across, backwards: bool) -> DataFrame:
        """``df`` with ``__carry``: ``across`` over the summaries of the key's chunks before (after) this one."""
        per = df.filter(F.col(CHUNK) >= 0).groupBy(*self.parts).agg(summary.alias("__s"))
        w = Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc() if backwards else F.col(CHUNK).asc())
        per = per.select(*[F.col(k).alias(f"__c_{k}") for k in self.parts], across(w).alias("__carry"))
        match = reduce(lambda a, b: a & b, (df[k].eqNullSafe(per[f"__c_{k}"]) for k in self.parts))
        return df.join(F.broadcast(per), match, "left").drop(*[f"__c_{k}" for k in self.parts])

    def _neighbour(self, cols: Sequence[str], into: str, backwards: bool) -> Ordered:
        row = F.struct(*cols)
        local = F.lag(row).over(self._window(backwards))
        if not self.chunked:
            return self._with(self.df.withColumn(into, local))
        pick = F.min_by if backwards else F.max_by
        df = self.df.withColumn(into, local)
        df = self._carry(df, pick(row, F.struct(*self.order)), lambda w: F.lag("__s").over(w), backwards)
        return self._with(df.withColumn(into, F.coalesce(into, "__carry")).drop("__carry"))

    def _with(self, df: DataFrame, order: Sequence[str] | None = None) -> Ordered:
        new = object.__new__(Ordered)
        new.keys, new.order, new.chunked, new.df = self.keys, list(order or self.order), self.chunked, df
        return new

    def lag(self, cols: Sequence[str], into: str) -> Ordered:
        """Struct ``into`` with ``cols`` of the row before, null at the first."""
        return self._neighbour(cols, into, False)

    def lead(self, cols: Sequence[str], into: str) -> Ordered:
        """Struct ``into`` with ``cols`` of the row after, null at the last."""
        return self._neighbour(cols, into, True)

    def running_sum(self, col: str, into: str) -> Ordered:
        """Sum of ``col`` over the group's rows up to this one."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        df = self.df.withColumn(into, F.sum(col).over(w))
        if self.chunked:
            df = self._carry(df, F.sum(col), lambda w: F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)), False)
            df = df.withColumn(into, F.col(into) + F.coalesce("__carry", F.lit(0))).drop("__carry")
        return self._with(df)

    def first(self, cols: Sequence[str], into: str) -> Ordered:
        """Struct ``into`` with ``cols`` of the group's first row."""
        row = F.struct(*cols)
        df = self.df.withColumn(into, F.first(row).over(self._window().rowsBetween(Window.unboundedPreceding, 0)))
        if self.chunked:
            df = self._carry(df, F.min_by(row, F.struct(*self.order)), lambda w: F.first("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)), False)
            df = df.withColumn(into, F.coalesce("__carry", into)).drop("__carry")
        return self._with(df)

    def max_before(self, col: str, into: str) -> Ordered:
        """Maximum of ``col`` over the group's rows before this one, null at the first."""
        w = self._window().rowsBetween(Window.unboundedPreceding, -1)
        df = self.df.withColumn(into, F.max(col).over(w))
        if self.chunked:
            df = self._carry(df, F.max(col), lambda w: F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, -1)), False)
            df = df.withColumn(into, F.greatest(into, "__carry")).drop("__carry")
        return self._with(df)

    def map_rows(self, change, order: Sequence[str] | None = None) -> Ordered:
        """A change of rows that keeps each in its chunk and the order between chunks (filter, select, explode)."""
        return self._with(change(self.df), order)

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)


def skew_safe_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], min_rows: int = MIN_HOT_ROWS, how: str = "left", n_rows: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has at most one row per key, without sending a hot key of ``left`` to one task.

    The rows of hot keys (see :func:`hot_keys`, at most ``MAX_HOT`` keys) meet a broadcast of just those rows of
    ``right``; all others take the ordinary join. Keys must not be null on the right. A caller that knows how many rows
    ``left`` has says so in ``n_rows``: no key can be hot if there are no more than ``min_rows``.
    """
    hot = None if n_rows is not None and n_rows <= min_rows else hot_keys(left, keys, min_rows)
    if hot is None:
        return left.join(right, list(keys), how)
    few = F.broadcast(right.join(F.broadcast(hot.drop("__n")), list(keys), "left_semi"))
    marks = F.broadcast(hot.drop("__n"))
    return left.join(marks, same_key(left, hot, keys), "left_semi").join(few, list(keys), how).unionByName(left.join(marks, same_key(left, hot, keys), "left_anti").join(right, list(keys), how))
