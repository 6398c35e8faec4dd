"""Items of varying size combined into containers of a fixed capacity: best-two-fit.

A container is filled greedily with the largest item that still fits. Then its smallest item is replaced by those two
unpacked items that fit the expanded gap most tightly, if they leave less unused. Sizes are integers, so the unpacked
ones are a bit set: the largest that fits and the best pair are found with a few operations on long integers.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import checkpointed

#: Items that one task packs. With so many of varying sizes nearly every container is full.
PER_TASK = 50_000


class Stock:
    """Unpacked items by size, with a bit set of the sizes there are and its mirror image."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity = capacity
        self.items: dict[int, list[int]] = defaultdict(list)
        for i in sorted(range(len(sizes)), key=lambda i: -i):
            self.items[sizes[i]].append(i)
        self.bits = self.mirror = 0
        for size in self.items:
            self._flip(size)

    def _flip(self, size: int) -> None:
        self.bits ^= 1 << size
        self.mirror ^= 1 << (self.capacity - size)

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        if not self.items[size]:
            self._flip(size)
        return item

    def put(self, size: int, item: int) -> None:
        if not self.items[size]:
            self._flip(size)
        self.items[size].append(item)

    def largest(self, gap: int) -> int:
        """The largest size of at most ``gap``, 0 if there is none."""
        return max(0, (self.bits & ((1 << (gap + 1)) - 1)).bit_length() - 1)

    def pair(self, gap: int, least: int, tried: int = 48) -> tuple[int, int] | None:
        """Sizes of two items with the largest sum in (least, gap], of those with equal sums the most unequal two.

        The sums nearest to the gap are tried on the bit sets: where there are many sizes one of them is met. If not,
        every size is paired with the largest that fits beside it.
        """
        for total in range(gap, max(least, gap - tried), -1):
            found = self.bits & (self.mirror >> (self.capacity - total))
            if total % 2 == 0 and found >> (total // 2) & 1 and len(self.items[total // 2]) < 2:
                found ^= 1 << (total // 2)
            if found:
                big = found.bit_length() - 1
                return big, total - big
        return self._pair_of_few(gap, least) if gap - tried > least else None

    def _pair_of_few(self, gap: int, least: int) -> tuple[int, int] | None:
        sizes = np.array(sorted(s for s, items in self.items.items() if items and s < gap), np.int64)
        if not len(sizes):
            return None
        beside = np.searchsorted(sizes, gap - sizes, side="right") - 1
        # A size with a single item can't stand beside itself.
        lone = np.array([len(self.items[s]) < 2 for s in sizes.tolist()])
        beside -= (beside == np.arange(len(sizes))) & lone
        total = np.where(beside >= 0, sizes + sizes[beside.clip(0)], -1)
        best = int(total.max())
        if best <= least:
            return None
        big = int(sizes[np.flatnonzero(total == best)[-1]])
        return max(big, best - big), min(big, best - big)


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of indexes into ``sizes``, each of which must be from 1 to ``capacity``."""
    if any(not 0 < s <= capacity for s in sizes):
        raise ValueError("sizes must be from 1 to the capacity")
    stock, out = Stock(sizes, capacity), []
    while stock.bits:
        gap, inside = capacity, []
        while gap and (size := stock.largest(gap)):
            inside.append((size, stock.take(size)))
            gap -= size
        if gap and inside:
            size, item = inside[-1]
            if two := stock.pair(min(capacity, gap + size), size):
                inside.pop()
                inside += [(s, stock.take(s)) for s in two]
                stock.put(size, item)
        out.append([i for _, i in inside])
    return out


def pack(items: DataFrame, windows: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens", per_task: int = PER_TASK, full: float = 0.98) -> DataFrame:
    """Every item's place: ``window_name``, ``container_id``, ``key``, ``piece_no``, ``start``, ``size`` and ``used`` (of the container).

    ``windows`` are (name, capacity), a few driver-side values. An item above the capacity is the only one that is
    split: into pieces of the capacity, each a container, and a rest that is packed like an item. An item of size 0 or
    null needs no space and gets a row without container. A key that is repeated is one item, of its largest size.

    Items are spread by hash over tasks of about ``per_task``; the containers that a task leaves below ``full`` (0.98 of
    the capacity) are opened once more and their items packed together with those of the other tasks.
    """
    kind = dict(items.dtypes)[key]
    schema = f"window_name string, container_id string, `{key}` {kind}, piece_no int, start long, size long, used long, capacity long"
    named = items.groupBy(key).agg(F.coalesce(F.max(size), F.lit(0)).cast("long").alias("__n"))
    capacities = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for n, c in windows])
    wide = named.select(key, "__n", F.explode(capacities).alias("w")).select("w.*", key, "__n")
    none = wide.filter(F.col("__n") <= 0).select("window_name", F.lit(None).cast("string").alias("container_id"), key, F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("used"), "capacity")
    last = F.floor((F.col("__n") - 1) / F.col("capacity")).cast("int")
    split = wide.filter(F.col("__n") > 0).withColumn("piece_no", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("piece_no") * F.col("capacity"))
    split = split.withColumn("size", F.least("capacity", F.col("__n") - F.col("start"))).drop("__n")

    def packer(round_no: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values([key, "piece_no"], kind="stable").reset_index(drop=True)
            sizes = part["size"].astype(int).tolist()
            name, shard, capacity = part["window_name"][0], part["shard"][0], int(part["capacity"][0])
            ids, used = [""] * len(sizes), [0] * len(sizes)
            for no, inside in enumerate(best_two_fit(sizes, capacity)):
                total = sum(sizes[i] for i in inside)
                for i in inside:
                    ids[i], used[i] = f"{name}-{round_no}-{shard}-{no}", total
            return part.drop(columns="shard").assign(container_id=ids, used=used)[["window_name", "container_id", key, "piece_no", "start", "size", "used", "capacity"]]

        return run

    def spread(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64(F.col(key), "piece_no", "size"), F.lit(max(1, -(-n // per_task)))).cast("int"))

    whole = split.filter(F.col("size") == F.col("capacity"))
    whole = whole.select("window_name", F.concat_ws("-", "window_name", F.lit("whole"), F.col(key).cast("string"), F.col("piece_no").cast("string")).alias("container_id"), key, "piece_no", "start", "size", F.col("size").alias("used"), "capacity")
    parts = split.filter(F.col("size") < F.col("capacity"))
    n = parts.count() // max(1, len(windows))
    packed = spread(parts, n).groupBy("window_name", "shard").applyInPandas(packer(1), schema)
    packed = checkpointed(packed)
    loose = packed.filter(F.col("used") < F.col("capacity") * full).drop("container_id", "used")
    again = spread(loose, loose.count() // max(1, len(windows))).groupBy("window_name", "shard").applyInPandas(packer(2), schema)
    packed = packed.filter(F.col("used") >= F.col("capacity") * full).unionByName(again)
    return packed.unionByName(whole).unionByName(none)


def report(packed: DataFrame) -> DataFrame:
    """Per window: containers, items, tokens, capacity in use, share unused, and the least number of containers possible."""
    real = packed.filter(F.col("container_id").isNotNull())
    per = real.groupBy("window_name", "capacity", "container_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy("window_name", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"))
    return out.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))
