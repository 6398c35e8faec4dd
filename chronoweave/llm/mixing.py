"""Documents of several sources mixed to target shares: subset-sum budget fitting.

Every source gets a budget in tokens. Documents are counted by exact token length; whole passes and a proportional
part of every length use up nearly all of the budget, and a bounded knapsack over the lengths that are left (dynamic
programming over a bit set of reachable sums) fits what remains. The documents of each length are then drawn in a
seeded order until its count is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ordered import MIN_HOT_ROWS, Ordered, skew_safe_lookup
from chronoweave.session import checkpointed

#: The knapsack runs over at most so many tokens; what lies above is filled before.
RESERVE = 32_768


@dataclass(frozen=True)
class Budget:
    source: str
    share: float
    max_repeats: int
    size: int
    tokens: int

    @property
    def passes(self) -> int:
        return self.tokens // self.size if self.size else 0

    @property
    def rest(self) -> int:
        return self.tokens - self.passes * self.size


def budgets(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: int | None = None) -> list[Budget]:
    """Tokens per source. Without ``total`` the largest mixture in which every source that has tokens meets its share
    within its repeats; shares of sources without tokens go to the others. With ``total`` a source that can't give its
    share gives all it may, and the mixture falls short by the rest."""
    there = [(s, w, m) for s, w, m in targets if sizes.get(s, 0) > 0 and w > 0 and m > 0]
    weight = sum(w for _, w, _ in there)
    if total is None:
        total = min((int(m * sizes[s] * weight / w) for s, w, m in there), default=0)
    out = []
    for s, w, m in targets:
        size = sizes.get(s, 0)
        wanted = round(total * w / weight) if any(s == x for x, _, _ in there) else 0
        out.append(Budget(s, w, m, size, min(wanted, m * size)))
    return out


def knapsack(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Counts per length, each within its number, with the largest sum of at most ``budget``. ``lengths``: (length, number)."""
    steps, bits, mask = [], 1, (1 << (budget + 1)) - 1
    for length, number in lengths:
        left, k = min(number, budget // length if length else 0), 1
        while left > 0 and not bits >> budget & 1:
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= bits << (k * length) & mask
            left -= k
            k *= 2
        if bits >> budget & 1:
            break
    at, out = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + k
            at -= k * length
    return out


def fit_counts(lengths: list[tuple[int, int]], budget: int, seed: int = 0, reserve: int = RESERVE) -> dict[int, int]:
    """How many documents of each length to take, summing to ``budget`` or as closely below it as the knapsack finds.

    First the same share of every length, rounded down. Further documents, in a seeded order of the lengths, until at
    most half of ``reserve`` remains; the shortest are given back until the reserve is full. Then the knapsack over it.
    """
    total = sum(a * n for a, n in lengths)
    if budget >= total:
        return dict(lengths)
    taken = {a: n * budget // total for a, n in lengths}
    rest = budget - sum(a * c for a, c in taken.items())
    number = dict(lengths)
    order = sorted(number, key=lambda a: (xxhash.xxh64_intdigest(str(a), seed), a))
    for a in order:
        if rest <= reserve // 2:
            break
        more = min(number[a] - taken[a], max(0, rest - reserve // 4) // a)
        if more > 0:
            taken[a] += more
            rest -= more * a
    for a in sorted(order):
        while taken[a] and rest + a <= reserve:
            taken[a] -= 1
            rest += a
    left = [(a, number[a] - taken[a]) for a in order if number[a] > taken[a] and a <= rest]
    for a, c in knapsack(left, rest).items():
        taken[a] += c
    return taken


def mix(sized: DataFrame, targets: list[tuple[str, float, int]], key: str = "doc_id", source: str = "source", size: str = "n_tokens", total: int | None = None, seed: int = 0, reserve: int = RESERVE, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """``key``, ``source``, ``n_tokens``, ``n_uses`` of the documents of the mixture.

    ``targets`` (source, share, max repeats) is a small driver-side list. Documents of other or null sources and those
    without tokens are in no mixture. Only one sum per target source comes to the driver; the counts by length are
    fitted in one task per source, over at most as many rows as there are different lengths. A length that very many
    documents share is no hot group: see :class:`Ordered`.
    """
    names = [s for s, _, _ in targets]
    rows = checkpointed(sized.filter(F.col(source).isin(names) & (F.col(size) > 0)).select(F.col(key), F.col(source).alias("source"), F.col(size).alias("n_tokens")))
    counts = rows.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["source"]: r["s"] for r in counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("s")).collect()}
    plan = {b.source: b for b in budgets(targets, sizes, total)}

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        b = plan[part["source"].iloc[0]]
        lengths = sorted(zip(part["n_tokens"].astype(int), part["n"].astype(int), strict=True))
        taken = fit_counts(lengths, b.rest, seed, reserve) if b.rest else {}
        return pd.DataFrame([(b.source, a, taken.get(a, 0), b.passes) for a, _ in lengths], columns=["source", "n_tokens", "take", "passes"])

    takes = counts.groupBy("source").applyInPandas(fit, "source string, n_tokens long, take long, passes long")
    drawn = Ordered(rows.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__1", F.lit(1)), ["source", "n_tokens"], ["__h", key], min_rows, min_rows).running_sum("__1", "__place").result()
    uses = skew_safe_lookup(drawn, takes, ["source", "n_tokens"], min_rows, "inner").withColumn("n_uses", F.col("passes") + F.when(F.col("__place") <= F.col("take"), 1).otherwise(0))
    return uses.filter(F.col("n_uses") > 0).select(key, "source", "n_tokens", "n_uses")


def mix_report(mixture: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Per target source: target share, actual share, tokens and documents used, largest number of uses."""
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("used_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("n_uses").alias("most_uses"))
    total = used.agg(F.sum("used_tokens").alias("total"))
    out = targets.select(F.col(source).alias("source"), "target_share", "max_repeats").join(used, "source", "left").join(F.broadcast(total))
    return out.select("source", "target_share", "max_repeats", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.round(F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))
