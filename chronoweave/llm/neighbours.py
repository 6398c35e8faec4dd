"""The most similar vectors of every vector, through a permutation index in two levels.

A vector is represented by its nearest pivots in order of nearness and posted in the inverted file of each of them with
its rank there (Chavez, Figueroa and Navarro, Effective Proximity Retrieval by Ordering Permutations, 2008; Amato and
Savino's MI-File, 2008). A query opens the files of its own nearest pivots, adds up the footrule distance of the ranks
over them, and only the ``candidates`` nearest by footrule are fetched and reranked by cosine similarity.

The first level are centres, a random sample of the vectors, one for about ``CELL`` of them. A vector is an entry of its
nearest centre's cell and a query in the cells of its ``visits`` nearest centres. Each cell has an index of its own,
with pivots sampled from its entries, one for every ``SPARSENESS`` of them, so the files keep their size however many
vectors there are. Dense regions have as many more centres as they have more vectors; a cell that is large all the same
is dealt over several indexes, all of which its queries visit. Who is found by a vector also finds it: results count in
both directions. Vectors of equal direction are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators.ordered import skew_safe_lookup
from chronoweave.session import checkpointed

DIMENSIONS = 64
#: Vectors for each centre, queries that one task answers at one cell, and entries of a cell for each pivot.
CELL, BLOCK, SPARSENESS = 32_768, 32_768, 12


def usable(vectors: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key`` and ``vec`` of the usable vectors, once per key (the largest array, if rows of a key differ).

    Usable are arrays of ``dimensions`` numbers without null, NaN or infinity that aren't all zero.
    """
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector)
    fine = F.col(key).isNotNull() & (F.size(v) == dimensions) & F.forall(v, good) & F.exists(v, lambda x: x != 0)
    return vectors.filter(fine).groupBy(key).agg(F.max(v).alias("vec"))


def with_direction(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__h``, 128 bits of hash of the vector's direction to 6 decimals."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.zip_with("vec", F.array_repeat(norm, F.size("vec")), lambda x, n: F.rint(x.cast("double") / n * 1e6).cast("long"))
    return rows.withColumn("__u", unit).withColumn("__h", F.concat_ws(":", F.xxhash64("__u"), F.xxhash64(F.lit(1), "__u"))).drop("__u")


def classes(unit: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of equal direction (:func:`with_direction`) as classes, and each member's class.

    First: ``no`` (a number), ``vec`` (of the smallest key), ``ids`` (the k + 1 smallest keys). Second: ``key``, ``no``,
    ``ids``.
    The row_number limit is applied before the shuffle, so a class with a large part of all rows is reduced first.
    """
    few = unit.withColumn("__r", F.row_number().over(Window.partitionBy("__h").orderBy(key))).filter(F.col("__r") <= k + 1)
    reps = few.groupBy("__h").agg(F.array_sort(F.collect_list(key)).alias("ids"), F.min_by("vec", key).alias("vec"))
    reps = checkpointed(reps.withColumn("no", F.monotonically_increasing_id()))
    members = skew_safe_lookup(unit.select(key, "__h"), reps.select("__h", "no", "ids"), ["__h"], how="inner")
    return reps.select("no", "vec", "ids"), members.select(key, "no", "ids")


def sample_centres(reps: DataFrame, n: int) -> np.ndarray:
    """A seeded sample of ``n`` vectors (unit length), the only rows that come to the driver: one for ``CELL`` vectors."""
    rows = reps.select("vec", F.xxhash64("no").alias("__o")).orderBy("__o").limit(n).collect()
    found = np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    return units_of(found).astype(np.float32)


def units_of(raw: np.ndarray) -> np.ndarray:
    unit = raw.astype(np.float64)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def permutations(unit: np.ndarray, pivots: np.ndarray, prefix: int, block: int = 2048) -> np.ndarray:
    """The nearest ``prefix`` pivots of each vector, in order."""
    width, out = min(prefix, len(pivots)), []
    for lo in range(0, len(unit), block):
        near = unit[lo : lo + block] @ pivots.T
        first = np.argpartition(-near, width - 1, axis=1)[:, :width]
        order = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(first, order, 1))
    return np.concatenate(out) if out else np.zeros((0, width), np.int64)


def mixed(no: np.ndarray, salt: int) -> np.ndarray:
    """An even hash of numbers, from 0 to 2 ** 31."""
    x = (no.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)).astype(np.int64)


def blocks(batches: Iterator[pd.DataFrame], rows: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, len(batch), rows):
            part = batch.iloc[lo : lo + rows]
            yield part["no"].to_numpy(), np.stack(part["vec"].to_numpy())


def nearest_centres(vec: np.ndarray, centres: np.ndarray, visits: int) -> np.ndarray:
    return permutations(units_of(vec).astype(np.float32), centres, visits)


def count_visits(centres: np.ndarray, visits: int):
    """For mapInPandas: how many entries and queries each cell gets from these rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, queries = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for _, vec in blocks(batches):
            cells = nearest_centres(vec, centres, visits)
            entries += np.bincount(cells[:, 0], minlength=len(centres))
            queries += np.bincount(cells.ravel(), minlength=len(centres))
        yield pd.DataFrame({"cell": np.arange(len(centres), dtype=np.int32), "entries": entries, "queries": queries})

    return run


QUERY, ENTRY, BOTH = 0, 1, 2


def apart(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` numbers that hash partitioning into ``n`` partitions puts into one each: no two tasks wait for each other."""
    tried = spark.range(20 * n + 100).groupBy(F.expr(f"pmod(hash(id), {n})").alias("part")).agg(F.min("id").alias("id")).collect()  # n rows
    free = iter(range(-1, -n - 1, -1))
    found = {r["part"]: r["id"] for r in tried}
    return np.array([found.get(i, next(free)) for i in range(n)], np.int64)


def post(centres: np.ndarray, visits: int, shards: np.ndarray, splits: np.ndarray, keys: np.ndarray, kind: str):
    """For mapInPandas: one row per vector and index task it has to do with, as an entry, as a query or as both.

    A cell has ``shards`` indexes over parts of its entries and ``splits`` tasks for each, which answer parts of its
    queries. The entries of an index go to all of its tasks, a query to one task of each index of the cells it visits.
    ``keys`` are the names of the tasks, cell by cell.
    """
    first = np.cumsum(shards * splits) - shards * splits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for no, vec in blocks(batches):
            cells, at = nearest_centres(vec, centres, visits), np.arange(len(no))
            rows = []
            for place in range(cells.shape[1]):
                cell = cells[:, place]
                own = mixed(no, 1) % shards[cell]
                turn = mixed(no, 2) % splits[cell]
                for shard in range(int(shards[cell].max())):
                    there = shards[cell] > shard
                    entry = there & (own == shard) & (place == 0)
                    rows.append((at[there], cell[there], shard, turn[there], np.where(entry[there], BOTH, QUERY)))
                    for split in range(int(splits[cell[entry]].max()) if entry.any() else 0):
                        more = entry & (splits[cell] > split) & (turn != split)
                        rows.append((at[more], cell[more], shard, np.full(more.sum(), split), np.full(more.sum(), ENTRY)))
            which = np.concatenate([r[0] for r in rows])
            task = keys[np.concatenate([first[r[1]] + r[2] * splits[r[1]] + r[3] for r in rows])]
            raw = [v.tobytes() for v in vec.astype(kind)]
            yield pd.DataFrame({"task": task, "no": no[which], "role": np.concatenate([r[4] for r in rows]).astype(np.int8), "raw": [raw[i] for i in which]})

    return run


def by_place(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order that follows the nearest of a few of them, so that neighbours get near numbers."""
    few = pivots[: max(1, int(len(pivots) ** 0.5))]
    return pivots[np.argsort((pivots @ few.T).argmax(1), kind="stable")]


class Files:
    """The inverted files over the entries of one cell: per pivot the entries that have it among their nearest, with ranks."""

    def __init__(self, unit: np.ndarray, no: np.ndarray, prefix: int, sparseness: int = SPARSENESS):
        n = len(unit)
        chosen = np.argsort(mixed(no, 3), kind="stable")[: min(n, max(32, n // sparseness))]
        self.pivots = by_place(unit[np.sort(chosen)])
        perm = permutations(unit, self.pivots, prefix)
        #: The entries in the order of their nearest pivot: files hold places in it.
        self.order = np.argsort(perm[:, 0], kind="stable")
        perm = perm[self.order]
        self.prefix, self.n = perm.shape[1], n
        order = np.argsort(perm.ravel(), kind="stable")
        self.entry, self.rank = order // self.prefix, order % self.prefix
        self.start = np.searchsorted(perm.ravel()[order], np.arange(len(self.pivots) + 1))
        gain = np.arange(self.prefix)
        #: What an entry's rank (column) of a query's pivot of some rank (row of the square) takes off the largest footrule distance.
        self.gain = ((self.prefix - gain)[:, None] - np.abs(gain[:, None] - gain[None, :])).astype(np.float64).ravel()

    def candidates(self, perm: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` entries with the smallest footrule distance over the query's pivots (all with equal distance as
        the last are in or out together, unless there are none else)."""
        lo, hi = self.start[perm], self.start[perm + 1]
        met = np.concatenate([self.entry[a:b] for a, b in zip(lo, hi, strict=True)])
        ranks = np.concatenate([self.rank[a:b] for a, b in zip(lo, hi, strict=True)])
        near = np.bincount(met, np.take(self.gain, np.repeat(np.arange(self.prefix) * self.prefix, hi - lo) + ranks), minlength=self.n)
        found = np.flatnonzero(near > 0)
        if len(found) <= most:
            return found
        score = near[found].astype(np.int64)
        above = np.cumsum(np.bincount(score)[::-1])[::-1]
        least = int(np.searchsorted(-above, -most))
        return found[score >= least] if least < len(above) else found[score == score.max()]


def search(prefix: int, candidates: int, k: int, kind: str, sparseness: int = SPARSENESS):
    """For applyInPandas over the rows of one task: per query its k nearest entries (``near``, numbers) and ``sims``."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no", kind="stable")
        no, role = part["no"].to_numpy(), part["role"].to_numpy()
        exact = units_of(np.stack([np.frombuffer(x, kind) for x in part["raw"]]))
        quick = exact.astype(np.float32)
        entry, query = np.flatnonzero(role != QUERY), np.flatnonzero(role != ENTRY)
        if not len(entry) or not len(query):
            return pd.DataFrame({"no": [], "near": [], "sims": []})
        files = Files(quick[entry], no[entry], prefix, sparseness)
        entry = entry[files.order]
        inside = quick[entry]
        perms = permutations(quick[query], files.pivots, prefix)
        out = []
        # Entries and queries in the order of their nearest pivots: one after the other they need much the same entries.
        for at in np.argsort(perms[:, 0], kind="stable"):
            i, perm = query[at], perms[at]
            found = files.candidates(perm, candidates)
            sims = np.einsum("ij,j->i", inside[found], quick[i])  # no threads for so little
            if len(found) > k + 8:  # a few more than k, whose exact order is decided with double precision
                found = found[np.argpartition(-sims, k + 7)[: k + 8]]
            found = found[no[entry[found]] != no[i]]
            sims = np.round(exact[entry[found]] @ exact[i], 6)
            best = np.argsort(-sims, kind="stable")[:k]
            if len(best):
                out.append((no[i], no[entry[found[best]]], sims[best]))
        return pd.DataFrame(out, columns=["no", "near", "sims"])

    return run


def found_links(reps: DataFrame, n: int, k: int, kind: str, visits: int, prefix: int, candidates: int, cell: int, block: int, sparseness: int) -> DataFrame:
    """``no``, ``near``, ``sim``: what the index finds, each link in both directions and once."""
    centres = sample_centres(reps, max(1, -(-n // cell)))
    bound = reps.sparkSession.sparkContext.broadcast(centres)
    visited = min(visits, len(centres))
    given = reps.select("no", "vec")
    counted = given.mapInPandas(lambda b: count_visits(bound.value, visited)(b), "cell int, entries long, queries long")
    sizes = counted.groupBy("cell").agg(F.sum("entries").alias("entries"), F.sum("queries").alias("queries")).collect()  # one row per centre
    shards, splits = np.ones(len(centres), np.int64), np.ones(len(centres), np.int64)
    for r in sizes:
        shards[r["cell"]] = max(1, -(-r["entries"] // (2 * cell)))
        splits[r["cell"]] = max(1, -(-r["queries"] // block))
    keys = apart(reps.sparkSession, int((shards * splits).sum()))
    posted = given.mapInPandas(lambda b: post(bound.value, visited, shards, splits, keys, kind)(b), "task long, no long, role byte, raw binary")
    near = posted.repartition(len(keys), "task").groupBy("task").applyInPandas(search(prefix, candidates, 2 * k, kind, sparseness), "no long, near array<long>, sims array<double>")
    there = near.select("no", F.explode(F.arrays_zip("near", "sims")).alias("n")).select("no", F.col("n.near").alias("near"), F.col("n.sims").alias("sim"))
    both = there.select(F.explode(F.array(F.struct("no", "near", "sim"), F.struct(F.col("near").alias("no"), F.col("no").alias("near"), "sim"))).alias("x")).select("x.*")
    return both.groupBy("no", "near").agg(F.max("sim").alias("sim"))


def nearest(vectors: DataFrame, key: str, vector: str, k: int = 5, dimensions: int = DIMENSIONS, visits: int = 4, prefix: int = 16, candidates: int = 1000, cell: int = CELL, block: int = BLOCK, sparseness: int = SPARSENESS) -> DataFrame:
    """``key``, ``other``, ``similarity``, ``rank``: the k most similar vectors of every usable vector.

    Similarity is the cosine rounded to 6 decimals; ties go to the smaller key. Unusable vectors are in no row. With
    fewer than k + 1 usable vectors each has all others; with one or none there is no row. Members of a class of k + 1
    or more equal vectors have the smallest keys of their class. ``candidates`` are reranked at each cell visited.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    rows = checkpointed(with_direction(usable(vectors, key, vector, dimensions)))
    reps, members = classes(rows, key, k)
    n = reps.count()
    id_type = dict(rows.dtypes)[key]
    if n:
        links = found_links(reps, n, k, kind, visits, prefix, candidates, cell, block, sparseness)
        best = links.withColumn("__r", F.rank().over(Window.partitionBy("no").orderBy(F.desc("sim")))).filter(F.col("__r") <= k).drop("__r")
        ids = reps.select(F.col("no").alias("near"), F.slice("ids", 1, k).alias("near_ids"))
        others = skew_safe_lookup(checkpointed(best), ids, ["near"], how="inner").select("no", "sim", F.explode("near_ids").alias("other"))
    else:
        others = rows.sparkSession.createDataFrame([], f"no long, sim double, other {id_type}")
    # Members of large classes find all they need in their class; of the others there are at most k in a class.
    own = members.select(key, F.explode("ids").alias("other"), F.lit(1.0).alias("sim")).filter(F.col(key) != F.col("other"))
    asking = members.filter(F.size("ids") <= k).select(key, "no")
    found = own.select(key, "other", "sim").unionByName(asking.join(others, "no").select(key, "other", "sim"))
    w = Window.partitionBy(key).orderBy(F.desc("sim"), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "other", F.col("sim").alias("similarity"), "rank")


def neighbour_pairs(vectors: DataFrame, key: str, vector: str, k: int = 5, **options) -> DataFrame:
    """``a``, ``b`` (a < b): pairs of which at least one is among the k nearest of the other."""
    found = nearest(vectors, key, vector, k, **options)
    return found.select(F.least(key, "other").alias("a"), F.greatest(key, "other").alias("b")).distinct()
