"""Histories of changing attributes: insert-only satellites with hash differences and lead-based end dates.

Every attribute of an entity (subject and predicate) is a series of assertions, one for each time from which something
is said to hold. A satellite keeps the assertions as they came: a row is appended only where the hash of what holds from
that time differs from the hash last loaded for it, with the number of the load; nothing is updated. The view over a
satellite takes the last load of every such time and derives the versions: where one ends follows from the next row of
its series, so late and corrected assertions take their place whatever was loaded before, and an earlier state of belief
is the view of an earlier load. Attributes are split over satellites by how often they change, so that the slow ones
aren't compacted or scanned with the fast ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ordered import MIN_HOT_ROWS, Ordered

#: Predicates with one value at a time (fixed values of the data model).
SINGLE_VALUED = ("has_status", "seasoning_state", "qual_level", "running_recipe", "firmware_revision", "owning_team")
CLOSED, GONE = "closed", "gone"


def counting(facts: DataFrame) -> DataFrame:
    """Facts that are believed, positive, observed or confirmed, and not ended before they began."""
    return facts.filter(
        F.col("recorded_to").isNull() & (F.col("polarity") == "positive") & F.col("assertion_status").isin("observed", "confirmed") & F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    )


def folded(value: Column) -> Column:
    """Text trimmed of any white space and case-folded (upper, then lower case, which unites sharp s and ss)."""
    return F.lower(F.upper(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))


def canonical_values(facts: DataFrame, vocabulary: DataFrame, max_entries: int = 100_000) -> DataFrame:
    """``facts`` with ``value``: the folded text of object_value, an alias replaced by the vocabulary's canonical value.

    The vocabulary's (predicate, alias) pairs are broadcast only if they are no more than ``max_entries``; otherwise
    Spark picks the join. A value that is no JSON object with ``value`` is null. An alias given twice takes the
    smallest canonical value.
    """
    names = vocabulary.select(F.col("name").alias("predicate"), F.explode("aliases").alias("alias"), folded(F.col("canonical_value")).alias("canonical"))
    names = names.select("predicate", folded(F.col("alias")).alias("value"), "canonical").groupBy("predicate", "value").agg(F.min("canonical").alias("canonical"))
    if names.limit(max_entries + 1).count() <= max_entries:
        names = F.broadcast(names)
    raw = facts.withColumn("value", folded(F.get_json_object("object_value", "$.value")))
    return raw.join(names, ["predicate", "value"], "left").withColumn("value", F.coalesce("canonical", "value")).drop("canonical")


def held(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Of assertions with equal key and valid_from the one with the latest recorded_from (ties: the larger value, then end)."""
    best = F.max(F.struct("recorded_from", F.col(value).alias("value"), F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp")).alias("stop"))).alias("b")
    us = lambda c: F.unix_micros(F.col(c))
    out = rows.groupBy(*keys, "valid_from").agg(best)
    return out.select(*keys, us("valid_from").alias("from_us"), F.col("b.value").alias("value"), F.when(F.col("b.stop") < "9999-12-31", us("b.stop")).alias("stop_us"))


def loaded(held_rows: DataFrame, number: int) -> DataFrame:
    """A load of a satellite: :func:`held` rows with ``hash_diff`` (of value and explicit end), ``kind`` and ``load``."""
    told = F.concat_ws("|", F.coalesce(F.concat(F.lit("v:"), "value"), F.lit("null")), F.coalesce(F.col("stop_us").cast("string"), F.lit("open")))
    return held_rows.withColumn("hash_diff", F.sha2(told, 256)).withColumn("kind", F.lit("value")).withColumn("load", F.lit(number).cast("long"))


def current(satellite: DataFrame, keys: list[str], as_of: int | None = None) -> DataFrame:
    """What the satellite holds after its last load (or load ``as_of``): of each key and time the row loaded last,
    without those that were withdrawn."""
    rows = satellite if as_of is None else satellite.filter(F.col("load") <= as_of)
    row = F.struct("hash_diff", "value", "stop_us", "kind")
    last = rows.groupBy(*keys, "from_us").agg(F.max_by(row, "load").alias("r")).filter(F.col("r.kind") != GONE)
    return last.select(*keys, "from_us", "r.value", "r.stop_us", "r.hash_diff")


def appended(satellite: DataFrame | None, load: DataFrame, keys: list[str], complete: bool = True) -> DataFrame:
    """The rows that ``load`` adds to a satellite: those whose hash isn't the one that holds for their key and time. If the
    load is a ``complete`` snapshot, times that it no longer has get a row that withdraws them."""
    if satellite is None:
        return load
    there = current(satellite, keys).select(*[F.col(c).alias(f"__{c}") for c in (*keys, "from_us", "hash_diff")])
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "from_us")))
    both = load.join(there, match, "full" if complete else "left")
    new = both.filter(F.col("load").isNotNull() & (F.col("__hash_diff").isNull() | (F.col("__hash_diff") != F.col("hash_diff")))).select(*load.columns)
    if not complete:
        return new
    number = load.agg(F.max("load").alias("__number"))
    withdrawn = both.filter(F.col("load").isNull()).crossJoin(F.broadcast(number))  # one row
    kinds = dict(load.dtypes)
    fixed = {"kind": F.lit(GONE), "hash_diff": F.lit(GONE), "load": F.coalesce(F.col("__number"), F.lit(0)).cast("long"), "value": F.lit(None).cast(kinds["value"]), "stop_us": F.lit(None).cast("long")}
    return new.unionByName(withdrawn.select(*[fixed[c].alias(c) if c in fixed else F.col(f"__{c}").alias(c) for c in load.columns]))


def series(rows: DataFrame, keys: list[str], min_rows: int = MIN_HOT_ROWS, chunk_rows: int = MIN_HOT_ROWS) -> Ordered:
    """The changes that the assertions held (:func:`current` or :func:`held`) amount to: ``keys``, ``from_us``, ``value``,
    ``kind`` (value or closed).

    A value that ends before the next one begins is followed by a closing row; a row that says the same as the row
    before it is left out. Null is a value like any other.
    """
    told = Ordered(rows, keys, ["from_us"], min_rows, chunk_rows).lead(["from_us"], "__next")
    stop = F.col("stop_us").isNotNull() & (F.col("__next.from_us").isNull() | (F.col("stop_us") < F.col("__next.from_us")))
    opening = F.struct("from_us", "value", F.lit("value").alias("kind"))
    closing = F.struct(F.col("stop_us").alias("from_us"), F.lit(None).cast(dict(rows.dtypes)["value"]).alias("value"), F.lit(CLOSED).alias("kind"))
    rest = [c for c in told.parts]
    changes = told.map_rows(lambda d: d.select(*rest, F.explode(F.when(stop, F.array(opening, closing)).otherwise(F.array(opening))).alias("r")).select(*rest, "r.*"))
    changes = changes.lag(["value", "kind"], "__before")
    same = F.col("__before").isNotNull() & (F.col("__before.kind") == F.col("kind")) & F.col("__before.value").eqNullSafe(F.col("value"))
    return changes.map_rows(lambda d: d.filter(~same).drop("__before"))


def versions(rows: DataFrame, keys: list[str], min_rows: int = MIN_HOT_ROWS, chunk_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """The view: each version with ``from_us`` and ``to_us``, the start of what comes next in its series (-1: still valid)."""
    seen = series(rows, keys, min_rows, chunk_rows).lead(["from_us"], "__end").result()
    return seen.filter(F.col("kind") == "value").withColumn("to_us", F.coalesce(F.col("__end.from_us"), F.lit(-1).cast("long"))).drop("__end", "kind")


def change_rates(rows: DataFrame, entity: str, attribute: str, fast_at: float = 8.0) -> DataFrame:
    """Per attribute: rows, entities, rows per entity and the satellite (``fast`` or ``slow``) it belongs to."""
    per = rows.groupBy(attribute, entity).agg(F.count(F.lit(1)).alias("n")).groupBy(attribute).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_entities"))
    return per.withColumn("rows_per_entity", F.col("n_rows") / F.col("n_entities")).withColumn("satellite", F.when(F.col("rows_per_entity") >= fast_at, "fast").otherwise("slow"))


KEYS = ["subject_id", "predicate"]


def fact_rows(facts: DataFrame, vocabulary: DataFrame, predicates: tuple[str, ...] = SINGLE_VALUED) -> DataFrame:
    """The assertions that hold among the facts that count with single-valued ``predicates`` (see :func:`held`)."""
    rows = counting(facts).filter(F.col("predicate").isin(*predicates)).select(*KEYS, "valid_from", "valid_to", "recorded_from", "object_value")
    return held(canonical_values(rows, vocabulary), KEYS)


def fact_satellites(facts: DataFrame, vocabulary: DataFrame, predicates: tuple[str, ...] = SINGLE_VALUED, number: int = 0) -> dict[str, DataFrame]:
    """A load of the fast and of the slow satellite, by name: the predicates (a few names, which come to the driver) are
    split by how many times they are asserted anew per subject, and each satellite reads the facts of its own."""
    asserted = counting(facts).filter(F.col("predicate").isin(*predicates)).select(*KEYS)
    rates = change_rates(asserted, "subject_id", "predicate").collect()  # a row per predicate
    split = {name: tuple(sorted(r["predicate"] for r in rates if r["satellite"] == name)) for name in ("fast", "slow")}
    return {name: loaded(fact_rows(facts, vocabulary, named), number) for name, named in split.items() if named}


def fact_history(facts: DataFrame, vocabulary: DataFrame, predicates: tuple[str, ...] = SINGLE_VALUED, min_rows: int = MIN_HOT_ROWS, chunk_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Full history as now believed: one row per version of a subject's single-valued predicate, by the satellites.

    Repeated rows count once; late and corrected ones take the place that valid_from and recorded_from give them,
    whatever the order of arrival. An empty table gives no rows; other columns are ignored.
    """
    views = [versions(current(load, KEYS), KEYS, min_rows, chunk_rows) for load in fact_satellites(facts, vocabulary, predicates).values()]
    views = views or [versions(fact_rows(facts, vocabulary, predicates), KEYS, min_rows, chunk_rows)]
    return reduce(DataFrame.unionByName, views).select(*KEYS, "from_us", "to_us", "value")


def write_satellite(load: DataFrame, keys: list[str], folder: str, complete: bool = True) -> None:
    """Append to the satellite in ``folder`` what the load adds. Rows are never changed. A load that failed half-way is
    repeated as a whole: what was written is found again and left out."""
    spark = load.sparkSession
    try:
        there = spark.read.parquet(folder)
    except Exception as e:  # nothing was written so far
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        there = None
    appended(there, load, keys, complete).write.mode("append").parquet(folder)
