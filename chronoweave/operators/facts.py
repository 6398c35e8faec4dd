"""Bi-temporal facts: supersession, corrections, conflicts and their shapes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ordered import MIN_HOT_ROWS, Ordered


def once(df: DataFrame, key: str, first: tuple[str, ...] = (), latest: tuple[str, ...] = ()) -> DataFrame:
    """One whole row per key, as it was delivered: the one with the smallest ``first`` or the largest ``latest`` columns,
    of several such rows the one that is smallest (largest) in the other columns in order. Null is smaller than
    anything. Rows with a null key are dropped."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*first, *latest, *[c for c in rest if c not in (*first, *latest)])
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg((F.max(row) if latest else F.min(row)).alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def literal(value: str = "object_value") -> Column:
    """The text of a literal object, null for entities and invalid JSON."""
    return F.get_json_object(value, "$.value")


def object_key() -> Column:
    """What a fact says of its subject: the entity or the literal."""
    return F.concat_ws(":", F.coalesce("object_type", F.lit("")), F.coalesce("object_entity_id", literal(), F.lit("")))


def with_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with ``subject_name`` (inner) and ``object_text``: the object's name or the literal (left). ``entities`` has
    one row per entity_id; the join strategy is left to the optimizer, and at run time the partitions of an entity that
    very many facts name are split (adaptive skew join: nothing is aggregated before)."""
    names = entities.select("entity_id", "canonical_name")
    s = names.select(F.col("entity_id").alias("subject_id"), F.col("canonical_name").alias("subject_name"))
    o = names.select(F.col("entity_id").alias("object_entity_id"), F.col("canonical_name").alias("object_name"))
    out = facts.join(s, "subject_id").join(o, "object_entity_id", "left")
    return out.withColumn("object_text", F.when(F.col("object_type") == "entity", F.col("object_name")).otherwise(literal()))


def superseding(single: Column | None = None) -> Column:
    """Assertions that take part in supersession: positive and observed or confirmed, of a single-valued predicate."""
    base = (F.col("polarity") == "positive") & F.col("assertion_status").isin("observed", "confirmed")
    return base if single is None else base & single


def supersede(assertions: DataFrame, keys: list[str], known_at: Column | None = None, min_rows: int = MIN_HOT_ROWS, chunk_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """The belief that follows from assertions in any order of arrival, in closed form.

    Of assertions with equal key and valid_from the last recorded holds (``valid_to`` is the last explicit one, as a
    correction inherits it); it ends at its explicit valid_to or the next valid_from, whichever is first. Late arrivals
    need no watermark: they only take their place. ``assertions``: keys, assertion_id, valid_from, valid_to,
    recorded_from (longs or timestamps), value. With ``known_at`` only what was recorded by then counts.
    """
    rows = assertions if known_at is None else assertions.filter(F.col("recorded_from") <= known_at)
    rows = rows.filter(F.col("valid_from").isNotNull())
    order = F.struct("recorded_from", "assertion_id")
    last = rows.groupBy(*keys, "valid_from").agg(F.max_by(F.struct("assertion_id", "value", "recorded_from"), order).alias("a"), F.max_by("valid_to", F.when(F.col("valid_to").isNotNull(), order)).alias("explicit_to"))
    ordered = Ordered(last, keys, ["valid_from"], min_rows, chunk_rows).lead(["valid_from"], "__next").result()
    return ordered.select(*keys, "valid_from", F.least("explicit_to", "__next.valid_from").alias("valid_to"), "a.*")


def belief_log(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Every version that was ever believed, with the period of belief: ``recorded_from``, ``recorded_to``.

    The ordered fold behind :func:`supersede`: each assertion, in order of arrival, closes the belief it corrects or
    cuts off, and a cut-off belief is recorded again with its new end. ``rejected`` marks assertions whose explicit end
    isn't after their start or lies beyond the next version; they change nothing. Times are longs.
    The rows of a key stream through one task; only the key's current versions are held, their starts in order, so that
    an assertion finds its neighbours by binary search.
    """
    kinds = dict(assertions.dtypes)
    columns = [*keys, "assertion_id", "valid_from", "valid_to", "recorded_from", "recorded_to", "rejected"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, starts, out = None, {}, [], []

        def close() -> None:
            out.extend((*current, v[0], at, v[1], v[2], None, False) for at, v in held.items())

        for batch in batches:
            whole = batch.astype(object).where(batch.notna(), None)
            for *key, assertion, start, end, now in zip(*(whole[c] for c in [*keys, "assertion_id", "valid_from", "valid_to", "recorded_from"]), strict=True):
                if key != current:
                    if current is not None:
                        close()
                    current, held, starts = key, {}, []
                at = bisect_left(starts, start)
                there = start in held
                after = starts[at + there] if at + there < len(starts) else None
                if end is not None and (end <= start or after is not None and end > after):
                    out.append((*key, assertion, start, end, now, now, True))
                    continue
                if there:
                    old = held[start]
                    out.append((*key, old[0], start, old[1], old[2], now, False))
                    end = end if end is not None else old[1]
                else:
                    before = starts[at - 1] if at else None
                    starts.insert(at, start)
                    if before is not None and (held[before][1] is None or held[before][1] > start):
                        old = held[before]
                        out.append((*key, old[0], before, old[1], old[2], now, False))
                        held[before] = (old[0], start, now)
                    end = end if end is not None else after
                held[start] = (assertion, end, now)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        if current is not None:
            close()
        yield pd.DataFrame(out, columns=columns)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", assertion_id {kinds['assertion_id']}, valid_from long, valid_to long, recorded_from long, recorded_to long, rejected boolean"
    rows = assertions.filter(F.col("valid_from").isNotNull()).select(*keys, "assertion_id", "valid_from", "valid_to", "recorded_from")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "recorded_from", "assertion_id").mapInPandas(fold, schema)


def conflicts(live: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of live single-valued facts with more than one object: ``n_objects``, ``n_facts``."""
    return live.groupBy(*keys).agg(F.countDistinct(object_key()).alias("n_objects"), F.count(F.lit(1)).alias("n_facts")).filter(F.col("n_objects") > 1)


def coerce(rows: DataFrame, vocabulary: DataFrame, value: str, name: str | None = None, vocab_name: str | None = None) -> DataFrame:
    """``rows`` with ``coerced``: the canonical value for a canonical value or an alias, null for a miss in a closed
    vocabulary, else the value itself. The vocabulary is that named ``vocab_name`` or by column ``name``. It is a
    small dimension; its size decides (in the optimizer) whether it is broadcast."""
    words = vocabulary.select("name", "kind", "canonical_value", F.explode(F.array_distinct(F.concat(F.array("canonical_value"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("__w"))
    known = words.groupBy("name", "__w").agg(F.min("canonical_value").alias("__c"))
    kinds = vocabulary.groupBy("name").agg(F.max((F.col("kind") == "closed").cast("int")).alias("__closed"))
    named = rows.withColumn("__name", F.lit(vocab_name) if vocab_name else F.col(name))
    out = named.join(known.withColumnRenamed("name", "__name").withColumnRenamed("__w", value), ["__name", value], "left").join(kinds.withColumnRenamed("name", "__name"), "__name", "left")
    return out.withColumn("coerced", F.coalesce("__c", F.when(F.coalesce("__closed", F.lit(0)) == 0, F.col(value)))).drop("__name", "__c", "__closed")


def merged_once(entities: DataFrame) -> DataFrame:
    """``entity_id`` and ``resolved_id``: one step of merged_into."""
    return entities.select("entity_id", F.coalesce("merged_into", "entity_id").alias("resolved_id"))
