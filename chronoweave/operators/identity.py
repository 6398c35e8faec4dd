"""Which entity a mention means: exact names first, then near vectors, else a new entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import context_key, may_be_same
from chronoweave.functions.vectors import cosine

MERGE, ASK = 0.85, 0.30


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions (scope, name, entity_type, context, embedding, ordinal) once per scope, type, context and name, at their
    first ordinal: equal mentions must get the same entity, and linking one by one would depend on their order."""
    rows = mentions.withColumn("key", context_key("context", "entity_type")).withColumn("folded", F.lower(F.trim("name")))
    kind = F.coalesce("entity_type", F.lit(""))
    return rows.groupBy("scope", kind.alias("kind"), "key", "folded").agg(F.min(F.struct("ordinal", "name", "embedding")).alias("m")).select("scope", "kind", "key", "folded", "m.name", "m.embedding", "m.ordinal")


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, near: int = 5) -> DataFrame:
    """Per distinct mention: ``entity_id``, ``branch`` (exact, adopted, reuse, ask, new), ``similarity``.

    1. Live entities of the same scope and type with that name, canonical or alias. With a context one of the same
       context is taken; if there is none but a single one without context, that is adopted. Without a context a single
       one is taken.
    2. Where names matched but nothing was decided the mention is new: vectors aren't asked.
    3. Else the ``near`` most similar live entities of equal scope, type and context, filtered before the limit, without
       those whose identity tokens differ: at ``MERGE`` or more it is that entity, from ``ASK`` on it is left to ask
       (``entity_id`` is new then), below it is new. New ids are hashes of scope, type, context and name.
    """
    asked = distinct_mentions(mentions)
    live = entities.filter(F.col("merged_into").isNull()).withColumn("e_kind", F.coalesce("entity_type", F.lit("")))
    live = live.withColumn("e_key", F.coalesce("context_key", F.lit("{}")))
    names = live.select("entity_id", F.col("canonical_name").alias("n")).unionByName(aliases.select("entity_id", F.col("alias").alias("n"))).select("entity_id", F.lower(F.trim("n")).alias("folded")).distinct()
    known = names.join(live.select("entity_id", "scope", F.col("e_kind").alias("kind"), "e_key"), "entity_id")
    hits = asked.select("scope", "kind", "key", "folded").join(known, ["scope", "kind", "folded"])
    counted = hits.groupBy("scope", "kind", "key", "folded").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("e_key") == F.col("key")).alias("n_same"),
        F.min(F.when(F.col("e_key") == F.col("key"), F.col("entity_id"))).alias("same"),
        F.min("entity_id").alias("one"),
        F.max("e_key").alias("one_key"),
    )
    bare = F.col("key") == "{}"
    exact = F.when(~bare & (F.col("n_same") == 1), F.col("same")).when(bare & (F.col("n") == 1), F.col("one"))
    adopted = F.when(~bare & (F.col("n_same") == 0) & (F.col("n") == 1) & (F.col("one_key") == "{}"), F.col("one"))
    decided = asked.join(counted, ["scope", "kind", "key", "folded"], "left").withColumn("exact", exact).withColumn("adopted", adopted)

    open_ = decided.filter(F.col("n").isNull() & F.col("embedding").isNotNull()).select("scope", "kind", "key", "folded", "name", "embedding")
    pool = live.select("scope", F.col("e_kind").alias("kind"), F.col("e_key").alias("key"), "entity_id", "canonical_name", F.col("embedding").alias("e_vec"))
    pairs = open_.join(pool, ["scope", "kind", "key"]).withColumn("similarity", F.round(cosine("embedding", "e_vec"), 6)).filter(F.col("similarity").isNotNull())
    w = Window.partitionBy("scope", "kind", "key", "folded").orderBy(F.desc("similarity"), "entity_id")
    top = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= near).filter(may_be_same("name", "canonical_name", "kind"))
    best = top.groupBy("scope", "kind", "key", "folded").agg(F.max(F.struct("similarity", "entity_id")).alias("b"))

    new = F.sha2(F.concat_ws("|", "scope", "kind", "key", "folded"), 256)
    out = decided.join(best, ["scope", "kind", "key", "folded"], "left")
    branch = (
        F.when(F.col("exact").isNotNull(), "exact").when(F.col("adopted").isNotNull(), "adopted").when(F.col("b.similarity") >= MERGE, "reuse").when(F.col("b.similarity") >= ASK, "ask").otherwise("new")
    )
    found = F.coalesce("exact", "adopted", F.when(F.col("b.similarity") >= MERGE, F.col("b.entity_id")), new)
    return out.select("scope", F.col("kind").alias("entity_type"), F.col("key").alias("context_key"), "name", found.alias("entity_id"), branch.alias("branch"), F.col("b.similarity").alias("similarity"))
