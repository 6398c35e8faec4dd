"""From events to facts and beliefs: statements, vocabulary, linking, supersession and revision as one chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import extract_triples
from chronoweave.operators import beliefs
from chronoweave.operators.facts import coerce, supersede
from chronoweave.sources.ingest import triples

MODEL, TRUSTED = "rules", "given"


@dataclass(frozen=True)
class Extracted:
    """``facts`` and ``entities`` to add, and ``quarantine``: statements that a closed vocabulary doesn't know."""

    facts: DataFrame
    entities: DataFrame
    quarantine: DataFrame


def statements(events: DataFrame, extract=extract_triples) -> DataFrame:
    """What events say: ``event_id``, ``subject``, ``predicate``, ``object``, ``confidence``, ``model``. Events of kind
    triple say it themselves; others are read by ``extract`` (a function of a frame with event_id and text, any model's)."""
    given = triples(events).select("event_id", "subject", "predicate", "object", "confidence", F.lit(TRUSTED).alias("model"))
    if extract is None:
        return given
    texts = events.filter(F.coalesce(F.get_json_object("content", "$.kind"), F.lit("")) != "triple").select("event_id", F.get_json_object("content", "$.text").alias("text")).filter(F.col("text").isNotNull())
    read = extract(texts).select("event_id", "subject", "predicate", "object", F.lit(0.6).alias("confidence"), F.lit(MODEL).alias("model"))
    return given.unionByName(read)


def folded(name: Column | str) -> Column:
    return F.lower(F.trim(name))


def names_in_scope(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``scope``, ``name`` (folded), ``entity_id``, ``n``: the live entities that go by a name; the smallest of ``n``."""
    live = entities.filter(F.col("merged_into").isNull()).select("entity_id", "scope", F.col("canonical_name").alias("name"))
    also = aliases.select("entity_id", F.col("alias").alias("name")).join(live.select("entity_id", "scope"), "entity_id")
    every = live.unionByName(also).select("scope", folded("name").alias("name"), "entity_id").filter(F.col("name").isNotNull())
    return every.groupBy("scope", "name").agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("n"))


def extract(events: DataFrame, entities: DataFrame, aliases: DataFrame, vocabulary: DataFrame, reader=extract_triples) -> Extracted:
    """The facts that events add.

    An object that the predicate's vocabulary knows becomes its canonical value; one that a closed vocabulary doesn't know
    puts the statement into quarantine, with its event, evidence and model. A subject is the one live entity of the
    scope that goes by its name; if none or several do, it is a new one, whose id is a hash of scope and name. An object
    that is the name of one live entity is that entity, else a literal. Ids of facts are hashes of what they say and of
    the event, so that a repeated batch adds nothing new. Blank names give no fact.
    """
    told = statements(events, reader).filter((F.trim("subject") != "") & (F.trim("predicate") != "")).join(events.select("event_id", "scope", "observed_at", "recorded_at"), "event_id")
    known = coerce(told, vocabulary, "object", name="predicate")
    missed = known.filter(F.col("coerced").isNull() & F.col("object").isNotNull())
    quarantine = missed.select("event_id", "scope", "predicate", F.col("object").alias("value"), F.concat_ws(" ", "subject", "predicate", "object").alias("evidence"), "model", F.lit("not in the vocabulary").alias("reason"))
    kept = known.filter(F.col("coerced").isNotNull())

    names = names_in_scope(entities, aliases)
    one = names.filter(F.col("n") == 1)
    as_ = lambda c, i: one.select("scope", F.col("name").alias(c), F.col("entity_id").alias(i))
    linked = kept.withColumn("__s", folded("subject")).withColumn("__o", folded("coerced"))
    linked = linked.join(as_("__s", "__sid"), ["scope", "__s"], "left").join(as_("__o", "__oid"), ["scope", "__o"], "left")
    new = F.sha2(F.concat_ws("|", "scope", "__s"), 256)
    subject = F.coalesce("__sid", new)
    added = linked.filter(F.col("__sid").isNull()).groupBy(new.alias("entity_id"), "scope").agg(F.min("subject").alias("canonical_name"))
    fact_id = F.sha2(F.concat_ws("|", "scope", subject, "predicate", F.coalesce("__oid", "coerced"), "event_id"), 256)
    facts = linked.select(
        fact_id.alias("fact_id"), "scope", subject.alias("subject_id"), "predicate",
        F.when(F.col("__oid").isNotNull(), "entity").otherwise("literal").alias("object_type"), F.col("__oid").alias("object_entity_id"),
        F.when(F.col("__oid").isNull(), F.to_json(F.struct(F.col("coerced").alias("value")))).alias("object_value"),
        F.coalesce("observed_at", "recorded_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("recorded_at").alias("recorded_from"), F.lit(None).cast("timestamp").alias("recorded_to"),
        "confidence", F.lit("positive").alias("polarity"), F.lit("observed").alias("assertion_status"), F.array("event_id").alias("supports"), F.col("model").alias("extraction_model"),
    )
    return Extracted(facts.dropDuplicates(["fact_id"]), added, quarantine)


def merged(store: DataFrame, new: DataFrame, single: Column) -> DataFrame:
    """The facts believed after ``new`` ones came to the ``store``: those of single-valued predicates (``single``) end where
    the next begins; ``valid_to`` of the others stays. A fact that is there already isn't added again."""
    columns = ["fact_id", "scope", "subject_id", "predicate", "object_type", "object_entity_id", "object_value", "valid_from", "valid_to", "recorded_from", "confidence", "polarity", "assertion_status", "supports"]
    believed = store.filter(F.col("recorded_to").isNull()).select(*columns)
    every = believed.unionByName(new.select(*columns).join(believed.select("fact_id"), "fact_id", "left_anti"))
    takes_part = single & (F.col("polarity") == "positive") & F.col("assertion_status").isin("observed", "confirmed") & F.col("valid_from").isNotNull()
    keys = ["scope", "subject_id", "predicate"]
    held = supersede(every.filter(takes_part).withColumn("assertion_id", F.col("fact_id")).withColumn("value", F.col("fact_id")), keys)
    ended = every.drop("valid_to").join(held.select(F.col("assertion_id").alias("fact_id"), "valid_to"), "fact_id").select(*columns)
    return ended.unionByName(every.filter(~F.coalesce(takes_part, F.lit(False))))


def revised(store: DataFrame, new: DataFrame, names: DataFrame, single: Column) -> DataFrame:
    """The beliefs that ``new`` facts may change, made anew from all facts that hold after them."""
    held = merged(store, new, single).filter(F.col("valid_to").isNull())
    touched = beliefs.impacted(new)
    return beliefs.revise(held, names).join(touched, ["scope", "about_entity_id"], "left_semi")
