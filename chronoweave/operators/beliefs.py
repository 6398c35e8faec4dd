"""Beliefs: what the current facts about an entity add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXCLUDED = ("contradicts", "no_correlation")


def belief_inputs(facts: DataFrame) -> DataFrame:
    """Statements that bear on an entity, as ``about``: those of which it is the subject, and contradictions of it."""
    own = facts.filter(~F.col("predicate").isin(*EXCLUDED)).withColumn("about", F.col("subject_id")).withColumn("__against", F.lit(False))
    against = facts.filter((F.col("predicate") == "contradicts") & F.col("object_entity_id").isNotNull()).withColumn("about", F.col("object_entity_id")).withColumn("__against", F.lit(True))
    return own.unionByName(against)


def revise(facts: DataFrame, names: DataFrame) -> DataFrame:
    """A belief per scope and entity from live facts: ``stance``, ``confidence``, ``claim``, counts, ``valid_from_us``.

    A statement is hypothesized, opposing (a contradiction, negative, ruled out or rejected) or supporting (positive
    and observed or confirmed). With hypotheses or with both sides the stance is uncertain, else likely_true or
    likely_false. A pure side has the mean confidence, raised by .05 for each further event that supports it (.15 at
    most), at most .95; a mixed one the balance of the sides, at least .1. ``names``: entity_id, canonical_name.

    Confidences are added as decimals, so that no order of rows can change a sum, and rounded up at ties.
    One aggregation: distinct supporting events come from collecting per group and side what is already distinct per
    fact; nothing is joined back.
    """
    status = F.col("assertion_status")
    rows = belief_inputs(facts)
    hypo = (status == "hypothesized") & ~F.col("__against")
    opposing = (status != "hypothesized") | F.col("__against")
    opposing = opposing & (F.col("__against") | (F.col("polarity") == "negative") | status.isin("ruled_out", "rejected"))
    supporting = ~hypo & ~opposing & (F.col("polarity") == "positive") & status.isin("observed", "confirmed")
    sided = rows.withColumn("side", F.when(hypo, "h").when(opposing, "o").when(supporting, "s")).filter(F.col("side").isNotNull())
    per = sided.groupBy("scope", "about", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double").alias("w"), F.min("valid_from").alias("first")
    )
    events = sided.filter(F.col("side") != "h").select("scope", "about", "side", F.explode("supports").alias("event")).groupBy("scope", "about", "side").agg(F.countDistinct("event").alias("n_events"))
    joined = per.join(events, ["scope", "about", "side"], "left")
    pick = lambda side, c: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(0))
    wide = joined.groupBy("scope", "about").agg(
        *[pick(s, c).alias(f"{s}_{c}") for s in "soh" for c in ("n", "w")], *[pick(s, "n_events").alias(f"{s}_events") for s in "so"], F.min("first").alias("first")
    )
    mixed = (F.col("h_n") > 0) | ((F.col("s_n") > 0) & (F.col("o_n") > 0))
    side = F.when(F.col("s_n") > 0, F.struct(F.col("s_n").alias("n"), F.col("s_w").alias("w"), F.col("s_events").alias("e"))).otherwise(F.struct(F.col("o_n").alias("n"), F.col("o_w").alias("w"), F.col("o_events").alias("e")))
    wide = wide.withColumn("__p", side)
    pure = F.least(F.lit(0.95), F.col("__p.w") / F.col("__p.n") + F.least(F.lit(0.15), 0.05 * F.greatest(F.lit(0), F.col("__p.e") - 1)))
    balance = F.greatest(F.lit(0.1), F.abs(F.col("s_w") - F.col("o_w")) / F.greatest(F.lit(1e-4), F.col("s_w") + F.col("o_w") + 0.5 * F.col("h_w")))
    out = wide.join(names.select(F.col("entity_id").alias("about"), "canonical_name"), "about")
    return out.select(
        "scope",
        F.col("about").alias("about_entity_id"),
        F.when(mixed, "uncertain").when(F.col("o_n") > 0, "likely_false").otherwise("likely_true").alias("stance"),
        F.round(F.when(mixed, balance).otherwise(pure) + 1e-9, 3).alias("confidence"),
        F.concat("canonical_name", F.lit(" has "), F.col("s_n").cast("string"), F.lit(" supporting, "), F.col("o_n").cast("string"), F.lit(" opposing, and "), F.col("h_n").cast("string"), F.lit(" hypothesized current assertions")).alias("claim"),
        F.unix_micros("first").alias("valid_from_us"),
    )


def support_graph(facts: DataFrame, about: str = "about_entity_id") -> DataFrame:
    """Edges belief - fact (supported_by) and fact - event (extracted_from) behind the belief about each entity."""
    rows = belief_inputs(facts)
    one = rows.select(F.col("about").alias("from_id"), F.col("fact_id").alias("to_id"), F.lit("supported_by").alias("relation"))
    two = rows.select(F.col("fact_id").alias("from_id"), F.explode("supports").alias("to_id"), F.lit("extracted_from").alias("relation"))
    return one.unionByName(two).distinct()


def impacted(new_facts: DataFrame) -> DataFrame:
    """Scopes and entities whose belief the new facts may change."""
    rows = belief_inputs(new_facts)
    return rows.select("scope", F.col("about").alias("about_entity_id")).distinct()


def topics(beliefs: DataFrame, live_facts: DataFrame, names: DataFrame, per_scope: int = 5, claims: int = 3, supports: int = 5) -> DataFrame:
    """Concepts per scope: for the first ``per_scope`` names with beliefs the joined first claims and supporting facts.

    The limits are the feature; each is a top-k by a total order, so the window limits groups before the shuffle.
    """
    from pyspark.sql import Window

    named = beliefs.join(names.select(F.col("entity_id").alias("about_entity_id"), F.col("canonical_name").alias("topic")), "about_entity_id")
    first = named.select("scope", "topic").distinct().withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy("topic"))).filter(F.col("r") <= per_scope).drop("r")
    ranked = named.join(first, ["scope", "topic"]).withColumn("r", F.row_number().over(Window.partitionBy("scope", "topic").orderBy("claim", "about_entity_id")))
    summary = ranked.filter(F.col("r") <= claims).groupBy("scope", "topic").agg(F.concat(F.col("topic"), F.lit(": "), F.array_join(F.array_sort(F.collect_list("claim")), "; ")).alias("summary"))
    of = live_facts.join(names.select(F.col("entity_id").alias("subject_id"), F.col("canonical_name").alias("topic")), "subject_id").join(first, ["scope", "topic"], "left_semi")
    kept = of.withColumn("r", F.row_number().over(Window.partitionBy("scope", "topic").orderBy("fact_id"))).filter(F.col("r") <= supports)
    ids = kept.groupBy("scope", "topic").agg(F.array_join(F.array_sort(F.collect_list("fact_id")), ",").alias("supports"))
    return summary.join(ids, ["scope", "topic"], "left").withColumn("supports", F.coalesce("supports", F.lit("")))
