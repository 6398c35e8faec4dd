"""Evidence packs: the facts of a recall with the beliefs and events behind them, within limits, and what is said of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import fact_text

#: How citations are given (fixed values).
MODES = ("inline_with_markers", "block_at_end", "structured_only", "none")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def layers(pack: DataFrame, beliefs: DataFrame, events: DataFrame, facts: int | None = None, most_beliefs: int = 10, most_events: int = 5, max_tokens: int | None = None, exclude_content: bool = False) -> DataFrame:
    """``layer``, ``rank``, ``id``, ``body`` (JSON) and ``tokens`` (a quarter of its characters, at least 1) of a pack.

    ``pack``: the ranked facts of ``recall``, of which the first ``facts`` stay. ``beliefs`` (of ``revise``) about their
    subjects and ``events`` that they rest on follow in the order of the first fact that leads to them, at most
    ``most_beliefs`` and ``most_events``; these limits are the feature. With ``max_tokens`` events are dropped from the
    end, then facts, but never the first fact nor a belief. ``exclude_content`` empties the events and drops supports.
    A pack has at most as many rows as the reranker leaves, so its windows over all rows are small.
    """
    kept = pack if facts is None else pack.filter(F.col("rank") <= facts)
    about = kept.groupBy(F.col("subject_id").alias("about_entity_id")).agg(F.min("rank").alias("of"))
    held = beliefs.join(F.broadcast(about), "about_entity_id").withColumn("rank", F.row_number().over(Window.orderBy("of", "about_entity_id", "scope"))).filter(F.col("rank") <= most_beliefs)
    links = kept.select("rank", F.explode("supports").alias("event_id")).groupBy("event_id").agg(F.min("rank").alias("of"))
    behind = events.join(F.broadcast(links), "event_id").withColumn("rank", F.row_number().over(Window.orderBy("of", "event_id"))).filter(F.col("rank") <= most_events)
    content = F.lit("{}") if exclude_content else F.col("content")
    fact_fields = {"subject": F.col("subject_name"), "predicate": F.col("predicate"), "object": F.col("object_text"), "confidence": F.col("confidence"), "polarity": F.col("polarity"), "assertion_status": F.col("assertion_status")}
    if not exclude_content:
        fact_fields["supports"] = F.array_join("supports", ",")
    every = (
        held.select(F.lit(0).alias("of_layer"), F.lit("beliefs").alias("layer"), "rank", F.concat_ws("|", "scope", "about_entity_id").alias("id"), _json(stance=F.col("stance"), claim=F.col("claim"), confidence=F.col("confidence")).alias("body"))
        .unionByName(kept.select(F.lit(1).alias("of_layer"), F.lit("facts").alias("layer"), "rank", F.col("fact_id").alias("id"), _json(**fact_fields).alias("body")))
        .unionByName(behind.select(F.lit(2).alias("of_layer"), F.lit("events").alias("layer"), "rank", F.col("event_id").alias("id"), _json(modality=F.col("modality"), actor=F.col("observed_actor"), content=content).alias("body")))
    )
    out = every.withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("body") / 4)).cast("int"))
    if max_tokens is not None:
        used = F.sum("tokens").over(Window.orderBy("of_layer", "rank").rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("used", used).filter((F.col("used") <= max_tokens) | (F.col("of_layer") == 0) | ((F.col("of_layer") == 1) & (F.col("rank") == 1))).drop("used")
    return out.drop("of_layer")


def numbered(pack: DataFrame, most: int, between: str = "; ") -> DataFrame:
    """One row: the first facts of a pack as ``text`` with their numbers, and the ``citations`` of all facts of it."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), fact_text())
    told = F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", line.alias("t"))))
    cited = F.collect_list(F.struct("rank", "fact_id"))
    return pack.agg(
        F.array_join(F.transform(F.array_sort(told), lambda x: x["t"]), between).alias("text"),
        F.array_join(F.transform(F.array_sort(cited), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("]="), x["fact_id"])), ",").alias("citations"),
    )


def context_block(pack: DataFrame, mode: str = MODES[0], most: int = 6) -> DataFrame:
    """One row: ``context_block`` and ``citations`` in one of the ``MODES``: none gives neither, structured_only no text."""
    if mode not in MODES:
        raise ValueError(f"unknown citation mode {mode!r}")
    text = F.lit("") if mode in ("none", "structured_only") else F.col("text")
    return numbered(pack, most).select(text.alias("context_block"), (F.lit("") if mode == "none" else F.col("citations")).alias("citations"))


def short_answer(pack: DataFrame, most: int = 4) -> DataFrame:
    """One row: ``answer``, the first facts in a sentence, the deterministic stand-in for a model; and ``citations``."""
    said = numbered(pack, most)
    return said.select(F.when(F.col("text") == "", "Nothing is remembered.").otherwise(F.concat(F.lit("From memory: "), "text", F.lit("."))).alias("answer"), "citations")


def stream(pack: DataFrame, rows: DataFrame, block: DataFrame) -> DataFrame:
    """A pack as an ordered stream of events: ``seq``, ``event``, ``data``: plan, a row per item of its ``layers``, the
    context block with the citations, done with the number of items."""
    order = F.row_number().over(Window.orderBy(F.expr("CASE layer WHEN 'facts' THEN 0 WHEN 'beliefs' THEN 1 ELSE 2 END"), "rank"))
    items = rows.select((order + 1).alias("seq"), F.regexp_replace("layer", "s$", "").alias("event"), F.col("id").alias("data"))
    n = rows.agg(F.count(F.lit(1)).cast("int").alias("n"))
    first = n.select(F.lit(1).alias("seq"), F.lit("plan").alias("event"), F.lit("").alias("data"))
    said = n.crossJoin(block).select((F.col("n") + 2).alias("seq"), F.lit("context").alias("event"), F.concat_ws(" | ", "context_block", "citations").alias("data"))  # one row each
    last = n.select((F.col("n") + 3).alias("seq"), F.lit("done").alias("event"), F.col("n").cast("string").alias("data"))
    return first.unionByName(items).unionByName(said).unionByName(last)
