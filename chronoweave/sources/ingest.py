"""Ingesting event envelopes: idempotent appends, importers of foreign formats, scope provisioning and export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.scopes import parent, prefixes
from chronoweave.operators.ordered import MIN_HOT_ROWS, Ordered

ENVELOPE = "scope string, modality string, content string, context string, idempotency_key string, observed_at string"


def canonical_json(text: Column | str) -> Column:
    """JSON in one spelling: object keys sorted and no blanks, so that equal bodies are equal text. Invalid JSON is null."""
    return F.to_json(F.try_parse_json(text))


def body_hash(modality: Column | str = "modality", content: Column | str = "content", context: Column | str = "context") -> Column:
    """SHA-256 of what makes two deliveries the same: modality, content and context, whatever the spelling of the JSON."""
    parts = [F.coalesce(c, F.lit("null")) for c in (F.col(modality) if isinstance(modality, str) else modality, canonical_json(content), canonical_json(context))]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def admitted(envelopes: DataFrame, order: list[str], min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Each (scope, idempotency_key) once: ``status`` accepted for the first delivery in order, duplicate for later ones
    with the same body, conflict for those with another. Rows without a key or scope are all accepted.

    Of rows that are equal in ``order`` the smallest body comes first, of equal bodies any. The deliveries of a key are
    counted and compared with its first by :class:`Ordered`, so that bodies are read once and no hot key goes through one
    task.
    """
    keys = ["scope", "idempotency_key"]
    rows = envelopes.withColumn("body", body_hash())
    keyed = rows.filter(F.col("idempotency_key").isNotNull() & F.col("scope").isNotNull()).withColumn("__1", F.lit(1))
    met = Ordered(keyed, keys, [*order, "body"], min_rows).running_sum("__1", "__n").first(["body"], "__head").result()
    status = F.when(F.col("__n") == 1, "accepted").when(F.col("body") == F.col("__head.body"), "duplicate").otherwise("conflict")
    free = rows.filter(F.col("idempotency_key").isNull() | F.col("scope").isNull()).withColumn("status", F.lit("accepted"))
    return met.withColumn("status", status).drop("__head", "__1", "__n").unionByName(free)


def key_conflicts(envelopes: DataFrame) -> DataFrame:
    """Keys delivered with more than one body: ``scope``, ``idempotency_key``, ``n_bodies``. One aggregation, no window."""
    rows = envelopes.filter(F.col("idempotency_key").isNotNull()).select("scope", "idempotency_key", body_hash().alias("body"))
    return rows.groupBy("scope", "idempotency_key").agg(F.countDistinct("body").alias("n_bodies")).filter(F.col("n_bodies") > 1)


def scopes_of(*frames: DataFrame) -> DataFrame:
    """Every scope in the frames with all its ancestors: ``scope_path``, ``parent_path``."""
    every = None
    for frame in frames:
        rows = frame.select("scope").distinct()
        every = rows if every is None else every.unionByName(rows)
    paths = every.filter(F.col("scope").isNotNull()).distinct().select(F.explode(prefixes("scope")).alias("scope_path")).distinct()
    return paths.withColumn("parent_path", parent("scope_path"))


def missing_scopes(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """What of :func:`scopes_of` isn't provisioned yet."""
    return wanted.join(known.select("scope_path"), "scope_path", "left_anti")


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """A scope from a template: ``{field}`` is replaced by the record's value, an unknown or null field stays as it is."""
    parts = re.split(r"\{(\w+)\}", template)
    out = [F.lit(p) if i % 2 == 0 else F.coalesce(fields[p].cast("string"), F.lit("{" + p + "}")) if p in fields else F.lit("{" + p + "}") for i, p in enumerate(parts)]
    return F.concat(*out)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _key(prefix: str, *parts: Column) -> Column:
    """A reproducible key for records that bring none."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16))


def _scope(scope: str, template: str | None, fields: dict[str, Column]) -> Column:
    return F.lit(scope) if template is None else fill_template(template, fields)


def from_jsonl(lines: DataFrame, scope: str, template: str | None = None, fields: tuple[str, ...] = ("user",)) -> DataFrame:
    """Envelopes of JSON lines (column ``value``). Blank and invalid lines give none; a line without content is a text."""
    rows = lines.filter(F.trim("value") != "").filter(F.try_parse_json("value").isNotNull())
    at = lambda p: F.get_json_object("value", f"$.{p}")
    text = _json(kind=F.lit("text"), text=F.coalesce(at("text"), F.lit("")))
    return rows.select(
        _scope(scope, template, {f: at(f) for f in fields}).alias("scope"),
        F.coalesce(at("modality"), F.lit("conversation")).alias("modality"),
        F.coalesce(at("content"), text).alias("content"),
        F.coalesce(at("context"), F.lit("{}")).alias("context"),
        F.coalesce(at("idempotency_key"), _key("ik", F.col("value"))).alias("idempotency_key"),
        at("context.observed_at").alias("observed_at"),
    )


def from_mem0(memories: DataFrame, scope: str, template: str | None = None) -> DataFrame:
    """Envelopes of memories (memory, timestamp, labels, intent): messages of a user."""
    context = _json(observed_at=F.col("timestamp"), labels=F.coalesce("labels", F.array().cast("array<string>")), intent=F.col("intent"))
    content = _json(kind=F.lit("message"), role=F.lit("user"), text=F.coalesce("memory", F.lit("")))
    return memories.select(_scope(scope, template, {c: F.col(c) for c in memories.columns}).alias("scope"), F.lit("conversation").alias("modality"), content.alias("content"), context.alias("context"), F.coalesce("memory", _key("memory", F.col("timestamp"))).alias("idempotency_key"), F.col("timestamp").alias("observed_at"))


def from_letta(blocks: DataFrame, scope: str, template: str | None = None) -> DataFrame:
    """Envelopes of memory blocks (text, label): documents with the label as intent."""
    content = _json(kind=F.lit("text"), text=F.coalesce("text", F.lit("")))
    return blocks.select(_scope(scope, template, {c: F.col(c) for c in blocks.columns}).alias("scope"), F.lit("document").alias("modality"), content.alias("content"), _json(intent=F.col("label")).alias("context"), F.coalesce("label", _key("label", F.col("text"))).alias("idempotency_key"), F.lit(None).cast("string").alias("observed_at"))


def from_openai(memories: DataFrame, scope: str, template: str | None = None) -> DataFrame:
    """Envelopes of memories (id, content): observations, the id as key."""
    content = _json(kind=F.lit("text"), text=F.coalesce("content", F.lit("")))
    return memories.select(_scope(scope, template, {c: F.col(c) for c in memories.columns}).alias("scope"), F.lit("observation").alias("modality"), content.alias("content"), F.lit("{}").alias("context"), F.coalesce("id", _key("oai", F.col("content"))).alias("idempotency_key"), F.lit(None).cast("string").alias("observed_at"))


def from_zep(statements: DataFrame, scope: str, default_from: str = "2026-01-01 00:00:00") -> tuple[DataFrame, DataFrame]:
    """(facts, entities) of bi-temporal statements (subject, predicate, object, confidence, valid_from, valid_to): they
    keep their periods, supersede nothing and rest on no events. Ids are hashes of scope and name."""
    node = lambda c: F.sha2(F.concat_ws("|", F.lit(scope), F.lower(F.trim(c))), 256)
    facts = statements.filter(F.col("subject").isNotNull() & F.col("object").isNotNull() & F.col("predicate").isNotNull()).select(
        F.sha2(F.concat_ws("|", F.lit(scope), "subject", "predicate", "object", F.coalesce(F.col("valid_from").cast("string"), F.lit(""))), 256).alias("fact_id"),
        F.lit(scope).alias("scope"),
        node(F.col("subject")).alias("subject_id"),
        "predicate",
        F.lit("entity").alias("object_type"),
        node(F.col("object")).alias("object_entity_id"),
        F.coalesce(F.col("valid_from").cast("timestamp"), F.lit(default_from).cast("timestamp")).alias("valid_from"),
        F.col("valid_to").cast("timestamp").alias("valid_to"),
        F.coalesce("confidence", F.lit(0.8)).alias("confidence"),
        F.array().cast("array<string>").alias("supports"),
    )
    names = statements.select(F.col("subject").alias("name")).unionByName(statements.select(F.col("object").alias("name"))).filter(F.col("name").isNotNull())
    entities = names.groupBy(node(F.col("name")).alias("entity_id")).agg(F.min("name").alias("canonical_name")).withColumn("scope", F.lit(scope))
    return facts, entities


def triples(events: DataFrame) -> DataFrame:
    """Statements that events of kind ``triple`` carry: ``event_id``, subject, predicate, object, ``confidence`` (.9)."""
    at = lambda p: F.get_json_object("content", f"$.triple.{p}")
    rows = events.filter(F.get_json_object("content", "$.kind") == "triple")
    out = rows.select("event_id", at("subject").alias("subject"), at("predicate").alias("predicate"), at("object").alias("object"), F.coalesce(at("confidence").cast("double"), F.lit(0.9)).alias("confidence"))
    return out.filter(F.col("subject").isNotNull() & F.col("predicate").isNotNull())


def progress(statuses: DataFrame, key: str = "scope") -> DataFrame:
    """Counters of an import per key: ``total``, ``accepted``, ``failed``."""
    ok = F.col("status") == "accepted"
    return statuses.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("accepted"), F.count_if(F.col("status") == "conflict").alias("failed"))


def chunk_envelopes(chunks: DataFrame, scope: str, key: str = "doc_id") -> DataFrame:
    """Envelopes of document chunks: the text under its path as a heading, path and depth as context."""
    body = F.when(F.col("path") != "", F.concat(F.lit("# "), "path", F.lit("\n"), "chunk")).otherwise(F.col("chunk"))
    return chunks.select(
        F.lit(scope).alias("scope"),
        F.lit("document").alias("modality"),
        _json(kind=F.lit("text"), text=body).alias("content"),
        _json(chunk_path=F.col("path"), depth=F.col("depth")).alias("context"),
        F.concat_ws("-", F.lit("chunk"), F.col(key).cast("string"), F.col("chunk_no").cast("string")).alias("idempotency_key"),
        F.lit(None).cast("string").alias("observed_at"),
    )


def export_lines(events: DataFrame, facts: DataFrame, beliefs: DataFrame | None = None) -> DataFrame:
    """``kind``, ``ordinal_us``, ``id``, ``line``: live events, believed facts and the beliefs (of ``revise``) as JSON lines,
    for ``write.text``."""
    live = events.filter(~F.coalesce("excluded_from_recall", F.lit(False)))
    a = live.select(F.lit("event").alias("kind"), F.unix_micros("observed_at").alias("ordinal_us"), F.col("event_id").alias("id"), _json(type=F.lit("event"), event_id=F.col("event_id"), scope=F.col("scope"), modality=F.col("modality"), content=F.col("content")).alias("line"))
    held = facts.filter(F.col("recorded_to").isNull())
    b = held.select(F.lit("fact").alias("kind"), F.unix_micros("valid_from").alias("ordinal_us"), F.col("fact_id").alias("id"), _json(type=F.lit("fact"), fact_id=F.col("fact_id"), scope=F.col("scope"), subject_id=F.col("subject_id"), predicate=F.col("predicate"), confidence=F.col("confidence")).alias("line"))
    if beliefs is None:
        return a.unionByName(b)
    c = beliefs.select(F.lit("belief").alias("kind"), F.col("valid_from_us").alias("ordinal_us"), F.concat_ws("|", "scope", "about_entity_id").alias("id"), _json(type=F.lit("belief"), scope=F.col("scope"), about=F.col("about_entity_id"), stance=F.col("stance"), claim=F.col("claim"), confidence=F.col("confidence"), valid_from=F.timestamp_micros("valid_from_us")).alias("line"))
    return a.unionByName(b).unionByName(c)
