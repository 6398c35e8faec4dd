"""Extraction end to end and forgetting, on small worlds."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.functions.temporal import seen
from chronoweave.operators import extraction, governance

T0 = datetime(2026, 1, 1)
EVENT = "event_id string, scope string, content string, observed_at timestamp, recorded_at timestamp, excluded_from_recall boolean, subject string"
STORE = "fact_id string, scope string, subject_id string, predicate string, object_type string, object_entity_id string, object_value string, valid_from timestamp, valid_to timestamp, recorded_from timestamp, recorded_to timestamp, confidence double, polarity string, assertion_status string, supports array<string>"


def triple(i, subject, predicate, value, at=T0):
    content = json.dumps({"kind": "triple", "triple": {"subject": subject, "predicate": predicate, "object": value}})
    return (f"ev{i}", "s", content, at, T0 + timedelta(days=9), False, "clash")


@pytest.fixture(scope="module")
def world(spark):
    entities = spark.createDataFrame([("e1", "s", "Pump 7", None), ("e2", "s", "Acme", None), ("e3", "s", "acme ", None), ("e4", "s", "Gone", "e1"), ("e5", "t", "Pump 7", None)], "entity_id string, scope string, canonical_name string, merged_into string")
    aliases = spark.createDataFrame([("e1", "P7"), ("e1", "P7"), ("none", "x")], "entity_id string, alias string")
    vocabulary = spark.createDataFrame([("has_status", "closed", "idle", ["waiting"]), ("has_status", "closed", "alarm", None), ("colour", "open", "red", [])], "name string, kind string, canonical_value string, aliases array<string>")
    return entities, aliases, vocabulary


def test_extraction_links_coerces_and_quarantines(spark, world):
    rows = [
        triple(1, "p7", "has_status", "waiting"),
        triple(2, "Pump 7", "has_status", "broken"),
        triple(3, "Acme", "colour", "blue"),
        triple(4, " Pump 7", "part_of", "P7"),
        triple(5, None, "part_of", "x"),
        triple(6, " ", "part_of", "x"),
        triple(7, "Pump 7", "part_of", "x", None),
        ("ev8", "s", None, T0, T0, False, None),
        ("ev9", "s", '{"kind": "text", "text": "Jane Doe works at Beta; nothing here. Bob uses P7 and sleeps"}', T0, T0, None, None),
    ]
    got = extraction.extract(spark.createDataFrame(rows, EVENT), *world)
    facts = {(r.supports[0], r.subject_id, r.predicate, r.object_entity_id, r.object_value) for r in got.facts.collect()}
    known = {f for f in facts if f[1] == "e1"}
    assert known == {("ev1", "e1", "has_status", None, '{"value":"idle"}'), ("ev4", "e1", "part_of", "e1", None), ("ev7", "e1", "part_of", None, '{"value":"x"}')}
    assert {(f[0], f[2], f[3]) for f in facts - known} == {("ev3", "colour", None), ("ev9", "works_at", None), ("ev9", "uses", "e1")}  # two go by Acme: a new one
    assert {(r.event_id, r.value) for r in got.quarantine.collect()} == {("ev2", "broken")}
    assert {r.canonical_name for r in got.entities.collect()} == {"Acme", "Jane Doe", "Bob"}
    again = extraction.extract(spark.createDataFrame(rows + rows[:1], EVENT), *world)
    assert {r.fact_id for r in again.facts.collect()} == {r.fact_id for r in got.facts.collect()}
    nothing = extraction.extract(spark.createDataFrame([], EVENT), *world)
    assert nothing.facts.count() == nothing.quarantine.count() == nothing.entities.count() == 0


def test_new_facts_end_old_ones_and_change_beliefs(spark, world):
    old = [("f1", "s", "e1", "has_status", "literal", None, '{"value": "alarm"}', T0 - timedelta(days=3), None, T0, None, 0.9, "positive", "observed", ["x"]), ("f2", "s", "e1", "owns", "literal", None, '{"value": "a"}', T0, None, T0, None, 0.9, "positive", "observed", None), ("f3", "s", "e2", "owns", "literal", None, None, None, None, T0, None, 0.9, "negative", "observed", [])]
    store, single = spark.createDataFrame(old, STORE), F.col("predicate") == "has_status"
    new = extraction.extract(spark.createDataFrame([triple(1, "Pump 7", "has_status", "idle")], EVENT), *world, None).facts
    after = {r.fact_id: r.valid_to for r in extraction.merged(store, new, single).collect()}
    assert len(after) == 4 and after["f1"] == T0 and sum(v is None for v in after.values()) == 3
    revised = extraction.revised(store, new, world[0], single).collect()
    assert [(r.about_entity_id, r.stance, r.claim.split(" has ")[1][:12]) for r in revised] == [("e1", "likely_true", "2 supporting")]


def test_forgetting_redacts_what_lies_behind_closed_facts(spark):
    fact = lambda i, scope, predicate, closed, supports: (f"f{i}", scope, "e1", predicate, "literal", None, None, T0, None, T0, T0 if closed else None, 0.9, "positive", "observed", supports)
    store = spark.createDataFrame([fact(1, "s", "a", False, ["v1"]), fact(2, "s", "b", True, ["v2", "v2"]), fact(3, "s", "b", False, ["v3"]), fact(4, "t", "a", False, ["v4"]), fact(5, "s", "a", False, None)], STORE)
    events = spark.createDataFrame([(f"v{i}", "t" if i == 4 else "s", "x", None) for i in range(1, 6)], "event_id string, scope string, content string, excluded_from_recall boolean")
    beliefs = spark.createDataFrame([("s", "e1", None), ("t", "e1", None)], "scope string, about_entity_id string, recorded_to timestamp")
    after, held, log = governance.forget_scope(store, beliefs, events, "s", "2026-06-01", predicate="a", redact=True)
    assert {r.fact_id for r in after.filter("recorded_to IS NULL").collect()} == {"f3", "f4"} and held.filter("recorded_to IS NULL").count() == 2
    assert {r.event_id for r in log.filter("content = '{}' AND excluded_from_recall").collect()} == {"v1", "v2"} and log.count() == 5
    _, held, log = governance.forget_scope(store, beliefs, events, "s", "2026-06-01", about="e1")
    assert [r.scope for r in held.filter("recorded_to IS NULL").collect()] == ["t"] and log.filter("content = '{}'").count() == 0
    with pytest.raises(ValueError):
        governance.forget_scope(store, beliefs, events, "s", "2026-06-01")
    assert governance.forget_scope(store, beliefs, events, "s", "2026-06-01", confirm_all=True)[0].filter("scope = 's' AND recorded_to IS NULL").count() == 0


def test_what_a_recall_sees(spark):
    at = lambda d: T0 + timedelta(days=d) if d is not None else None
    rows = [("now", 0, None, 0, None), ("ended", 0, 5, 0, None), ("withdrawn", 0, None, 0, 3), ("late", 0, None, 8, None), ("null", None, None, 0, None)]
    df = spark.createDataFrame([(i, *map(at, r)) for i, *r in rows], "id string, valid_from timestamp, valid_to timestamp, recorded_from timestamp, recorded_to timestamp")
    found = lambda **k: {r.id for r in df.filter(seen(**k)).collect()}
    assert found() == {"now", "late", "null"} and found(as_of_time=at(2)) == {"now", "ended", "late"}
    assert found(as_of_time=at(2), include_superseded=True) == {"now", "ended", "withdrawn"}
    assert found(include_superseded=True) == {"now", "withdrawn", "late", "null"}
    assert found(valid_during=(at(4), at(6))) == {"now", "ended", "late"} and found(recorded_during=(at(1), at(2)), include_superseded=True) == {"now", "ended", "withdrawn", "null"}


def test_identity_tokens_know_width_variants(spark):
    rows = [("Ｓｅｎｓｏｒ－１２ ５ µm", "sensor-12 5 μm"), ("Pump 3", "pump 4"), ("Ofen 25 ℃", "ofen 25 °c"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(text.may_be_same("a", "b", F.lit("sensor"))).collect()] == [True, True, True, None]


def test_mentioned_names(spark):
    df = spark.createDataFrame([("1", "Acme owns Beta"), ("2", "seen near Gamma Works and Al, then Delta"), ("3", None), ("4", "")], "event_id string, text string")
    got = text.mentioned(df, text.extract_triples(df))
    assert {tuple(r) for r in got.collect()} == {("1", "Acme"), ("1", "Beta"), ("2", "Gamma Works"), ("2", "Delta")}
