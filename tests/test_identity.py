"""Mentions, small tables and the lifecycle stream."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronoweave.operators import identity, tables

T0 = datetime(2026, 1, 1)
MENTION = "scope string, name string, entity_type string, context string, embedding array<float>, ordinal long"
ENTITY = "entity_id string, scope string, canonical_name string, entity_type string, context_key string, embedding array<float>, merged_into string"


def resolved(spark, mentions, entities=(), aliases=()):
    df = identity.resolve(spark.createDataFrame(mentions, MENTION), spark.createDataFrame(list(entities), ENTITY), spark.createDataFrame(list(aliases), "entity_id string, alias string"))
    return {(r.name, r.context_key): (r.branch, r.entity_id) for r in df.collect()}


def test_same_name_in_another_fab_is_another_entity(spark):
    mentions = [("s", "PM1", "equipment", '{"fab": "A"}', [1.0, 0.0], 1), ("s", "PM1", "equipment", '{"fab": "B"}', [1.0, 0.0], 2), ("s", " pm1 ", "equipment", '{"fab": "A"}', None, 3)]
    got = resolved(spark, mentions)
    assert {b for b, _ in got.values()} == {"new"} and len({e for _, e in got.values()}) == 2


def test_exact_names_and_contexts(spark):
    entities = [
        ("e1", "s", "PM1", "equipment", '{"fab":"a"}', None, None),
        ("e2", "s", "PM2", "equipment", "{}", None, None),
        ("e3", "s", "Ann", "person", "{}", None, None),
        ("e4", "s", "Bob", "person", "{}", None, None),
        ("e5", "s", "bob ", "person", "{}", [1.0, 0.0], None),
        ("e6", "s", "PM3", "equipment", '{"fab":"a"}', None, "e1"),
    ]
    mentions = [
        ("s", "pm1", "equipment", '{"fab": "A"}', None, 1),
        ("s", "pm1", "equipment", '{"fab": "B"}', None, 2),
        ("s", "pm2", "equipment", '{"fab": "B"}', None, 3),
        ("s", "Annie", "person", None, None, 4),
        ("s", "Bob", "person", None, [1.0, 0.0], 5),
        ("s", "PM3", "equipment", '{"fab": "A"}', None, 6),
        ("t", "Ann", "person", None, None, 7),
    ]
    got = {k[0]: v for k, v in resolved(spark, [m for m in mentions if m[5] != 2], entities, [("e3", "annie")]).items()}
    assert got["pm1"] == ("exact", "e1") and got["pm2"] == ("adopted", "e2") and got["Annie"] == ("exact", "e3")
    assert got["Bob"][0] == got["PM3"][0] == got["Ann"][0] == "new"  # two exact rows; merged away; another scope
    assert resolved(spark, [mentions[1]], entities)[("pm1", '{"fab":"b"}')][0] == "new"


def test_near_vectors(spark):
    entities = [("e1", "s", "pump", "part", "{}", [1.0, 0.0], None), ("e2", "s", "sensor P-02", "sensor", "{}", [1.0, 0.0], None), ("e3", "s", "bad", "part", "{}", [0.0, 0.0], None)]
    ask = lambda name, vec, kind="part": list(resolved(spark, [("s", name, kind, None, vec, 1)], entities).values())[0]
    assert ask("pompe", [1.0, 0.1]) == ("reuse", "e1")
    assert ask("valve", [1.0, 1.0])[0] == "ask" and ask("seal", [0.1, 1.0])[0] == "new"
    assert ask("sensor T-02", [1.0, 0.0], "sensor")[0] == "new"
    assert ask("none", None)[0] == "new"
    assert resolved(spark, [], entities) == {}


def test_small_tables(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "z")], "k string, v int, w string")
    changed = tables.upsert(rows, spark.createDataFrame([("b", 9), ("b", 7), ("c", 5), (None, 4)], "k string, v int"), ["k"])
    assert {tuple(r) for r in changed.collect()} == {("a", 1, "x"), ("b", 9, None), ("c", 5, None), (None, 4, None)}
    assert tables.remove(rows, rows.filter("k = 'a'"), ["k"]).count() == 2
    cases = spark.createDataFrame([("c1", "scoping", "open", "Leak at PM1", "pm1", None, None), ("c2", "nowhere", None, None, "pm2", "worn Seal", None), ("c3", None, "gone", "x", None, None, None)], "case_id string, phase string, status string, title string, equipment string, root_cause string, resolution string")
    good, bad = tables.checked_cases(cases)
    assert [r.case_id for r in good.collect()] == ["c1"] and {(r.case_id, r.reason) for r in bad.collect()} == {("c2", "unknown phase"), ("c3", "unknown status")}
    found = lambda **k: {r.case_id for r in tables.find_cases(cases, **k).collect()}
    assert found(text="SEAL") == {"c2"} and found(status="open") == {"c1"} and found(equipment="pm2", text="leak") == set() and len(found()) == 3
    cache = spark.createDataFrame([("p", T0, "old"), ("p", T0 + timedelta(seconds=30), "new"), ("q", T0 - timedelta(hours=1), "gone")], "key string, created_at timestamp, value string")
    assert [(r.key, r.value) for r in tables.unexpired(cache, T0 + timedelta(seconds=59)).collect()] == [("p", "new")]
    assert tables.unexpired(cache, T0 + timedelta(seconds=90)).count() == 0


def test_lifecycle_cursor(spark):
    rows = [(f"l{i}", f"e{i % 2}", "s" if i % 3 else "t", kind, T0 + timedelta(seconds=i // 2)) for i, kind in enumerate(["captured", "captured", "extracted", "indexed", "indexed", "failed"])]
    df = spark.createDataFrame(rows, "lifecycle_id string, event_id string, scope string, kind string, ts timestamp")
    seen, ts, last = [], "2000-01-01", ""
    while page := tables.lifecycle_after(df, ts, last, 2).collect():
        seen += [r.lifecycle_id for r in page]
        ts, last = page[-1].ts, page[-1].lifecycle_id
    assert seen == [f"l{i}" for i in range(6)]
    assert [r.lifecycle_id for r in tables.lifecycle_after(df, "2000-01-01", "", 9, "s", "indexed").collect()] == ["l4"]
    assert {(r.event_id, r.kind) for r in tables.latest_stage(df).collect()} == {("e0", "indexed"), ("e1", "failed")}
    assert tables.latest_stage(df.filter(F.lit(False))).count() == 0
