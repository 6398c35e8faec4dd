"""Ingestion, identity, graph, beliefs, episodes, retrieval and maintenance on small worlds."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import ontology, text
from chronoweave.functions.scopes import in_view, parent, prefix_list, prefixes
from chronoweave.functions.vectors import cosine
from chronoweave.operators import beliefs, episodes, facts, governance, graph, packs, retrieval
from chronoweave.sources import ingest
from chronoweave.streaming import pipelines

A, B = "org:acme/dept:sales/user:alice", "org:acme/dept:eng/user:bob"
T0 = datetime(2026, 1, 1)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def value(spark, column, **fields):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()], F.lit(0).alias("__")).select(column).first()[0]


def test_scopes(spark):
    assert prefix_list(A) == ["org:acme", "org:acme/dept:sales", A]
    assert value(spark, prefixes("s"), s=A) == prefix_list(A)
    assert value(spark, parent("s"), s=A) == "org:acme/dept:sales" and value(spark, parent("s"), s="org:acme") is None
    df = spark.createDataFrame([(A,), (B,), ("org:acme",), ("org:acme2",), (None,)], "scope string")
    seen = lambda s, v: {r.scope for r in df.filter(in_view("scope", s, v)).collect()}
    assert seen(A, "holistic") == {A, "org:acme"} and seen("org:acme", "descend") == {A, B, "org:acme"} and seen(A, "other") == {A}


def test_identity_keys(spark):
    raw = json.dumps({"fab": " FAB 1 ", "tool": "ＰＭ１", "module": "  Etch   Module ", "recipe_rev": " R2 ", "recipe": " "}, ensure_ascii=False)
    assert json.loads(value(spark, text.context_key("c"), c=raw)) == {"equipment": "pm1", "fab": "fab 1", "module": "etch module", "recipe_revision": "r2"}
    assert value(spark, text.context_key("c", "t"), c=raw, t="Tool") == '{"equipment":"pm1","fab":"fab 1"}'
    assert value(spark, text.context_key("c", "t"), c=raw, t="alarm") == "{}" and value(spark, text.context_key("c"), c="{bad") == "{}"
    names = ["P-02", "T-02", "MFC-1", "VALVE-1"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    assert rows_of(df.filter(text.may_be_same("a", "b", F.lit("sensor")))) == {(n, n) for n in names}
    assert value(spark, text.identity_tokens("n"), n="heater 40 kW on PM-3") == ["40 kw", "pm-3"]
    assert value(spark, text.canonical_text("n"), n=" Straße　ＸＹ ") == "strasse xy"


def test_text_functions(spark):
    assert value(spark, text.words("t"), t="Pump-3 läuft, OK") == ["pump", "3", "läuft", "ok"] and value(spark, text.words("t"), t="") == []
    assert value(spark, text.has_all_words("t", F.lit("ok pump")), t="Pump-3 OK") and not value(spark, text.has_all_words("t", F.lit("")), t="x")
    assert value(spark, F.array_sort(text.trigrams("t")), t="cat") == ["  c", " ca", "at ", "cat"]
    assert abs(value(spark, text.trigram_similarity("a", "b"), a="word", b="two words") - 4 / 11) < 1e-9
    assert value(spark, text.trigram_similarity("a", "b"), a="", b="") == 0
    assert value(spark, text.query_names("q"), q="what did Priya Rao say of Acme") == ["Priya Rao", "Acme"]
    assert value(spark, text.query_names("q"), q="which of them said more than that there") == ["which", "them", "said", "more", "than"]
    assert value(spark, text.without_thoughts("t"), t="<think>a\nb</think> yes <think>open") == "yes"
    assert text.first_json_object('say ```json\n{"a": {"b": 1}}\n``` ok') == {"a": {"b": 1}} and text.first_json_object("none {") is None and text.first_json_object(None) is None
    assert value(spark, text.token_estimate("t"), t="") == 1 and value(spark, text.token_estimate("t"), t="x" * 10) == 3


def test_chunks():
    doc = "intro\n\n# Motor\nbody\n## Axis\nturns\n# Pump\n" + "It runs. " * 400
    found = text.chunks_of(doc)
    assert [(h, p, d) for h, p, d, _ in found[:3]] == [("", "", 0), ("Motor", "Motor", 1), ("Axis", "Motor/Axis", 2)]
    assert all(len(c[3]) <= 2000 for c in found) and {c[0] for c in found[3:]} == {"Pump"} and len(found) > 4
    assert [c[3] for c in text.chunks_of("short\n\nalso short\n\n" + "x" * 300)] == ["short\nalso short\n" + "x" * 300]
    assert text.chunks_of(" \n ") == [] and len(text.chunks_of("y" * 5000)) == 1


def test_extracted_triples(spark):
    df = spark.createDataFrame([("e1", "Priya works at Acme. Acme acquired Globex and Bob Lee owns Q3 Renewal because he can"), ("e2", "nothing here"), ("e3", None), ("e4", "")], "event_id string, text string")
    got = rows_of(text.extract_triples(df).select("event_id", "subject", "predicate", "object"))
    assert got == {("e1", "Priya", "works_at", "Acme"), ("e1", "Acme", "acquired", "Globex"), ("e1", "Bob Lee", "owns", "Q3 Renewal")}


def test_cosine(spark):
    for other, want in (((1.0, 0.0, 0.0), 0.9948), ((1.0, 1.0, 0.0), 0.7737), ((0.0, 1.0, 0.0), 0.0995)):
        df = spark.createDataFrame([([1.0, 0.1, 0.02], list(other))], "a array<double>, b array<double>")
        assert abs(df.select(cosine("a", "b")).first()[0] - want) < 2e-4  # the goldens are stated as approximate
    df = spark.createDataFrame([([1.0], [0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert all(r[0] is None for r in df.select(cosine("a", "b")).collect())


def test_ontology():
    names = [p for p, _ in ontology.vocabulary()]
    assert len(names) == 42 == len(set(names)) and dict(ontology.vocabulary())["has_status"] == "single"


def test_assertion_semantics(spark):
    cases = [
        ("ruled_out", "positive", False, "confirmed", None, True, ("negative", "ruled_out")),
        ("contradicts", "positive", False, None, None, False, ("positive", "observed")),
        ("caused_by", "positive", False, None, None, False, ("positive", "hypothesized")),
        ("caused_by", "positive", False, "confirmed", "seen", True, ("positive", "confirmed")),
        ("caused_by", "positive", False, "confirmed", "it leaks", False, ("positive", "confirmed")),
        ("caused_by", "positive", False, "confirmed", "not there", False, ("positive", "hypothesized")),
        ("caused_by", "positive", False, "confirmed", " ", True, ("positive", "hypothesized")),
        ("caused_by", "positive", True, "confirmed", "seen", True, ("negative", "ruled_out")),
        ("caused_by", None, None, "rejected", None, None, ("positive", "ruled_out")),
        ("part_of", "negative", False, None, None, False, ("negative", "observed")),
        ("part_of", None, None, "requested", None, None, ("positive", "requested")),
    ]
    df = spark.createDataFrame([c[:6] for c in cases], "predicate string, polarity string, negation boolean, assertion_status string, evidence_span string, trusted boolean").withColumn("source_text", F.lit("we saw that it leaks"))
    assert [tuple(r) for r in df.select(*ontology.assertion()).collect()] == [c[6] for c in cases]


def test_idempotent_ingest(spark):
    rows = [("k1", 1, '{"a": 1, "b": 2}'), ("k1", 2, '{"b":2,"a":1}'), ("k1", 3, '{"a": 9}'), ("k2", 4, "{}"), (None, 5, "{}"), (None, 6, "{}"), ("k3", 7, "{bad"), ("k3", 8, None)]
    df = spark.createDataFrame([("s", "m", c, "{}", k, n, "x") for k, n, c in rows], "scope string, modality string, content string, context string, idempotency_key string, wal_offset long, body string")
    got = {r.wal_offset: r.status for r in ingest.admitted(df, ["wal_offset"]).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "accepted", 5: "accepted", 6: "accepted", 7: "accepted", 8: "duplicate"}
    cut = ingest.admitted(df.unionAll(df.filter("wal_offset = 4")), ["wal_offset"], min_rows=1)
    assert sorted((r.wal_offset, r.status) for r in cut.collect()) == sorted([*got.items(), (4, "duplicate")])
    assert rows_of(ingest.key_conflicts(df)) == {("s", "k1", 2)}
    assert rows_of(ingest.progress(ingest.admitted(df, ["wal_offset"]))) == {("s", 8, 5, 1)}
    assert ingest.admitted(df.limit(0), ["wal_offset"]).count() == 0


def test_importers(spark):
    lines = spark.createDataFrame([('{"user": "alice", "text": "hi"}',), ("  ",), ('{"user": "bob", "content": {"kind": "text", "text": "yo"}, "idempotency_key": "k"}',), ("{broken",)], "value string")
    got = ingest.from_jsonl(lines, "s", "org:acme/user:{user}").collect()
    assert {(r.scope, json.loads(r.content)["text"]) for r in got} == {("org:acme/user:alice", "hi"), ("org:acme/user:bob", "yo")}
    assert {r.idempotency_key for r in ingest.from_jsonl(lines, "s").collect()} == {r.idempotency_key for r in got}
    zep = spark.createDataFrame([("Priya", "works_at", "Acme", None, None, 0.7), ("Priya", None, "Acme", None, None, 0.7), ("PRIYA", "owns", "Q3", "2026-02-01", "2026-03-01", None)], "subject string, predicate string, object string, valid_from string, valid_to string, confidence double")
    stated, things = ingest.from_zep(zep, "s")
    assert stated.count() == 2 and stated.select("subject_id").distinct().count() == 1 and things.count() == 3
    assert {r.confidence for r in stated.collect()} == {0.7, 0.8}
    df = spark.createDataFrame([("a", None)], "id string, b string")
    assert df.select(ingest.fill_template("x:{id}/{b}/{c}", {"id": F.col("id"), "b": F.col("b")})).first()[0] == "x:a/{b}/{c}"
    wanted = ingest.scopes_of(spark.createDataFrame([(A,), (None,), (B,)], "scope string"))
    assert wanted.count() == 5
    assert {r.scope_path for r in ingest.missing_scopes(wanted, wanted.filter("scope_path LIKE '%sales%'")).collect()} == {"org:acme", "org:acme/dept:eng", B}


EDGE = "fact_id string, src string, predicate string, dst string"


def test_graph_walks(spark):
    ring = spark.createDataFrame([("AB", "A", "p", "B"), ("BC", "B", "p", "C"), ("CA", "C", "p", "A"), ("BX", "B", "q", "X")], EDGE)
    seed = spark.createDataFrame([("A",)], "seed string")
    walk = lambda h: {r.fact_id: r.hop for r in graph.paths(ring, seed, h).collect()}
    assert walk(1) == {"AB": 1} and walk(2) == {"AB": 1, "BC": 2, "BX": 2} and walk(3) == walk(2)
    assert rows_of(graph.reachable(ring, seed, 3)) == {("A", "B", 1), ("A", "C", 2), ("A", "X", 2)}
    assert graph.reachable(ring, seed.limit(0), 2).count() == 0
    assert graph.incident(ring).filter("node = 'B'").count() == 3
    things = spark.createDataFrame([("A", None), ("B", "A"), ("C", None)], "entity_id string, merged_into string")
    assert rows_of(graph.ghosts(ring, things)) == {("B",), ("X",)}
    concepts = spark.createDataFrame([("1", "s", "a", [("b", "uses"), ("c", "co_occurs")]), ("2", "s", "b", [("a", "uses")]), ("3", "s", "c", [])], "concept_id string, scope string, name string, related array<struct<name: string, relation: string>>")
    assert rows_of(graph.related(concepts, "1")) == {("2", 1), ("3", 1)} and rows_of(graph.related(concepts, "1", "uses")) == {("2", 1)}


FACT = "fact_id string, scope string, subject_id string, predicate string, object_type string, object_entity_id string, object_value string, valid_from timestamp, valid_to timestamp, recorded_to timestamp, extracted_at timestamp, confidence double, polarity string, assertion_status string, supports array<string>"


def fact(i, subject="e", predicate="has_status", **other):
    row = dict(fact_id=str(i), scope="s", subject_id=subject, predicate=predicate, object_type="literal", object_entity_id=None, object_value='{"value": "x"}', valid_from=T0, valid_to=None, recorded_to=None, extracted_at=T0, confidence=0.9, polarity="positive", assertion_status="observed", supports=[f"ev{i}"])
    return tuple((row | other).values())


def belief(spark, rows):
    names = spark.createDataFrame([("e", "PM1"), ("h", "leak")], "entity_id string, canonical_name string")
    return {r.about_entity_id: (r.stance, r.confidence, r.claim) for r in beliefs.revise(spark.createDataFrame(rows, FACT), names).collect()}


def test_belief_goldens(spark):
    assert belief(spark, [fact(1), fact(2, polarity="negative")]) == {"e": ("uncertain", 0.1, "PM1 has 1 supporting, 1 opposing, and 0 hypothesized current assertions")}
    assert belief(spark, [fact(1), fact(2)])["e"][:2] == ("likely_true", 0.95)
    assert belief(spark, [fact(1, confidence=0.5), fact(2, confidence=0.7, supports=["ev1"])])["e"][:2] == ("likely_true", 0.6)
    assert belief(spark, [fact(1, assertion_status="hypothesized", predicate="caused_by")])["e"][0] == "uncertain"
    against = fact(3, "z", "contradicts", object_type="entity", object_entity_id="h", object_value=None)
    assert belief(spark, [against])["h"][0] == "likely_false"
    assert belief(spark, [fact(1, assertion_status="odd")]) == {} and belief(spark, []) == {}
    why = rows_of(beliefs.support_graph(spark.createDataFrame([fact(1), against], FACT)))
    assert ("h", "3", "supported_by") in why and ("1", "ev1", "extracted_from") in why and len(why) == 4


def test_conflicts_and_coercion(spark):
    rows = [fact(1), fact(2, object_value='{"value": "y"}'), fact(3, "q"), fact(4, "q")]
    assert rows_of(facts.conflicts(spark.createDataFrame(rows, FACT), ["subject_id", "predicate"])) == {("e", "has_status", 2, 2)}
    vocabulary = spark.createDataFrame([("deal", "closed", "signed", ["签约", "won"]), ("deal", "closed", "poc", ["pitch"]), ("kind", "open", "org", ["company"])], "name string, kind string, canonical_value string, aliases array<string>")
    df = spark.createDataFrame([("deal", v) for v in ("签约", "pitch", "won", "expired", None)] + [("kind", v) for v in ("feature", "company")] + [("free", "z")], "n string, v string")
    got = {(r.n, r.v): r.coerced for r in facts.coerce(df, vocabulary, "v", "n").collect()}
    assert got == {("deal", "签约"): "signed", ("deal", "pitch"): "poc", ("deal", "won"): "signed", ("deal", "expired"): None, ("deal", None): None, ("kind", "feature"): "feature", ("kind", "company"): "org", ("free", "z"): "z"}


def test_episodes(spark):
    at = lambda h, m: T0 + timedelta(hours=h, minutes=m)
    rows = [("ev1", None, at(10, 0), "ann", "{}"), ("ev2", None, at(10, 10), "bob", '{"preceded_by": ["ev1", "gone"]}'), ("ev3", None, at(12, 0), "ann", '{"preceded_by": ["ev1"]}'), ("c1", "case", at(1, 0), None, "{}"), ("c2", "case", at(23, 0), "eve", None), ("x", None, None, "z", "{}")]
    df = spark.createDataFrame([("s", *r, False) for r in rows], "scope string, event_id string, case_id string, observed_at timestamp, observed_actor string, context string, excluded_from_recall boolean")
    members, summary = episodes.episodes(df)
    assert {(r.case_id, r.n_events, r.actors) for r in summary.collect()} == {(None, 2, "ann,bob"), (None, 1, "ann"), ("case", 2, "eve")}
    assert rows_of(episodes.causal_chains(members).select("from_id", "to_id")) == {("ev1", "ev2")}
    fresh = episodes.episodes(df, taken=df.filter("event_id LIKE 'ev%'"))[0]
    assert {r.event_id for r in fresh.collect()} == {"c1", "c2"}
    supported = spark.createDataFrame([fact(1, supports=["c1", "c2"]), fact(2, supports=["ev1"]), fact(3, supports=["c1"])], FACT)
    assert {r.fact_id for r in episodes.case_facts(members, supported).collect()} == {"1", "3"}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "pump current high"), (2, "pump"), (3, None), (4, "valve")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in retrieval.bm25(docs, "doc_id", "text", "pump current").collect()}
    assert set(score) == {1, 2} and score[1] > score[2] > 0
    one = spark.createDataFrame([("f1", "a", 1), ("f2", "a", 2)], "fact_id string, channel string, rank int")
    two = spark.createDataFrame([("f2", "b", 1)], "fact_id string, channel string, rank int")
    fused = {r.fact_id: r.score for r in retrieval.fuse([one, two]).collect()}
    assert fused == {"f1": round(1 / 61, 9), "f2": round(1 / 62 + 1 / 61, 9)}
    named = spark.createDataFrame([("f1", "Acme", "deal_stage", "signed"), ("f2", "Bob", "owns", "car")], "fact_id string, subject_name string, predicate string, object_text string")
    scores = spark.createDataFrame([("f1", 0.1, 1), ("f2", 0.2, 1)], "fact_id string, score double, n_channels int")
    assert [r.fact_id for r in retrieval.rerank(named, scores, "acme signed").collect()] == ["f1"]
    assert [r.fact_id for r in retrieval.rerank(named, scores, "zebra").orderBy("rank").collect()] == ["f2", "f1"]
    block = packs.context_block(retrieval.rerank(named, scores, "zebra")).first()
    assert block.context_block == "[1] Bob owns car; [2] Acme deal_stage signed" and block.citations == "[1]=f2,[2]=f1"
    pack = retrieval.rerank(named, scores, "zebra").withColumn("supports", F.array(F.lit("ev1"), F.concat(F.lit("ev"), "fact_id"))).withColumn("confidence", F.lit(0.5)).withColumn("polarity", F.lit("positive")).withColumn("assertion_status", F.lit("observed")).withColumn("subject_id", F.concat(F.lit("e"), "fact_id"))
    believed = spark.createDataFrame([("s", "ef1", "likely_true", 0.9, "x"), ("s", "ef2", "likely_true", 0.9, "y"), ("s", "other", "uncertain", 0.1, "z")], "scope string, about_entity_id string, stance string, confidence double, claim string")
    log = spark.createDataFrame([("ev1", "note", "a", "c" * 400), ("evf2", "note", "a", "c" * 400)], "event_id string, modality string, observed_actor string, content string")
    layers = lambda **limits: {(r.layer, r["rank"], r.id) for r in packs.layers(pack, believed, log, **limits).collect()}
    both = {("facts", 1, "f2"), ("facts", 2, "f1"), ("beliefs", 1, "s|ef2"), ("beliefs", 2, "s|ef1"), ("events", 1, "ev1"), ("events", 2, "evf2")}
    assert layers() == both and layers(facts=1, most_beliefs=1, most_events=1) == {("facts", 1, "f2"), ("beliefs", 1, "s|ef2"), ("events", 1, "ev1")}
    assert layers(max_tokens=1) == {("facts", 1, "f2"), ("beliefs", 1, "s|ef2"), ("beliefs", 2, "s|ef1")}
    rows = packs.layers(pack, believed, log, exclude_content=True)
    assert all("ccc" not in r.body and "supports" not in r.body for r in rows.collect())
    assert [r.event for r in packs.stream(pack, rows, packs.context_block(pack)).orderBy("seq").collect()] == ["plan", "fact", "fact", "belief", "belief", "event", "event", "context", "done"]
    assert tuple(packs.context_block(pack, "none").first()) == ("", "") and packs.context_block(pack, "structured_only").first().citations == block.citations
    assert packs.short_answer(pack.limit(0)).first().answer == "Nothing is remembered."
    items = spark.createDataFrame([(1, 50), (2, 5), (3, 5), (4, 1)], "i int, n int")
    assert [r.i for r in retrieval.within_budget(items, ["i"], "n", 56).collect()] == [1, 2]
    assert [r.i for r in retrieval.within_budget(items, ["i"], "n", 10).collect()] == [1]
    synonyms = spark.createDataFrame([("signed", ["closed"])], "term string, aliases array<string>")
    assert [r.fact_id for r in retrieval.synonym_channel(named, synonyms, "signed").collect()] == ["f1"]
    assert retrieval.synonym_channel(named, synonyms, "car").count() == 0 and retrieval.synonym_channel(named, synonyms, "signed", mode="all").count() == 0


def test_governance(spark):
    events = spark.createDataFrame([("s", "ev1", "{}x", False, 0, T0, None), ("s", "ev9", "y", None, 3, T0, None), ("s", "ev8", "z", True, 0, None, None)], "scope string, event_id string, content string, excluded_from_recall boolean, access_count int, observed_at timestamp, methylated_at timestamp")
    rows = spark.createDataFrame([fact(1), fact(2, supports=["ev1", "ev1", "ev7"]), fact(3, supports=None)], FACT)
    assert {r.event_id: r.refcount for r in governance.reference_counts(events, rows).collect()} == {"ev1": 2, "ev9": 0, "ev8": 0}
    manifest = governance.erasure_manifest(events, rows, spark.createDataFrame([("ev1",), ("ev9",), ("none",)], "event_id string"))
    assert {(r.event_id, r.action) for r in manifest.collect()} == {("ev1", "redact"), ("ev9", "delete")}
    kept, cleaned = governance.erase(events, rows, manifest)
    assert {(r.event_id, r.content, r.excluded_from_recall) for r in kept.collect()} == {("ev1", "{}", True), ("ev8", "z", True)}
    assert {r.fact_id: r.supports for r in cleaned.collect()} == {"1": [], "2": ["ev7"], "3": None}
    assert {r.event_id for r in governance.methylate(events, "2026-06-01").filter("methylated_at IS NOT NULL").collect()} == {"ev1"}
    after = governance.forget(rows, F.col("fact_id") == "1", "2026-06-01")
    assert {r.fact_id for r in after.filter("recorded_to IS NULL").collect()} == {"2", "3"}
    doubles = spark.createDataFrame([fact(1), fact(2, valid_from=T0 + timedelta(1)), fact(3, object_value='{"value": "y"}'), fact(4, recorded_to=T0)], FACT)
    assert rows_of(governance.consolidate(doubles, "2026-06-01")) == {("1",)}


def test_queue(spark):
    now = datetime(2026, 6, 1)
    rows = [("a", "queued", 10, 0, 3, now, None), ("b", "queued", 99, 0, 3, now, None), ("c", "queued", 500, 0, 3, now + timedelta(hours=1), None), ("d", "running", 0, 1, 2, now, now - timedelta(minutes=6)), ("e", "running", 0, 2, 2, now, now)]
    jobs = spark.createDataFrame(rows, "job_id string, status string, priority int, attempts int, max_attempts int, run_after timestamp, locked_at timestamp").withColumn("created_at", F.col("run_after"))
    assert [r.job_id for r in governance.claimable(jobs, now, 5).collect()] == ["b", "a"]
    failed = {r.job_id: (r.status, r.run_after) for r in governance.after_failure(jobs, now).collect()}
    assert failed["d"] == ("queued", now + timedelta(seconds=2)) and failed["e"][0] == "failed" and failed["a"] == ("queued", now)
    assert {r.job_id for r in governance.reap(jobs, now).filter("status = 'running'").collect()} == {"e"}


def test_streams_equal_batch(spark, tmp_path):
    from chronoweave.operators.sessions import sessions

    rows = [("e1", "s", T0, T0, False), ("e2", "s", T0 + timedelta(minutes=30), T0, False), ("e3", "s", T0 + timedelta(minutes=61), T0, None), ("e4", "t", T0, T0, True), ("e5", "t", None, T0, False)]
    log = spark.createDataFrame(rows, "event_id string, scope string, observed_at timestamp, recorded_at timestamp, excluded_from_recall boolean")
    path = str(tmp_path / "log")
    log.limit(3).coalesce(1).write.parquet(path)
    log.coalesce(1).write.mode("append").parquet(path)
    stream = lambda: pipelines.read_stream(spark, path, log)
    once = pipelines.run_once(pipelines.deduplicated(stream()).select("event_id"), "append", str(tmp_path / "a"))
    assert sorted(r.event_id for r in once.collect()) == ["e1", "e2", "e3", "e4", "e5"]
    got = pipelines.run_once(pipelines.session_stream(stream()), "complete", str(tmp_path / "b")).drop("batch")
    live = spark.read.parquet(path).filter("NOT coalesce(excluded_from_recall, false)")
    assert rows_of(got) == rows_of(sessions(live, ["scope"]).select("scope", "start_us", "end_us", "n_events")) and got.count() == 2
    seen = []
    query = pipelines.derive_layers(spark, stream(), lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "c"))
    query.awaitTermination()
    assert sum(n for _, n in seen) == 8 and len(seen) >= 2


def test_supersession_stream_over_several_files(spark, tmp_path):
    """Corrections, late arrivals and explicit ends in files of their own: the last version equals the closed form."""
    from chronoweave.operators.facts import supersede

    rng, rows = random.Random(9), []
    for i in range(60):
        start = rng.randrange(8)
        rows.append(("s", rng.choice("pq"), start, start + rng.randrange(1, 6) if rng.random() < 0.3 else None, i, f"a{i:02}"))
    rng.shuffle(rows)
    schema = "subject string, predicate string, valid_from long, valid_to long, recorded_from long, assertion_id string"
    for n in range(0, 60, 15):
        spark.createDataFrame(rows[n : n + 15], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    every, keys = spark.read.parquet(str(tmp_path / "in")), ["subject", "predicate"]
    out = pipelines.run_once(pipelines.supersession_stream(pipelines.read_stream(spark, str(tmp_path / "in"), every), keys), "update", str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 4
    last = out.groupBy(*keys).agg(F.max_by(F.arrays_zip("starts", "ends", "assertion_ids"), "version").alias("v"))
    want = supersede(every.withColumn("value", F.lit("x")), keys).select(*keys, "valid_from", "valid_to", "assertion_id")
    assert rows_of(last.select(*keys, F.explode("v").alias("v")).select(*keys, "v.*")) == rows_of(want)


def test_belief_log_grows_in_proportion(spark):
    """Thirty thousand versions of one key in one task; the last belief is that of the closed form."""
    import time

    from chronoweave.operators.facts import belief_log

    rows = [("k", f"a{i:05}", (i * 7919) % 30011, None, i) for i in range(30000)]
    df = spark.createDataFrame(rows, "k string, assertion_id string, valid_from long, valid_to long, recorded_from long")
    began = time.monotonic()
    assert belief_log(df, ["k"]).filter("recorded_to IS NULL AND NOT rejected").count() == 30000
    assert time.monotonic() - began < 30


def test_once_takes_a_whole_row(spark):
    from chronoweave.operators.facts import once

    rows = [("a", "x", None, 1), ("a", None, "m", 2), ("b", "z", None, None), ("b", "y", None, None), (None, "n", None, 9)]
    df = spark.createDataFrame(rows, "id string, name string, merged string, at long")
    assert rows_of(once(df, "id", latest=("at",))) == {("a", None, "m", 2), ("b", "z", None, None)}
    assert rows_of(once(df, "id", first=("at",))) == {("a", "x", None, 1), ("b", "y", None, None)}


def test_entry_without_optional_part():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80 and "p1_found" in sql


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "facts_superseded", "belief_revision", "graph_bfs_2", "rrf_fuse"])
def test_queries_match_their_sql(spark, name):
    """A few queries against DuckDB on the smallest tables; tools/verify.py compares all."""
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    import __spark_entry__ as entry
    from conftest import SF

    if not SF.exists():
        pytest.skip("no test tables here")
    from tools.verify import rows

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")  # as users run them
    try:
        df = entry.queries()[name](spark, str(SF))
        got = rows(df.columns, [tuple(x) for x in df.collect()])
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
    r = con.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in r.description], r.fetchall())


def test_recall_routes_and_fuses_all_channels(spark):
    """A long question reads 160 rows of each channel, synonyms and the salience bonus count."""
    long = "which one of the many tools here has the status alarm"
    assert [retrieval.route_limit(q) for q in (long, "alarm", "status before")] == [160, 40, 160]
    rows = [(f"f{i:03}", f"e{i}", None, T0 - timedelta(minutes=i), f"thing{i}", "p", "status alarm" if i == 120 else "x") for i in range(150)]
    rows.append(("old", "e999", None, T0 - timedelta(days=90), "Acme", "p", "closed"))
    named = spark.createDataFrame(rows, "fact_id string, subject_id string, object_entity_id string, valid_from timestamp, subject_name string, predicate string, object_text string")
    entities = spark.createDataFrame([], "entity_id string, canonical_name string, merged_into string, embedding array<double>")
    aliases = spark.createDataFrame([], "entity_id string, alias string")
    graph_ = spark.createDataFrame([], "fact_id string, src string, dst string")
    args = (named, entities, aliases, graph_, named)
    assert "f120" in {r.fact_id for r in retrieval.recall(*args, long, [1.0, 0.0], "2026-01-01 00:00:00").collect()}
    synonyms = spark.createDataFrame([("signed", ["closed"])], "term string, aliases array<string>")
    bonus = spark.createDataFrame([("old", 2.0)], "fact_id string, bonus double")
    plain_, widened, lifted = ({r.fact_id: r.score for r in retrieval.recall(*args, "acme signed", [1.0, 0.0], "2026-01-01 00:00:00", **more).collect()} for more in ({}, {"synonyms": synonyms}, {"synonyms": synonyms, "bonus": bonus}))
    assert "old" not in plain_ and set(widened) == set(lifted) == {"old"} and lifted["old"] == pytest.approx(widened["old"] + 2)


def test_export_has_beliefs(spark):
    events = spark.createDataFrame([("s", "ev1", "note", "{}", False, T0)], "scope string, event_id string, modality string, content string, excluded_from_recall boolean, observed_at timestamp")
    believed = spark.createDataFrame([("s", "e1", "likely_true", 0.9, "x has 1", 5)], "scope string, about_entity_id string, stance string, confidence double, claim string, valid_from_us long")
    held = spark.createDataFrame([], "fact_id string, scope string, subject_id string, predicate string, confidence double, valid_from timestamp, recorded_to timestamp")
    lines = {r.kind: json.loads(r.line) for r in ingest.export_lines(events, held, believed).collect()}
    assert set(lines) == {"event", "belief"} and lines["belief"]["type"] == "belief" and (lines["belief"]["about"], lines["belief"]["stance"]) == ("e1", "likely_true")


def test_importers_take_whole_texts(spark, tmp_path):
    """Long, dirty and empty texts come out of the envelopes as they went in."""
    from hashlib import sha256

    from chronoweave.plans import knowledge

    dirty = 'a "b" \\ \t\u0001 é 漢 \U0001f600\r\n' * 5000
    rows = [(1, dirty, "t", "web", "en", T0), (2, None, "t", None, "de", T0), (3, "", None, "web", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, title string, source string, lang string, created_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((sha256((r[1] or "").encode()).hexdigest(), len(r[1] or "")) for r in rows)
    for query in (knowledge.import_mem0_texts, knowledge.import_letta_texts, knowledge.import_openai_texts):
        assert sorted((r.text_hash, r.n_characters) for r in query(spark, str(tmp_path)).collect()) == want
