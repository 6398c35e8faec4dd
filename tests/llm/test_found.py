"""Operators on training data against brute force."""

import json
import random
import time

import numpy as np
import pytest

from chronoweave.llm import groups, neighbours, splitting


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root}


@pytest.mark.parametrize("min_rows", [2_000_000, 2])
def test_groups_against_union_find(spark, min_rows):
    rng = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    star = [("zz", f"s{i}") for i in range(12)] + [(f"t{i}", "aa") for i in range(12)]
    noise = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(18)]
    rows = chain + star + noise + noise + [("x", "x"), (None, "y"), ("y", None)]
    got = groups.connected_groups(spark.createDataFrame([(*r, 1) for r in rows], "a string, b string, id int"), "a", "b", min_rows=min_rows)
    assert {tuple(r) for r in got.collect()} == components(rows)


def test_groups_of_nothing(spark):
    assert groups.connected_groups(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_merged_groups_ignore_unknown_targets(spark):
    rows = [("a", "b"), ("a", None), ("b", None), ("c", "gone"), ("d", "a"), ("a", "b")]
    got = groups.merged_groups(spark.createDataFrame(rows, "entity_id string, merged_into string"))
    assert {tuple(r) for r in got.select("entity_id", "group_id").collect()} == {("a", "a"), ("b", "a"), ("d", "a")}


def brute_cuts(text, limit, overlap):
    strengths, start, out = splitting.boundary_strengths(text), 0, []
    while len(text) - start > limit:
        best = max((strengths[e], e) for e in range(start + limit // 2, start + limit + 1))
        end = best[1] if best[0] else start + limit
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(text))]


def test_cuts_against_brute_force():
    rng = random.Random(1)
    for n in [*range(0, 60), 300, 2000, 2001, 5000]:
        text = "".join(rng.choice("abc de.\n，。😀 ") for _ in range(n))
        for limit, overlap in ((20, 4), (64, 0), (300, 140)):
            pieces = splitting.cut_points(text, limit, overlap)
            assert [p[:2] for p in pieces] == brute_cuts(text, limit, overlap)
            assert text == text[: pieces[0][1]] + "".join(text[q[1] : p[1]] for q, p in zip(pieces, pieces[1:], strict=False))
            assert all(b - a <= limit for a, b, _ in pieces)


def test_cuts_of_text_without_boundaries_and_bad_overlap():
    assert [p[:2] for p in splitting.cut_points("x" * 25, 10, 2)] == [(0, 10), (8, 18), (16, 25)]
    with pytest.raises(ValueError):
        splitting.cut_points("x", 10, 5)


def test_boundaries_of_a_long_run_of_marks_take_little_time():
    began = time.monotonic()
    assert splitting.boundary_strengths("." * 400_000 + "x").max() == 0
    assert list(splitting.boundary_strengths('a..") b')) == [0, 0, 0, 0, 0, 4, 1, 0]
    assert time.monotonic() - began < 5


def test_range_maximum():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1000, 1000)
    index = splitting.RangeMaximum(keys)
    for _ in range(500):
        lo, hi = sorted(rng.integers(0, 1001, 2))
        if lo < hi:
            assert index.best(lo, hi) == keys[lo:hi].max()


def test_text_of_json():
    assert splitting.text_of('{"text": "a\\ud83d\\ude00"}', ("text",)) == "a😀"
    assert splitting.text_of('{"text": "a\\ud83d"}', ("text",)) == "a�"
    for bad in (None, "", "{", '{"text": 3}', '{"content": 1}', "[]", '"x"', '{"text": "abc'):
        assert splitting.text_of(bad, ("text",)) is None


def test_oversized_pieces(spark):
    long = "word " * 500
    log = [("e1", 1, json.dumps({"text": long})), ("e1", 2, json.dumps({"text": long})), ("e2", 3, json.dumps({"text": "short"})), ("e3", 4, '{"text": "' + "x" * 3000), ("e4", 5, None), (None, 6, json.dumps({"text": long}))]
    log = spark.createDataFrame([(a, b, c, b, "x") for a, b, c in log], "event_id string, wal_offset long, content string, recorded_at long, item_id string")
    files = spark.createDataFrame([("f", json.dumps({"content": {"text": "界" * 2001}}, ensure_ascii=True)), ("f", json.dumps({"content": {"text": "界" * 2001}}, ensure_ascii=True)), (None, "x" * 3000), ("g", "{}")], "file_name string, raw string")
    got = splitting.oversized_pieces(log, files).collect()
    assert {(r.item_table, r.item_id) for r in got} == {("event_log", "e1"), ("incident_envelopes", "f")}
    first = sorted((r for r in got if r.item_id == "e1"), key=lambda r: r.piece_no)
    assert all(len(r.text) <= 2000 for r in got) and first[0].text[-200:] == first[1].text[:200]
    assert len(got) == len({(r.item_table, r.item_id, r.piece_no) for r in got})
    assert splitting.oversized_pieces(log.limit(0), files.limit(0)).count() == 0


def brute_neighbours(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 6)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((-sims[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[a] = [b for _, b in order]
    return out


def test_neighbours_recall_copies_and_unusable(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    vectors = {f"v{i:04}": (centres[i % 12] + rng.normal(size=8) * 0.4).tolist() for i in range(900)}
    copy = vectors["v0000"]
    vectors |= {f"w{i}": [2.0 * x for x in copy] for i in range(9)}
    bad = [("b1", None), ("b2", [0.0] * 8), ("b3", [float("nan")] * 8), ("b4", [1.0] * 7), ("b5", [1.0] * 7 + [None])]
    rows = [(k, v, 0.5) for k, v in vectors.items()] + [(k, v, 0.5) for k, v in bad] + [("v0001", vectors["v0001"], 0.5)]
    df = spark.createDataFrame(rows, "entity_id string, embedding array<double>, sim double")
    got = {}
    for r in neighbours.nearest(df, "entity_id", "embedding", 5, 8).collect():
        got.setdefault(r.entity_id, []).append((r["rank"], r.other))
    want = brute_neighbours(vectors, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({b for _, b in got[a]} & set(want[a])) for a in want)
    assert hits / (5 * len(want)) > 0.95
    for a in ("v0000", *(f"w{i}" for i in range(9))):
        assert [b for _, b in sorted(got[a])] == want[a]


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "entity_id string, embedding array<float>")
    assert {tuple(r) for r in neighbours.neighbour_pairs(df, "entity_id", "embedding", 5, dimensions=2).collect()} == {("a", "b")}
    assert neighbours.neighbour_pairs(df.limit(0), "entity_id", "embedding", 5, dimensions=2).count() == 0
