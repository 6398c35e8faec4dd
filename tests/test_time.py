"""Ordered windows, histories, sessions, intervals and supersession against brute force and goldens."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import temporal
from chronoweave.operators import facts as facts_op
from chronoweave.operators import history, intervals, sessions
from chronoweave.operators.ordered import Ordered, hot_keys, skew_safe_lookup

DAY = timedelta(days=1)
T0 = datetime(2026, 1, 1)


def rows_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot", i * 3, rng.randrange(5)) for i in range(120)] + [(f"k{i % 7}", i, rng.randrange(5)) for i in range(60)] + [(None, i, 1) for i in range(4)]
    return spark.createDataFrame(rows, "k string, t long, v long")


def test_hot_keys(skewed):
    assert rows_of(hot_keys(skewed, ["k"], 50)) == {("hot", 120)}
    assert hot_keys(skewed, ["k"], 1000) is None
    assert hot_keys(skewed, ["k"], 3, 2).count() == 1  # no more than half of the rows each


def test_chunks_change_nothing(skewed):
    def run(min_rows):
        o = Ordered(skewed, ["k"], ["t"], min_rows, 16)
        o = o.lag(["v"], "before").lead(["v", "t"], "after").running_sum("v", "total").max_before("v", "most").first(["t"], "head")
        return o.chunked, rows_of(o.result().select("k", "t", "v", "before.v", F.col("after.t").alias("x"), "total", "most", F.col("head.t").alias("h")))

    plain, chunked = run(10_000), run(3)
    assert not plain[0] and chunked[0]
    assert plain[1] == chunked[1] and len(plain[1]) == 184


def test_skew_safe_lookup(spark, skewed):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k string, w int")
    for how in ("left", "inner"):
        a = skew_safe_lookup(skewed, right, ["k"], 10_000, how)
        b = skew_safe_lookup(skewed, right, ["k"], 20, how)
        assert sorted(map(str, a.select("k", "t", "w").collect())) == sorted(map(str, b.select("k", "t", "w").collect()))


FACT = "fact_id string, scope string, subject_id string, predicate string, object_type string, object_entity_id string, object_value string, valid_from timestamp, valid_to timestamp, recorded_from timestamp, recorded_to timestamp, confidence double, polarity string, assertion_status string, value string"


def fact(i, subject, value, start, end=None, recorded=None, predicate="has_status", **other):
    row = dict(fact_id=str(i), scope="s", subject_id=subject, predicate=predicate, object_type="literal", object_entity_id=None, object_value=None if value is None else '{"value": "%s"}' % value, valid_from=start, valid_to=end, recorded_from=recorded or start, recorded_to=None, confidence=0.9, polarity="positive", assertion_status="observed", value="clash")
    return tuple((row | other).values())


VOCABULARY = [("has_status", "closed", "idle", ["waiting", " Wait "]), ("has_status", "closed", "running", None)]


def us(t):
    return int((t.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def history_of(spark, rows, **options):
    vocabulary = spark.createDataFrame(VOCABULARY, "name string, kind string, canonical_value string, aliases array<string>")
    return rows_of(history.fact_history(spark.createDataFrame(rows, FACT), vocabulary, **options))


def test_history_merges_equal_values_and_leaves_gaps(spark):
    rows = [
        fact(1, "a", "idle", T0),
        fact(2, "a", " WAITING ", T0 + DAY),
        fact(2, "a", " WAITING ", T0 + DAY),
        fact(3, "a", "running", T0 + 2 * DAY, T0 + 3 * DAY),
        fact(4, "a", "running", T0 + 5 * DAY, T0 + 9 * DAY),
        fact(5, "a", "running", T0 + 6 * DAY),
        fact(6, "a", "alarm", T0 + 4 * DAY, T0 + 4 * DAY),
        fact(7, "a", "alarm", T0, recorded=T0 - DAY),
        fact(8, "a", "alarm", T0, polarity="negative"),
        fact(9, "a", "alarm", T0, recorded_to=T0),
        fact(10, "b", None, T0, T0 + DAY),
        fact(11, "b", None, T0 + DAY),
        fact(12, "c", "x", None),
        fact(13, None, "x", T0),
    ]
    d = lambda n: us(T0 + n * DAY)
    want = {("a", "has_status", d(0), d(2), "idle"), ("a", "has_status", d(2), d(3), "running"), ("a", "has_status", d(5), -1, "running"), ("b", "has_status", d(0), -1, None), (None, "has_status", d(0), -1, "x")}
    assert history_of(spark, rows) == want
    assert history_of(spark, rows, min_rows=1, chunk_rows=2) == want
    assert history_of(spark, []) == set()


def test_history_in_chunks_equals_plain(spark):
    rng = random.Random(9)
    rows = [fact(i, rng.choice(["hot", "hot", "hot", f"s{i % 5}"]), rng.choice("xy"), T0 + timedelta(hours=rng.randrange(400)), rng.choice([None, T0 + timedelta(hours=rng.randrange(400))]), T0 + timedelta(hours=rng.randrange(999))) for i in range(260)]
    assert history_of(spark, rows) == history_of(spark, rows, min_rows=20, chunk_rows=25)


def test_satellites_are_split_by_change_rate(spark):
    vocabulary = spark.createDataFrame(VOCABULARY, "name string, kind string, canonical_value string, aliases array<string>")
    rows = [fact(i, f"s{i % 3}", "idle" if i % 2 else "running", T0 + i * DAY) for i in range(30)] + [fact(100, "s0", "team a", T0, predicate="owning_team")]
    loads = history.fact_satellites(spark.createDataFrame(rows, FACT), vocabulary)
    assert {name: {r.predicate for r in load.select("predicate").distinct().collect()} for name, load in loads.items()} == {"fast": {"has_status"}, "slow": {"owning_team"}}


@pytest.mark.parametrize("seed", [1, 2])
def test_stored_satellites_equal_the_history_whatever_the_order_of_arrival(spark, tmp_path, seed):
    """Late, corrected and withdrawn assertions in several loads, complete or not; each load is written twice."""
    rng = random.Random(seed)
    vocabulary = spark.createDataFrame(VOCABULARY, "name string, kind string, canonical_value string, aliases array<string>")
    rows = [fact(i, f"s{i % 4}", rng.choice(["idle", "wait", "x"]), T0 + rng.randrange(12) * DAY, rng.choice([None, None, T0 + rng.randrange(14) * DAY]), T0 + timedelta(minutes=rng.randrange(5000))) for i in range(60)]
    rng.shuffle(rows)
    folder, arrived, truth = str(tmp_path / "satellite"), [], []
    for number, n in enumerate((20, 20, 20)):
        arrived += rows[number * n : (number + 1) * n]
        if number == 2:
            arrived = arrived[7:]  # some are withdrawn
        held = history.fact_rows(spark.createDataFrame(arrived, FACT), vocabulary)
        for _ in range(2):
            history.write_satellite(history.loaded(held, number), history.KEYS, folder, complete=number == 2)
        truth.append(rows_of(history.fact_history(spark.createDataFrame(arrived, FACT), vocabulary)))
    stored = spark.read.parquet(folder)
    assert stored.groupBy(*history.KEYS, "from_us", "load").count().filter("count > 1").count() == 0
    for number, want in enumerate(truth):
        view = history.versions(history.current(stored, history.KEYS, number), history.KEYS)
        assert rows_of(view.select("subject_id", "predicate", "from_us", "to_us", "value")) == want


def test_a_correction_replaces_what_was_loaded(spark):
    """{1: A, 5: B}, then {1: C, 3: B, 5: B}: C holds until 3, B from there on; the first state can still be seen."""
    rows = lambda told, n: history.loaded(spark.createDataFrame([("s", "p", at, v, None) for at, v in told], "subject_id string, predicate string, from_us long, value string, stop_us long"), n)
    first = rows([(1, "A"), (5, "B")], 0)
    both = first.unionByName(history.appended(first, rows([(1, "C"), (3, "B"), (5, "B")], 1), history.KEYS))
    seen = lambda n: {(r.from_us, r.to_us, r.value) for r in history.versions(history.current(both, history.KEYS, n), history.KEYS).collect()}
    assert both.count() == 4 and seen(0) == {(1, 5, "A"), (5, -1, "B")} and seen(1) == {(1, 3, "C"), (3, -1, "B")}


def brute_sessions(rows, gap):
    out = set()
    for k in {k for k, _ in rows}:
        times = sorted(us(t) for x, t in rows if x == k and t is not None)
        while times:
            n = 1
            while n < len(times) and times[n] - times[n - 1] <= gap * 1_000_000:
                n += 1
            out.add((k, times[0], times[n - 1], n))
            times = times[n:]
    return out


def test_sessions_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), T0 + timedelta(seconds=rng.randrange(-50_000, 200_000))) for _ in range(300)] + [("a", None), ("exact", T0), ("exact", T0 + timedelta(minutes=30)), ("over", T0), ("over", T0 + timedelta(minutes=30, microseconds=1)), ("same", T0), ("same", T0)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "k string, observed_at timestamp, n_events int")
    for gap in (60, 1800):
        got = rows_of(sessions.sessions(df, ["k"], gap_seconds=gap).select("k", "start_us", "end_us", "n_events"))
        assert got == brute_sessions(rows, gap)
    assert sessions.sessions(df.limit(0), ["k"]).count() == 0


def test_event_sessions_count_each_event_once(spark):
    rows = [("e1", 1, "s", T0, T0, False), ("e1", 9, "s", T0, T0 + DAY, False), ("e2", 2, "s", T0 + timedelta(minutes=5), T0, None), ("e3", 3, "s", T0, T0, True), (None, 4, "s", T0, T0, False), ("e5", 5, "s", None, T0, False)]
    df = spark.createDataFrame(rows, "event_id string, wal_offset long, scope string, observed_at timestamp, recorded_at timestamp, excluded_from_recall boolean")
    assert rows_of(sessions.event_sessions(df).select("scope", "n_events", "duration_us")) == {("s", 2, 300_000_000)}


def brute_coverage(rows):
    out = set()
    for k in {r[0] for r in rows}:
        spans = sorted((a, intervals.OPEN if b is None else b) for x, a, b in rows if x == k and a is not None and (b is None or b > a))
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        end = lambda t: -1 if t == intervals.OPEN else t
        out |= {(k, "period", a, end(b)) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    return out


def test_coverage_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), a := rng.randrange(3000), rng.choice([a + rng.randrange(-5, 40)] * 60 + [None])) for _ in range(500)]
    rows += [("nest", 0, 10), ("nest", 2, 3), ("touch", 0, 5), ("touch", 5, 9), ("x", None, 4), ("bad", 5, 5), ("bad", 6, 2), ("dup", 1, 2), ("dup", 1, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, a long, b long, kind string")
    want = brute_coverage(rows)
    assert rows_of(intervals.coverage(df, ["k"], "a", "b")) == want
    assert rows_of(intervals.coverage(df, ["k"], "a", "b", min_rows=30, chunk_rows=25)) == want
    assert intervals.coverage(df.limit(0), ["k"], "a", "b").count() == 0


def test_interval_map():
    m = intervals.IntervalMap()
    for a, b in ((10, 20), (30, 40), (20, 25), (5, 5), (50, 60), (24, 31)):
        m.insert(a, b)
    assert m.periods() == [(10, 40), (50, 60)] and m.gaps() == [(40, 50)]


def assertions(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "k string, assertion_id string, value string, valid_from long, valid_to long, recorded_from long")


def test_late_arrivals_take_their_place(spark):
    # alarm@3, idle@1, running@2 in that order of arrival
    df = assertions(spark, [("x", "alarm", 3, None, 10), ("y", "idle", 1, None, 11), ("z", "running", 2, None, 12)])
    got = facts_op.supersede(df, ["k"]).select("value", "valid_from", "valid_to")
    assert rows_of(got) == {("idle", 1, 2), ("running", 2, 3), ("alarm", 3, None)}
    assert rows_of(facts_op.supersede(df, ["k"], F.lit(11)).select("value", "valid_to")) == {("idle", 3), ("alarm", None)}


def test_correction_at_equal_time(spark):
    df = assertions(spark, [("x", "idle", 5, None, 10), ("y", "running", 5, None, 11)])
    assert rows_of(facts_op.supersede(df, ["k"]).select("value")) == {("running",)}
    log = facts_op.belief_log(df, ["k"]).collect()
    assert {(r.assertion_id, r.recorded_to) for r in log} == {("x", 11), ("y", None)}


def test_fold_equals_closed_form(spark):
    rng = random.Random(11)
    for trial in range(3):
        rows = []
        for i in range(120):
            start = rng.randrange(40)
            rows.append((f"{i:03}", rng.choice("abc"), start, rng.choice([None, None, None, start + rng.randrange(0, 9)]), i))
        keys = [(f"k{rng.randrange(12)}", *r) for r in rows]
        df = spark.createDataFrame(keys, "k string, assertion_id string, value string, valid_from long, valid_to long, recorded_from long")
        log = facts_op.belief_log(df, ["k"])
        rejected = log.filter("rejected").select("assertion_id")
        accepted = df.join(rejected, "assertion_id", "left_anti").select(df.columns)
        now = rows_of(log.filter("NOT rejected AND recorded_to IS NULL").select("k", "valid_from", "valid_to", "assertion_id"))
        assert now == rows_of(facts_op.supersede(accepted, ["k"]).select("k", "valid_from", "valid_to", "assertion_id"))


def test_time_predicates(spark):
    rows = [("idle", "2026-03-01", None, "2026-03-01", "2026-03-02"), ("running", "2026-03-01", None, "2026-03-02", None), ("old", "2026-01-01", "2026-02-01", "2026-01-01", None)]
    df = spark.createDataFrame(rows, "v string, valid_from string, valid_to string, recorded_from string, recorded_to string").withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to", "recorded_from", "recorded_to")})
    seen = lambda p: {r.v for r in df.filter(p).collect()}
    assert seen(temporal.as_of("2026-03-01 12:00:00", True)) == {"idle"}
    assert seen(temporal.as_of("2026-03-03", True)) == {"running"}
    assert seen(temporal.as_of("2026-01-15")) == {"old"}
    assert seen(temporal.as_of("2026-02-01")) == set()
    assert seen(temporal.current()) == {"running"}
    assert seen(temporal.still_valid()) == {"idle", "running"}
    assert seen(temporal.as_known("2000-01-01")) == set()
    assert seen(temporal.overlaps("valid", "2026-02-01", "2026-02-15")) == {"old"}
    assert seen(temporal.overlaps("recorded", "2026-03-02", "2026-03-05")) == {"idle", "running", "old"}
    assert seen(temporal.listed_as_of("2026-03-03", True)) == {"idle", "running"}


def test_phrases():
    ref = datetime(2026, 6, 18)
    assert temporal.phrase_window(" Last Week", ref) == (datetime(2026, 6, 11), ref)
    assert temporal.phrase_window("never", ref) is None
    assert temporal.phrase_window("shift", ref, {"shift": "-PT8H..PT30M"}) == (ref - timedelta(hours=8), ref + timedelta(minutes=30))
    assert temporal.parse_duration("-P1Y2M1W3DT4H5M6S") == -timedelta(days=365 + 60 + 7 + 3, hours=4, minutes=5, seconds=6)
    for bad in ("P", "7D", "P7X"):
        with pytest.raises(ValueError):
            temporal.parse_duration(bad)
    with pytest.raises(ValueError):
        temporal.window_of("P1D", ref)
