import bisect
import datetime as dt
import random

from leafmill.operators import incremental

T0 = dt.datetime(2025, 1, 1)
FEED = "feed_id long, tab string, rec_id string, status string, updated_at timestamp_ntz, arrived_at timestamp_ntz, run_id string"
RUNS = "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, state string"


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def brute(feed, runs):
    ok = sorted((r[1], r[0]) for r in runs if r[3] == "ok" and r[1] is not None)
    last, out = {}, set()
    for f in sorted((f for f in feed if f[5] is not None and f[2] is not None), key=lambda f: (f[5], f[0])):
        key, new = (f[1], f[2]), (f[4] or dt.datetime.min, f[3])
        old = last.get(key)
        if old is None or new[0] > old[0] or new[0] == old[0] and new[1] != old[1]:
            last[key] = new
            k = bisect.bisect_left([s for s, _ in ok], f[5])
            if k < len(ok):
                out.add((ok[k][1], *key))
    return out


def replay(spark, feed, runs):
    return [tuple(r) for r in incremental.replay(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS)).collect()]


def test_random_histories(spark):
    rng = random.Random(3)
    for _ in range(3):
        feed = [(k, rng.choice(["documents", "translations"]), rng.choice(["a", "b", "c", "d", "e"]), rng.choice(["queued", "ok", None]), at(rng.choice([None, rng.randrange(0, 4000)])), at(rng.randrange(0, 6000)), "clash") for k in range(150)]
        feed += feed[:20]
        runs = [(k, at(rng.randrange(0, 7000)), None, rng.choice(["ok", "ok", "failed", "running"])) for k in range(25)]
        got = replay(spark, feed, runs)
        assert len(got) == len(set(got))
        assert set(got) == brute(feed, runs)


def test_empty_tables_and_nulls(spark):
    runs = [(1, at(10), None, "ok"), (2, None, None, "ok")]
    assert replay(spark, [], runs) == []
    feed = [(1, "documents", "x", None, None, at(5), None), (2, "documents", None, "ok", at(1), at(5), None), (3, "documents", "y", "ok", at(1), None, None)]
    assert replay(spark, feed, runs) == [(1, "documents", "x")]
    assert replay(spark, feed, []) == []


def test_equal_times_and_states_out_of_order(spark):
    feed = [
        (1, "d", "r", "a", at(5), at(10), None), (2, "d", "r", "b", at(4), at(20), None),  # late: no change
        (3, "d", "r", "a", at(5), at(30), None), (4, "d", "r", "b", at(5), at(40), None), (5, "d", "r", "a", at(5), at(50), None),
    ]
    runs = [(k, at(10 * k), None, "ok") for k in range(1, 7)]
    assert sorted(replay(spark, feed, runs)) == [(1, "d", "r"), (4, "d", "r"), (5, "d", "r")]


def test_runs_one_by_one_with_a_ledger_equal_the_replay(spark):
    rng = random.Random(9)
    feed = [(k, "documents", rng.choice("abcdef"), rng.choice(["q", "ok"]), at(m := rng.randrange(0, 500)), at(m + rng.randrange(0, 300)), "x") for k in range(80)]
    runs = [(1, at(100), None, "ok"), (2, at(250), None, "failed"), (3, at(400), None, "ok"), (4, at(900), None, "ok")]
    f = spark.createDataFrame(feed, FEED)
    ledger, out = spark.createDataFrame([], "tab string, rec_id string, version long"), set()
    for k, (run_id, _, _, state) in enumerate(runs):
        batch = incremental.next_batch(f, spark.createDataFrame(runs[: k + 1], RUNS), ledger, run_id)
        if state == "ok":
            rows = batch.collect()
            out |= {(run_id, r.tab, r.rec_id) for r in rows}
            ledger = spark.createDataFrame([*ledger.collect(), *((r.tab, r.rec_id, r.version) for r in rows)], "tab string, rec_id string, version long")
            assert incremental.next_batch(f, spark.createDataFrame(runs[: k + 1], RUNS), ledger, run_id).count() == 0
    assert out == brute(feed, runs)


def test_a_transaction_open_for_the_whole_history(spark):
    feed = [(k, "documents", f"r{k % 7}", "ok", at(k), at(k), "x") for k in range(1, 120)] + [(500, "documents", "old", "ok", at(-5000), at(110), "x")]
    runs = [(k, at(10 * k), None, "ok") for k in range(1, 13)]
    f, r = spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS)
    read = incremental.candidates(incremental.changes(f), incremental.reread_spans(f, r))
    assert read.groupBy("version").count().where("count > 2").count() == 0 and read.where("not fresh").count() > 90
    assert set(replay(spark, feed, runs)) == brute(feed, runs)


def test_stretches_against_all_runs(spark):
    rng = random.Random(4)
    for _ in range(5):
        highs = sorted(rng.randrange(1000) for _ in range(9))
        lows = [None, *(max(0, h - rng.choice([0, 5, 400])) for h in highs)]
        spans = spark.createDataFrame([(k, at(low), at(h)) for k, (low, h) in enumerate(zip(lows, highs))], "ordinal int, low timestamp_ntz, high timestamp_ntz")
        got = incremental.readers(spans)
        for minute in range(0, 1001, 7):
            a = at(minute)
            want = [k for k, h in enumerate(highs) if (lows[k] is None or minute >= lows[k] or minute > highs[k - 1]) and minute <= h]
            mine = [x for x in got if (x[0] is None or a > x[0]) and a <= x[1]]
            assert len(mine) == (1 if want else 0)
            if want:
                assert mine[0][2] == want[0] and mine[0][3] == (want[1] if len(want) > 1 else None)


def test_the_replay_is_an_anti_join_with_the_ledger(spark):
    plan = incremental.replay(spark.createDataFrame([(1, "d", "a", "ok", at(1), at(2), "x")], FEED), spark.createDataFrame([(1, at(5), None, "ok"), (2, at(9), None, "ok")], RUNS))._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "BroadcastNestedLoopJoin" not in plan


LATE = [
    (1, "d", "on time", "a", at(12), at(14), None), (2, "d", "late", "a", at(5), at(15), None), (3, "d", "ahead", "a", at(35), at(15), None),
    (4, "d", "no time", "a", None, at(15), None), (5, "d", "later", "a", at(11), at(25), None), (6, "d", "after all", "a", at(29), at(31), None),
]
TENS = [(k, at(10 * k), None, "ok") for k in (1, 2, 3)]


def test_late_deliveries_are_found_by_rereading_only(spark, monkeypatch):
    f, r = spark.createDataFrame(LATE, FEED), spark.createDataFrame(TENS, RUNS)
    read = lambda feed: {(x.rec_id, x.ordinal, x.fresh) for x in incremental.candidates(incremental.changes(f), incremental.reread_spans(feed, r)).collect()}
    anew = {("on time", 1, True), ("ahead", 1, True), ("no time", 1, True)}
    assert read(f.where("false")) == anew
    assert read(f) == anew | {("late", 1, False), ("later", 2, False), ("on time", 2, False), ("no time", 2, False)}
    assert set(replay(spark, LATE, TENS)) == brute(LATE, TENS)
    readers = incremental.readers
    monkeypatch.setattr(incremental, "readers", lambda spans: [(*x[:3], *(None for _ in x[3:])) for x in readers(spans)])
    assert {x[2] for x in replay(spark, LATE, TENS)} == {"on time", "ahead", "no time"}


def test_a_run_selects_by_updated_at(spark):
    ledger = spark.createDataFrame([(1, "d", "on time")], "version long, tab string, rec_id string")
    batch = incremental.next_batch(spark.createDataFrame(LATE, FEED), spark.createDataFrame(TENS, RUNS), ledger, 3)
    assert sorted(x.rec_id for x in batch.collect()) == ["ahead", "later", "no time"]


def test_candidates_against_all_runs(spark):
    rng = random.Random(6)
    for _ in range(3):
        feed = [(k, "d", f"r{k}", "a", at(rng.choice([None, m, m, m + 200])), at(m + rng.choice([0, 3, 40, 900])), None) for k in range(80) for m in [rng.randrange(0, 2000)]]
        runs = [(k, at(rng.randrange(0, 2600)), None, "ok") for k in range(20)] + [(20, at(1000), None, "ok"), (21, at(1000), None, "ok")]
        f = spark.createDataFrame(feed, FEED)
        spans = incremental.reread_spans(f, spark.createDataFrame(runs, RUNS))
        ordered = sorted(spans.collect(), key=lambda x: x.ordinal)
        want = set()
        for k, _, _, _, u, a, _ in feed:
            u = u or a
            seen = [(x.ordinal, x.ordinal == 0 or u > ordered[x.ordinal - 1].high) for x in ordered if a <= x.high and (x.low is None or u >= x.low)]
            want |= {(k, *next(x for x in seen if x[1] is kind)) for kind in {x[1] for x in seen}}
        got = incremental.candidates(incremental.changes(f), spans).select("version", "ordinal", "fresh").collect()
        assert len(got) == len(set(got)) and {tuple(x) for x in got} == want
        assert set(replay(spark, feed, runs)) == brute(feed, runs)
