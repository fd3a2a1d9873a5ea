"""Health and usage of sources against a plain replay: deactivation that only a reactivation ends, events out of order, late ones, timers, odd rows."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 1)
LOG = "source_id long, ts timestamp, ok boolean, ord long, back boolean"


def replay(log):
    """(failures in a row, active) of each source, one event after the other."""
    state = {}
    for s, _, ok, _, back in sorted((e for e in log if e[0] is not None and e[1] and (e[2] is not None or e[4])), key=lambda e: (e[1], e[3])):
        failures, active = state.get(s, (0, True))
        if back:
            state[s] = (0, True)
        elif ok:
            state[s] = (0, active)
        else:
            state[s] = (failures + 1, active and failures + 1 < 5)
    return state


def random_log(seed, n=1500, sources=12):
    r = random.Random(seed)
    return [(r.randrange(sources), T0 + dt.timedelta(minutes=r.randrange(3000)), r.random() < 0.45, i, r.random() < 0.02) for i in range(n)]


def land(spark, path, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.stat(f"{path}/{f}").st_mtime > 2_000_000:
                os.utime(f"{path}/{f}", (1_000_000 + i, 1_000_000 + i))


def test_only_a_reactivation_revives(spark):
    from newsloom.operators import registry

    t = lambda i: T0 + dt.timedelta(minutes=i)
    log = [(1, t(i), i == 6, i, False) for i in range(7)]  # six failures, then a success
    log += [(2, t(i), False, i, False) for i in range(5)] + [(2, t(9), True, 9, True), (2, t(10), False, 10, False)]
    log += [(3, t(i), False, i, False) for i in range(4)] + [(3, t(4), True, 4, True)] + [(3, t(5 + i), False, 5 + i, False) for i in range(4)]
    log += [(4, t(0), False, i, False) for i in range(4)] + [(4, t(0), True, 4, False), (4, t(0), False, 5, False)]  # ties in time go by number
    df = spark.createDataFrame(log, LOG).repartition(3)
    got = {x.source_id: (x.failure_count, x.is_active) for x in registry.health(df.where("not back"), reactivations=df.where("back")).collect()}
    assert got == replay(log) == {1: (0, False), 2: (1, True), 3: (4, True), 4: (1, True)}
    assert registry.health(df.where("source_id = 1")).first().is_active is False


def test_batch_health_like_a_replay(spark):
    from newsloom.operators import registry

    log = random_log(1)
    df = spark.createDataFrame(log, LOG).repartition(4)
    got = {x.source_id: (x.failure_count, x.is_active) for x in registry.health(df.where("not back"), reactivations=df.where("back")).collect()}
    want = replay(log)
    assert got == {s: want[s] for s in got} and len(got) == 12 and {a for _, a in got.values()} == {True, False}


def drained(spark, path, job, per=1, **more):
    from newsloom.streaming import jobs

    return jobs.drain(job(jobs.stream(spark, path, per), **more), "t")


def last_health(out):
    rows = out.groupBy("source_id").agg(F.max_by("failures", "version").alias("failures"), F.max_by("active", "version").alias("active"), F.max_by("late", "version").alias("late"), F.max("version").alias("version"))
    return {x.source_id: x for x in rows.collect()}


def test_health_stream_like_a_replay_in_any_order(spark, tmp_path):
    from newsloom.streaming import jobs

    log = random_log(2) + [(None, T0, True, 1, False), (3, None, True, 1, False), (4, T0, None, 1, False), (4, T0, None, 2, None)]
    random.Random(5).shuffle(log)
    land(spark, str(tmp_path / "l"), [log[i::4] for i in range(4)])
    want = replay(log)
    got = last_health(drained(spark, str(tmp_path / "l"), jobs.health))
    assert {s: (x.failures, x.active) for s, x in got.items()} == want and all(x.late == 0 and x.version == 4 for x in got.values())


def test_late_events_are_counted_and_settled_ones_stay(spark, tmp_path):
    from newsloom.streaming import jobs

    early = [(1, T0 + dt.timedelta(minutes=i), False, i, False) for i in range(5)]
    then = [(1, T0 + dt.timedelta(hours=9), True, 100, False)]
    late = [(1, T0 + dt.timedelta(minutes=10), True, 50, True), (1, T0 + dt.timedelta(hours=9, minutes=-1), False, 60, False)]
    land(spark, str(tmp_path / "l"), [early, then, late])
    got = last_health(drained(spark, str(tmp_path / "l"), jobs.health, horizon=jobs.HOUR))[1]
    assert (got.failures, got.active, got.late) == (0, False, 1)  # the reactivation came too late, the failure within the horizon counts
    # with a longer horizon the same files give what a replay gives
    got = last_health(drained(spark, str(tmp_path / "l"), jobs.health, horizon=2 * jobs.DAY))[1]
    assert (got.failures, got.active, got.late) == (0, True, 0) and replay(early + then + late) == {1: (0, True)}


def test_a_silent_source_is_settled_by_a_timer(spark, tmp_path):
    from newsloom.streaming import jobs

    parts = [[(1, T0 + dt.timedelta(minutes=i), False, i, False) for i in range(3)], [(2, T0, True, 1, False)], [(2, T0, True, 2, False)], [(1, T0, True, 9, False), (1, T0 + dt.timedelta(hours=1), False, 10, False)]]
    land(spark, str(tmp_path / "l"), parts)
    got = last_health(drained(spark, str(tmp_path / "l"), jobs.health, idle=0))
    assert (got[1].failures, got[1].late) == (4, 1)  # settled while only source 2 sent something, so the early success was late


def test_usage_keeps_a_bounded_state_and_all_counts(spark, tmp_path):
    from newsloom.streaming import jobs

    r = random.Random(4)
    log = [(r.randrange(3), T0 + dt.timedelta(minutes=r.randrange(60 * 24 * 6)), True, i, False) for i in range(900)] + [(None, T0, True, 0, False), (1, None, True, 0, False)]
    parts = [log[i::5] for i in range(5)]
    parts.append([(0, T0 + dt.timedelta(days=20), True, 1, False), (7, T0, True, 2, False)])
    parts.append([(0, T0, True, 3, False), (0, T0 + dt.timedelta(days=20), True, 4, False)])
    land(spark, str(tmp_path / "l"), parts)
    want, whole = {}, {}
    for s, t, *_ in [e for p in parts for e in p]:
        if s is not None and t:
            want[s, t.replace(minute=0)] = want.get((s, t.replace(minute=0)), 0) + 1
    out = drained(spark, str(tmp_path / "l"), jobs.usage_with_late)
    totals = jobs.usage_totals(out).collect()
    assert {(x.source_id, x.slot): x.requests for x in totals} == want
    assert sum(x.late for x in totals) > 50  # days later than the last of their source
    for x in out.where("kind = 'open'").collect():
        whole.setdefault((x.source_id, x.version), []).append(x.slot)
    assert max(map(len, whole.values())) <= 25 and max(max(v) - min(v) for v in whole.values()) <= dt.timedelta(days=1)
