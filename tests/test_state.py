"""State per particle over several batches: sessions, status from a saved state."""

import datetime as dt
import itertools
import random

import pytest

from spark_drift.streaming import state, streams

T0 = dt.datetime(2024, 1, 1)
FIXES = "particle_id long, time timestamp_ntz, in_domain int, is_beached int, error_status int, land_boundary_encounters int"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def write(spark, rows, folder, i):
    spark.createDataFrame(rows, FIXES).coalesce(1).write.parquet(f"{folder}/{i}")


def read(spark, folder):
    return spark.readStream.schema(FIXES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def plain_sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t <= out[-1][1] + gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return out


def test_fixes_into_sessions_in_any_order():
    rnd = random.Random(1)
    for _ in range(300):
        times = [rnd.randint(0, 60) for _ in range(rnd.randint(1, 14))]
        sessions = []
        for t in times:
            state.add_to_sessions(sessions, 3, t, (t,))
        want = plain_sessions(times, 3)
        assert [s[:3] for s in sessions] == want
        assert sum(s[3] for s in sessions) == sum(times)


def test_sessions_across_files(spark, tmp_path):
    """A session over two files is one; those past the watermark are closed by the timer, once; the others stay open."""
    first = [(1, at(h), 1, 0, 0, 0) for h in (0, 1, 30, 31)] + [(2, at(31), 1, 1, 0, 0), (None, at(30), 1, 0, 0, 0), (4, at(2), 1, 0, 1, 0), (5, None, 1, 0, 0, 0)]
    second = [(1, at(h), 1, 0, 1, 0) for h in (34, 33, 60)] + [(2, at(36.5), 0, 1, 0, 0), (3, at(61), 1, None, 0, 0)]
    third = [(2, at(90), 1, 0, 0, 0)]
    for i, rows in enumerate((first, second, third)):
        write(spark, rows, f"{tmp_path}/in", i)
    out = streams.run_to_parquet(state.stream_sessions(read(spark, f"{tmp_path}/in"), 6 * 3600), f"{tmp_path}/out", "update", batches=True).cache()
    got = {(r.particle_id, r.t_start): (r.t_end, r.n, r.n_in_domain, r.n_beached, r.n_error, r.is_open) for r in state.newest_sessions(out).collect()}
    assert got == {
        (1, at(0)): (at(7), 2, 2, 0, 0, False), (1, at(30)): (at(40), 4, 4, 0, 2, False), (1, at(60)): (at(66), 1, 1, 0, 1, False),
        (2, at(31)): (at(42.5), 2, 1, 2, 0, False), (2, at(90)): (at(96), 1, 1, 0, 0, True), (3, at(61)): (at(67), 1, 1, 0, 0, False),
        (None, at(30)): (at(36), 1, 1, 0, 0, False), (4, at(2)): (at(8), 1, 1, 0, 1, False)}
    closed = [(r.particle_id, r.t_start) for r in out.where("not is_open").collect()]
    assert len(closed) == len(set(closed))


def plain_status(rows, death, settling):
    out = {}
    for p, own in itertools.groupby(sorted((r for r in rows if r[1]), key=lambda r: r[0]), key=lambda r: r[0]):
        own = list(own)
        times = [r[1] for r in own]
        age = (max(times) - min(times)).total_seconds()
        out[p] = (age, sum(r[5] or 0 for r in own), max(r[3] or 0 for r in own if r[1] == max(times)), min(1 if r[2] is None else r[2] for r in own),
                  int(age < death), int(age >= settling))
    return out


@pytest.mark.parametrize("ttl", [None, 86400.0])
def test_status_from_a_saved_state(spark, tmp_path, ttl):
    rnd = random.Random(2)
    rows = [(rnd.randint(1, 12), at(rnd.choice([5, 50, 51, 52, 80, 120])), rnd.choice([1, 1, 1, 0, None]), rnd.choice([0, 1, None]), 0, rnd.choice([0, 2, None])) for _ in range(150)]
    rows.append((13, None, 0, 0, 0, 0))
    for i in range(3):
        write(spark, rows[50 * i:50 * (i + 1)] + rows[150:], f"{tmp_path}/in", i)
    columns = ["particle_id", "age_s", "land_encounters", "is_beached", "in_domain", "is_alive", "settling"]
    run = lambda folder, name, saved=None: streams.run_to_parquet(
        state.stream_status(read(spark, folder), 3e5, 1e5, saved, ttl), f"{tmp_path}/{name}", "update", ["particle_id"], idle=ttl is None)
    whole = {r[0]: tuple(r[1:]) for r in run(f"{tmp_path}/in", "whole").select(columns).collect()}
    assert whole == plain_status(rows, 3e5, 1e5)
    write(spark, rows[:50], f"{tmp_path}/a", 0)
    for i in (0, 1):
        write(spark, rows[50 * (i + 1):50 * (i + 2)], f"{tmp_path}/b", i)
    saved = run(f"{tmp_path}/a", "first")
    second = run(f"{tmp_path}/b", "second", saved)
    split = {r[0]: tuple(r[1:]) for r in saved.select(columns).collect()} | {r[0]: tuple(r[1:]) for r in second.select(columns).collect()}
    assert split == whole


def test_the_session_setting_comes_back(spark):
    before = spark.conf.get(state.STORE[0], None)
    with streams.state_store(spark):
        assert spark.conf.get(state.STORE[0]) == state.STORE[1]
    assert spark.conf.get(state.STORE[0], None) == before
