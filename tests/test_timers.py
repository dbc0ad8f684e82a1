"""Stateful streams: the same as folds in order, whatever the order of arrival; state ends by timers."""

import random

import pytest
from pyspark.sql import functions as F
from sparkloom.streaming import bus, timers

MINUTE = 60_000


def run(spark, tmp_path, make, files, name):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "k string, ms long, v string").withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    stream = bus.source(spark, f"{tmp_path}/{name}", "k string, ms long, v string, ts timestamp", 1)
    with timers.rocksdb(spark):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = [tuple(r) for r in spark.table(name).where("k <> 'end'").collect()]
    last = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    return sorted(rows), last


@pytest.fixture(scope="module")
def events():
    rng = random.Random(4)
    rows = sorted(((rng.choice("abc"), rng.randrange(0, 300) * MINUTE // 2, rng.choice(["x", "y", "z"])) for _ in range(60)), key=lambda r: r[1])
    rows = list({r[:2]: r for r in rows}.values())
    files = [rows[i : i + 12] for i in range(0, len(rows), 12)]
    for f in files:
        rng.shuffle(f)
    moved = files[1].pop()  # out of order, but not behind the watermark
    files[2].append(moved)
    return rows, files


def test_heartbeats_and_late_rows(spark, tmp_path, events):
    rows, files = events
    late = ("a", 1, "late")
    found, state = run(spark, tmp_path, lambda s: timers.heartbeats(s, "k", "ts", 20 * MINUTE, "60 minutes"), [*files, [("end", 10_000 * MINUTE, "x")], [late]], "beats")
    expected = []
    for k in "abc":
        times = sorted(r[1] for r in rows if r[0] == k)
        group = [times[0]]
        for t in times[1:]:
            if t - group[-1] >= 20 * MINUTE:
                expected.append((k, group[0], group[-1], len(group)))
                group = []
            group.append(t)
        expected.append((k, group[0], group[-1], len(group)))
    assert found == sorted(expected)
    assert sum(p["numRowsDroppedByWatermark"] for p in state) == 1  # the late row, counted


def test_cooldown(spark, tmp_path, events):
    rows, files = events
    found, _ = run(spark, tmp_path, lambda s: timers.cooldown(s, "k", "ts", 10 * MINUTE, "60 minutes"), [*files, [("end", 10_000 * MINUTE, "x")]], "cool")
    expected = []
    for k in "abc":
        last = None
        for t in sorted(r[1] for r in rows if r[0] == k):
            if last is None or t - last >= 10 * MINUTE:
                last = t
                expected.append((k, t))
    assert found == sorted(expected)


def test_durations(spark, tmp_path, events):
    rows, files = events
    found, _ = run(spark, tmp_path, lambda s: timers.durations(s, "k", "ts", "v", 15 * MINUTE, "60 minutes"), [*files, [("end", 10_000 * MINUTE, "x")]], "spent")
    expected = []
    for k in "abc":
        mine = sorted((t, v) for x, t, v in rows if x == k)
        for (t, v), (u, _) in zip(mine, [*mine[1:], (1 << 60, "")]):
            expected.append((k, v, t, min(u - t, 15 * MINUTE), u - t >= 15 * MINUTE))
    assert found == sorted(expected)


@pytest.mark.parametrize("name", ["stream_state_times", "stream_windows"])
def test_results_in_files(spark, name):
    """What a stream gives out lies in files, not in the driver's memory."""
    from sparkloom.plans import stores

    rows = stores.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and all(".parquet" in f for f in rows.inputFiles()) and rows.inputFiles()
