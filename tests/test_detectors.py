"""Detectors against plain sequential loops, over slices that cut through every state."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import calibrate
from trackweave.operators import decide as dc
from trackweave.plans.track import Track

SCHEMA = "flight string, row_pos long, t double, ground boolean, a double, b double"


def random_rows(seed, n=400):
    rnd, rows, pos = random.Random(seed), [], 0
    for f in ("f1", "hot"):
        t = 1000.0
        for _ in range(n if f == "hot" else n // 8):
            t += rnd.choice([0.0, 1.0, 5.0, 20.0, 20.0, 70.0, -3.0])
            g = rnd.choice([False] * 14 + [True, None])
            a = rnd.choice([None, None, float("nan"), 1.0, 2.5, 4.0, -3.0, 9.0])
            rows.append((f, pos, t if rnd.random() > 0.01 else None, g, a, rnd.choice([None, 0.2, 1.0, -2.0])))
            pos += 1
    return rows


def loop_page(rows, cal, threshold, max_gap, missing_reset, clip):
    out, state = {}, {}
    prev = None
    fin = lambda v: v is not None and math.isfinite(v)
    for f, pos, t, g, a, b in rows:
        if prev is None or prev[0] != f:
            reason = "flight_start"
        elif g is None or prev[2] is None:
            reason = "unknown_ground_status"
        elif g:
            reason = "on_ground"
        elif prev[2]:
            reason = "ground_transition"
        elif not fin(t) or not fin(prev[1]):
            reason = "invalid_time"
        else:
            dt = t - prev[1]
            reason = "negative_dt" if dt < 0 else "long_gap" if dt > max_gap else "zero_dt" if dt == 0 else "none"
        if reason not in ("none", "zero_dt"):
            state = {c: [0.0, 0.0, 0.0] for c in cal}
        seen = 0
        if reason == "none":
            for c, v in (("a", a), ("b", b)):
                m, s, k = cal[c]
                if fin(v):
                    z = max(-clip, min(clip, (v - m) / s))
                    state[c] = [max(0.0, state[c][0] + z - k), max(0.0, state[c][1] - z - k), 0.0]
                    seen += 1
                else:
                    state[c][2] += dt
                    if state[c][2] >= missing_reset:
                        state[c][0] = state[c][1] = 0.0
        joint = max(v for c in cal for v in state[c][:2])
        out[pos] = (reason, joint, seen > 0 and joint > threshold, state["a"][0], state["b"][1])
        prev = (f, t, g)
    return out


@pytest.mark.parametrize("chunk", [7.0, 1000.0])
def test_page_sums_match_the_sequential_rule(spark, chunk):
    rows = random_rows(5)
    cal = {"a": (1.0, 1.5, 0.3), "b": (0.0, 1.0, 0.2)}
    want = loop_page(rows, cal, 2.0, 60.0, 40.0, 3.0)
    got = dc.page_sums(
        spark.createDataFrame(rows, SCHEMA).repartition(4), Track(("flight",), ("row_pos",), chunk), {k: dc.Calibration(*v) for k, v in cal.items()},
        time="t", on_ground="ground", threshold=2.0, max_gap_s=60.0, missing_reset_s=40.0, z_clip=3.0,
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        reason, joint, alarm, ap, bn = want[r.row_pos]
        assert r.cusum_reset_reason == reason
        assert (r.cusum_joint_score, r.a_cusum_positive, r.b_cusum_negative) == pytest.approx((joint, ap, bn))
        assert r.cusum_joint_alarm == alarm


def simple_series(n=300, seed=2):
    rnd = random.Random(seed)
    return [("s", i, float(i), rnd.choice([-1.0, 0.2, 0.9, 1.8, 2.5])) for i in range(n)]


@pytest.mark.parametrize("chunk", [11.0, 1e6])
def test_refractory_page_alarms(spark, chunk):
    rows = simple_series()
    s, skip, want = 0.0, 0, set()
    for _, i, _, v in rows:
        if skip:
            skip, s = skip - 1, 0.0
            continue
        s = max(0.0, s + v - 0.8)
        if s > 3.0:
            want.add(i)
            s, skip = 0.0, 4
    df = spark.createDataFrame(rows, "k string, row_pos long, t double, z double").repartition(3)
    got = dc.refractory_page_alarms(df, Track(("k",), ("t", "row_pos"), chunk), z=F.col("z"), slack=0.8, threshold=3.0, refractory_rows=4)
    assert got.count() == len(rows)
    assert {r.row_pos for r in got.filter("onset").collect()} == want and want


def test_crossing_alarms(spark):
    rows = simple_series(seed=9)
    prev, last, want = 0.0, -math.inf, set()
    for _, i, t, v in rows:
        if prev < 1.5 <= v and t - last >= 7:
            want.add(i)
            last = t
        prev = v
    df = spark.createDataFrame(rows, "k string, row_pos long, t double, z double")
    got = dc.crossing_alarms(df, Track(("k",), ("t", "row_pos"), 13.0), score="z", reset=F.lit(False), threshold=1.5, refractory_s=7.0)
    assert {r.row_pos for r in got.collect()} == want


def test_a_folded_group_goes_on_over_batches(spark):
    # of a batch of four rows, a5 b1 b1 b5, a frame lists the groups as a5 b5 b1
    rows = [("a", 5, 0), ("b", 1, 0), ("b", 1, 1), *[("b", 5, i) for i in range(9)]]
    df = spark.createDataFrame(rows, "k string, g long, i long")

    def third(pdf, state):
        seen = state.get("n", 0) + np.arange(1, len(pdf) + 1)
        state["n"] = int(seen[-1])
        return seen % 3 == 0

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = dc.fold_groups(df, ["k", "g"], ["i"], third, out="on").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.i) for r in got if r.on} == {("b", 2), ("b", 5), ("b", 8)}


def test_a_sum_at_the_threshold_does_not_hang_on_its_last_digit(spark):
    below, above = 0.3 + 0.6 + 0.1, 0.1 + 0.2
    assert below < 1.0 and above > 0.3
    rows = spark.createDataFrame([("s", 0, 0.0, 0.0, 0), ("s", 1, 1.0, below, 0)], "k string, row_pos long, t double, z double, block long")
    tr = Track(("k",), ("t", "row_pos"), 13.0)
    got = dc.crossing_alarms(rows, tr, score="z", reset=F.lit(False), threshold=1.0, refractory_s=7.0)
    assert [(r.row_pos, r.z) for r in got.collect()] == [(1, below)]
    counts = calibrate.crossing_counts(rows, tr, score="z", reset=F.lit(False), candidates=[1.0], refractory_s=7.0, block="block")
    assert [(r.h, r.onsets) for r in counts.collect()] == [(1.0, 1)]
    page = spark.createDataFrame([("f", i, float(i), False, v) for i, v in enumerate([0.0, 0.1, 0.2, 0.1])], "flight string, row_pos long, t double, ground boolean, a double")
    out = dc.page_sums(page, Track(("flight",), ("row_pos",), 7.0), {"a": dc.Calibration(0.0, 1.0, 0.0)}, time="t", on_ground="ground", threshold=0.3)
    assert [r.cusum_joint_alarm for r in out.orderBy("row_pos").collect()] == [False, False, False, True]


def test_scores_are_rounded_from_settled_sums(spark):
    from trackweave.suites.calibration import fresh

    # 0.5 / 30 and 1 / 30 add up to 0.05, in doubles to a little less
    rows = [("s", i, float(i), False, x) for i, x in enumerate([50.0, 53.0, 53.5])]
    df = spark.createDataFrame(rows, "k string, row_pos long, t double, on_ground boolean, x double")
    got = fresh(df, Track(("k",), ("t", "row_pos"), 13.0)).orderBy("row_pos").collect()
    assert [r.cusum_score for r in got] == [0.0, 0.0, 0.1]


def test_temporal_evidence(spark):
    rows = [("f", i, t, p) for i, (t, p) in enumerate([(0, 0.5), (10, 0.01), (20, 0.01), (30, 0.5), (40, 0.01), (200, 0.01), (210, 0.01)])]
    df = spark.createDataFrame([(k, i, float(t), p) for k, i, t, p in rows], "k string, row_pos long, t double, p double")
    tr = Track(("k",), ("t", "row_pos"), 15.0)
    got = dc.temporal_evidence(df, tr, p_value="p", alpha=0.05, mode="persistence", max_gap_s=60.0, persistence_s=20.0).orderBy("row_pos").collect()
    assert [r.temporal_evidence for r in got] == [0, 10, 20, 0, 10, 0, 10]
    assert [r.alarm for r in got] == [False, False, True, False, False, False, False]
    assert [r.reset_reason for r in got][0] == "flight_start" and got[5].reset_reason == "invalid_or_large_gap"
    acc = dc.temporal_evidence(df, tr, p_value="p", alpha=0.05, mode="accumulation", max_gap_s=60.0, reference_surprisal=1.0, accumulation_threshold=50.0)
    e, want, last = 0.0, [], None
    for _, _, t, p in rows:
        dt = None if last is None else t - last
        e = 0.0 if dt is None or dt <= 0 or dt > 60 else max(0.0, e + dt * (-math.log(p) - 1.0))
        want.append(e)
        last = t
    assert [r.temporal_evidence for r in acc.orderBy("row_pos").collect()] == pytest.approx(want)
    with pytest.raises(ValueError):
        dc.temporal_evidence(df, tr, p_value="p", alpha=0.05, mode="persistence", max_gap_s=60.0, persistence_s=1.0, reference_surprisal=1.0)


def test_stream_in_any_order_equals_batch(spark, tmp_path):
    """Rows of one entity over micro-batches out of order; a closing row passes the watermark over all."""
    from trackweave.streaming import keyed, live

    rows = [(k, i, t, z, True) for k, i, t, z in simple_series()]
    df = spark.createDataFrame(rows, "k string, row_pos long, t double, z double, ok boolean")
    for part in (2, 0, 1):
        df.filter(F.col("row_pos") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(None, -1, 1e9, None, None)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = keyed.page_sums(s, entity="k", time="t", position="row_pos", value="z", evaluable="ok", slack=0.5, max_gap_s=10.0, delay="1 day", slice_s=60.0)
    q = live.per_batch(out, live.append_batches(str(tmp_path / "out")), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    found = live.read_batches(spark, str(tmp_path / "out"), out.schema).collect()
    got = {r.row_pos: r.cusum_score for r in found}
    want = dc.simple_page_sums(df, Track(("k",), ("t", "row_pos"), 17.0), {"z": F.col("z")}, slack=0.5, max_gap_s=10.0, evaluable=F.col("ok"))
    want = {r.row_pos: r.cusum_score for r in want.collect()}
    assert len(found) == len(got)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def states(q):
    return [s for p in q.recentProgress for s in p["stateOperators"]]


@pytest.mark.parametrize("held", [262_144, 5])
def test_rows_wait_outside_the_python_state(spark, tmp_path, monkeypatch, held):
    """A batch that completes no slice touches no sums; complete slices are folded at once, also those that do not fit in memory."""
    from trackweave.streaming import keyed, live

    monkeypatch.setattr(keyed, "_HELD", held, raising=False)
    monkeypatch.setattr(keyed, "_PIECE", 4, raising=False)
    rows = [(k, i, t, z if i % 11 else None, i % 13 != 0) for k, i, t, z in simple_series()] + [("n", -2, float("nan"), 1.0, True), ("n", -3, None, 1.0, True)]
    df = spark.createDataFrame(rows, "k string, row_pos long, t double, z double, ok boolean")
    for part in (1, 2, 0):
        df.filter(F.pmod("row_pos", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(None, -1, 1e9, None, None)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = keyed.page_sums(s, entity="k", time="t", position="row_pos", value="z", evaluable="ok", slack=0.5, max_gap_s=10.0, delay="1 day", slice_s=60.0)
    q = live.per_batch(out, live.append_batches(str(tmp_path / "out")), str(tmp_path / "ck"), once=True)
    q.awaitTermination()
    found = live.read_batches(spark, str(tmp_path / "out"), out.schema).collect()
    df = df.filter("row_pos >= 0")
    want = dc.simple_page_sums(df, Track(("k",), ("t", "row_pos"), 17.0), {"z": F.col("z")}, slack=0.5, max_gap_s=10.0, evaluable=F.col("ok"))
    want = {(r.k, r.row_pos): (r.reset, pytest.approx(r.cusum_score)) for r in want.collect()}
    assert len(found) == len(want) and {(r.k, r.row_pos): (r.reset, r.cusum_score) for r in found} == want
    sums = [s for s in states(q) if s["operatorName"].startswith("transformWithState")]
    keys = df.select("k").distinct().count()
    assert [s["numRowsUpdated"] for s in sums[:-1]] == [0] * (len(sums) - 1)
    assert sums[-1]["numRowsTotal"] == keys


def test_stream_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """Four micro-batches and the closing row, in as many files as their size asks for."""
    from trackweave.suites import live_streams

    monkeypatch.setattr(live_streams, "FILE_ROWS", 50, raising=False)
    monkeypatch.setattr(live_streams, "scratch", lambda spark, name: str(tmp_path / name))
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    s = live_streams.stream(spark, "/root/testdata/sf0.001", mixed=True, closing=True)
    assert len(list((tmp_path / "live" / "in").glob("*.parquet"))) == 4 * -(-n // 200) + 1
    seen = []
    q = s.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda b, i: seen.append(b.count())).start()
    q.awaitTermination()
    assert [c for c in seen if c] == [n // 4] * 4 + [1]


def test_latest_touches_only_the_keys_of_a_batch(spark, tmp_path):
    from trackweave.streaming import keyed, live

    schema = "k string, t double, v long"
    spark.createDataFrame([(f"k{i}", 1.0, i) for i in range(500)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("k3", 2.0, 33), ("k4", 0.5, 44), ("new", 0.0, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    how = dict(key=["k"], order=["t", "v"])
    out = keyed.latest(s, **how)
    q = live.per_batch(out, live.append_batches(str(tmp_path / "out")), str(tmp_path / "ck"), once=True, mode="update")
    q.awaitTermination()
    assert [(s["numRowsUpdated"], s["numRowsTotal"]) for s in states(q)][:2] == [(500, 500), (3, 501)]
    table = keyed.newest(live.read_batches(spark, str(tmp_path / "out"), out.schema), **how)
    got = {r.k: r.v for r in table.collect()}
    assert len(got) == 501 and (got["k3"], got["k4"], got["new"]) == (33, 4, 1)


def test_keys_of_old_cycles_leave_the_state(spark, tmp_path):
    from trackweave.streaming import keyed, live

    schema, order = "k string, c long, t double", ["c", "t"]
    for n, rows in enumerate([[("a", 1, 0.0), ("b", 1, 0.0), ("c", 1, 0.0)], [("a", 2, 1.0), ("b", 3, 2.0)], [("b", 5, 4.0), ("a", 4, 3.0), ("a", 3, 2.5)], [("b", 6, 5.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = keyed.cycle_changes(s, key="k", cycle="c", order=order)
    q = live.per_batch(out, live.append_batches(str(tmp_path / "out")), str(tmp_path / "ck"), once=True, mode="update")
    q.awaitTermination()
    changes = live.read_batches(spark, str(tmp_path / "out"), out.schema)
    table = keyed.present(changes, key="k", order=order)
    # c was last seen five cycles ago, a two, which the watermark has reached after the last batch
    assert {(r.k, r.c) for r in live.sweep_cycles(table.filter("c >= 5"), cycle="c").collect()} == {("b", 6)}
    assert {r.k for r in table.collect()} <= {"a", "b"} and changes.filter("gone AND k = 'c'").count() == 1
    assert states(q)[-1]["numRowsTotal"] < 6
