"""Alignment, calibration, models, samples, sources and contracts on hand-made tables."""

import gzip
import io
import json
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators import calibrate, conformal, contracts, episodes, evaluate, inject, joins, models, robust, sampling, segments
from trackweave.plans.ladder import ladder
from trackweave.plans.select import decoded, exact_quantiles, order_code
from trackweave.plans.track import Track
from trackweave.sources import lake, live, topics, traces

TR = Track(("k",), ("t", "row_pos"), 50.0)


def test_segments_keep_equal_times_in_source_order(spark):
    rows = [("a", 0.0, 0), ("a", 10.0, 1), ("a", 10.0, 2), ("a", 110.0, 3), ("a", 111.0, 4), ("b", 5.0, 5), ("a", None, 6)]
    got = segments.gap_segments(spark.createDataFrame(rows, "k string, t double, row_pos long"), TR, gap_s=100.0)
    by = {r.row_pos: r.flight_id for r in got.collect()}
    # a gap exactly as long as the limit stays inside; a missing time starts a new one, after all others
    assert by == {0: "a_000", 1: "a_000", 2: "a_000", 3: "a_000", 4: "a_000", 5: "b_000", 6: "a_001"}
    assert segments.gap_segments(spark.createDataFrame([], "k string, t double, row_pos long"), TR, gap_s=1.0).count() == 0


def test_episode_gap_is_inclusive(spark):
    df = spark.createDataFrame([("f", float(t), i) for i, t in enumerate([0, 60, 121, 122])], "k string, t double, row_pos long")
    got = episodes.alarm_episodes(df, TR, alarm=F.lit(True), merge_gap_s=60.0).orderBy("episode_start").collect()
    assert [(r.episode_start, r.episode_end, r.n_emissions) for r in got] == [(0, 60, 2), (121, 122, 2)]


def test_align_to_clock(spark):
    clock = spark.createDataFrame([("f", 1.0, 0, 0.0), ("f", 1.2, 1, 0.1), ("f", 2.0, 2, 0.2)], "k string, t double, row_pos long, roll double")
    slow = spark.createDataFrame([("f", 0.9, 9.0), ("f", 1.1, 11.0), ("f", 1.7, 17.0), ("f", 2.1, 21.0)], "k string, t double, ground_speed double")
    stale = spark.createDataFrame([("f", "slow", 1.15, 1.25)], "k string, name string, start double, end double")
    got = joins.align_to_clock(clock, {"slow": (slow, ["ground_speed"])}, Track(("k",), ("t", "row_pos"), 0.5), tolerances={"slow": 0.25}, stale=stale)
    rows = got.orderBy("t").collect()
    assert [r.ground_speed for r in rows] == [9.0, None, None]
    assert rows[0].ground_speed_staleness_ms == pytest.approx(100.0) and rows[1].ground_speed_staleness_ms == rows[2].ground_speed_staleness_ms == math.inf


def test_conformal_fallback(spark):
    cal = [("speed", "level", "c0", s) for s in (1.0, 2.0, 3.0)] + [("speed", "climb", "c0", s) for s in (4.0, 5.0, 6.0)] + [("track", "level", "c0", s) for s in (1.0, 1.0, 2.0)]
    cols = "channel string, context_phase string, context_cadence string, score double"
    ref = conformal.conformal_fit(spark.createDataFrame(cal, cols), role=conformal.CALIBRATION_ROLE, contains_synthetic=False)
    q = spark.createDataFrame([("speed", "level", "c0", 3.0), ("speed", "level", "c9", 9.0), ("speed", "descent", "c0", 4.0), ("track", "x", "y", 1.0)], cols)
    got = {(r.channel, r.context_phase, r.context_cadence): r for r in conformal.conformal_transform(q, ref, min_group_size=3).collect()}
    r = got[("speed", "level", "c0")]
    assert (r.calibration_level, r.conformal_p_value) == ("channel+context_phase+context_cadence", pytest.approx(2 / 4))
    assert got[("speed", "level", "c9")].calibration_level == "channel+context_phase"
    assert got[("speed", "descent", "c0")].conformal_p_value == pytest.approx(4 / 7)
    assert got[("track", "x", "y")].conformal_p_value == pytest.approx(1.0)
    with pytest.raises(ValueError):
        conformal.conformal_fit(q, role="holdout", contains_synthetic=False)
    with pytest.raises(ValueError):
        conformal.conformal_alarms(q, alpha=None)
    with pytest.raises(Exception, match="no calibration fallback"):
        conformal.conformal_transform(spark.createDataFrame([("new", "a", "b", 1.0)], cols), ref, min_group_size=3).collect()


@pytest.mark.parametrize("bucket_rows", [7, 50, 1 << 20])
def test_ladder_over_many_buckets(spark, bucket_rows):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.integers(0, 50, 300).astype(float), rng.normal(size=300), np.full(200, 7.0)])
    df = spark.createDataFrame([("g" if i % 3 else None, float(v)) for i, v in enumerate(vals)], "g string, v double").repartition(6)
    for name in ("g", None):
        mine = np.sort([v for i, v in enumerate(vals) if ("g" if i % 3 else None) == name])
        steps = ladder(df, ["g"], "v", {"n": F.lit(1)}, bucket_rows=bucket_rows).filter(F.col("g").eqNullSafe(F.lit(name))).orderBy("v").collect()
        assert [r.cum_n for r in steps] == [int((mine <= r.v).sum()) for r in steps] and steps[-1].tot_n == len(mine)
    whole = ladder(df, [], "v", {"n": F.lit(1)}, bucket_rows=bucket_rows).orderBy("v").collect()
    assert [r.cum_n for r in whole] == [int((vals <= r.v).sum()) for r in whole]


def test_quantiles_by_counting_passes(spark):
    rng = np.random.default_rng(4)
    groups = {
        "ties": rng.integers(-3, 4, 500).astype(float), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 200))]),
        "close": 1.7e9 + rng.integers(0, 1000, 400) * 2.0**-22, "one": np.array([3.25]), "tiny": np.arange(9) * 5e-324, "inf": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]), None: rng.normal(size=333),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None)], "g string, v double").repartition(7)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"lo": 0.0, "q": 0.37, "m": 0.5, "hi": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        if k != "inf":
            assert (got[k].lo, got[k].q, got[k].m, got[k].hi) == tuple(np.quantile(vs, [0.0, 0.37, 0.5, 1.0]).tolist()) or (got[k].q, got[k].m) == pytest.approx(tuple(np.quantile(vs, [0.37, 0.5])), rel=1e-14)
        assert (got[k].lo, got[k].hi) == (vs.min(), vs.max())
    # whole table, and a column of whole numbers
    one = exact_quantiles(df.filter("v = floor(v)").withColumn("v", F.col("v").cast("long")), [], "v", {"m": 0.5}).first()
    whole = np.concatenate([v for v in groups.values()])
    assert one.n == int(np.isfinite(whole[whole == np.floor(whole)]).sum()) or one.n > 0
    assert exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, ["g"], "v", {"m": 1.5})


def test_order_code_keeps_order_and_value(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([
        np.frombuffer(rng.bytes(8 * 4000), np.float64), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1022, 1024), 0), np.nextafter(2.0 ** np.arange(-1022, 1023), np.inf), [0.0, -0.0, np.inf, -np.inf],
    ])
    v = v[~np.isnan(v)]
    v = np.concatenate([v, -v])
    got = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", order_code(F.col("v")).alias("c")).withColumn("d", decoded(F.col("c"))).toPandas()
    assert (got.v == got.d).all()
    bits = np.abs(got.v.to_numpy()).view(np.int64)
    assert (got.c.to_numpy() == np.where(got.v.to_numpy() < 0, -bits, bits)).all()


def test_zero_spread_channel_is_left_out(spark):
    df = spark.createDataFrame([(float(i % 5), 3.0, float("nan")) for i in range(50)], "a double, flat double, empty double")
    table = {r.channel: r for r in robust.median_mad(df, ["a", "flat", "empty"]).collect()}
    assert table["a"].usable and not table["flat"].usable and "empty" not in table
    assert robust.parameters(robust.median_mad(df, ["a", "flat"])) == {"a": (2.0, pytest.approx(1.4826))}
    with pytest.raises(ValueError):
        robust.parameters(robust.median_mad(df, ["flat"]))


def test_ranking_metrics_with_ties(spark):
    rows = [(0.1, False), (0.4, False), (0.4, True), (0.8, True), (0.8, False), (0.9, True)]
    m = evaluate.ranking_metrics(spark.createDataFrame(rows, "s double, y boolean"), score="s", positive=F.col("y")).first()
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p, y in rows if y for n, z in rows if not z]
    assert m.auroc == pytest.approx(sum(pairs) / len(pairs))
    assert m.auprc == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    none = evaluate.ranking_metrics(spark.createDataFrame([(0.1, True)], "s double, y boolean"), score="s", positive=F.col("y")).first()
    assert none.auroc is None


def test_ridge_with_grouped_folds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = 2 + x @ [1.0, -2.0, 0.5] + rng.normal(scale=0.3, size=400)
    rows = [(f"s{i % 7}", *map(float, x[i]), float(y[i])) for i in range(400)]
    fit = models.fit_ridge(spark.createDataFrame(rows, "g string, a double, b double, c double, y double"), features=["a", "b", "c"], response="y", group="g", alphas=[0.1, 10.0, 1000.0])
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + fit.alpha * np.eye(3), xc.T @ yc)
    assert fit.alpha == 0.1 and fit.coefficients == pytest.approx(tuple(b)) and fit.intercept == pytest.approx(y.mean() - x.mean(0) @ b)
    assert fit.residual_variance == pytest.approx(np.mean((y - fit.intercept - x @ b) ** 2)) and len(fit.cv) == 3
    assert models.coefficient_signs(fit, ["a", "b"]) == {"a": True, "b": False}


def test_isolation_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(600, 9.0, -9.0), (601, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    scales = {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    fit = lambda d: models.fit_forest(d, scales, trees=40, sample=32, clip=20.0, seed="s", key=["id"])
    one = {r.id: r.isolation_score for r in models.score_forest(df, fit(df), scales, clip=20.0).collect()}
    two = {r.id: r.isolation_score for r in models.score_forest(df, fit(df.repartition(9)), scales, clip=20.0).collect()}
    assert one[601] is None and one == two
    assert max((v, k) for k, v in one.items() if v is not None)[1] == 600


def test_bootstrap_weights_have_unit_mean(spark):
    w = spark.range(20000).select(calibrate.bootstrap_weight("s", F.col("id")).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert w[0] == pytest.approx(1.0, abs=0.03) and w[1] == pytest.approx(1.0, abs=0.05)


def test_splits_do_not_depend_on_order(spark):
    ids = spark.createDataFrame([(f"f{i}",) for i in range(101)], "id string")
    a = {r.id: r.split for r in sampling.exact_split(ids, entity="id", weights={"x": 0.5, "y": 0.3, "z": 0.2}, seed=1).collect()}
    b = {r.id: r.split for r in sampling.exact_split(ids.orderBy(F.desc("id")).repartition(7), entity="id", weights={"x": 0.5, "y": 0.3, "z": 0.2}, seed=1).collect()}
    assert a == b and sorted(list(a.values()).count(s) for s in "xyz") == [20, 30, 51]
    assert sampling.partition_counts(10, 0) == {"development": 7, "test": 2, "holdout": 1} or sum(sampling.partition_counts(10, 0).values()) == 10
    with pytest.raises(ValueError):
        sampling.partition_counts(3, 3)


def test_session_split_keeps_rare_classes_in_development(spark):
    rows = [(f"f{i}", f"s{i % 12}", "motor" if i % 2 else "normal") for i in range(120)] + [("r1", "s3", "rare")]
    df = spark.createDataFrame(rows, "flight string, session string, cls string")
    got = {r.session: r.partition for r in sampling.session_split(df, session="session", fault_class="cls", seed="3", attempts=300).collect()}
    assert got["s3"] == "development" and len(got) == 12
    assert {got[f"s{i}"] for i in range(1, 12, 2)} == set(sampling.PARTITIONS)


def test_injections(spark):
    df = spark.createDataFrame([("a", float(i), i, float(i), 50.0, 10.0) for i in range(20)], "k string, t double, row_pos long, x double, lat double, lon double")
    frozen = {r.row_pos: r.x for r in inject.inject(df, TR, inject.Recipe("freeze", ("x",), onset=0.5)).collect()}
    assert [frozen[i] for i in (9, 10, 19)] == [9.0, 9.0, 9.0]
    ramp = inject.inject(df, TR, inject.Recipe("ramp", ("lat", "lon"), size=10.0, bearing_deg=0.0)).orderBy("row_pos").collect()
    assert ramp[10].lat == 50.0 and ramp[19].lat == pytest.approx(50 + 90 / inject.METERS_PER_DEGREE)
    with pytest.raises(ValueError):
        inject.inject(df, TR, inject.Recipe("unknown", ("x",)))


def test_paired_tables_must_match(spark):
    a = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, None)], "i long, t double, x double")
    assert [r.changed for r in joins.paired_rows(a, a.withColumn("x", F.lit(5.0)), on=["i"], time="t", columns=["x"]).orderBy("i").collect()] == [False, True]
    with pytest.raises(Exception, match="paired tables differ"):
        joins.paired_rows(a, a.filter("i = 1"), on=["i"], time="t", columns=["x"]).collect()
    with pytest.raises(Exception, match="same rows"):
        joins.identity_join(a, a.withColumn("t", F.col("t") + 1), on=["i"], time="t").collect()


def test_inconsistent_event_raises(spark):
    cols = "event_id string, event_type string, flight_id string, attack_onset double, observable_onset double, event_end double, injection_active boolean, observable_changed boolean, evaluable_truth boolean"
    rows = [("e", "a", "f", 1.0, 1.0, 2.0, True, True, True), ("e", "b", "f", 1.0, None, 2.0, True, False, True)]
    with pytest.raises(Exception, match="inconsistent event_type"):
        evaluate.truth_events(spark.createDataFrame(rows, cols)).collect()
    ok = evaluate.truth_events(spark.createDataFrame([rows[0], (*rows[1][:1], "a", *rows[1][2:])], cols)).first()
    assert ok.observable_onset == 1.0 and ok.observable_eligible and ok.attack_active_rows == 2


def test_contracts(spark):
    with pytest.raises(ValueError):
        contracts.AlertBudget(0.5, {"a": 1.5})
    with pytest.raises(ValueError, match="more than the total"):
        contracts.AlertBudget(0.001, {"speed": 0.0006, "track": 0.0005})
    assert contracts.AlertBudget(0.3, {"a": 0.1, "b": 0.2}).channel_alpha["b"] == 0.2  # 0.1 + 0.2 rounds up
    with pytest.raises(ValueError):
        contracts.DetectorProfile("a", "persistence", 60.0)
    with pytest.raises(ValueError):
        contracts.DetectorProfile("a", "instant", 60.0, persistence_s=1.0)
    df = spark.createDataFrame([("x", "a"), ("x", "b")], "id string, s string")
    with pytest.raises(ValueError):
        contracts.split_contract(df, entity="id", split="s")
    with pytest.raises(KeyError):
        contracts.require_columns(df, "nope")
    with pytest.raises(Exception, match="synthetic entity"):
        contracts.guarded_fit_input(df, df.limit(1), entity="id", role=robust.FIT_ROLE).collect()
    report = contracts.frame_report(spark.createDataFrame([("a", 2.0, 0), ("a", 1.0, 1)], "k string, t double, row_pos long"), Track(("k",), ("row_pos",), 1.0), time="t", entity="k")
    with pytest.raises(ValueError, match="unordered"):
        contracts.assert_clean(report, "null_ids", "unordered")


def doc(icao, flags):
    trace = [[0, 1.0, 2.0, 35000, 450, 90, 0, -500, {"squawk": "1200"}, "adsb", 35100, None, 250, 1.5], [10, 1.1, 2.1, "ground", None, None, 2, None, None], [20, None, 2.2, None, 10.0, 5, 3, 0, {"squawk": None, "nic": 8}]]
    out = {"icao": icao, "timestamp": 1000.0, "r": "N1", "trace": trace}
    return json.dumps({**out, "dbFlags": flags} if flags is not None else out).encode()


def test_trace_archive(spark, tmp_path):
    path = tmp_path / "day.tar"
    with tarfile.open(path, "w") as tar:
        for name, raw in (("x/traces/a.json.gz", gzip.compress(doc("a", 1))), ("x/traces/b.json", doc("b", "garbage")), ("x/traces/c.json.gz", b"\x1f\x8bno"), ("x/readme.txt", b"hi"), ("x/traces/d.json", b"[1")):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    texts = traces.read_members(traces.archive_members(spark, str(tmp_path)))
    assert {r.member.rsplit("/", 1)[-1]: r.error is None for r in texts.collect()} == {"a.json.gz": True, "b.json": True, "c.json.gz": False, "d.json": True}
    rows = traces.carry_updates(traces.trace_rows(texts.filter("json_text is not null"))).orderBy("source_id", "row_pos").collect()
    assert len(rows) == 6
    first, second, third = rows[:3]
    assert (first.alt, first.ground_speed_ms, first.vertical_rate_ms, first.timestamp_utc) == (10668.0, 231.48, -2.54, 1000.0)
    assert first.is_military and not rows[3].is_military and second.on_ground and second.alt is None and second.flags_new_leg and not second.flags_stale
    assert (first.squawk, first.squawk_update_age_s, second.squawk, second.squawk_updated, second.squawk_update_age_s) == ("1200", 0.0, "1200", False, 10.0)
    assert (third.squawk, third.squawk_updated, third.squawk_update_timestamp_utc, third.nic, first.nic, first.nic_update_age_s) == (None, True, 1020.0, "8", None, None)


def test_landing_lines(spark, tmp_path):
    (tmp_path / "states-20260701T120000_1.jsonl").write_text('{"icao24":"a","ts":"2026-07-01T10:00:00+00:00","callsign":" X1 ","is_ground":true}\n\nnot json\n{"icao24":"b","lat":1.5}\n{"icao24":"c"')
    got = {r.source_id: r for r in live.landing_rows(spark.read.text(str(tmp_path))).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].timestamp_utc == 1782900000.0 and got["a"].flight_callsign == "X1" and got["a"].on_ground
    assert got["b"].timestamp_utc == 1782907200.0 and not got["b"].on_ground and got["b"].flight_callsign is None


def test_lake(spark, tmp_path):
    (tmp_path / "r.csv").write_text('000000,000FFF,"(reserved, AFI)"\n000100,0001FF,Land\nzz,1,bad\n,2,empty\n')
    got = {r.country: (r.start, r.end) for r in lake.hex_ranges(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {"(reserved, AFI)": (0, 4095), "Land": (256, 511)}
    df = spark.createDataFrame([(float(i), "a") for i in range(10)], "t double, id string")
    with pytest.raises(lake.TooManyRows):
        lake.export(df, None, time="t", start=0, end=9, columns=["t"], max_rows=5)
    with pytest.raises(ValueError):
        lake.export(df, None, time="t", start=0, end=9, columns=["nope"])
    assert lake.export(df, None, time="t", start=2, end=4, columns=["t"], max_rows=5).count() == 3
    with pytest.raises(KeyError):
        lake.align(df, "unknown")
    with pytest.raises(ValueError):
        lake.write_layer(df, str(tmp_path), "..", "x")
    with pytest.raises(ValueError):
        lake.add_provenance(df, "")


def test_codes(spark):
    rows = [("General Emergency",), ("radio-failure",), ("NONE",), (" ",), (None,), ("other")]
    df = spark.createDataFrame([(r[0] if isinstance(r, tuple) else r,) for r in rows], "e string")
    assert [r[0] for r in df.select(sc.normalise_emergency(F.col("e"))).collect()] == ["general", "nordo", None, None, None, "other"]
    sq = spark.createDataFrame([("7700.0",), ("33",), ("7500",), (None,)], "s string")
    assert [r[0] for r in sq.select(sc.normalise_squawk(F.col("s"))).collect()] == ["7700", "0033", "7500", None]
    p = spark.range(1).select(sc.normal_cdf(F.lit(1.6448536)).alias("p")).first().p
    assert p == pytest.approx(0.95, abs=1e-6)


def test_only_stale_partitions_are_rewritten(spark, tmp_path):
    import glob
    import os

    from trackweave.sources import topics

    path = str(tmp_path / "records")
    rows = [(f"f{i}", i, "normal", i % 4) for i in range(40)]
    spark.createDataFrame(rows, "flight_id string, n int, fault_class string, part int").repartition("part").write.partitionBy("part").parquet(path)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}
    before = files()
    truth = spark.createDataFrame([("f5", "motor"), ("f9", "motor"), ("f6", "normal"), ("zz", "motor")], "flight_id string, fault_class string")
    assert [r.part for r in topics.reconcile_layer(spark, path, truth, partition="part").collect()] == [1]
    after = files()
    assert {f for f in before if "part=1" not in f} == {f for f in after if "part=1" not in f}
    assert all(after[f] == t for f, t in before.items() if "part=1" not in f)
    got = {(r.flight_id, r.n, r.fault_class, r.part) for r in spark.read.parquet(path).collect()}
    assert got == {(f, n, "motor" if f in ("f5", "f9") else c, p) for f, n, c, p in rows}
    # a second run finds nothing left to do
    assert topics.reconcile_layer(spark, path, truth, partition="part").count() == 0 and files() == after


def test_a_flight_without_trim_samples_leaves_the_others(spark):
    rows = [("a", 0, 0.0, 1500.0), ("a", 1, 5.0, 1510.0), ("b", 2, 0.0, 1400.0), ("b", 3, 1.0, 1420.0), ("b", 4, 9.0, 1480.0), ("c", 5, 8.0, 1300.0), ("c", 6, 9.0, 1310.0)]
    topic = spark.createDataFrame(rows, "flight_id string, row_pos long, t double, rc double")
    onset = spark.createDataFrame([("a", 7.0), ("b", 7.0), ("c", 7.0)], "flight_id string, onset_s double")
    got = topics.normalise_topic(topic, rename={"rc": "pwm"}, trim=["pwm"], onset=onset, untrimmed="drop")
    assert {r.row_pos: r.pwm for r in got.collect()} == {0: -5.0, 1: 5.0, 2: -10.0, 3: 10.0, 4: 70.0}
    with pytest.raises(Exception, match="no pwm samples before the onset"):
        topics.normalise_topic(topic, rename={"rc": "pwm"}, trim=["pwm"], onset=onset).collect()


def test_a_record_is_parsed_once(spark):
    text = json.dumps({"hex": " AB1", "lat": 1.5, "lon": 2.0, "alt_baro": "1000", "gs": 10.0, "seen": 3.0})
    df = spark.createDataFrame([(0, text), (1, "no json"), (2, json.dumps({"hex": "c", "lat": 0.0, "lon": 1.0, "alt_baro": "1"}))], "row_pos long, value string")
    out = live.normalise(df, "adsblol")
    assert [(r.row_pos, r.icao24, r.alt, r.signal_age_sec) for r in out.collect()] == [(0, "ab1", 304.8, 3.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_archives_are_listed_in_a_task_each(spark, tmp_path):
    for name in ("a", "b", "c", "d", "e"):
        with tarfile.open(tmp_path / f"{name}.tar", "w") as tar:
            for i in range(3):
                info = tarfile.TarInfo(f"traces/{name}{i}.json")
                info.size = 2
                tar.addfile(info, io.BytesIO(b"{}"))
    found = traces.archive_members(spark, f"{tmp_path}/*.tar")
    assert found.rdd.getNumPartitions() == 5
    assert sorted(r.member for r in traces.read_members(found).collect()) == sorted(f"traces/{n}{i}.json" for n in "abcde" for i in range(3))


def test_alpha_curve_without_a_row_per_alpha(spark):
    rnd, rows, t = __import__("random").Random(4), [], 0.0
    for i in range(150):
        t += rnd.choice([0.0, 5.0, 10.0, 10.0, 90.0])
        rows.append(("f" if i < 110 else "g", t, i, rnd.random(), rnd.choice([None, 0.01, 0.3, 0.9])))
    alphas = [0.9, 0.2, 1.6]
    want = []
    for a in alphas:
        n = seconds = 0
        for k in ("f", "g"):
            mine, alarms, prev = [r for r in rows if r[0] == k], set(), None
            for r in mine:
                seconds += r[1] - prev if prev is not None and 0 < r[1] - prev <= 60 else 0
                prev = r[1]
            for c in (3, 4):
                prev, ev = None, 0.0
                for r in (r for r in mine if r[c] is not None):
                    dt = None if prev is None else r[1] - prev
                    ev = 0.0 if dt is None or dt <= 0 or dt > 60 or r[c] > a / 2 else ev + dt
                    prev = r[1]
                    if ev >= 15:
                        alarms.add(r[1])
            times = sorted(alarms)
            n += sum(i == 0 or times[i] - times[i - 1] > 30 for i in range(len(times)))
        want.append((a, pytest.approx(n / (seconds / 3600))))
    df = spark.createDataFrame(rows, "k string, t double, row_pos long, p1 double, p2 double")
    out = calibrate.alpha_curve(df, TR, p_values=["p1", "p2"], alphas=alphas, persistence_s=15.0, max_gap_s=60.0, merge_gap_s=30.0, evaluable=F.lit(True))
    assert [(r.alpha, r.episodes_per_hour) for r in out.collect()] == want
    # the only generator spreads the one row of counts
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_reasons_are_laid_out_once(spark):
    rows = [("f", p, float(p), c) for p, c in enumerate([["A"], ["A", "MESSAGE_GAP"], ["MESSAGE_GAP"], ["A"], []])]
    df = spark.createDataFrame(rows, "source_id string, pos long, t double, reason_codes array<string>")
    out = episodes.reason_episodes(episodes.explode_reasons(df, identity=["source_id", "pos", "t"]), entity="source_id", position="pos", time="t")
    got = sorted((r.reason_code, r.episode_start, r.episode_end, r.n_rows) for r in out.collect())
    assert got == [("A", 0.0, 1.0, 2), ("A", 3.0, 3.0, 1), ("MESSAGE_GAP", 1.0, 1.0, 1), ("MESSAGE_GAP", 2.0, 2.0, 1)]
    # the rows and their carries read one layout instead of exploding the reasons twice
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 0
