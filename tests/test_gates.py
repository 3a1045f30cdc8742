"""Gates, roles and caps: what must raise, and rows that must survive."""

import hashlib
import itertools
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.operators import calibrate as cb
from trackweave.operators import evaluate as ev
from trackweave.operators import models as md
from trackweave.operators import sampling as sp
from trackweave.plans.track import Track, time_frame
from trackweave.suites import calibration  # noqa: F401  (registers the query)
from trackweave.suites.base import QUERIES, telemetry

GATE = {"coverage_min": 0.5, "event_coverage_min": 0.5, "recall_min": 0.5, "wilson_lower_min": 0.3, "per_mode_recall_min": 0.3, "max_rate": 1.0}


@pytest.mark.parametrize("native, cusum, model, selected, passing", [
    (0.6, 0.6, 0.75, "native", 3), (0.4, 0.6, 0.9, "cusum", 2), (0.4, 0.45, 0.52, None, 1), (0.4, 0.45, 0.56, "model", 1), (0.4, 0.3, 0.45, None, 0), (0.4, None, 0.9, None, 1),
])
def test_method_gate(spark, native, cusum, model, selected, passing):
    rows = [(m, 0.9, 0.9, r, 0.4, 0.4, 0.5) for m, r in (("native", native), ("cusum", cusum), ("model", model))]
    m = spark.createDataFrame(rows, "method string, coverage double, event_coverage double, recall double, recall_low double, min_mode_recall double, rate double")
    got = cb.method_gate(m, GATE, order=["native", "cusum", "model"], baseline="cusum", model="model").first()
    assert (got.selected, got.n_passing) == (selected, passing)


def test_exact_distance_counts_all_orders():
    for n, m in ((3, 4), (5, 2), (4, 4)):
        reach = []
        for post in itertools.combinations(range(n + m), m):
            a = b = 0
            top = 0.0
            for k in range(n + m):
                a, b = a + (k not in post), b + (k in post)
                top = max(top, abs(a / n - b / m))
            reach.append(top)
        for d in set(reach):
            assert ev._ks_exact(n, m, d) == pytest.approx(sum(r >= d - 1e-9 for r in reach) / len(reach))
    assert ev._ks_exact(8, 6, 0.5) == pytest.approx(0.302, abs=0.001)
    assert ev._ks_exact(50, 15, 0.47) == pytest.approx(0.0074, abs=0.0003)


def test_pools_of_one_side_are_not_evaluable(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True), ("b", 1.0, True), ("b", 5.0, False)], "g string, v double, post boolean")
    got = {r.g: r.status for r in ev.ks_gate(df, value="v", is_post=F.col("post"), groups=["g"], p_threshold=0.01).collect()}
    assert got == {"a": "not_evaluable", "b": "failed"}


def test_ablation_without_the_commands_features_raises(spark):
    df = spark.createDataFrame([("f", 1.0, 2.0), ("g", 2.0, 1.0)], "flight string, x double, y double")
    kw = dict(response="y", group="flight", alpha=1.0, minimum=1.02)
    with pytest.raises(ValueError, match="throttle"):
        md.ablation_ratio(df, features=["x"], commands=["x", "throttle"], **kw)
    with pytest.raises(ValueError):
        md.ablation_ratio(df, features=["x"], commands=[], **kw)


def test_ablation_of_all_features_compares_with_the_mean(spark):
    df = spark.createDataFrame([(f"f{i % 4}", float(i), 3.0 * i + i % 3) for i in range(40)], "flight string, x__last double, y double")
    got = md.ablation_ratio(df, features=["x__last"], commands=["x"], response="y", group="flight", alpha=1e-6, minimum=1.02).first()
    assert got.ratio > 100 and not got.flagged


def catalog(spark, normal, faulty):
    rows = [(f"n{m}{i:03d}", m, None, False) for m in ("hover", "cruise") for i in range(normal)]
    rows += [(f"f{m}{c}{i:03d}", m, c, False) for m in ("hover", "cruise") for c in ("3", "4") for i in range(faulty)]
    rows += [("q1", "hover", None, True), ("other", "hover", "9", False), ("strange", "drift", None, False)]
    return spark.createDataFrame(rows, "flight string, mode string, fault string, q boolean")


def roles(df):
    return sp.balanced_roles(df, flight="flight", mode="mode", fault="fault", is_fault=F.col("fault").isNotNull(), quarantined=F.col("q"), modes=["hover", "cruise"], faults=["3", "4"])


def test_roles_need_enough_flights(spark):
    for normal, faulty in ((9, 2), (10, 1)):
        with pytest.raises(ValueError, match="fewer than"):
            roles(catalog(spark, normal, faulty))
    got = roles(catalog(spark, 12, 3))
    count = {(r.mode, r.role): r["count"] for r in got.filter("fault IS NULL").groupBy("mode", "role").count().collect()}
    assert count[("hover", "fit")] == 4 and count[("hover", "development")] == 3 and count[("hover", "holdout")] == 2
    by = {r.flight: r.role for r in got.collect()}
    assert by["q1"] == "quarantine" and by["other"] is None and by["strange"] is None and by["fcruise4001"] == "holdout"


def test_rows_without_time_stay_in_time_frames(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", None, 3.0)], schema)
    got = time_frame(df, Track(("k",), ("t",), 10.0), {"s": lambda w: F.sum("v").over(w.rangeBetween(-5, 0))}, before=5)
    assert sorted((r.v, r.s) for r in got.collect() if r.s is not None) == [(1.0, 1.0), (2.0, 3.0)]
    assert [(r.v, r.s) for r in got.collect() if r.t is None] == [(3.0, None)]


def test_session_split_goes_on_until_an_attempt_fits(spark):
    rows = [(f"s{i}", c) for i in range(9) for c in (["motor"] * 3 if i in (0, 1, 2) else ["normal"])]
    df = spark.createDataFrame(rows, "session string, fault string")
    got = sp.session_split(df, session="session", fault_class="fault", seed="x")
    parts = {r.session: r.partition for r in got.collect()}
    assert len(parts) == 9 and {parts[s] for s in ("s0", "s1", "s2")} == {"development", "test", "holdout"}


def test_page_policy_over_50_hours_equals_the_plain_fold(spark):
    """300 blocks of 10 rows drawn one by one, every h folded on its own."""
    sf, tracks = "/root/testdata/sf0.001", {}
    for r in sorted(telemetry(spark, sf).select("source_id", "t", "row_pos", "x").collect(), key=lambda r: (r.source_id, r.t, r.row_pos)):
        p = max(1e-6, min(1 - 1e-6, r.x / (r.x + 40)))
        tracks.setdefault(r.source_id, []).append(math.log(p / (1 - p)))
    g = [v for rows in tracks.values() for v in rows]
    mu = math.fsum(g) / len(g)
    sd = math.sqrt(math.fsum((v - mu) ** 2 for v in g) / len(g))
    unit = lambda *k: int(hashlib.sha256("\0".join(map(str, ("k9", *k))).encode()).hexdigest()[:13], 16) / 2**52
    names = sorted((n for n, rows in tracks.items() if len(rows) >= 10), key=lambda n: hashlib.sha256(n.encode()).hexdigest())
    stream = []
    for i in range(300):
        rows = tracks[names[int(unit("track", i) * len(names))]]
        start = int(unit("start", i) * (len(rows) - 9))
        stream += [(v - mu) / sd for v in rows[start : start + 10]]

    def rate(h):
        s, skip, n = 0.0, 0, 0
        for v in stream:
            if skip:
                skip, s = skip - 1, 0.0
                continue
            s = max(0.0, s + v - 0.5)
            if s > h:
                s, skip, n = 0.0, 5, n + 1
        return n / 50

    high = next(2.0**i for i in range(21) if rate(2.0**i) <= 1.0)
    low = 0.0
    for _ in range(12):
        mid = (low + high) / 2
        low, high = (low, mid) if rate(mid) <= 1.0 else (mid, high)
    got = QUERIES["k9_page_policy"](spark, sf).first()
    assert len(stream) == 3000
    assert (got.mu, got.sigma, got.h) == pytest.approx((mu, sd, high), abs=2e-6)
    assert (got.fa_per_hour, got.meets_budget) == (pytest.approx(rate(high)), True)


def test_turns_equal_the_greedy_loop():
    import heapq
    import random

    from trackweave.operators.sampling import _turns

    g = random.Random(7)
    for _ in range(300):
        k = g.randrange(2, 7)
        load = [0] * k
        for size in sorted({g.randrange(1, 40) for _ in range(g.randrange(1, 6))}, reverse=True):
            count = g.choice([1, 2, 3, g.randrange(1, 60)])
            heap = [(v, f) for f, v in enumerate(load)]
            heapq.heapify(heap)
            want = []
            for _ in range(count):
                v, f = heap[0]
                want.append(f)
                heapq.heapreplace(heap, (v + size, f))
            phases, load = _turns(load, size, count)
            assert len(phases) <= k
            got = []
            for i in range(count):
                first, turn = [p for p in phases if p[0] <= i][-1]
                got.append(turn[(i - first) % len(turn)])
            assert got == want and sorted((v, f) for f, v in enumerate(load)) == sorted(heap)


def test_group_folds_of_whole_numbers_and_a_missing_name(spark):
    from trackweave.operators.sampling import group_folds

    sizes = {9: 4, 10: 4, 11: 4, None: 4, 5: 1, 100: 7}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "g int")
    got = {r.g: (r.rows, r.fold) for r in group_folds(df, group="g", max_folds=3).collect()}
    # 100 -> 0; 11 -> 1, 10 -> 2, 9 -> 1 (four rows each), none -> 2; 5 -> 0
    assert got == {100: (7, 0), 11: (4, 1), 10: (4, 2), 9: (4, 1), None: (4, 2), 5: (1, 0)}
