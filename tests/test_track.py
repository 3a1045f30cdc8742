"""The chunked sequence engine against plain sequential loops, for several chunk widths."""

import random

import pytest
from pyspark.sql import functions as F

from trackweave.plans import track as tk
from trackweave.plans.track import Ahead, Carry, Lag, Lead, Running, Track, Whole


def make(seed=7, n=240):
    rnd = random.Random(seed)
    rows, pos = [], 0
    for k in ("a", "b", "hot"):
        t = 0.0
        for _ in range(n if k == "hot" else n // 6):
            t += rnd.choice([0.0, 1.0, 3.0, 40.0])
            rows.append((k, t, pos, rnd.choice([-2.0, -1.0, 0.5, 1.0, 3.0]), rnd.random() < 0.15, rnd.random() < 0.3))
            pos += 1
    return rows


SCHEMA = "k string, t double, row_pos long, x double, r boolean, m boolean"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("chunk", [5.0, 60.0, 1e9])
def test_sweep(spark, chunk):
    rows = make()
    tr = Track(("k",), ("t", "row_pos"), chunk)
    x = F.col("x")
    got = tk.sweep(
        spark.createDataFrame(rows, SCHEMA).repartition(5), tr,
        {"lag": Lag(x), "lead": Lead(x), "cum": Running(x), "pmax": Running(x, "max", inclusive=False),
         "held": Carry(F.when(x > 0, x), when=F.col("m")), "nxt": Ahead(F.col("t"), when=F.col("r"), inclusive=False),
         "all": Whole(x)},
    ).collect()
    got = {r.row_pos: r for r in got}
    for seq in by_key(rows).values():
        for i, (_, t, p, v, r, m) in enumerate(seq):
            g = got[p]
            assert g.lag == (seq[i - 1][3] if i else None)
            assert g.lead == (seq[i + 1][3] if i + 1 < len(seq) else None)
            assert g.cum == pytest.approx(sum(s[3] for s in seq[: i + 1]))
            assert g.pmax == (max(s[3] for s in seq[:i]) if i else None)
            marks = [s for s in seq[: i + 1] if s[5]]
            assert g.held == ((marks[-1][3] if marks[-1][3] > 0 else None) if marks else None)
            later = [s[1] for s in seq[i + 1 :] if s[4]]
            assert g.nxt == (later[0] if later else None)
            assert g.all == pytest.approx(sum(s[3] for s in seq))


@pytest.mark.parametrize("chunk", [5.0, 60.0, 1e9])
def test_runs_since_accumulate(spark, chunk):
    rows = make(11)
    tr = Track(("k",), ("t", "row_pos"), chunk)
    df = tk.settle(spark.createDataFrame(rows, SCHEMA).repartition(5), tr)
    df = tk.runs(df, tr, {"t": F.col("t")}, lambda p, c: c["t"] - p["t"] > 10, out="run", prev="pr")
    df = tk.since(df, tr, {"el": (F.col("m"), F.abs("x"))})
    df = tk.accumulate(df, tr, {"up": (F.col("r"), F.col("x") - 0.4), "dn": (F.col("r"), -F.col("x") - 0.4)})
    got = {r.row_pos: r for r in df.collect()}
    for seq in by_key(rows).values():
        run, el, up, dn, prev = 0, 0.0, 0.0, 0.0, None
        for _, t, p, v, r, m in seq:
            run += prev is None or t - prev > 10
            el = abs(v) if m else el + abs(v)
            up = 0.0 if r else max(0.0, up + v - 0.4)
            dn = 0.0 if r else max(0.0, dn - v - 0.4)
            g = got[p]
            assert (g.run, g.pr.t if g.pr else None) == (run, prev)
            assert g.el == pytest.approx(el) and g.up == pytest.approx(up) and g.dn == pytest.approx(dn)
            prev = t


def test_settled_rows_are_not_shuffled_again(spark):
    tr = Track(("k",), ("t", "row_pos"), 60.0)
    df = tk.settle(spark.createDataFrame(make(), SCHEMA), tr)
    plan = tk.sweep(df, tr, {"lag": Lag(F.col("x"))})._jdf.queryExecution().executedPlan().toString()
    exchanges = [ln for ln in plan.splitlines() if "Exchange" in ln]
    # one for the carries along the entity, one to bring them back; none under the rows
    assert len(exchanges) == 2, plan


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_row_frame(spark, block):
    rows = make(3)
    tr = Track(("k",), ("t", "row_pos"), 60.0)
    got = tk.row_frame(
        spark.createDataFrame(rows, SCHEMA), tr,
        {"s": lambda w: F.sum("x").over(w.rowsBetween(-3, 0)), "f": lambda w: F.count("x").over(w.rowsBetween(1, 2))},
        before=3, after=2, block_rows=block,
    ).collect()
    got = {r.row_pos: r for r in got}
    for seq in by_key(rows).values():
        for i, s in enumerate(seq):
            assert got[s[2]].s == pytest.approx(sum(q[3] for q in seq[max(0, i - 3) : i + 1]))
            assert got[s[2]].f == len(seq[i + 1 : i + 3])


def test_time_frame(spark):
    rows = [(k, int(t), p, x, r, m) for k, t, p, x, r, m in make(5)]
    df = spark.createDataFrame(rows, SCHEMA.replace("t double", "t long"))
    got = tk.time_frame(
        df, Track(("k",), ("t", "row_pos"), 10), {"s": lambda w: F.sum("x").over(w.rangeBetween(-7, 4))}, before=7, after=4
    ).collect()
    assert len(got) == len(rows)
    for g in got:
        want = sum(r[3] for r in rows if r[0] == g.k and -7 <= r[1] - g.t <= 4)
        assert g.s == pytest.approx(want)


def test_fit_chunk_narrows_for_a_dominant_entity(spark):
    df = spark.createDataFrame(make(), SCHEMA)
    assert tk.fit_chunk(df, Track(("k",), chunk=1e9), rows_per_chunk=60).chunk < 1e9
    assert tk.fit_chunk(df, Track(("k",), chunk=1e9)).chunk == 1e9
