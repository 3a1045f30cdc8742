import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor string, found string, block string, place string"


def plain(rows, positives=5, negatives=3, low=50, high=95, every=50):
    """All scores of all anchors."""
    fine = []
    for i, v, lab in rows:
        if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, lab, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, lab, v) in enumerate(fine):
        if i % every:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, m) for m, (j, _, w) in enumerate(fine) if m != n]
        by = sorted(score, key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in by if fine[s[2]][1] == lab][:positives]:
            inside = [s for s in by if fine[s[2]][1] != lab and low * p <= 100 * s[0] <= high * p][:negatives]
            out += [(i, pid, r + 1, s[1], p, s[0]) for r, s in enumerate(inside)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, lab, *["x"] * 5) for i, v, lab in rows], SCHEMA).repartition(4)
    out = negatives.hard_negatives(df, F.col("id") % 50 == 0, label=F.col("label"), **how)
    return sorted(tuple(r) for r in out.collect())


def clustered(seed, n, dims, labels):
    g = random.Random(seed)
    centres = [[g.gauss(0, 0.4) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        lab = g.randrange(labels)
        rows.append((i, [c + g.gauss(0, 0.4) for c in centres[lab]], lab))
    return rows


@pytest.mark.parametrize("dims,labels,block_rows", [(3, 2, 60), (8, 10, 100_000), (1, 3, 40), (16, 2, 200)])
def test_equals_all_scores(spark, dims, labels, block_rows):
    rows = clustered(dims, 600, dims, labels)
    assert run(spark, rows, block_rows=block_rows) == plain(rows)


def test_awkward_rows(spark):
    rows = clustered(9, 120, 4, 2)
    rows += [(None, [1.0] * 4, 0), (150, None, 0), (200, [1.0] * 4, None), (250, [1.0, None, 1.0, 1.0], 1), (300, [math.nan, 1.0, 1.0, 1.0], 1), (350, [math.inf, 0.0, 0.0, 0.0], 0)]
    rows += [(400, [0.0] * 4, 0), (450, [], 1), (500, [0.5], 0), (50, [0.3, 0.2, 0.1, 0.4], 1)]  # zeros, none, short, an id again
    rows += [(600 + i, [0.25, 0.25, 0.25, 0.25], i % 2) for i in range(30)]  # ties
    assert run(spark, rows) == plain(rows)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = clustered(5, 60, 4, 2)
    rows += [rows[0], rows[0], rows[7]]
    assert run(spark, rows, block_rows=16) == plain(rows)


def test_empty_and_one_row(spark):
    assert run(spark, []) == [] and run(spark, [(50, [1.0, 2.0], 1)]) == []


def test_large_components_stay_exact(spark):
    g = random.Random(2)
    rows = [(i, [float(g.randrange(1 << 19)) for _ in range(3)], i % 2) for i in range(100)]
    assert run(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="2\\^28"):
        run(spark, [(0, [1e9], 0)])


def test_search_stops_before_all_rows_are_seen():
    g = np.random.default_rng(1)
    x = np.round(g.normal(0, 100, (20_000, 2))).astype(np.int64)
    lists, anchor = negatives.Lists(x), np.array([3, -5])
    rows, scores = lists.search(anchor, lambda r, s: negatives._kth(s, 5))
    want = np.sort(x @ anchor)[::-1][:5]
    assert len(rows) < 10_000 and np.sort(scores)[::-1][:5].tolist() == want.tolist()
