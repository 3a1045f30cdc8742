import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, no_docs, words
from trackweave.llm import contexts


def plain_ctw(train, depth):
    """log10 probability of a text under the frozen tree, by recursion over explicit nodes."""
    nodes = defaultdict(lambda: [0, 0])

    def text_of(t):
        return " ".join(words(t)).encode() + b"\n"

    def steps(t):
        s = b"\n" * depth + text_of(t)
        for i in range(depth, len(s)):
            for k in range(8):
                yield s[i - depth : i], (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1

    for t in train:
        for ctx, choice, bit in steps(t):
            for d in range(depth + 1):
                nodes[ctx[depth - d :], choice][bit] += 1
    below = defaultdict(list)
    for ctx, choice in nodes:
        if ctx:
            below[ctx[1:], choice].append(ctx)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, choice):
        own = kt(*nodes[ctx, choice])
        if len(ctx) == depth:
            return own
        return np.logaddexp(own, sum(weighted(c, choice) for c in below[ctx, choice])) - math.log(2)

    def predict(ctx, choice, bit, d=0):
        here = ctx[depth - d :]
        a = nodes.get((here, choice))
        if a is None:
            return None
        own = (a[bit] + 0.5) / (sum(a) + 1)
        deeper = predict(ctx, choice, bit, d + 1) if d < depth else None
        if deeper is None:
            return own
        p, q = kt(*a), sum(weighted(c, choice) for c in below[here, choice])
        w = 1 / (1 + math.exp(q - p))
        return w * own + (1 - w) * deeper

    def score(t):
        return sum(math.log10(predict(*s) or 0.5) for s in steps(t))

    return score


@pytest.mark.parametrize("hot", [1 << 20, 8])
def test_scores_equal_the_recursion(spark, hot):
    train = ["the cat and the dog", "The dog and a cat", "", "aé b"]
    rows = [(i, t) for i, t in enumerate(train)] + [(10, "a cat the zebra"), (11, None), (12, "the dog and the cat and the dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in contexts.score(docs, F.col("doc_id") < 10, depth=3, hot=hot).collect()}
    score = plain_ctw(train, 3)
    count = Counter(w for t in train for w in words(t))
    n, v, ends = sum(count.values()) + 4, len(count) + 1, 4
    for i, t in rows:
        assert got[i].score == pytest.approx(score(t), abs=1e-6)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)) + math.log10((ends + 1) / (n + v + 1))
        assert got[i].base_score == pytest.approx(base)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words(t)) + 1, sum(count[w] > 0 for w in words(t)) + 1, n)


def test_choices_add_up_to_one():
    g = np.random.default_rng(1)
    gram = np.unique(g.integers(97, 101, (300, 4)).astype(np.uint64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint64))
    count = g.integers(0, 5, len(gram)).astype(float)
    found, _ = contexts.levels(gram, count, 3, 0)
    context = gram[7] >> np.uint64(8)
    every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    both = np.concatenate([gram, every])
    found, rows = contexts.levels(both, np.append(count, np.zeros(256)), 3, 0)
    p = contexts.blend(found, rows, contexts.choices(both)[1])[:, -256:]
    assert np.where(np.isnan(p), 0.5, p).prod(axis=0).sum() == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1e3, 1e7])
    assert contexts._log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-9)


def test_awkward_rows(spark):
    docs = edge_docs(spark)
    got = contexts.score(docs, F.col("doc_id") % 2 == 0).toPandas()
    assert len(got) == docs.count()
    empty = got[got.doc_id.isin([3, 4, 5])]
    assert (empty.n_tokens == 1).all() and np.ptp(empty.score) < 1e-9
    assert (got.score <= 0).all()
    twice = got[got.doc_id == 15]
    assert len(twice) == 2 and np.ptp(twice.score) < 1e-6
    assert contexts.score(no_docs(spark), F.lit(True)).count() == 0
    untrained = contexts.score(docs, F.lit(False)).toPandas()
    assert (untrained.n_known == 0).all() and (untrained.train_tokens == 0).all()
    assert untrained.score.to_numpy() == pytest.approx(untrained.n_bytes.to_numpy() * 8 * math.log10(0.5))


