import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, edge_docs, no_docs
from trackweave.llm import queries, repeats

SF = "/root/testdata/sf0.001"


def plain(rows, length):
    """(id, bytes, spans, kept) by a table of all windows' smallest documents."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        if i is not None:
            for s in range(len(t) - length + 1):
                w = t[s : s + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for s in range(len(t) - length + 1):
                if least[t[s : s + length]] < i:
                    gone[s : s + length] = b"\1" * length
        spans, at = [], None
        for p, g in enumerate([*gone, 0]):
            if g and at is None:
                at = p
            elif not g and at is not None:
                spans.append((at, p))
                at = None
        out.append((i, len(t), tuple(spans), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def found(df, **how):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in repeats.without_repeats(df, **how).collect()), key=repr)


def test_edge_cases(spark):
    docs = edge_docs(spark)
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert repeats.without_repeats(no_docs(spark)).collect() == []


def corpus(seed, n=120):
    g = random.Random(seed)
    vocabulary = ["".join(g.choice("abcdeé ") for _ in range(g.randrange(1, 7))) for _ in range(30)]
    passages = [" ".join(g.choice(vocabulary) for _ in range(g.randrange(5, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [g.choice(passages)[g.randrange(3) :] if g.random() < 0.5 else " ".join(g.choice(vocabulary) for _ in range(g.randrange(0, 30))) for _ in range(g.randrange(0, 6))]
        text = g.choice(["", " ", "x"]).join(parts)
        if g.random() < 0.1:
            text += "ab" * g.randrange(20, 200)
        if g.random() < 0.2 and rows:
            text = g.choice(rows)[1] or ""
        rows.append((g.randrange(n) if g.random() < 0.9 else None, text if g.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize("crowd", [50_000, 3])
@pytest.mark.parametrize("length,anchor", [(50, 20), (12, 5), (8, 8)])
def test_equals_all_windows(spark, monkeypatch, crowd, length, anchor):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = corpus(length * 7 + crowd)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(docs, length=length, anchor=anchor, block_bytes=2000, batch_bytes=3000)
    assert got == plain(rows, length)


def test_scan_covers_by_the_longest_maximal_repeat():
    # suffixes 0..3 share 50 bytes, 1 and 2 share 54; the smallest document stays whole
    lcp, left, doc = np.array([0, 50, 54, 50]), np.array([1, 2, 3, 4]), np.array([5, 7, 6, 9])
    where, size = repeats.interval_scan(lcp, left, doc, 50)
    assert dict(zip(where.tolist(), size.tolist())) == {1: 54, 2: 50, 3: 50}
    # the same byte before all of them: a longer repeat says the same
    assert len(repeats.interval_scan(lcp, np.array([1, 1, 1, 1]), doc, 50)[0]) == 0


def test_hidden_clashes_remove_nothing(spark, monkeypatch):
    """With hashes that often agree, bytes still decide."""
    rows = corpus(4, 60)
    data = np.frombuffer(b"\0".join((t or "").encode() for _, t in rows), np.uint8)
    at = np.arange(len(data) - 20)
    doc = np.repeat(np.arange(len(rows)), [len((t or "").encode()) + 1 for _, t in rows])[: len(at)]
    monkeypatch.setattr(repeats, "window_hashes", lambda d, n: np.zeros(max(0, len(d) - n + 1), np.uint64))
    hit, size = repeats._spans(data, at, np.full(len(at), len(data)), np.ones(len(at), bool), doc, 20)
    raw = data.tobytes()
    least = {}
    for a in at.tolist():
        least[raw[a : a + 20]] = min(least.get(raw[a : a + 20], 1 << 60), int(doc[a]))
    want = {a for a in at.tolist() if least[raw[a : a + 20]] < doc[a]}
    assert set(hit.tolist()) == want


def test_query_on_whole_tables(spark):
    got = {tuple(r) for r in queries.QUERIES["op13_repeat_removal"](spark, SF).collect()}
    import hashlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in plain(rows, 50)}
    assert got == want


def test_long_text_against_itself(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "new words in front of it " + LONG)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.without_repeats(docs).withColumn("kept", F.decode("kept", "UTF-8")).collect()}
    assert got[1].spans == [] and got[2].kept.startswith("new words in front of it") and len(got[2].kept) <= 26
