import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import LONG, edge_docs, no_docs
from trackweave.llm import queries, runs

SF = "/root/testdata/sf0.001"


def split(text):
    return (text or "").encode().split()


def plain(w, least=24, repeats=3):
    """Every period tried at every place."""
    n, out = len(w), []
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, repeats * p) and not any(all(w[t] == w[t + q] for t in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(t for i, t in enumerate(w) if i not in gone).decode()


@settings(max_examples=400, deadline=None)
@given(st.integers(3, 12), st.sampled_from([3, 3, 4]), st.lists(st.integers(0, 2), max_size=60), st.integers(1, 7), st.integers(0, 59))
def test_equals_all_periods(least, repeats, w, p, a):
    for i in range(a, len(w)):
        w[i] = w[a + (i - a) % p]
    number = np.array(w, np.int64)
    found = runs.runs_of(number, least, repeats) if w else []
    assert found == plain(w, least, repeats)
    if found:
        assert runs.repeating(number, np.array([0, len(w)]), runs.least_match(least, repeats))[0]


def test_many_periods_stay_cheap():
    assert runs.runs_of(np.zeros(50_000, np.int64), 24, 3) == [(0, 50_000, 1)]
    # a line of twenty words ten thousand times, each time followed by words of its own
    line = np.concatenate([np.concatenate([np.arange(20), [100 + 2 * i, 101 + 2 * i]]) for i in range(10_000)])
    assert runs.runs_of(line, 24, 3) == []


def test_edge_cases(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        w = split(t)
        # the long text repeats after 18,200 words, thrice and a bit
        found = [(0, len(w), 18200)] if t == LONG else [(0, len(w) - 1, 18200)] if t == LONG + " tail" else plain(w)
        want.append((i, tuple(found), collapsed(w, found)))
    assert got == sorted(want, key=repr)
    assert runs.periodic_runs(no_docs(spark)).collect() == []


def test_blank_texts_alone(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in runs.periodic_runs(docs).orderBy("doc_id").collect()] == [(1, [], ""), (2, [], ""), (3, [], "")]


def contract(doc_id, text):
    w = split(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain(w)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapsed(w, found)))


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert got == {contract(i, t) for i, t in docs}
    assert sum(r[1] for r in got) > 5


def test_words_of_other_scripts_count_by_bytes(spark):
    g = random.Random(3)
    words = ["日本", "é", "don't", " x", " "]
    w = [g.choice(words) for _ in range(9)] * 5
    docs = spark.createDataFrame([(1, "\t".join(w))], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == plain(w) and row.collapsed == " ".join(w[:9])
