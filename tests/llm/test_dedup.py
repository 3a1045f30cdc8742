import hashlib
from collections import defaultdict

import pytest

from tests.llm.helpers import components, edge_docs, no_docs, shingle_set
from trackweave.llm import exactdup, neardup
from trackweave.llm.components import components as linked_components

SF = "/root/testdata/sf0.001"


def check_exact(docs, block):
    got = exactdup.exact_duplicates(docs, block_bytes=block).toPandas()
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    ids = defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    best = {t: max((i for i in v if i is not None), default=None) for t, v in ids.items()}
    want = sorted((str(i), str(best[t]), len(ids[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    name = lambda v: "None" if v is None or v != v else str(int(v))
    assert sorted(zip(got.doc_id.map(name), got.keep_id.map(name), got.group_size, got.text_sha256)) == want
    kept = got[got.kept]
    assert len(kept) == len(ids)
    assert kept.text_sha256.is_unique
    assert (kept.doc_id.map(name) == kept.keep_id.map(name)).all()


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_groups(spark, block):
    docs = edge_docs(spark)
    check_exact(docs.filter("length(text) < 6000 OR text IS NULL") if block == 4 else docs, block)


def test_exact_groups_when_block_hashes_clash(spark, monkeypatch):
    # every hash is the block's length: content has to decide
    monkeypatch.setattr(exactdup.F, "xxhash64", lambda c: exactdup.F.octet_length(c).cast("long") % 3)
    check_exact(edge_docs(spark).filter("length(text) < 200 OR text IS NULL"), 8)


def test_no_documents(spark):
    assert exactdup.exact_duplicates(no_docs(spark)).count() == 0
    assert neardup.near_duplicates(no_docs(spark)).count() == 0


def check_near(docs, k):
    got = neardup.near_duplicates(docs, k=k).toPandas()
    rows = [(r.doc_id, shingle_set(r.text, k)) for r in docs.select("doc_id", "text").collect()]
    part = components(rows, 80)
    name = lambda v: "None" if v is None or v != v else str(int(v))
    want = sorted((name(i), len(s), name(part.get(i))) for i, s in rows)
    assert sorted(zip(got.doc_id.map(name), got.n_shingles, got.component_id.map(name))) == want
    assert (got.kept == (got.doc_id.map(name) == got.component_id.map(name))).all()


def test_near_groups_of_awkward_rows(spark):
    check_near(edge_docs(spark).filter("doc_id IS NULL OR doc_id NOT IN (10, 11, 12)"), 4)


def test_near_groups_of_the_table(spark):
    check_near(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), 4)
    check_near(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), 5)


def test_chains_and_large_groups(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :])) for i in range(60)]  # each near to every other
    chain = [f"c{i}" for i in range(200)]
    rows += [(100 + i, " ".join(chain[4 * i : 4 * i + 80])) for i in range(30)]  # near to the next only
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 4)


def test_sketch_keeps_all_pairs_at_the_threshold():
    import numpy as np

    g = np.random.default_rng(5)
    samples = g.integers(0, 1 << 32, (400, 240), dtype=np.uint32)
    other = samples.copy()
    change = g.random(other.shape) < 0.2
    other[change] = g.integers(0, 1 << 32, int(change.sum()), dtype=np.uint32)
    x, y = neardup.odd_sketches(samples).view(np.uint64), neardup.odd_sketches(other).view(np.uint64)
    apart = np.bitwise_count(x ^ y).sum(axis=1)
    assert apart.max() <= neardup.sketch_limit(0.8, 240)
    far = neardup.odd_sketches(g.integers(0, 1 << 32, samples.shape, dtype=np.uint32)).view(np.uint64)
    assert np.bitwise_count(x ^ far).sum(axis=1).min() > neardup.sketch_limit(0.8, 240)


def test_components_of_a_long_path(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201)], "a long, b long")
    got = {r.node: r.component for r in linked_components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}
