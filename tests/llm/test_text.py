import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import words as plain_words
from trackweave.llm import text as X

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB é.\n\t0", max_size=14)), min_size=1, max_size=6)


def parts(texts, limit=1 << 20):
    return X.blocks(iter([pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})]), "t", limit)


@settings(max_examples=60, deadline=None)
@given(TEXT, st.sampled_from([1, 6, 1 << 20]))
def test_words_are_those_of_the_pattern(texts, limit):
    got = []
    for _, data, offs in parts(texts, limit):
        solid, at, first = X.words(X.LOWER[data], offs)
        found = [bytes(solid[a:b]).decode() for a, b in zip(at, at[1:])]
        got += [found[a:b] for a, b in zip(first, first[1:])]
    assert got == [plain_words(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(TEXT)
def test_equal_words_and_shingles_have_equal_hashes(texts):
    (_, data, offs), = parts(texts)
    solid, at, first = X.words(X.LOWER[data], offs)
    hashes = X.word_hashes(solid, at)
    flat = [w for t in texts for w in plain_words(t)]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    values, upto = X.shingles(hashes, first, 3)
    for t, a, b in zip(texts, upto, upto[1:]):
        w = plain_words(t)
        assert b - a == (max(1, len(w) - 2) if w else 0)


def test_minima_join_over_tiles():
    g = np.random.default_rng(1)
    values, at = g.integers(0, 1 << 64, 1000, dtype=np.uint64), np.array([0, 0, 10, 400, 400, 1000])
    a, b = X.permutations(7, 3)
    got = X.minima(values, at, a, b, tile=64)
    x = (values >> np.uint64(32)).astype(np.uint32)
    for i, (lo, hi) in enumerate(zip(at, at[1:])):
        want = [(x[lo:hi] * m + c).min() if lo < hi else 0xFFFFFFFF for m, c in zip(a, b)]
        assert got[i].tolist() == want


def test_lookup_finds_each_key_and_no_other():
    g = np.random.default_rng(2)
    keys = np.unique(g.integers(0, 1 << 64, 5000, dtype=np.uint64))
    table = X.Lookup(keys, bits=10)  # far fewer slots than keys
    assert (table(keys) == np.arange(len(keys))).all()
    assert (table(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (X.Lookup(np.zeros(0, np.uint64))(keys) == -1).all()
