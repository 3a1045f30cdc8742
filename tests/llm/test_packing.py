import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import edge_docs, no_docs
from trackweave.llm import packing

NAME = "word_bpe_49k.json"


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file(NAME))
    docs = edge_docs(spark)
    got = packing.pack(docs, NAME, length=64, piece=16, group=8).toPandas()
    want = sorted((str(r.doc_id), tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.select("doc_id", "text").toLocalIterator())
    # rows with one id cannot be told apart by it: compare the pieces as a bag
    pieces = []
    for key, ids in want:
        at = 0
        while at < len(ids):
            n = 64 if len(ids) - at >= 64 else min(16, len(ids) - at)
            part = np.array(ids[at : at + n], np.uint32)
            pieces.append((key, at, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids)))
            at += n
    key = got.doc_id.map(lambda x: "None" if x != x else str(int(x)))
    assert sorted(zip(key, got.start, got.length, got.ids_crc32, got.doc_tokens)) == sorted(pieces)
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(got.ids, got.ids_crc32))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= 64
    padded = packing.sequences(packing.pack(docs, NAME, length=64, piece=16, group=8), length=64).toPandas()
    assert all(len(i) == (n if n & (n - 1) == 0 else 64) for i, n in zip(padded.ids, padded.n_ids))


def test_empty_table(spark):
    assert packing.pack(no_docs(spark), NAME, ids=False).count() == 0


def test_bad_sizes(spark):
    with pytest.raises(ValueError):
        packing.pack(no_docs(spark), NAME, length=8, piece=9)


def test_differencing_deals_every_piece_once_and_evenly():
    r = random.Random(4)
    for _ in range(30):
        sizes = [r.randint(1, 50) for _ in range(r.randint(1, 80))]
        k = r.randint(1, 12)
        dealt = packing.deal(sizes, k)
        assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in dealt]
        assert len(sums) <= k
        assert max(sums) <= max(max(sizes), -(-sum(sizes) // k) + max(sizes))
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.deal([8, 7, 6, 5, 4], 2)) == [14, 16]  # the known outcome
    assert all(sum(w) <= 10 for w in [[sizes[i] for i in x] for sizes in [[6] * 9] for x in packing.windows_of(sizes, 10)])


def test_odd_words_tokenize_as_in_whole_texts():
    tokens = packing.WordTokens(packing.tokenizer_file(NAME), room=5)
    r = random.Random(3)
    alphabet = ["a", "the", "reanha", ".", "!!", " ", "\n", "é", "É", "'s", "'", "don't", "12", "–", "́", "<|endoftext|>", "<|", "×", "\x1c", " ", "日本", "İ", "\x7f", "²", "Σ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(800)]
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    ids, at = tokens.encode(np.frombuffer(b"".join(raw), np.uint8), offs, 1)
    want = tokens.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids + [1] for e in want]


def test_table_of_words_is_bounded():
    """What a worker keeps does not grow with the texts that it has seen."""
    tokens = packing.WordTokens(packing.tokenizer_file(NAME))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters]
    for part in (words[:150_000], words[150_000:300_000], words[300_000:], words[:3]):
        raw = " ".join(part).encode()
        ids, at = tokens.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 1)
    assert ids.tolist() == [*tokens.tokenizer.encode(" ".join(words[:3]), add_special_tokens=False).ids, 1]
    assert len(tokens.row) <= 400_000


def test_texts_reach_python_by_bytes(spark):
    """Packing and the language stage plan their texts in small batches, whatever the number of rows."""
    import corpus_pipeline

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    docs = spark.range(0, 400, 1, 1).selectExpr("id doc_id", "repeat('a word ', 8000) text", "cast(null as string) lang")
    sizes = lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches)
    try:
        for step in (lambda: packing.pack(docs, NAME), lambda: corpus_pipeline.identify_language(spark, docs, "")):
            spark.conf.unset(conf)
            step()
            found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 400 * 56_000 and max(found) < 6 << 20
    finally:
        spark.conf.set(conf, before)
