import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, no_docs
from trackweave.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"


def plain_ppm(train, order):
    """Code length of a text in each language by the definition, one byte at a time."""
    counts = defaultdict(lambda: defaultdict(Counter))
    fold = lambda t: language.fold(np.frombuffer(t.encode(), np.uint8)).tobytes() if t else b""
    for lang, text in train:
        padded = b" " * order + fold(text)
        for i in range(order, len(padded)):
            for d in range(order + 1):
                counts[lang][padded[i - d : i]][padded[i]] += 1

    def bits(lang, text):
        padded, total = b" " * order + fold(text), 0.0
        for i in range(order, len(padded)):
            for d in range(order, -1, -1):
                seen = counts[lang].get(padded[i - d : i])
                if not seen:
                    continue
                t, m = sum(seen.values()), len(seen)
                if padded[i] in seen:
                    total -= math.log2(seen[padded[i]] / (t + m))
                    break
                total -= math.log2(m / (t + m))
            else:
                total += 8
        return total

    return bits


def test_code_lengths_equal_the_definition(spark):
    train = [("en", "the cat sat on the mat"), ("en", "a dog is in the house"), ("de", "die Katze saß auf der Matte"), ("de", "ein Hund ist im Haus")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(train)], "doc_id long, text string, lang string")
    trees = language.learn(docs, id_col="doc_id", text_col="text", lang_col="lang", order=3)
    bits = plain_ppm(train, 3)
    texts = ["the house", "Das Haus saß", "zzz qqq", "", "ÄÖ 12 xx the"]
    data = language.fold(np.frombuffer("".join(texts).encode(), np.uint8))
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got = trees.scorer()(*language.grams(data, offs, 3))
    for i, lang in enumerate(trees.languages):
        assert got[i] == pytest.approx([bits(lang, t) for t in texts])


def test_awkward_rows_and_nothing_to_learn(spark):
    docs = edge_docs(spark)
    trees = language.learn(docs, id_col="doc_id", text_col="text", lang_col="lang")
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs, trees).collect()}
    assert got >= {(3, "und"), (4, "und"), (5, "und"), (8, "und"), (10, "en"), (9, "en"), (None, "en")}
    none = language.learn(no_docs(spark), id_col="doc_id", text_col="text", lang_col="lang")
    assert none is None
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(no_docs(spark), trees).count() == 0


def test_a_tie_goes_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    trees = language.learn(docs, id_col="doc_id", text_col="text", lang_col="lang")
    assert {(r.lang_pred, r.score) for r in language.predict(docs, trees).collect()} == {("a", 0.5)}


@pytest.mark.parametrize("nodes", [60_000, 10])
def test_a_small_bound_takes_fewer_documents_at_the_same_order(spark, nodes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = lambda df: language.learn(df, id_col="doc_id", text_col="text", lang_col="lang", max_nodes=nodes)
    trees, again = learn(docs), learn(docs.repartition(7))
    assert len(trees.keys) == 4
    assert all(np.array_equal(a, b) for x, y in ((trees.keys, again.keys), (trees.cost, again.cost)) for a, b in zip(x, y))
    got = language.predict(docs, trees).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op2_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98


def test_toxic_words_are_learned(spark):
    bad = ["vile scum talk", "you are scum", "such scum here", "scum and more scum"] * 8
    good = ["a fine day out", "the river is calm", "green hills are near", "bread and some tea"] * 8
    rows = [(i, f"{t} number {i}") for i, t in enumerate(bad + good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 32)) for i, _ in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    new = spark.createDataFrame([(100, "what SCUM this is"), (101, "a calm river"), (102, None), (103, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(new, model).collect()}
    assert got[100].predicted == 1 and got[101].predicted == 0
    assert got[102].score == got[103].score
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(edge_docs(spark), model).count() == edge_docs(spark).count()
    assert toxicity.score(no_docs(spark), model).count() == 0


def test_without_labels_of_both_classes(spark):
    docs = edge_docs(spark)
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    ones = toxicity.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, ones).collect()} == {1}


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.QUERIES["op3_toxicity"](spark, SF).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.95
