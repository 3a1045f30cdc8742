"""Licenses, mixing, fingerprints, sharding, the pipeline and the SQL of the queries."""

import glob
import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scripts.check import canon
from tests.llm.helpers import components, edge_docs, no_docs, shingle_set
from trackweave.llm import fingerprints, licenses, mixing, neardup, queries, sharding
from trackweave.llm import text as text_work

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert canon(got) == canon(want)


def test_licenses_inside_long_texts(spark):
    filler = [f"w{i}" for i in range(400)]
    mit = licenses.TEMPLATES["mit-permission"]
    rows = [(i, " ".join(filler[: 7 * i]) + "\n" + mit.replace(" ", "\n * ") + "\n" + " ".join(filler)) for i in range(20)]
    rows += [(50, mit.replace("Software", "Program")), (51, " ".join(mit.split()[:20])), (52, "Released under\nthe M.I.T. MIT License"), (53, "released UNDER the mit-license!")]
    got = {(r.doc_id, r.license_id): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.TEMPLATES).collect()}
    assert all(got[i, "mit-permission"].containment == 1.0 for i in range(20))
    assert all(got[i, "mit-permission"].start_word == 7 * i for i in range(20))
    assert (51, "mit-permission") not in got and (52, "mit") not in got and (53, "mit") in got
    assert licenses.scan(edge_docs(spark), licenses.TEMPLATES).count() == 0
    assert licenses.scan(no_docs(spark), licenses.TEMPLATES).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(no_docs(spark), {"short": "two words"})


def test_raking_meets_all_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {"source": 0.5, "lang": {"en": 0.4, "de": 0.3}, "topic": 0.8}
    rows = mixing._cells(docs, "doc_id", "text", None)
    cells, miss = mixing.rake(rows.groupBy(*mixing.DIMS).agg(F.sum("tokens").alias("tokens")), wanted)
    cells = cells.toPandas()
    assert miss <= 1e-10
    total = cells.tokens.sum()
    by = cells.groupby("lang")[["tokens", "weight"]].sum()
    assert by.weight["en"] / total == pytest.approx(0.4) and by.weight["de"] / total == pytest.approx(0.3)
    assert by.weight["fr"] / by.weight["es"] == pytest.approx(by.tokens["fr"] / by.tokens["es"])
    for d, power in (("source", 0.5), ("topic", 0.8)):
        by = cells.groupby(d)[["tokens", "weight"]].sum()
        want = by.tokens**power / (by.tokens**power).sum() * total
        assert by.weight.to_numpy() == pytest.approx(want.to_numpy())
    got = mixing.mix(docs, wanted).toPandas()
    assert got.probability.max() == pytest.approx(1) and got.probability.min() > 0
    expected = (got.tokens * got.probability).groupby(got.lang).sum()
    assert expected["de"] / expected.sum() == pytest.approx(0.3)
    drawn = mixing.mix(docs, mixing.TEMPER).toPandas()
    assert drawn.kept.sum() == pytest.approx(drawn.probability.sum(), rel=0.1)


def test_raking_says_when_targets_cannot_be_met(spark):
    rows = [("a", "en", "t", 10), ("b", "de", "t", 10), ("c", "en", "t", 10)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="cannot all be met"):
        fitted, miss = mixing.rake(cells, {"source": {"a": 0.2, "b": 0.6, "c": 0.2}, "lang": {"en": 0.7, "de": 0.3}})
    assert miss > 0.01 and fitted.agg(F.sum("weight")).first()[0] == pytest.approx(30)
    # targets that can be met only with a cell at nothing are reached slowly, and reached
    rows = [("a", "en", "t", 10), ("a", "de", "t", 10), ("b", "de", "t", 10)]
    fitted, miss = mixing.rake(spark.createDataFrame(rows, cells.schema), {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.4, "de": 0.6}})
    by = {(r.source, r.lang): r.weight for r in fitted.collect()}
    assert miss <= 1e-10 and by["a", "en"] == pytest.approx(12) and by["a", "de"] == pytest.approx(3)


def test_mixing_awkward_rows(spark):
    docs = edge_docs(spark)
    got = mixing.mix(docs, mixing.TEMPER)
    assert got.count() == docs.count()
    kept = mixing.sampled(docs, mixing.TEMPER)
    assert kept.columns == docs.columns
    assert kept.count() == got.filter("kept").count()
    assert mixing.mix(no_docs(spark), mixing.TEMPER).count() == 0 == mixing.sampled(no_docs(spark), mixing.TEMPER).count()


def check_compared(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = fingerprints.compared(fingerprints.signed(docs)).toPandas()
    want = Counter()
    for i, (key, text) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        want[(str(key), len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest())] += 1
    name = got.doc_id.map(lambda v: "None" if v is None or v != v else str(int(v)))
    assert Counter(zip(name, got.n_chars, got.edited_sha256)) == want
    assert got[["near_edited", "near_next"]].min().min() >= 0 and got[["near_edited", "near_next"]].max().max() <= 1
    return got


def test_fingerprints_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    got = check_compared(docs).set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id").text.sort_index()
    order = texts.index.tolist()
    for i, key in enumerate(order):
        text, following = texts[key], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        a, b = shingle_set(text, 5), shingle_set(text[: len(text) - half] + following[:half], 5)
        assert got.near_edited[key] == pytest.approx(len(a & b) / len(a | b), abs=0.25)
    assert (got.near_edited > got.near_next).mean() > 0.95
    assert texts.map(lambda t: t).groupby(got.fingerprint).nunique().mean() < 1.1
    assert got.fingerprint.groupby(texts).nunique().max() == 1


def test_fingerprints_of_awkward_rows(spark):
    # rows that share an id have no order of their own: leave those out
    got = check_compared(edge_docs(spark).dropDuplicates(["doc_id"]))
    assert got[got.doc_id.isin([3, 4, 5])].fingerprint.nunique() == 1
    assert fingerprints.fingerprints(edge_docs(spark)).count() == edge_docs(spark).count()
    assert fingerprints.fingerprints(no_docs(spark)).count() == 0
    one = fingerprints.fingerprints(edge_docs(spark).filter("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprint_classes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.class_id for r in fingerprints.fingerprints(docs).collect()}
    want = components([(r.doc_id, shingle_set(r.text, 5)) for r in docs.collect()], 80)
    assert np.mean([got[i] == want[i] for i in want]) > 0.98


def test_fingerprints_equal_plain_minhash(spark):
    """Each byte from the least of a * x + b over a text's shingles, by plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(25).unionByName(edge_docs(spark).filter("doc_id < 10").select("doc_id", "text", "lang", "source", "n_chars"))
    a, b = (x.tolist() for x in text_work.permutations(fingerprints.BANDS * fingerprints.ROWS, 6))

    def plain(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        names, _ = neardup.shingle_sets(raw, np.array([0, len(raw)]), 5)
        least = [min([(i * (int(x) >> 32) + j) % 2**32 for x in names], default=2**32 - 1) for i, j in zip(a[:128], b)]
        return bytes(int(text_work.mix(np.array([v + 1], np.uint64))[0]) >> 56 for v in least)

    def alike(x, y):
        return max((sum(p == q for p, q in zip(x, y)) / 128 * 256 - 1) / 255, 0.0)

    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1]))
    got = {}
    for r in fingerprints.fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for n, (i, t) in enumerate(rows):
        if len(got[i]) > 1 or len(got[rows[(n + 1) % len(rows)][0]]) > 1:
            continue
        following = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        own, edited, after = plain(t), plain(t[: len(t) - half] + following[:half]), plain(following)
        r = got[i][0]
        assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), edited.hex())
        assert r.near_edited == pytest.approx(alike(own, edited)) and r.near_next == pytest.approx(alike(own, after))


def test_filter_passes_all_its_ids(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    few = neardup.passing(docs, docs.filter("doc_id % 7 = 0"), "doc_id")
    got = {r.doc_id for r in few.collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 800
    assert neardup.passing(docs, docs.limit(0), "doc_id").count() == 0


def test_fingerprint_query_has_the_classes_of_all_pairs(spark, tmp_path):
    """Pairs just above and just below 0.8, equal fingerprints of different sets, one id with two texts."""
    base = [f"w{i}" for i in range(204)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:180] + [f"v{i}" for i in range(20)]))]  # 176 of 224: below
    rows += [(10 * n + j, " ".join([f"g{n}x{i}" for i in range(204 - j * c)] + [f"h{n}y{i}" for i in range(j * c)])) for n in range(1, 31) for c in [16 + n % 10] for j in (0, 1)]
    rows += [(900, "one two three four five six"), (900, "seven eight nine ten eleven twelve"), (901, "seven eight nine ten eleven twelve"), (902, None), (903, " "), (None, "one two three four five six")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = queries.QUERIES["op8_fingerprints"](spark, path).toPandas()
    assert "digest" not in got.columns
    nodes = list({shingle_set(t, 5) for _, t in rows})
    part = components([(i, s) for i, s in enumerate(nodes)], 80)
    least = {}
    for i, t in rows:
        if i is not None:
            c = part[nodes.index(shingle_set(t, 5))]
            least[c] = min(i, least.get(c, i))
    want = Counter((i, None if i is None else i if not shingle_set(t, 5) else least[part[nodes.index(shingle_set(t, 5))]]) for i, t in rows)
    none = lambda v: None if v != v else int(v)
    assert Counter((none(a), none(b)) for a, b in zip(got.doc_id.astype(float), got.class_id.astype(float))) == want
    assert len({c for _, c in want}) < len({i for i, _ in want})
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op8_fingerprints"](spark, SF).collect()}
    assert got == components([(r.doc_id, shingle_set(r.text, 5)) for r in table.collect()], 80)


def test_bands_travel_with_numbers_and_are_written_once(spark, monkeypatch):
    """Each of 40 bands carries its node: a number, not a digest. Texts reach a task by bytes, whatever the number of rows."""
    nodes, tables, sizes = [], [], []
    buckets, write, signed = neardup.buckets, neardup.written, fingerprints.signed
    monkeypatch.setattr(neardup, "buckets", lambda keyed: nodes.append(dict(keyed.dtypes)["node"]) or buckets(keyed))
    monkeypatch.setattr(neardup, "written", lambda df: tables.append(df.columns) or write(df))
    monkeypatch.setattr(fingerprints, "signed", lambda docs, **how: sizes.append(int(spark.conf.get(fingerprints.BATCH_CONF))) or signed(docs, **how))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(n, " ".join(f"w{n % 3}x{i}" for i in range(50)) + f" tail{n}") for n in range(12)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()
    assert {r.doc_id: r.class_id for r in got} == {n: n % 3 for n in range(12)}
    assert nodes == ["bigint"] and not any("bands" in t for t in tables)
    assert sizes == [fingerprints.BATCH_BYTES] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_shard_table():
    names = [f"n{i}" for i in range(9)]
    table = sharding.fill(names, 1009)
    count = Counter(table)
    assert set(count) == set(range(9)) and max(count.values()) - min(count.values()) <= 1
    less = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less) if a != 8)
    assert moved < 0.15 * 1009
    half = Counter(sharding.fill(names, 1009, {"n0": 0.5}))
    assert half[0] == pytest.approx(half[1] / 2, abs=2)
    for bad in (dict(shards=names, size=1000), dict(shards=["a", "a"], size=7), dict(shards=names, size=7)):
        with pytest.raises(ValueError):
            sharding.fill(**bad)


def test_placing_keeps_rows_and_names_clashes(spark, tmp_path):
    docs = edge_docs(spark)
    placed = sharding.place(docs, "doc_id", ["a", "b", "c"], size=101)
    assert placed.count() == docs.count() and placed.filter("shard IS NULL").count() == 0
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError, match="shard"):
        sharding.place(placed.drop("slot"), "doc_id", ["a"], size=3)
    assert sharding.place(no_docs(spark), "doc_id", ["a"], size=3).count() == 0
    sharding.write_shards(placed.select("doc_id", "text", "slot", "shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_pipeline_stages(spark):
    """Each stage's rows against a plain version on the smallest table with rows to reject."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, "", None, None, 0)], table.schema)
    docs = table.unionByName(more)
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        assert docs.columns == columns
        steps[name] = docs.toPandas()
    rows = table.toPandas()
    assert sorted(steps["language_id"].doc_id) == sorted(rows.doc_id)
    exact = rows.groupby("text").doc_id.max()
    assert sorted(steps["exact_dedup"].doc_id) == sorted(exact)
    part = components([(r.doc_id, shingle_set(r.text, 5)) for r in steps["exact_dedup"].itertuples()], 80)
    assert sorted(steps["near_dedup"].doc_id) == sorted({part[i] for i in part})
    ids = set(steps["near_dedup"].doc_id)
    assert set(steps["mixing"].doc_id) <= ids and len(steps["mixing"]) > 0.3 * len(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(steps["mixing"].doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_language_stage_without_any_language(spark):
    docs = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    want = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    got = corpus_pipeline.identify_language(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(want) and want


def test_language_stage_rejects_what_no_learned_language_codes(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(1)
    odd = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 800)), "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 200))]
    docs = table.unionByName(spark.createDataFrame([(9001 + i, t, None, "s", len(t)) for i, t in enumerate(odd)], table.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in table.collect()}


def test_pipeline_of_awkward_and_of_no_rows(spark):
    for docs in (edge_docs(spark), no_docs(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, SF))
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
