"""The registered query of each operator, with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import contexts, exactdup, fingerprints, language, licenses, mixing, neardup, negatives, packing, repeats, runs, sharding, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), "word_bpe_49k.json", length=2048, ids=False)


@_query("op4_exact_dedup", exactdup.EXACT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(_documents(spark, sf_dir))


@_query("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), k=4, percent=80)


@_query("op7_mixing", mixing.mix_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir), mixing.TEMPER)
    return mixed.drop("draw").withColumn("probability", F.round("probability", 6))


@_query("op9_sharding", sharding.SHARD_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id")
    return sharding.place(docs, "doc_id", sharding.SHARDS, size=sharding.SIZE).select("doc_id", "slot", "shard")


@_query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    trees = language.learn(docs.filter(~language.held_out(F.col("doc_id"), 4, 2)), id_col="doc_id", text_col="text", lang_col="lang")
    out = language.predict(docs, trees)
    return out.select("doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.filter(~language.held_out(F.col("doc_id"), 5, 0)))
    out = toxicity.score(docs, model)
    return out.select("doc_id", language.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@_query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = language.held_out(F.col("doc_id"), 7, 2)
    out = contexts.score(_documents(spark, sf_dir), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


@_query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, sf_dir))


@_query("op5_license_scan", licenses.scan_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir), licenses.TEMPLATES).withColumn("containment", F.round("containment", 6))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The contract's texts: in a tenth of the documents the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    placed = chosen.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


@_query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_made_periodic(_documents(spark, sf_dir)), least=24, repeats=3)

    def higher(x: Column, y: Column) -> Column:
        """Greater exponent first, by whole numbers."""
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        tie = F.when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"]))
        return F.when(left != right, F.sign(right - left)).otherwise(tie).cast("int")

    top = F.get(F.array_sort("runs", higher), F.lit(0))
    line = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("top", top)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query("op12_hard_negatives", negatives.NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0, label=label, positives=5, negatives=3, low=50, high=95)


@_query("op13_repeat_removal")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(_documents(spark, sf_dir), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
