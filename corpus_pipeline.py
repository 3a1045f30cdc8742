"""From documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import exactdup, language, mixing, neardup, packing
from trackweave.llm.tables import by_bytes, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: a stage fits its model on its own input, so no SQL expresses the whole; the tests compare it with a sequential version
ORACLE_SQL = None


#: bits a byte above which a text is in none of the languages learned: as it stands, a byte takes 8
MOST_BITS = 8.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null text, no letter, or coded by no learned language in ``MOST_BITS`` a byte.

    If no row has both a text and a language there is nothing to code by, and letters decide alone. Rows are judged by their
    text only: repeated rows and ids stay repeated, the given ``lang`` stays as it is.
    """
    by_bytes(spark)
    trees = language.learn(docs, id_col="doc_id", text_col="text", lang_col="lang")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    if trees is None:
        return language.lettered(rows, id_col="row").filter("lettered").select("doc_id.*")
    found = language.predict(rows, trees, id_col="row")
    return found.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS)).select("doc_id.*")


def _boxed(docs: DataFrame) -> DataFrame:
    """(row, i, h): whole rows, their id and the hash of their text; no column of ``docs`` can clash with a join's own."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("h"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, the one with the largest id; null text counts as empty, a null id is below all others, of rows that share id and text one stays."""
    found = written(exactdup.exact_duplicates(docs).select("doc_id", "text_sha256", "kept"))
    kept = found.filter("kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("g"))
    same = F.col("i").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g"))
    out = _boxed(docs).join(kept, same, "left_semi")
    # an id that repeats with its text meets its own key more than once
    again = written(found.groupBy("doc_id", "text_sha256").count().filter("count > 1").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("g")))
    if not again.isEmpty():
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["i", "h"]))
    return out.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more, the one with the smallest id.

    Texts without words are like no other and stay, as do rows without an id; rows that share an id stay or go together.
    """
    by_bytes(spark)
    kept = neardup.near_duplicates(docs, k=5, percent=80).filter("kept").select(F.col("doc_id").alias("k")).distinct()
    return _boxed(docs).join(kept, F.col("i").eqNullSafe(F.col("k")), "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and kinds of text take their target shares.

    Null source and language are values of their own. Documents without words are kept with the
    probability of their cell; rows that share an id are kept or left together.
    """
    return mixing.sampled(docs, mixing.TEMPER)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 2048: a row for each piece. Null and empty texts are their end token alone; rows are packed one by one, repeated ids too."""
    return packing.pack(docs, "word_bpe_49k.json", length=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
    ("mixing", mix_sources), ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
