"""Exact de-duplication by deterministic block naming.

A text's UTF-8 bytes are cut into blocks of a fixed size. The distinct blocks are sorted and
numbered; then adjacent pairs of numbers are named in the same way, level by level, until one
number is left for each document. Two texts of the same level and number are equal, and equal
texts always get the same: blocks are numbered by their content and pairs by their numbers,
never by a hash. A 64-bit hash of a block only spares the second shuffle of its content; where
two different blocks share a hash, content decides.

Copies shrink to one row per task before the content is shuffled. The number of levels is the
logarithm of the longest text in blocks; only documents of more than one block take part.

Null text counts as empty, an empty text is one empty block. Of equal texts the row with the
largest id stays (null is smallest; of rows with one id the first). Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.tables import written


def _numbered(names: DataFrame, *by: str, keep: tuple[Column | str, ...] | None = None) -> DataFrame:
    """Distinct rows with a number each, in sorted order within a partition; written, so numbers stay."""
    return written(names.sortWithinPartitions(*by).select(*(by if keep is None else keep), F.monotonically_increasing_id().alias("name")))


def block_names(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """doc_id, row, text_sha256, level and name of each row; (level, name) is the identity of its text."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    last = F.greatest(F.ceil(F.octet_length("raw") / F.lit(block_bytes)).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("raw", i * block_bytes + 1, F.lit(block_bytes)))
    texts = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"))
    tagged = texts.withColumn("row", F.monotonically_increasing_id())

    def described(of: DataFrame) -> DataFrame:
        return written(of.select("doc_id", "row", F.sha2("raw", 256).alias("text_sha256"), F.transform(cut, lambda b: F.xxhash64(b)).alias("hashes")))

    rows = described(tagged)
    blocks = texts.select(F.explode(cut).alias("block"))
    number = _numbered(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block", keep=(F.xxhash64("block").alias("h"),))
    shared = number.groupBy("h").count().filter("count > 1").select("h")
    clash = not shared.isEmpty()
    if clash:  # contents decide: rows and blocks are read from one table, so that they share row numbers
        tagged = written(tagged)
        rows = described(tagged)
    at = rows.select("row", F.posexplode("hashes").alias("pos", "h"))
    now = at.join(number.join(shared, "h", "left_anti"), "h").select("row", "pos", "name")
    if clash:
        apart = tagged.select("row", F.posexplode(cut).alias("pos", "block")).withColumn("h", F.xxhash64("block")).join(shared, "h", "left_semi")
        named = _numbered(apart.select("block").distinct(), "block").withColumn("name", -1 - F.col("name"))
        now = now.unionByName(apart.join(named, "block").select("row", "pos", "name"))
    count = rows.select("row", F.size("hashes").alias("n"))
    done = written(now.join(count.filter("n = 1"), "row").select("row", F.lit(0).alias("level"), "name"))
    now, level = written(now.join(count.filter("n > 1"), "row").select("row", "pos", "name", "n")), 0
    while not now.isEmpty():
        level += 1
        side = F.col("pos") % 2
        pairs = now.groupBy("row", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("n") + 1, 1).alias("n")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("a"), F.max(F.when(side == 1, F.col("name"))).alias("b"))
        pairs = written(pairs.withColumn("odd", F.col("b").isNull()).withColumn("b", F.coalesce("b", F.lit(0))))
        names = _numbered(pairs.select("a", "b", "odd").distinct(), "a", "b", "odd")
        up = written(pairs.join(names, ["a", "b", "odd"]).select("row", "pos", "name", "n"))
        done = done.unionByName(up.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        now = up.filter("n > 1")
    return rows.drop("hashes").join(done, "row")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    named = written(block_names(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes))
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("back")))
    # a table of its own, so that the join may split a hot group
    groups = written(named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")))
    out = named.join(groups, ["level", "name"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.back")).alias("kept"), "text_sha256")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
