"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table. Shards take
turns; in its turn a shard claims the first slot of its order that is still free. A key's
shard is the entry at its hash modulo the table size: one look-up, whatever the number of
keys. Slots are shared out evenly to one turn, and few keys move when a shard leaves or joins.

The table depends on the names of the shards alone and has ``size`` rows (a parameter), which
bounds what is broadcast. Placing rows is a hash and a broadcast join: rows are not shuffled.

A null key is placed as the empty string, repeated keys share a shard. Columns of the input
are kept; a clash with ``slot`` or ``shard`` is an error that names the column. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(text: str, modulus: int) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % modulus


def fill(shards: Sequence[str], size: int, weights: Mapping[str, float] | None = None) -> list[int]:
    """Number of the shard of each slot. A shard of weight w (up to 1) takes the share w of turns."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named apart")
    if size <= len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime above the number of shards")
    share = [float((weights or {}).get(s, 1.0)) for s in shards]
    if not all(0 < w <= 1 for w in share):
        raise ValueError("weights lie above 0 and up to 1")
    at = [_draw(f"{s}|offset", size) for s in shards]
    skip = [_draw(f"{s}|skip", size - 1) + 1 for s in shards]
    table, free, turn = [-1] * size, size, 0
    while free:
        for i, w in enumerate(share):
            if not free or int((turn + 1) * w) == int(turn * w):
                continue
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            free -= 1
        turn += 1
    return table


def slot_of(key: Column, size: int) -> Column:
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size))


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """slot, shard: ``size`` rows."""
    names = F.array(*[F.lit(s) for s in shards])
    entries = F.from_json(F.lit(json.dumps(fill(shards, size, weights))), "array<int>")
    rows = spark.range(1).select(F.posexplode(entries).alias("slot", "number"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("number") + 1).alias("shard"))


def place(df: DataFrame, key: str, shards: Sequence[str], *, size: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``df`` with the slot and shard of each row."""
    if clash := {"slot", "shard"} & set(df.columns):
        raise ValueError(f"columns in use: {sorted(clash)}")
    table = lookup_table(df.sparkSession, shards, size, weights)
    return df.withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot")


def write_shards(placed: DataFrame, path: str, *, spread: int = 8, spread_by: str = "slot") -> None:
    """One folder per shard, each written by up to ``spread`` tasks so that a hot shard is not one task."""
    salt = F.pmod(F.xxhash64(spread_by), F.lit(spread))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)


SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
SIZE = 3203

SHARD_SQL = f"""
WITH RECURSIVE names AS (SELECT range AS i, printf('shard-%02d', range) AS shard FROM range({len(SHARDS)})),
prefs AS (
  SELECT list(('0x' || substr(sha256(shard || '|offset'), 1, 15))::BIGINT % {SIZE} ORDER BY i) AS start,
         list(('0x' || substr(sha256(shard || '|skip'), 1, 15))::BIGINT % {SIZE - 1} + 1 ORDER BY i) AS skip FROM names),
claims(step, slot, taken) AS (
  SELECT -1::BIGINT, -1::BIGINT, list_transform(range({SIZE}), lambda x: false) FROM prefs
  UNION ALL
  SELECT step + 1, claim, list_transform(taken, lambda t, k: t OR k = claim + 1) FROM (
    SELECT step, taken, list_filter(list_transform(range({SIZE}), lambda j: (start[(step + 1) % {len(SHARDS)} + 1] + j * skip[(step + 1) % {len(SHARDS)} + 1]) % {SIZE}),
                                    lambda s: NOT taken[s + 1])[1] AS claim
    FROM claims, prefs WHERE step + 1 < {SIZE})),
seats AS (SELECT slot, printf('shard-%02d', step % {len(SHARDS)}) AS shard FROM claims WHERE step >= 0)
SELECT d.doc_id, s.slot, s.shard
FROM (SELECT doc_id, ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SIZE} AS slot FROM documents) d JOIN seats s USING (slot)"""
