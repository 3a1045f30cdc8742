"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link in (a, b).

    Each round first hangs a node's larger neighbours under its smallest neighbour, then its
    smaller ones; rounds number about the logarithm of the longest path. Links that form stars
    already, the common case, are done after the first look. A round's links are a written
    table, and only whether there is a node out of place leaves the cluster.
    """
    edges = written(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        # a < b throughout; a star's centre has no parent and its rim one each
        ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("parents")).union(edges.select(F.col("b").alias("node"), F.lit(1).alias("parents")))
        odd = ends.groupBy("node").agg(F.min("parents").alias("lo"), F.sum("parents").alias("n")).filter("n > 1 OR n = 1 AND lo = 0")
        if odd.isEmpty():
            break
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        low = up.groupBy("b").agg(F.min("a").alias("m"))
        hung = up.join(low, "b").select(F.explode(F.array(F.struct("m", F.col("a").alias("w")), F.struct("m", F.col("b").alias("w")))).alias("e")).select("e.*")
        edges = written(hung.filter("m <> w").select(F.col("m").alias("a"), F.col("w").alias("b")).distinct())
    tops = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(tops)


#: 64-bit words of a parity bitmap of a whole set
PARITY_LONGS = 16


def bits_apart(x: str, y: str, longs: int) -> Column:
    """Bits in which the bitmaps x and y differ."""
    return reduce(Column.__add__, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(longs)])


def buckets(keyed: DataFrame, *, crowd: int = 16) -> DataFrame:
    """(key, node, leader, second) of keys that several nodes of ``keyed`` (key, node) share.

    The leader is the smallest node of a bucket. Buckets of more than ``crowd`` nodes are also
    divided by a hash of node and key, and the smallest node of a division is its second.
    """
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).filter("leader < last").drop("last")
    rows = written(keyed.join(shared, "key"))
    crowded = rows.filter(F.col("n") > crowd).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.lit(crowd)))
    heads = crowded.groupBy("key", "part").agg(F.min("node").alias("second"))
    few = rows.filter(F.col("n") <= crowd).select("key", "node", "leader", F.col("leader").alias("second"))
    return few.unionByName(crowded.join(heads, ["key", "part"]).select("key", "node", "leader", "second"))


def linked(
    bucket: DataFrame, confirm: Callable[[DataFrame], DataFrame], extra: DataFrame | None = None,
    bound: Callable[[DataFrame], DataFrame] | None = None, percent: int = 80,
) -> DataFrame:
    """Components that confirming all pairs of nodes with a common key would give.

    ``bucket`` comes from ``buckets``, ``extra`` holds further links. Every node is compared with
    the leader and the second of each of its buckets; once components are known, buckets that
    still span several compare the nodes outside the leader's component with the rest.
    Pairs inside a component are never written out. ``bound`` gives (node, n, c, parity) for nodes:
    a set of n values shares at most c of them with another node's, and two sets differ in at
    least as many values as their parity bitmaps in bits. That spares, without loss, the
    pairs that cannot have ``percent`` % of their union in common.
    """
    bucket = written(bucket)
    heads = bucket.select(F.explode(F.array("leader", "second")).alias("a"), F.col("node").alias("b")).filter("a <> b")
    links = confirm(heads.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    part = written(components(links if extra is None else links.union(extra)))
    spread = written(bucket.select("key", "node", "leader").join(part, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = spread.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.when(F.col("node") == F.col("leader"), F.col("component"))).alias("home")).filter("lo < hi")
    spread = written(spread.join(mixed.select("key", "home"), "key"))
    able = F.lit(True)
    if bound is not None:
        spread = spread.join(written(bound(spread.select("node").distinct())), "node")
        most = F.least("xc", "yc")
        able = (most * 100 >= (F.col("xn") + F.col("yn") - most) * percent) & (bits_apart("xparity", "yparity", PARITY_LONGS) * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent))
        spread = spread.filter(F.col("c") * 100 >= F.col("n") * percent)
    side = lambda df, v: df.select("key", F.col("node").alias(v), F.col("component").alias(f"{v}p"), *[F.col(c).alias(f"{v}{c}") for c in ("n", "c", "parity") if bound is not None])
    outside, rest = side(spread.filter("component <> home"), "x"), side(spread.filter("node <> leader"), "y")
    pairs = outside.join(rest, (outside["key"] == rest["key"]) & (F.col("xp") != F.col("yp")) & able).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    more = written(confirm(pairs))
    if more.isEmpty():
        return part
    return components(part.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
