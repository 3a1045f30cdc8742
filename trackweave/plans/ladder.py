"""Value-ordered running totals without a single sorted partition.

Rows are first reduced to distinct values per group, kept as a checkpoint. As many range partitions
as their number asks for, each a run of neighbouring (group, value), become the buckets: a
group may lie in several of them and a bucket may hold several groups. Running totals are
local to a bucket plus the totals of the group's buckets below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.plans.durable import durable

_ALL = "_all"
_LO, _HI = Window.unboundedPreceding, Window.unboundedFollowing


def ladder(df: DataFrame, groups: Sequence[str], value: str, sums: Mapping[str, Column], *, bucket_rows: int = 1 << 20) -> DataFrame:
    """One row per (groups, distinct value): each sum, ``cum_<sum>`` up to it, ``tot_<sum>``.

    A sort task has about ``bucket_rows`` distinct values, however many there are.
    """
    if bucket_rows < 1:
        raise ValueError("bucket_rows must be >= 1")
    g = list(groups) or [_ALL]
    src = df if groups else df.withColumn(_ALL, F.lit(0))
    steps = durable(src.filter(F.col(value).isNotNull()).groupBy(*g, value).agg(*[F.sum(e).alias(k) for k, e in sums.items()]))
    buckets = -(-steps.count() // bucket_rows)
    cols = [F.col(c) for c in [*groups, value, *sums]]
    if buckets <= 1:
        upto, whole = Window.partitionBy(*g).orderBy(value).rowsBetween(_LO, 0), Window.partitionBy(*g)
        return steps.select(*cols, *[F.sum(k).over(upto).alias(f"cum_{k}") for k in sums], *[F.sum(k).over(whole).alias(f"tot_{k}") for k in sums])
    # the number of a range partition is only known once its rows are laid down
    placed = durable(steps.repartitionByRange(buckets, *g, value).withColumn("_b", F.spark_partition_id()))
    along = Window.partitionBy(*g).orderBy("_b")
    below = placed.groupBy(*g, "_b").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums]).select(
        *[F.col(c).alias(f"_g_{c}") for c in [*g, "_b"]],
        *[F.sum(f"_t_{k}").over(along.rowsBetween(_LO, -1)).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(along.rowsBetween(_LO, _HI)).alias(f"tot_{k}") for k in sums],
    )
    w = Window.partitionBy(*g, "_b").orderBy(value).rowsBetween(_LO, 0)
    same = F.lit(True)
    for c in [*g, "_b"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = placed.withColumns({f"_l_{k}": F.sum(k).over(w) for k in sums}).join(below, same)
    cols += [(F.col(f"_l_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0))).alias(f"cum_{k}") for k in sums]
    return out.select(*cols, *[F.col(f"tot_{k}") for k in sums])


def long_form(df: DataFrame, keep: Sequence[str], channels: Sequence[str], *, name: str = "channel", value: str = "v") -> DataFrame:
    """Channels as rows; NaN and infinities count as missing."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    pairs = F.array(*[F.struct(F.lit(c).alias(name), finite(F.col(c).cast("double")).alias(value)) for c in channels])
    return df.select(*keep, F.inline(pairs))
