"""Exact order statistics by counting passes: no sort, whatever the number of rows or distinct values.

A double maps to a 64-bit code of the same order. The first pass counts rows by the leading bits of
their codes; a running sum over these counts (at most 2^20 of a group, mostly a few thousand)
tells in which bucket each wanted rank lies and how far into it. The next pass counts only the
rows of those buckets by further bits, and so on: four passes settle all 64 bits, fewer once
every bucket in question holds one value. Groups and ranks share the passes. Each pass
reduces rows to counts before its shuffle, so neither a hot group nor a hot value meets in a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.plans.durable import durable

#: leading bits of the code settled after each pass
DEPTHS = (20, 34, 48, 64)
_MANTISSA, _BIAS = 1 << 52, 1022
_TINY, _HALF_STEP = 2.0**-1022, 2.0**537


def order_code(value: Column) -> Column:
    """A long ordered as the double: the bits of its magnitude, negative for negative values. Both zeros are 0, NaN is above all."""
    v = value.cast("double")
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    # a logarithm may round over a power of two: one step up or down
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(size < power, guess - 1).when(size / 2 >= power, guess + 1).otherwise(guess)
    unit = F.pow(F.lit(2.0), exponent)
    normal = (exponent + _BIAS).cast("long") * _MANTISSA + (size / unit * float(_MANTISSA)).cast("long")
    bits = (
        F.when(size < _TINY, (size * _HALF_STEP * _HALF_STEP).cast("long")).when(size == float("inf"), F.lit(2047 * _MANTISSA)).otherwise(normal)
    )
    signed = F.when(v < 0, -bits).otherwise(bits)
    return F.when(F.isnan(v), F.lit(2047 * _MANTISSA + 1)).otherwise(signed)


def decoded(code: Column) -> Column:
    """The double of a code."""
    bits = F.abs(code)
    exponent = F.shiftright(bits, 52).cast("int")
    rest = (bits - exponent.cast("long") * _MANTISSA).cast("double")
    normal = (rest / float(_MANTISSA) + 1.0) * F.pow(F.lit(2.0), exponent - 1023)
    size = F.when(exponent == 0, rest / _HALF_STEP / _HALF_STEP).when(bits == 2047 * _MANTISSA, float("inf")).when(bits > 2047 * _MANTISSA, float("nan")).otherwise(normal)
    return F.when(code < 0, -size).otherwise(size)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    return reduce(Column.__and__, [left[n].eqNullSafe(right[f"{prefix}{n}"]) for n in names], F.lit(True))


def at_ranks(df: DataFrame, groups: Sequence[str], value: str, wanted: Column) -> DataFrame:
    """(groups, rank, value, n): the value at each 0-based rank among a group's non-null values, n of them.

    ``wanted`` is an array of ranks over the column ``n``; ranks outside 0 .. n-1 are left out.
    """
    g = list(groups)
    codes = durable(df.filter(F.col(value).isNotNull()).select(*g, order_code(F.col(value)).alias("_code")))
    lo = Window.unboundedPreceding
    open_ = settled = None
    before = 0
    for depth in DEPTHS:
        at = F.shiftright("_code", 64 - depth) if depth < 64 else F.col("_code")
        if open_ is None:
            rows, by = codes, []
        else:
            held = open_.select(*[F.col(n).alias(f"_g_{n}") for n in g], F.col("_at").alias("_in")).distinct()
            rows = codes.join(held, _same(codes, held, g, "_g_") & (F.shiftright("_code", 64 - before) == F.col("_in"))).select(*g, "_in", "_code")
            by = ["_in"]
        counts = rows.groupBy(*g, *by, at.alias("_at")).agg(F.count(F.lit(1)).alias("_c"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi"))
        line = Window.partitionBy(*g, *by).orderBy("_at")
        counts = counts.withColumn("_upto", F.sum("_c").over(line.rowsBetween(lo, 0)))
        if open_ is None:
            counts = counts.withColumn("n", F.sum("_c").over(Window.partitionBy(*g)))
            # of the wanted ranks those that fall into this bucket, once each
            mine = F.filter(F.array_distinct(wanted), lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")))
            found = counts.select(*g, "n", F.explode(mine).alias("rank"), "_at", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_below"))
            found = found.withColumn("_rest", F.col("rank") - F.col("_below"))
        else:
            left = open_.select(*[F.col(n).alias(f"_g_{n}") for n in g], "n", "rank", F.col("_at").alias("_was"), "_rest")
            inside = (F.col("_rest") >= F.col("_upto") - F.col("_c")) & (F.col("_rest") < F.col("_upto"))
            found = counts.join(left, _same(counts, left, g, "_g_") & (F.col("_in") == F.col("_was")) & inside)
            found = found.select(*g, "n", "rank", "_at", "_lo", "_hi", (F.col("_rest") - (F.col("_upto") - F.col("_c"))).alias("_rest"))
        found = durable(found.select(*g, "n", "rank", "_at", "_lo", "_hi", "_rest"))
        done = found.filter("_lo = _hi").select(*g, "rank", decoded(F.col("_lo")).alias("value"), "n")
        settled = done if settled is None else settled.unionByName(done)
        open_, before = found.filter("_lo < _hi"), depth
        if depth == 64 or open_.isEmpty():
            return settled
    raise AssertionError("all bits are settled")


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group (numpy's default rule), one column per name, and n."""
    for name, p in probs.items():
        if not 0 <= p <= 1:
            raise ValueError(f"{name}: probability outside [0,1]")
    at = {k: F.lit(float(p)) * (F.col("n") - 1) for k, p in probs.items()}
    ranks = F.array(*[f(a).cast("long") for a in at.values() for f in (F.floor, F.ceil)])
    found = at_ranks(df, groups, value, ranks)
    pick = lambda r, name: F.max(F.when(F.col("rank") == r.cast("long"), F.col("value"))).alias(name)
    agg = found.groupBy(*groups).agg(
        F.max("n").alias("n"), *[c for k, a in at.items() for c in (pick(F.floor(a), f"_lo_{k}"), pick(F.ceil(a), f"_hi_{k}"))])
    # equal neighbours need no step between them, infinite ones have none
    step = lambda k, a: F.when(F.col(f"_lo_{k}") == F.col(f"_hi_{k}"), F.col(f"_lo_{k}")).otherwise(F.col(f"_lo_{k}") + (a - F.floor(a)) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")))
    return agg.select(*groups, "n", *[step(k, a).alias(k) for k, a in at.items()])
