"""Scalar expressions: units, flags, codes, buckets, intervals and hash draws."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit factors and the decimals kept
FT_TO_M = (0.3048, 1)
KN_TO_MPS = (0.5144, 2)
FPM_TO_MPS = (0.00508, 3)
GRAVITY = 9.80665

# fixed values: emergency vocabulary
SQUAWK_TYPE = {"7500": "unlawful", "7600": "nordo", "7700": "general"}
EMERGENCY_ALIAS = {
    "unlawful_interference": "unlawful",
    "minimum_fuel": "minfuel",
    "radio_failure": "nordo",
    "general_emergency": "general",
}
EMERGENCY_INACTIVE = ("", "none", "no_emergency", "noemergency")


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def convert(x: Column, unit: tuple[float, int]) -> Column:
    factor, decimals = unit
    return F.round(x.cast("double") * F.lit(factor), decimals)


def has_bit(flags: Column, bit: int) -> Column:
    """Flag test; null stays null."""
    return flags.bitwiseAND(F.lit(bit)) != 0


def military_from_flags(raw: Column) -> Column:
    """Lowest bit of a possibly malformed flag field; absent or malformed is false."""
    return F.coalesce(raw.cast("string").try_cast("long").bitwiseAND(F.lit(1)) == 1, F.lit(False))


def normalise_emergency(x: Column) -> Column:
    code = F.regexp_replace(F.lower(F.trim(x.cast("string"))), r"[\s\-/]+", "_")
    code = F.coalesce(F.try_element_at(literal_map(EMERGENCY_ALIAS), code), code)
    return F.when(~code.isin(*EMERGENCY_INACTIVE), code)


def normalise_squawk(x: Column) -> Column:
    text = F.regexp_replace(F.trim(x.cast("string")), r"^(\d+)\.0$", "$1")
    return F.when(text.rlike(r"^\d{1,3}$"), F.lpad(text, 4, "0")).otherwise(text)


def squawk_type(x: Column) -> Column:
    return F.try_element_at(literal_map(SQUAWK_TYPE), normalise_squawk(x))


def token(x: Column) -> Column:
    """Upper-case reason token; runs of other characters become one underscore."""
    t = F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(t == "", F.lit("UNSPECIFIED")).otherwise(t)


def cadence_bucket(dt: Column, edges: Sequence[float], max_gap: float) -> Column:
    """``cadence_<i>`` with i = edges below dt; ``gap`` beyond max_gap; else ``initial_or_invalid``."""
    if not edges or any(e <= 0 for e in edges) or list(edges) != sorted(set(edges)) or max_gap <= edges[-1]:
        raise ValueError("edges must be positive, strictly increasing and below max_gap")
    label = F.when(dt > max_gap, F.lit("gap")).when(dt.isNull() | (dt <= 0), F.lit("initial_or_invalid"))
    for i, edge in enumerate(edges):
        label = label.when(dt <= edge, F.lit(f"cadence_{i}"))
    return label.otherwise(F.lit(f"cadence_{len(edges)}"))


def coordinated_turn_rate(roll_rad: Column, airspeed: Column, *, gravity: float = GRAVITY) -> Column:
    return F.when(airspeed > 0, F.lit(gravity) * F.tan(roll_rad) / airspeed)


def vector_norm(*parts: Column) -> Column:
    """Euclidean norm; null if any part is null."""
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def total_and_spread(*parts: Column) -> tuple[Column, Column]:
    """Sum and population standard deviation across columns; null if any is null."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    mean = total / len(parts)
    return total, vector_norm(*[p - mean for p in parts]) / math.sqrt(len(parts))


def normalised_innovation(innovation: Column, variance: Column) -> Column:
    return finite(F.when(finite(variance) > 0, finite(innovation) / F.sqrt(variance)))


def ratio_alarm(ratios: Sequence[Column], flags: Column, evaluable: Column) -> Column:
    """Evaluable row whose largest ratio exceeds 1 or whose fault flags are set."""
    top = F.greatest(*ratios) if len(ratios) > 1 else ratios[0]
    hit = F.coalesce(top > 1, F.lit(False)) | F.coalesce(flags != 0, F.lit(False))
    return F.coalesce(evaluable, F.lit(False)) & hit


def rule_penalty(z: Mapping[str, Column], weights: Mapping[str, float], *, start: float = 3.0, cap: float = 10.0) -> Column:
    """Weighted sum of clip(|z|-start, 0, cap); a missing z adds nothing."""
    total = F.lit(0.0)
    for name, column in z.items():
        over = F.greatest(F.lit(0.0), F.least(F.abs(column) - start, F.lit(cap)))
        total = total + F.lit(float(weights.get(name, 1.0))) * F.when(column.isNotNull(), over).otherwise(0.0)
    return total


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a five-term rational fit (error below 7.5e-8)."""
    a = F.abs(z)
    k = 1.0 / (1.0 + 0.2316419 * a)
    # fixed values: published coefficients of the fit, ascending powers of k
    poly = F.lit(0.0)
    for c in reversed((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)):
        poly = (poly + c) * k
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def settled(x: Column) -> Column:
    """A sum of doubles without the digits that depend on the order in which it was added up; compare this with a threshold."""
    return F.round(x, 9)


def logit_standardise(p: Column, mu: float, sigma: float) -> Column:
    q = F.when(p.isNotNull(), F.greatest(F.lit(1e-6), F.least(p, F.lit(1 - 1e-6))))
    return (F.log(q / (1 - q)) - mu) / sigma


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval clamped to [0, 1]; null for an empty total."""
    n = F.when(total > 0, total.cast("double"))
    p, zz = successes / n, z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = middle - half, middle + half
    return (
        F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))),
        F.when(high.isNotNull(), F.least(high, F.lit(1.0))),
    )


def hash_unit(*parts: Column | str) -> Column:
    """Uniform draw in [0, 1) from SHA-256 of the NUL-joined parts: the same on any engine.

    The first 13 hex digits (52 bits) are used, which a double holds exactly.
    """
    text = F.concat_ws("\0", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def hash_normal(*parts: Column | str) -> Column:
    """Standard normal draw from two hashed uniforms."""
    u, v = hash_unit("u", *parts), hash_unit("v", *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def sha_fraction_below(fraction: float, *parts: Column | str) -> Column:
    """SHA-256 read as a fraction of 2^256 compared with ``fraction`` (as hex text)."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be inside (0, 1)")
    limit = f"{int(fraction * (1 << 60)) << 196:064x}"
    text = F.concat_ws("\0", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.sha2(text, 256) < F.lit(limit)
