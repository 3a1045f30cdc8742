"""Table-level contracts a job checks before it fits, scores or publishes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.operators.robust import require_fit_role
from trackweave.plans.track import Lag, Track, sweep


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")


def frame_report(df: DataFrame, track: Track, *, time: str, entity: str, finite: Mapping[str, str] = {}) -> DataFrame:
    """One row of counts: null ids, non-finite times, steps backward in source order, missing cells per column."""
    require_columns(df, time, entity, *finite.values())
    rows = sweep(df, track, {"_pt": Lag(F.col(time))})
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(entity).isNull()).alias("null_ids"),
        F.count_if(sc.finite(F.col(time)).isNull()).alias("bad_times"), F.count_if(F.col(time) < F.col("_pt")).alias("unordered"),
        *[F.count_if(sc.finite(F.col(c)).isNull()).alias(f"bad_{k}") for k, c in finite.items()],
    )


def assert_clean(report: DataFrame, *counters: str) -> None:
    """Raise with the counters that are not zero; the report has one row."""
    row = report.select(*counters).first()
    bad = {c: row[c] for c in counters if row[c]}
    if bad:
        raise ValueError(f"contract violated: {bad}")


def guarded_fit_input(df: DataFrame, synthetic: DataFrame, *, entity: str, role: str) -> DataFrame:
    """The rows, failing at run time on the first one that belongs to a synthetic entity."""
    require_fit_role(role, contains_synthetic=False)
    marked = df.join(synthetic.select(entity).distinct().withColumn("_syn", F.lit(True)), entity, "left")
    bad = F.raise_error(F.concat(F.lit("synthetic entity in a fit: "), F.col(entity).cast("string"))).cast("string")
    return marked.withColumn(entity, F.when(F.col("_syn"), bad).otherwise(F.col(entity))).drop("_syn")


def shared_owners(df: DataFrame, *, day: str, entity: str, part: str) -> DataFrame:
    """(day, entity) pairs found in more than one part."""
    one = df.select(day, entity, part).distinct().groupBy(day, entity).agg(F.count(F.lit(1)).alias("parts"))
    return one.filter(F.col("parts") > 1)


def new_ids(df: DataFrame, known: DataFrame, *, on: str) -> DataFrame:
    return df.select(on).distinct().join(known.select(on).distinct(), on, "left_anti")


def split_overlap(df: DataFrame, *, entity: str, split: str) -> DataFrame:
    """Entities in more than one split."""
    one = df.select(entity, split).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n_splits"))
    return one.filter(F.col("n_splits") > 1)


def split_contract(df: DataFrame, *, entity: str, split: str) -> DataFrame:
    """Ids and one digest per split, whatever the input order; an entity in two splits raises.

    Hashed ids are digested per three-digit prefix and the 4096 prefix digests once more, so
    no task holds a whole split.
    """
    ids = df.select(entity, split).distinct()
    if not split_overlap(ids, entity=entity, split=split).isEmpty():
        raise ValueError("splits overlap")
    hashed = ids.withColumn("_i", F.sha2(F.col(entity).cast("string"), 256))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    per = hashed.groupBy(split, F.substring("_i", 1, 3).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), joined("_i").alias("_d"))
    pairs = F.array_sort(F.collect_list(F.struct("_p", "_d")))
    digest = F.sha2(F.array_join(F.transform(pairs, lambda x: x["_d"]), ""), 256)
    return per.groupBy(split).agg(F.sum("_n").alias("ids"), digest.alias("digest"))


def input_manifest(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Bytes and SHA-256 per file of a ``binaryFile`` frame, with row counts per ``path`` when given."""
    out = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return out if rows is None else out.join(rows, "path", "left")


def schema_digest(df: DataFrame) -> str:
    import hashlib

    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    return hashlib.sha256(text.encode()).hexdigest()


def table_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, rows, columns, schema_sha256 and content of each table.

    ``content`` is the sum of the rows' hashes: the same for any order and file layout, and
    computed where the rows are, whatever the size of a file.
    """
    parts = []
    for name, df in tables.items():
        cells = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)")
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).cast("string").alias("content"))
        parts.append(one.select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(schema_digest(df)).alias("schema_sha256"), "content"))
    return reduce(DataFrame.unionByName, parts)


def clean_truth_report(df: DataFrame) -> DataFrame:
    """A clean reference carries no event id, no active or changed row and only evaluable rows."""
    bad = (
        F.col("event_id").isNotNull() | F.coalesce(F.col("injection_active"), F.lit(False))
        | F.coalesce(F.col("observable_changed"), F.lit(False)) | ~F.coalesce(F.col("evaluable_truth"), F.lit(False))
    )
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("violations"))


def provenance_problems(df: DataFrame, *, part: str, source: str, entity: str) -> DataFrame:
    """Parts with other than one source, or with rows lacking an entity id."""
    per = df.groupBy(part, source).agg(F.count_if(F.col(entity).isNull()).alias("_n"))
    out = per.groupBy(part).agg(F.count(source).alias("sources"), F.sum("_n").alias("null_ids"))
    return out.filter((F.col("sources") != 1) | (F.col("null_ids") > 0))


def union_layers(layers: Sequence[DataFrame], *, on: str) -> DataFrame:
    """All keys of all layers; a measure a key lacks is 0."""
    out = reduce(lambda a, b: a.join(b, on, "full"), layers)
    return out.na.fill(0, subset=[c for c in out.columns if c != on])


@dataclass(frozen=True)
class AlertBudget:
    """One false-alert level and what each channel gets of it: never more than the whole."""

    total_alpha: float
    channel_alpha: Mapping[str, float]

    def __post_init__(self) -> None:
        given = [self.total_alpha, *self.channel_alpha.values()]
        if not self.channel_alpha or any(not (math.isfinite(a) and 0 < a < 1) for a in given):
            raise ValueError("the total and every channel need an alpha inside (0, 1)")
        # the sum of shares may round up by the last bit
        if math.fsum(self.channel_alpha.values()) > self.total_alpha + math.ulp(1.0):
            raise ValueError("the channels get more than the total")


@dataclass(frozen=True)
class DetectorProfile:
    """Temporal rule of one channel; parameters of another mode are refused."""

    channel: str
    mode: str
    max_gap_s: float
    persistence_s: float | None = None
    reference_surprisal: float | None = None
    accumulation_threshold: float | None = None

    def __post_init__(self) -> None:
        if not self.max_gap_s > 0:
            raise ValueError("max_gap_s must be positive")
        wanted = {"instant": (), "persistence": ("persistence_s",), "accumulation": ("reference_surprisal", "accumulation_threshold")}
        if self.mode not in wanted:
            raise ValueError(f"unknown mode {self.mode!r}")
        for name in ("persistence_s", "reference_surprisal", "accumulation_threshold"):
            value, needed = getattr(self, name), name in wanted[self.mode]
            if needed and (value is None or not (math.isfinite(value) and value > 0)):
                raise ValueError(f"{self.mode} needs a positive {name}")
            if not needed and value is not None:
                raise ValueError(f"{self.mode} cannot carry {name}")

    def apply(self, df: DataFrame, track: Track, budget: AlertBudget, *, p_value: str = "conformal_p_value") -> DataFrame:
        from trackweave.operators.decide import temporal_evidence

        if self.channel not in budget.channel_alpha:
            raise ValueError(f"no alert allocation for {self.channel!r}")
        kw = {k: getattr(self, k) for k in ("persistence_s", "reference_surprisal", "accumulation_threshold")}
        out = temporal_evidence(df, track, p_value=p_value, alpha=budget.channel_alpha[self.channel], mode=self.mode, max_gap_s=self.max_gap_s, **kw)
        return out.withColumn("channel", F.lit(self.channel))


