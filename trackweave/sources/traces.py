"""Trace archives: tar members, trace documents, sparse updates, sampled inventory."""

from __future__ import annotations

import gzip
import tarfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import scalars as sc
from trackweave.plans.track import Carry, Running, Track, Whole, sweep

# fixed values: positions of a trace row and provider names of the forwarded fields
TRACE_CELLS = 14
UPDATE_FIELDS = {
    "squawk": "squawk", "emergency": "emergency", "nic": "nic", "rc": "rc", "nac_p": "nac_p", "sil": "sil", "adsb_version": "version",
    "sil_type": "sil_type", "sda": "sda", "nac_v": "nac_v",
}
HEADER_FIELDS = ("icao", "r", "t", "desc", "dbFlags", "timestamp", "trace", "noRegData")
DOC_SCHEMA = (
    "icao string, timestamp string, r string, t string, `desc` string, dbFlags string, noRegData boolean, trace array<array<string>>"
)
MEMBER_SCHEMA = "source_file string, member string, offset long, size long, error string"
TEXT_SCHEMA = "source_file string, member string, json_text string, error string"


def filesystem(path: str):
    """(filesystem, path on it) of a path or URI, whatever store it is on."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _open(path: str):
    where, name = filesystem(path)
    return where.open_input_file(name)


def archive_members(spark: SparkSession, pattern: str) -> DataFrame:
    """Trace members of plain tar archives with their byte ranges.

    Only headers are read here, so one large archive can be shared out by members afterwards.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows: list[tuple] = []
                try:
                    with _open(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                        while (m := tar.next()) is not None:
                            tar.members.clear()  # an archive's headers are not kept
                            if m.isfile() and "traces" in m.name and m.name.endswith((".json", ".json.gz")):
                                rows.append((path, m.name, m.offset_data, m.size, None))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=MEMBER_COLUMNS)
                                    rows = []
                except (tarfile.TarError, OSError) as e:
                    rows.append((path, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=MEMBER_COLUMNS)

    files = spark.read.format("binaryFile").load(pattern).select("path")
    # the number is given, else the few short names would be put together in one task
    return files.repartition(max(files.count(), 1), "path").mapInPandas(members, MEMBER_SCHEMA)


#: bytes of an archive that are read by one task at least
RANGE_BYTES = 16 << 20
MEMBER_COLUMNS = ["source_file", "member", "offset", "size", "error"]


def read_members(members: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Text of each member, gunzipped when needed; a bad member yields its error and no text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, part in pdf.groupby("source_file", sort=False):
                out = []
                with _open(path) as f:
                    for m in part.sort_values("offset").itertuples():
                        try:
                            f.seek(int(m.offset))
                            raw = f.read(int(m.size))
                            text = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                            out.append((path, m.member, text.decode("utf-8"), None))
                        except (OSError, EOFError, ValueError) as e:
                            out.append((path, m.member, None, str(e)))
                        if len(out) == 100:
                            yield pd.DataFrame(out, columns=["source_file", "member", "json_text", "error"])
                            out = []
                yield pd.DataFrame(out, columns=["source_file", "member", "json_text", "error"])

    good = members.filter(F.col("error").isNull() & F.col("member").isNotNull())
    # archives are read by (file, range) so that one archive is not one task and a task reads on where it is
    at = ["source_file", F.floor(F.col("offset") / RANGE_BYTES)]
    spread = good.repartition(tasks, *at) if tasks else good.repartition(*at)
    return spread.mapInPandas(read, TEXT_SCHEMA)


def parse_documents(docs: DataFrame) -> DataFrame:
    """Parsed document per row, plus ``bad`` for text that is no JSON object."""
    d = F.from_json("json_text", DOC_SCHEMA, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})
    return docs.withColumn("doc", d).withColumn("bad", F.col("doc").isNull() | (F.col("doc.icao").isNull() & F.col("doc.trace").isNull()))


def _number(c: Column) -> Column:
    return sc.finite(c.try_cast("double"))


def trace_rows(docs: DataFrame, *, source_type: str = "adsblol_historical") -> DataFrame:
    """One row per trace entry in SI units; rows are padded to 14 cells, ground altitude is no altitude.

    ``doc_id`` and ``row_pos`` order a document's rows; ``update`` is its sparse map.
    """
    parsed = parse_documents(docs).filter(~F.col("bad"))
    rows = parsed.select("source_file", "member", "doc", F.posexplode("doc.trace").alias("row_pos", "cell"))
    cell = lambda i: F.get("cell", F.lit(i))
    ground = cell(3) == "ground"
    meters = lambda i: F.when(cell(i) != "ground", sc.convert(_number(cell(i)), sc.FT_TO_M))
    flags = cell(6).try_cast("int")
    base, offset = _number(F.col("doc.timestamp")), _number(cell(0))
    updates = F.when(cell(8).startswith("{"), F.from_json(cell(8), "map<string,string>"))
    return rows.select(
        F.concat_ws("#", "source_file", "member").alias("doc_id"), F.col("row_pos").cast("long").alias("row_pos"), F.lit(source_type).alias("source_type"),
        F.col("doc.icao").alias("source_id"), (base + offset).alias("timestamp_utc"), offset.alias("t_offset"), _number(cell(1)).alias("lat"), _number(cell(2)).alias("lon"),
        F.when(~F.coalesce(ground, F.lit(False)), meters(3)).alias("alt"), meters(10).alias("alt_geom_m"), F.coalesce(ground, F.lit(False)).alias("on_ground"),
        F.lit(None).cast("string").alias("label"), sc.convert(_number(cell(4)), sc.KN_TO_MPS).alias("ground_speed_ms"), _number(cell(5)).alias("track_deg"),
        sc.convert(_number(cell(7)), sc.FPM_TO_MPS).alias("vertical_rate_ms"), sc.convert(_number(cell(12)), sc.KN_TO_MPS).alias("indicated_airspeed_ms"),
        _number(cell(13)).alias("roll_deg"), sc.has_bit(flags, 1).alias("flags_stale"), sc.has_bit(flags, 2).alias("flags_new_leg"), cell(9).alias("ads_source_type"),
        F.col("doc.r").alias("registration"), F.col("doc.t").alias("aircraft_type"), F.col("doc.desc").alias("description"),
        sc.military_from_flags(F.col("doc.dbFlags")).alias("is_military"), F.coalesce(F.col("doc.noRegData"), F.lit(False)).alias("no_reg_data"), updates.alias("update"),
    )


def carry_updates(
    rows: DataFrame, *, fields: dict[str, str] = UPDATE_FIELDS, entity: str = "doc_id", position: str = "row_pos", update: str = "update",
    time: str = "timestamp_utc", offset: str = "t_offset", chunk: float = 100_000.0,
) -> DataFrame:
    """Last reported value per field with its update flag, time and age.

    A key present in the sparse map is an update even when its value is null (a clear); an
    absent key keeps the previous report. Nothing crosses documents.
    """
    has = lambda k: F.coalesce(F.map_contains_key(F.col(update), k), F.lit(False))
    line = Track((entity,), (position,), chunk)
    box = lambda k: F.struct(F.try_element_at(F.col(update), F.lit(k)).alias("v"), F.col(time).alias("t"), F.col(offset).alias("o"))
    out = sweep(rows, line, {f"_c_{n}": Carry(box(k), when=has(k)) for n, k in fields.items()})
    cols: dict[str, Column] = {}
    for name, key in fields.items():
        c = F.col(f"_c_{name}")
        cols[name] = c["v"]
        cols[f"{name}_updated"] = has(key)
        cols[f"{name}_update_timestamp_utc"] = c["t"]
        cols[f"{name}_update_age_s"] = F.when(has(key), 0.0).otherwise(F.col(offset) - c["o"])
    return out.withColumns(cols).drop(*[f"_c_{n}" for n in fields])


def evenly_sampled(members: DataFrame, *, samples: int) -> DataFrame:
    """Evenly spaced members of each archive in file order: index floor(i n / samples)."""
    line = Track(("source_file",), ("offset",), 1e9)
    one = F.lit(1).cast("long")
    rows = sweep(members.filter(F.col("member").isNotNull()), line, {"_i": Running(one), "_n": Whole(one)})
    i, n = F.col("_i") - 1, F.col("_n")
    k = F.ceil(i * samples / n)
    keep = (n <= samples) | ((F.floor(k * n / samples) == i) & (k < samples))
    return rows.filter(keep).drop("_i", "_n")


def profile_documents(docs: DataFrame, *, header: Sequence[str] = HEADER_FIELDS, updates: Sequence[str] = tuple(UPDATE_FIELDS.values())) -> DataFrame:
    """(metric, key, count): header and update field presence, row lengths, categories, whole-second intervals, ground rows, errors."""
    parsed = parse_documents(docs)
    text = F.from_json("json_text", "map<string,string>")
    ok = parsed.filter(~F.col("bad")).withColumn("_keys", F.map_keys(text))
    counted = lambda df, metric: df.groupBy(F.lit(metric).alias("metric"), F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    heads = counted(ok.select(F.explode(F.array_intersect("_keys", F.array(*[F.lit(h) for h in header]))).alias("key")), "header_field")
    rows = trace_rows_raw(ok)
    per_doc = F.array_intersect(F.array_distinct(F.flatten(F.transform("doc.trace", lambda c: F.coalesce(F.map_keys(F.from_json(F.get(c, F.lit(8)), "map<string,string>")), F.array())))), F.array(*[F.lit(u) for u in updates]))
    seen = counted(ok.select(F.explode(per_doc).alias("key")), "update_field")
    lengths = counted(rows.select(F.size("cell").alias("key")), "row_length")
    cats = counted(rows.select(F.try_element_at(F.from_json(F.get("cell", F.lit(8)), "map<string,string>"), F.lit("category")).alias("key")).filter(F.length("key") > 0), "category")
    line = Track(("doc_id",), ("row_pos",), 100_000.0)
    from trackweave.plans.track import Lag

    off = _number(F.get("cell", F.lit(0)))
    steps = sweep(rows.withColumn("_o", off), line, {"_po": Lag(F.col("_o"))})
    gaps = counted(steps.select(F.rint(F.col("_o") - F.col("_po")).cast("long").alias("key")).filter(F.col("key").isNotNull()), "interval_s")
    grounds = counted(rows.filter(F.get("cell", F.lit(3)) == "ground").select(F.lit("on_ground").alias("key")), "rows")
    total = counted(rows.select(F.lit("all").alias("key")), "rows")
    errors = counted(parsed.filter("bad").select(F.lit("parse").alias("key")), "errors")
    out = heads
    for part in (seen, lengths, cats, gaps, grounds, total, errors):
        out = out.unionByName(part)
    return out


def trace_rows_raw(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.concat_ws("#", "source_file", "member").alias("doc_id"), F.posexplode("doc.trace").alias("row_pos", "cell"))
