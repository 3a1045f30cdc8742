"""Quality states, filters, predicates and contracts."""

from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.functions import scalars as sc
from trackweave.operators import contracts as ct
from trackweave.operators import filters as fl
from trackweave.operators import quality as ql
from trackweave.operators import routes as rt
from trackweave.operators.episodes import explode_reasons, reason_episodes
from trackweave.suites.base import POSITION, TRACK, query, r6, rounded, table, telemetry

Q = """q AS (SELECT row_pos, source_id, t, alt, alt_geom_m, on_ground,
 CASE row_pos % 23 WHEN 0 THEN '7500' WHEN 1 THEN '7700' WHEN 2 THEN '700.0' WHEN 3 THEN NULL WHEN 4 THEN '7600' ELSE '1200' END AS squawk,
 CASE row_pos % 19 WHEN 0 THEN 'General Emergency' WHEN 1 THEN 'unlawful' WHEN 2 THEN 'none' WHEN 3 THEN NULL WHEN 4 THEN 'Minimum-Fuel' WHEN 5 THEN 'weird! code' ELSE 'No Emergency' END AS emergency,
 CASE row_pos % 13 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 7.5 WHEN 3 THEN 12.0 WHEN 4 THEN 6.0 ELSE 8.0 END AS nic,
 CASE row_pos % 11 WHEN 0 THEN NULL WHEN 1 THEN 0.0 WHEN 2 THEN 7.0 ELSE 9.0 END AS nac_p, CASE row_pos % 7 WHEN 0 THEN NULL WHEN 1 THEN 2.0 ELSE 3.0 END AS sil,
 CASE row_pos % 17 WHEN 0 THEN NULL WHEN 1 THEN 1.0 WHEN 2 THEN 5.0 ELSE 2.0 END AS adsb_version,
 CASE row_pos % 29 WHEN 0 THEN NULL WHEN 1 THEN 'mlat' ELSE 'adsb_icao' END AS ads_source_type, CASE row_pos % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS faa_reference_scope,
 CASE row_pos % 6 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS squawk_updated, CASE WHEN row_pos % 6 <> 2 THEN t END AS squawk_update_timestamp_utc,
 CASE row_pos % 6 WHEN 2 THEN NULL WHEN 3 THEN -1.0 WHEN 4 THEN 30.0 WHEN 5 THEN 90.0 ELSE 0.0 END AS squawk_update_age_s,
 row_pos % 2 = 0 AS emergency_updated, t AS emergency_update_timestamp_utc, 10.0 + row_pos % 80 AS emergency_update_age_s FROM tel)"""
CLS = f"""{Q}, f AS (SELECT *, CASE WHEN squawk_updated IS NULL THEN 'freshness_unknown' WHEN squawk_updated THEN 'fresh' WHEN squawk_update_age_s < 0 THEN 'invalid_update_metadata' WHEN squawk_update_age_s <= 60 THEN 'fresh'
 WHEN squawk_update_age_s IS NOT NULL THEN 'stale' WHEN squawk_update_timestamp_utc IS NULL THEN 'never_observed' ELSE 'freshness_unknown' END AS sf,
 CASE WHEN emergency_updated THEN 'fresh' WHEN emergency_update_age_s <= 60 THEN 'fresh' ELSE 'stale' END AS ef,
 CASE squawk WHEN '7500' THEN 'unlawful' WHEN '7600' THEN 'nordo' WHEN '7700' THEN 'general' END AS st,
 CASE emergency WHEN 'General Emergency' THEN 'general' WHEN 'unlawful' THEN 'unlawful' WHEN 'Minimum-Fuel' THEN 'minfuel' WHEN 'weird! code' THEN 'weird!_code' END AS et,
 CASE WHEN on_ground THEN 'ground_not_applicable' WHEN ads_source_type IS NULL OR ads_source_type NOT LIKE 'adsb%' THEN 'not_adsb_source' WHEN adsb_version IS NULL THEN 'version_missing' WHEN adsb_version = 5 THEN 'version_schema_invalid'
  WHEN adsb_version <> 2 THEN 'version_ineligible' WHEN faa_reference_scope IS NULL THEN 'scope_unknown' WHEN NOT faa_reference_scope THEN 'outside_asserted_scope' ELSE 'eligible' END AS scope,
 CASE WHEN adsb_version IS NULL THEN 'missing' WHEN adsb_version = 5 THEN 'schema_invalid' ELSE 'valid' END AS vs,
 CASE WHEN on_ground THEN 'GROUND_ALT_NOT_APPLICABLE' WHEN alt IS NULL AND alt_geom_m IS NOT NULL THEN 'BARO_ALT_DROPOUT' WHEN alt IS NULL THEN 'ALL_ALTITUDE_UNAVAILABLE' ELSE 'AVAILABLE' END AS alt_state,
 t - lag(t) OVER (PARTITION BY source_id ORDER BY row_pos) > 43200 AS gap FROM q),
 c AS (SELECT *, CASE WHEN st IS NULL AND et IS NULL THEN 'not_applicable' WHEN st IS NOT NULL AND et IN ('general', 'unlawful', 'nordo') AND sf = 'fresh' AND ef = 'fresh' THEN CASE WHEN st = et THEN 'corroborated' ELSE 'contradictory' END ELSE 'not_corroborated' END AS cons,
 CASE WHEN nic IS NULL THEN 'missing' WHEN nic IN (7.5, 12) THEN 'schema_invalid' WHEN nic = 0 THEN 'reported_unknown_or_unavailable' WHEN scope <> 'eligible' THEN 'reported_valid_outside_faa_reference_scope' WHEN nic < 7 THEN 'below_faa_reference' ELSE 'meets_faa_reference' END AS nic_s,
 CASE WHEN nac_p IS NULL THEN 'missing' WHEN nac_p = 0 THEN 'reported_unknown_or_unavailable' WHEN scope <> 'eligible' THEN 'reported_valid_outside_faa_reference_scope' WHEN nac_p < 8 THEN 'below_faa_reference' ELSE 'meets_faa_reference' END AS nac_s,
 CASE WHEN sil IS NULL THEN 'missing' WHEN scope <> 'eligible' THEN 'reported_valid_outside_faa_reference_scope' WHEN sil < 3 THEN 'below_faa_reference' ELSE 'meets_faa_reference' END AS sil_s FROM f),
 r AS (SELECT *, list_filter([CASE WHEN st IS NOT NULL THEN 'DECLARED_SQUAWK_' || upper(st) END, CASE WHEN et IS NOT NULL THEN 'DECLARED_EMERGENCY_' || trim(regexp_replace(upper(et), '[^A-Z0-9]+', '_', 'g'), '_') END,
  CASE WHEN st IS NOT NULL OR et IS NOT NULL THEN 'DECLARED_STATUS_' || upper(cons) END, CASE WHEN vs = 'schema_invalid' THEN 'POSITION_QUALITY_ADSB_VERSION_SCHEMA_INVALID' END,
  CASE WHEN nic_s NOT LIKE 'meets%' AND nic_s NOT LIKE 'reported_valid%' THEN 'POSITION_QUALITY_NIC_' || upper(nic_s) END, CASE WHEN nac_s NOT LIKE 'meets%' AND nac_s NOT LIKE 'reported_valid%' THEN 'POSITION_QUALITY_NAC_P_' || upper(nac_s) END,
  CASE WHEN sil_s NOT LIKE 'meets%' AND sil_s NOT LIKE 'reported_valid%' THEN 'POSITION_QUALITY_SIL_' || upper(sil_s) END, 'ALTITUDE_AVAILABILITY_' || alt_state, CASE WHEN gap THEN 'MESSAGE_GAP' END], lambda z: z IS NOT NULL) AS codes FROM c),
 lg AS (SELECT source_id, row_pos, t, unnest(codes) AS code FROM r),
 ln AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY row_pos) AS pos FROM r), lp AS (SELECT source_id, pos, t, unnest(codes) AS code FROM ln),
 ep AS (SELECT *, CASE WHEN code = 'MESSAGE_GAP' OR pos - lag(pos) OVER (PARTITION BY source_id, code ORDER BY pos) IS DISTINCT FROM 1 THEN 1 ELSE 0 END AS st FROM lp),
 ei AS (SELECT *, sum(st) OVER (PARTITION BY source_id, code ORDER BY pos) AS k FROM ep)"""
RULES = ql.QualityRules(gap_s=43200.0)


def quality_rows(spark, d):
    i, t = F.col("row_pos"), F.col("t")

    def pick(mod, default, **cases):
        out = None
        for k, v in cases.items():
            cond = i % mod == int(k[1:])
            out = F.when(cond, v) if out is None else out.when(cond, v)
        return out.otherwise(default)

    none = F.lit(None)
    return telemetry(spark, d).withColumns({
        "squawk": pick(23, "1200", m0="7500", m1="7700", m2="700.0", m3=none, m4="7600"),
        "emergency": pick(19, "No Emergency", m0="General Emergency", m1="unlawful", m2="none", m3=none, m4="Minimum-Fuel", m5="weird! code"),
        "nic": pick(13, 8.0, m0=none, m1=0.0, m2=7.5, m3=12.0, m4=6.0), "nac_p": pick(11, 9.0, m0=none, m1=0.0, m2=7.0), "sil": pick(7, 3.0, m0=none, m1=2.0),
        "adsb_version": pick(17, 2.0, m0=none, m1=1.0, m2=5.0), "ads_source_type": pick(29, "adsb_icao", m0=none, m1="mlat"),
        "faa_reference_scope": pick(5, True, m0=none, m1=False),
        "squawk_updated": pick(6, False, m0=True, m1=none), "squawk_update_timestamp_utc": F.when(i % 6 != 2, t),
        "squawk_update_age_s": pick(6, 0.0, m2=none, m3=-1.0, m4=30.0, m5=90.0),
        "emergency_updated": i % 2 == 0, "emergency_update_timestamp_utc": t, "emergency_update_age_s": 10.0 + i % 80,
    })


def classified(spark, d):
    return ql.classify(quality_rows(spark, d), POSITION, time="t", rules=RULES)


def numbered(spark, d):
    from trackweave.plans.track import Running, close, settle, sweep

    # classified once; the sweep would do it again for its carries
    slim = settle(classified(spark, d).select("source_id", "row_pos", "t", "reason_codes"), POSITION)
    return close(sweep(slim, POSITION, {"pos": Running(F.lit(1).cast("long"))}))


@query("b12_reason_codes", f"WITH {CLS} SELECT row_pos, array_to_string(codes, ',') AS codes FROM r")
def _(spark, d):
    return classified(spark, d).select("row_pos", F.array_join("reason_codes", ",").alias("codes"))


@query("b13_scope_status", f"WITH {CLS} SELECT row_pos, scope, vs AS version_status FROM r")
def _(spark, d):
    return classified(spark, d).select("row_pos", F.col("position_quality_scope").alias("scope"), F.col("adsb_version_status").alias("version_status"))


@query("b14_quality_value_status", f"WITH {CLS} SELECT row_pos, nic_s AS nic, nac_s AS nac_p, sil_s AS sil FROM r")
def _(spark, d):
    return classified(spark, d).select("row_pos", *[F.col(f"position_quality_{f}_status").alias(f) for f in ("nic", "nac_p", "sil")])


@query("b15_altitude_availability", f"WITH {CLS} SELECT row_pos, alt_state AS state FROM r")
def _(spark, d):
    return classified(spark, d).select("row_pos", F.col("altitude_availability").alias("state"))


@query("b16_field_freshness", f"WITH {CLS} SELECT row_pos, sf AS squawk, ef AS emergency, 'freshness_unknown' AS nic FROM r")
def _(spark, d):
    return classified(spark, d).select("row_pos", *[F.col(f"{f}_freshness").alias(f) for f in ("squawk", "emergency", "nic")])


@query("b17_declared_status", f"WITH {CLS} SELECT row_pos, st AS squawk_type, et AS emergency_type, cons AS consistency FROM r")
def _(spark, d):
    c = classified(spark, d)
    return c.select("row_pos", F.col("declared_squawk_type").alias("squawk_type"), F.col("declared_emergency_type").alias("emergency_type"), F.col("declared_status_consistency").alias("consistency"))


@query("h13_normalise_codes", f"WITH {CLS} SELECT row_pos, et AS emergency, CASE WHEN squawk = '700.0' THEN '0700' ELSE squawk END AS squawk FROM r")
def _(spark, d):
    q = quality_rows(spark, d)
    return q.select("row_pos", sc.normalise_emergency(F.col("emergency")).alias("emergency"), sc.normalise_squawk(F.col("squawk")).alias("squawk"))


@query("e8_explode_reasons", f"""WITH {CLS} SELECT row_pos, code AS reason_code, CASE WHEN code LIKE 'DECLARED%' THEN 'declared_status' WHEN code LIKE 'POSITION%' THEN 'position_quality' WHEN code LIKE 'ALT%' THEN 'altitude_availability' ELSE 'message_gap' END AS channel FROM lg""")
def _(spark, d):
    return explode_reasons(classified(spark, d), identity=["row_pos"])


@query("e7_reason_episodes", f"WITH {CLS} SELECT source_id, code AS reason_code, min(t) AS episode_start, max(t) AS episode_end, count(*) AS n_rows FROM ei GROUP BY source_id, code, k")
def _(spark, d):
    long = explode_reasons(numbered(spark, d), identity=["source_id", "pos", "t"])
    return reason_episodes(long, entity="source_id", position="pos", time="t").drop("channel")


SUMMARY = f"WITH {CLS} SELECT code AS reason_code, count(*) AS rows, count(DISTINCT source_id) AS flights, CAST(sum(st) AS BIGINT) AS episodes FROM ei GROUP BY code"


@query("d25_quality_summary", SUMMARY)
def _(spark, d):
    return ql.reason_summary(numbered(spark, d), entity="source_id", position="pos").drop("channel")


@query("d25_state_counts", f"WITH {CLS} SELECT 'scope' AS field, scope AS state, count(*) AS rows FROM r GROUP BY scope UNION ALL SELECT 'sf', sf, count(*) FROM r GROUP BY sf")
def _(spark, d):
    c = classified(spark, d).withColumnsRenamed({"position_quality_scope": "scope", "squawk_freshness": "sf"})
    return ql.state_counts(c, ["scope", "sf"])


@query("d25_altitude_exposure", f"""WITH {CLS}, g AS (SELECT alt_state, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, row_pos) AS dt FROM r)
SELECT alt_state AS altitude_availability, round(sum(CASE WHEN dt > 0 AND dt <= 43200 THEN dt ELSE 0 END), 2) AS exposure_s FROM g GROUP BY alt_state""")
def _(spark, d):
    return rounded(ql.altitude_exposure(classified(spark, d), TRACK, max_gap_s=43200.0), "exposure_s", n=2)


@query("d26_merge_summaries", SUMMARY)
def _(spark, d):
    rows = numbered(spark, d)
    odd = F.col("source_id").cast("long") % 2 == 1
    parts = [ql.reason_summary(rows.filter(c), entity="source_id", position="pos").withColumn("contract", F.lit("gap=43200")) for c in (odd, ~odd)]
    return ql.merge_summaries(parts[0].unionByName(parts[1]), contract="contract").drop("channel", "contract")


# ---------------------------------------------------------------- filters
@query("b3_bbox_filter", "SELECT row_pos FROM tel WHERE lat BETWEEN -20 AND 30 AND lon BETWEEN 0 AND 90")
def _(spark, d):
    return telemetry(spark, d).filter(fl.in_box(-20, 30, 0, 90)).select("row_pos")


@query("b4_source_filter", "SELECT row_pos FROM tel WHERE source_type IN ('view', 'click')")
def _(spark, d):
    return telemetry(spark, d).filter(F.col("source_type").isin("view", "click")).select("row_pos")


@query("b5_map_filter", "SELECT row_pos FROM tel WHERE (NOT is_military) AND NOT on_ground AND (alt IS NULL OR alt BETWEEN 2000 AND 6000)")
def _(spark, d):
    return telemetry(spark, d).filter(fl.map_filter(civil=True, military=False, ground=False, low=2000, high=6000)).select("row_pos")


@query("b6_signal_staleness", "SELECT row_pos, CASE WHEN row_pos % 7 = 0 THEN false ELSE x > 60 END AS is_stale FROM tel")
def _(spark, d):
    age = F.when(F.col("row_pos") % 7 != 0, F.col("x"))
    return telemetry(spark, d).select("row_pos", fl.is_stale(age, 60.0).alias("is_stale"))


@query("b7_emergency_predicate", f"WITH {CLS} SELECT row_pos FROM r WHERE squawk IN ('7500', '7600', '7700') OR et IS NOT NULL")
def _(spark, d):
    return quality_rows(spark, d).filter(fl.is_emergency(F.col("squawk"), F.col("emergency"))).select("row_pos")


@query("b8_callsign_search", """WITH m AS (SELECT c_custkey, c_name, CASE WHEN upper(trim(c_name)) = '0000012' THEN 0 WHEN contains(upper(trim(c_name)), '0000012') THEN 1 END AS match_rank FROM customer)
SELECT c_name, match_rank FROM m WHERE match_rank IS NOT NULL ORDER BY match_rank, upper(trim(c_name)) LIMIT 1""", tel=False)
def _(spark, d):
    return rt.callsign_search(table(spark, d, "customer").select("c_custkey", "c_name"), query=" 0000012 ", callsign="c_name").select("c_name", "match_rank")


@query("b9_mlat_filter", "SELECT source_type, count(*) FILTER (WHERE x > 40) AS n, round(count(*) FILTER (WHERE x > 40) / count(*), 6) AS share FROM tel GROUP BY source_type")
def _(spark, d):
    return rounded(fl.share_by(telemetry(spark, d), ["source_type"], F.col("x") > 40), "share")


@query("b10_complete_rows", "SELECT row_pos, alt IS NOT NULL AND alt_geom_m IS NOT NULL AND NOT on_ground AND NOT alarm AS eligible FROM tel")
def _(spark, d):
    ok = fl.complete_rows(["alt", "alt_geom_m"], target="x", phase=F.when(F.col("on_ground"), "ground").otherwise("cruise"), boundary=F.col("alarm"))
    return telemetry(spark, d).select("row_pos", ok.alias("eligible"))


@query("b11_time_range", "SELECT row_pos FROM tel WHERE t_us BETWEEN epoch_us(TIMESTAMP '2024-01-10 00:00:00') AND epoch_us(TIMESTAMP '2024-01-12 06:00:00')")
def _(spark, d):
    df = telemetry(spark, d).withColumn("ts", F.timestamp_micros("t_us"))
    return fl.time_range(df, ts="ts", start="2024-01-10T00:00:00Z", end="2024-01-12T06:00:00Z").select("row_pos")


@query("b11_last_hours", "SELECT row_pos FROM tel WHERE t_us >= (SELECT max(t_us) FROM tel) - 168 * 3600000000")
def _(spark, d):
    df = telemetry(spark, d).withColumn("ts", F.timestamp_micros("t_us"))
    return fl.last_hours(df, ts="ts", hours=1000, retention=168, now=df.agg(F.max("ts")).scalar()).select("row_pos")


@query("b18_not_evaluable_reason", "SELECT row_pos, CASE WHEN on_ground THEN 'landed' WHEN alt IS NULL THEN 'missing_innovation' WHEN x > 100 THEN 'time_gap' ELSE '' END AS reason FROM tel")
def _(spark, d):
    gates = {"landed": F.col("on_ground"), "missing_innovation": F.col("alt").isNull(), "time_gap": F.col("x") > 100}
    return telemetry(spark, d).select("row_pos", fl.first_failing(gates).alias("reason"))


@query("b19_range_violation", """WITH l AS (SELECT source_id, 'x' AS channel, x AS v FROM tel UNION ALL SELECT source_id, 'alt', alt FROM tel), s AS (SELECT * FROM (VALUES ('x', 0.0, 150.0), ('alt', 1200.0, 9900.0)) s(channel, lo, hi)),
 a AS (SELECT source_id, channel, count(*) FILTER (WHERE v < lo OR v > hi) AS bad, count(v) AS n FROM l JOIN s USING (channel) GROUP BY ALL)
SELECT source_id, channel, bad AS violations, n AS valid, bad / n > 0.05 AS quarantine FROM a""")
def _(spark, d):
    from trackweave.operators.registry import ChannelSpec, channel_table

    spec = channel_table(spark, [ChannelSpec("x", "ev", "1", 0.0, 150.0, 1.0, "context"), ChannelSpec("alt", "ev", "m", 1200.0, 9900.0, 1.0, "response")])
    return fl.range_violations(telemetry(spark, d), spec, channels=["x", "alt"], flight="source_id", limit=0.05)


@query("b20_exclusion_list", "SELECT row_pos FROM tel WHERE source_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)")
def _(spark, d):
    bad = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("source_id"))
    return fl.exclude(telemetry(spark, d), bad, on="source_id").select("row_pos")


@query("b21_airline_prefix", "SELECT c_custkey FROM customer WHERE substr(upper(trim(c_mktsegment)), 1, 3) IN ('AUT', 'BUI')", tel=False)
def _(spark, d):
    return fl.airline_prefix(table(spark, d, "customer"), callsign="c_mktsegment", prefixes=["aut", "bui"], total="seen").select("c_custkey")


# ---------------------------------------------------------------- scalars
@query("h11_unit_conversions", "SELECT row_pos, round(alt * 0.3048, 1) AS m, round(x * 0.5144, 2) AS mps, round(vertical_rate_ms * 100 * 0.00508, 3) + 0.0 AS vs FROM tel")
def _(spark, d):
    c = F.col
    return telemetry(spark, d).select("row_pos", sc.convert(c("alt"), sc.FT_TO_M).alias("m"), sc.convert(c("x"), sc.KN_TO_MPS).alias("mps"), (sc.convert(c("vertical_rate_ms") * 100, sc.FPM_TO_MPS) + 0.0).alias("vs"))


@query("h12_bit_flags", "SELECT row_pos, (row_pos & 1) <> 0 AS stale, (row_pos & 2) <> 0 AS new_leg, CASE row_pos % 5 WHEN 0 THEN false WHEN 1 THEN false ELSE (row_pos & 1) = 1 END AS military FROM tel")
def _(spark, d):
    i = F.col("row_pos")
    raw = F.when(i % 5 == 0, "garbage").when(i % 5 != 1, i.cast("string"))
    return telemetry(spark, d).select("row_pos", sc.has_bit(i, 1).alias("stale"), sc.has_bit(i, 2).alias("new_leg"), sc.military_from_flags(raw).alias("military"))


@query("h19_wrap_radians", "SELECT row_pos, round(CASE WHEN abs(lon) = 180 THEN pi() ELSE radians(lon) END, 9) AS w FROM tel")
def _(spark, d):
    return telemetry(spark, d).select("row_pos", r6(geo.wrap_radians(F.radians("lon") + 6.283185307179586), 9).alias("w"))


@query("h20_coordinated_turn", "SELECT row_pos, round(CASE WHEN x - 20 > 0 THEN 9.80665 * tan(radians(roll_deg)) / (x - 20) END, 6) + 0.0 AS rate FROM tel")
def _(spark, d):
    return telemetry(spark, d).select("row_pos", r6(sc.coordinated_turn_rate(F.radians("roll_deg"), F.col("x") - 20)).alias("rate"))


@query("h21_vector_norm", "SELECT row_pos, round(sqrt(x * x + alt * alt + roll_deg * roll_deg), 6) AS norm, x + alt + roll_deg + track_deg AS total, round(sqrt((power(x - m, 2) + power(alt - m, 2) + power(roll_deg - m, 2) + power(track_deg - m, 2)) / 4), 5) AS spread FROM (SELECT *, (x + alt + roll_deg + track_deg) / 4 AS m FROM tel)")
def _(spark, d):
    c = [F.col(n) for n in ("x", "alt", "roll_deg", "track_deg")]
    total, spread = sc.total_and_spread(*c)
    return telemetry(spark, d).select("row_pos", r6(sc.vector_norm(*c[:3])).alias("norm"), total.alias("total"), r6(spread, 5).alias("spread"))


@query("h22_normalised_innovation", "SELECT row_pos, round(CASE WHEN roll_deg > 0 THEN x / sqrt(roll_deg) END, 6) AS z FROM tel")
def _(spark, d):
    return telemetry(spark, d).select("row_pos", r6(sc.normalised_innovation(F.col("x"), F.col("roll_deg"))).alias("z"))


@query("h23_ratio_alarm", "SELECT row_pos, NOT on_ground AND (greatest(x / 100, coalesce(alt / 9000, 0)) > 1 OR row_pos % 40 = 0) AS alarm FROM tel")
def _(spark, d):
    a = sc.ratio_alarm([F.col("x") / 100, F.col("alt") / 9000], F.when(F.col("row_pos") % 40 == 0, 4).otherwise(0), ~F.col("on_ground"))
    return telemetry(spark, d).select("row_pos", a.alias("alarm"))


# ---------------------------------------------------------------- sets and contracts
@query("g1_union_sources", "SELECT row_pos, x, alt FROM tel WHERE source_type IN ('view', 'signup', 'purchase') UNION ALL SELECT row_pos, NULL, alt FROM tel WHERE source_type IN ('click', 'error')")
def _(spark, d):
    tel = telemetry(spark, d)
    a = tel.filter("source_type IN ('view', 'signup', 'purchase')").select("row_pos", "x", "alt")
    b = tel.filter("source_type IN ('click', 'error')").select("row_pos", "alt")
    return a.unionByName(b, allowMissingColumns=True)


@query("g2_distinct_days", "SELECT DISTINCT source_id, CAST(CAST(make_timestamp(t_us) AS DATE) AS VARCHAR) AS day FROM tel")
def _(spark, d):
    return telemetry(spark, d).select("source_id", F.to_date(F.timestamp_micros("t_us")).cast("string").alias("day")).distinct()


@query("g3_new_ids", "SELECT DISTINCT source_id FROM tel WHERE source_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
def _(spark, d):
    known = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"))
    return ct.new_ids(telemetry(spark, d), known, on="source_id")


@query("g4_split_overlap", "SELECT source_id, count(DISTINCT s) AS n_splits FROM (SELECT source_id, CASE WHEN x > 60 THEN 'a' ELSE 'b' END AS s FROM tel) GROUP BY source_id HAVING count(DISTINCT s) > 1")
def _(spark, d):
    return ct.split_overlap(telemetry(spark, d).withColumn("split", F.when(F.col("x") > 60, "a").otherwise("b")), entity="source_id", split="split")


@query("g5_union_of_layers", """WITH a AS (SELECT CAST(floor(lat / 5) AS BIGINT) AS cell, count(*) AS points FROM tel WHERE alarm GROUP BY 1), b AS (SELECT CAST(floor(lat / 5) AS BIGINT) AS cell, count(DISTINCT source_id) AS flights FROM tel WHERE on_ground AND lat > 0 GROUP BY 1)
SELECT coalesce(a.cell, b.cell) AS cell, coalesce(points, 0) AS points, coalesce(flights, 0) AS flights FROM a FULL JOIN b ON a.cell = b.cell""")
def _(spark, d):
    tel = telemetry(spark, d).withColumn("cell", F.floor(F.col("lat") / 5))
    a = tel.filter("alarm").groupBy("cell").agg(F.count(F.lit(1)).alias("points"))
    b = tel.filter("on_ground AND lat > 0").groupBy("cell").agg(F.countDistinct("source_id").alias("flights"))
    return ct.union_layers([a, b], on="cell")


@query("l1_frame_check", "SELECT count(*) AS rows, 0::BIGINT AS null_ids, 0::BIGINT AS bad_times, 0::BIGINT AS unordered, count(*) FILTER (WHERE alt IS NULL) AS bad_alt FROM tel")
def _(spark, d):
    return ct.frame_report(telemetry(spark, d), POSITION, time="t", entity="source_id", finite={"alt": "alt"})


@query("l2_fit_guard", "SELECT row_pos FROM tel")
def _(spark, d):
    tel = telemetry(spark, d)
    return ct.guarded_fit_input(tel, tel.filter("x < 0").select("source_id"), entity="source_id", role="natural_clean_fit").select("row_pos")


@query("l3_owner_parts", "SELECT CAST(CAST(make_timestamp(t_us) AS DATE) AS VARCHAR) AS day, source_id, count(DISTINCT row_pos % 3) AS parts FROM tel GROUP BY 1, 2 HAVING count(DISTINCT row_pos % 3) > 1")
def _(spark, d):
    rows = telemetry(spark, d).withColumns({"day": F.to_date(F.timestamp_micros("t_us")).cast("string"), "part": F.col("row_pos") % 3})
    return ct.shared_owners(rows, day="day", entity="source_id", part="part")


@query("l4_split_hash", """WITH s AS (SELECT DISTINCT source_id, CASE WHEN is_military THEN 'a' ELSE 'b' END AS split FROM tel), b AS (SELECT split, substr(sha256(source_id), 1, 3) AS p, count(*) AS n, sha256(string_agg(sha256(source_id), '' ORDER BY sha256(source_id))) AS h FROM s GROUP BY 1, 2)
SELECT split, CAST(sum(n) AS BIGINT) AS ids, sha256(string_agg(h, '' ORDER BY p)) AS digest FROM b GROUP BY split""")
def _(spark, d):
    return ct.split_contract(telemetry(spark, d).withColumn("split", F.when(F.col("is_military"), "a").otherwise("b")), entity="source_id", split="split")


@query("l6_clean_truth", "SELECT count(*) AS rows, 0::BIGINT AS violations FROM tel")
def _(spark, d):
    rows = telemetry(spark, d).withColumns({"event_id": F.lit(None).cast("string"), "injection_active": F.lit(False), "observable_changed": F.lit(False), "evaluable_truth": F.lit(True)})
    return ct.clean_truth_report(rows)


@query("l7_provenance_unique", "SELECT row_pos % 4 AS part, count(DISTINCT source_type) AS sources, count(*) FILTER (WHERE false) AS null_ids FROM tel GROUP BY 1 HAVING count(DISTINCT source_type) <> 1")
def _(spark, d):
    rows = telemetry(spark, d).withColumn("part", F.col("row_pos") % 4)
    return ct.provenance_problems(rows, part="part", source="source_type", entity="source_id")


@query("k19_class_gate", """WITH ch AS (SELECT source_type AS fault_class, 'c' || row_pos % 3 AS channel, CASE WHEN max(x) > 330 THEN 'passed' WHEN max(x) > 300 THEN 'failed' ELSE 'not_evaluable' END AS status FROM tel GROUP BY 1, 2)
SELECT fault_class, CASE WHEN bool_or(status = 'passed') THEN 'passed' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'not_evaluable' END AS status FROM ch GROUP BY fault_class""")
def _(spark, d):
    from trackweave.operators.calibrate import class_gate

    ch = telemetry(spark, d).groupBy(F.col("source_type").alias("fault_class"), (F.col("row_pos") % 3).alias("channel")).agg(F.max("x").alias("m"))
    return class_gate(ch.withColumn("status", F.when(F.col("m") > 330, "passed").when(F.col("m") > 300, "failed").otherwise("not_evaluable")))
