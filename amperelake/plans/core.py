"""Named queries for the engine's own operators over the tables of a folder, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperelake.common import cut, messages, scratch, table
from amperelake.functions import identity, measures
from amperelake.operators import battery, features, folds, registry, rollup, slots, usage, validate, windows
from amperelake.plans import wire_sql
from amperelake.plans.problems import MESSAGES_SQL
from amperelake.sources import decode, files

PLACES = 12
MAKERS = wire_sql.MAKERS
QUERIES, SQL = {}, {}
ALL = ("ts_event_ms", "ts_ingest_ms", "oem", "lat", "lon", "speed_kmh", "odo_km", "soc_pct", "pack_voltage_v", "pack_current_a", "pack_temp_min_c", "pack_temp_max_c", "cell_v_min_mv", "cell_v_max_mv", "isolation_kohm", "hv_interlock_ok", "aux_12v_v", "ambient_c", "charge_state", "charge_power_kw", "dtc", "evt", "schema_version")
WITH_M = f"WITH m AS {MESSAGES_SQL} "
REGISTRY_SQL = "(SELECT * FROM vehicle_registry QUALIFY row_number() OVER (PARTITION BY vin ORDER BY updated_ms DESC) = 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _m(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return messages(table(spark, d, "telemetry"), *cols)


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return registry.latest(table(spark, d, "vehicle_registry"), "vin", ["updated_ms"])


@query(
    WITH_M
    + """SELECT vin, ts_event_ms - ts_event_ms % 60000 AS minute_start_ms, count(*) AS sample_count, min(CAST(soc_pct AS DOUBLE)) AS soc_min_pct, max(CAST(soc_pct AS DOUBLE)) AS soc_max_pct,
round(avg(CAST(soc_pct AS DOUBLE)), 9) AS soc_avg_pct, round(coalesce(avg(CAST(speed_kmh AS DOUBLE)), 0), 9) AS speed_avg_kmh, round(max(odo_km) - min(odo_km), 9) AS distance_km,
round(avg(CAST(pack_voltage_v AS DOUBLE) * CAST(pack_current_a AS DOUBLE)) / 60000, 9) AS energy_kwh, round(avg(CAST(charge_power_kw AS DOUBLE)) / 60, 9) AS charge_kwh_grid,
CASE WHEN count(pack_temp_max_c) > 0 THEN greatest(0.0::DOUBLE, max(CAST(pack_temp_max_c AS DOUBLE))) END AS temp_max_c,
CASE WHEN count(cell_v_max_mv - cell_v_min_mv) > 0 THEN greatest(0.0::DOUBLE, max(CAST(cell_v_max_mv - cell_v_min_mv AS DOUBLE))) END AS imbalance_max_mv,
min(CAST(isolation_kohm AS DOUBLE)) AS isolation_min_kohm FROM m GROUP BY 1, 2"""
)
def rollup_minute(spark, d):
    cols = ("ts_event_ms", "soc_pct", "speed_kmh", "odo_km", "pack_voltage_v", "pack_current_a", "charge_power_kw", "pack_temp_max_c", "cell_v_min_mv", "cell_v_max_mv", "isolation_kohm")
    r = rollup.minute_rollup(_m(spark, d, *cols))
    return r.select(*(F.round(c, 9).alias(c) if c in ("soc_avg_pct", "speed_avg_kmh", "distance_km", "energy_kwh", "charge_kwh_grid") else c for c in r.columns))


@query(
    WITH_M
    + """SELECT vin, r.t AS ts_event_ms, r.s AS seq, r.soc AS soc_pct, r.odo AS odo_km, r.cs AS charge_state FROM (
SELECT vin, arg_max({'t': ts_event_ms, 's': seq, 'soc': CAST(soc_pct AS DOUBLE), 'odo': odo_km, 'cs': charge_state}, (ts_event_ms, seq)) AS r FROM m GROUP BY vin)"""
)
def latest_state(spark, d):
    s = rollup.latest_state(_m(spark, d, "ts_event_ms", "soc_pct", "odo_km", "charge_state"), ("soc_pct", "odo_km", "charge_state"))
    return s.withColumn("soc_pct", F.col("soc_pct").cast("double"))


@query(f"SELECT * FROM {REGISTRY_SQL}")
def registry_latest(spark, d):
    return _registry(spark, d)


@query(WITH_M + f"SELECT m.vin, seq, coalesce(r.tenant_id, '') AS tenant_id, r.fleet_id, r.depot_id, r.vin IS NOT NULL AS registered FROM m LEFT JOIN {REGISTRY_SQL} r ON r.vin = m.vin")
def registry_enrich(spark, d):
    return registry.enrich(_m(spark, d, "ts_event_ms"), _registry(spark, d)).select("vin", "seq", "tenant_id", "fleet_id", "depot_id", "registered")


@query(WITH_M + "SELECT m.vin, m.seq, r.depot_id, r.updated_ms FROM m ASOF LEFT JOIN vehicle_registry r ON r.vin = m.vin AND m.ts_event_ms >= r.updated_ms")
def registry_as_of(spark, d):
    e = _m(spark, d, "ts_event_ms")
    return registry.as_of(e.select("vin", "seq", "ts_event_ms"), table(spark, d, "vehicle_registry"), "vin", "ts_event_ms", "updated_ms", ["updated_ms", "depot_id"]).select("vin", "seq", "depot_id", "updated_ms")


@query(
    WITH_M
    + f""", e AS (SELECT coalesce(r.tenant_id, '') AS tenant_id, m.ts_event_ms - m.ts_event_ms % 3600000 AS hour_ms, unnest(m.dtc) AS code FROM m LEFT JOIN {REGISTRY_SQL} r ON r.vin = m.vin),
c AS (SELECT tenant_id, hour_ms, code, count(*) AS n FROM e GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id, hour_ms ORDER BY n DESC, code) AS INTEGER) AS rank FROM c QUALIFY rank <= 10"""
)
def topk_codes(spark, d):
    return registry.heavy_hitters(_codes(spark, d), ["tenant_id", "hour_ms"], "code", 10)


def _codes(spark, d):
    e = registry.enrich(_m(spark, d, "ts_event_ms", "dtc"), _registry(spark, d))
    return e.select("tenant_id", measures.hour_start(F.col("ts_event_ms")).alias("hour_ms"), F.explode("dtc").alias("code"))


@query(SQL["topk_codes"])
def topk_codes_sketch(spark, d):
    return registry.heavy_hitters_sketch(_codes(spark, d), ["tenant_id", "hour_ms"], "code", 10)


@query(
    WITH_M
    + f""", e AS (SELECT coalesce(r.tenant_id, '') AS tenant_id, m.ts_event_ms - m.ts_event_ms % 3600000 AS hour_ms, unnest(m.dtc) AS code FROM m LEFT JOIN {REGISTRY_SQL} r ON r.vin = m.vin)
SELECT tenant_id, hour_ms, code, count(*) AS estimate FROM e GROUP BY ALL"""
)
def sketch_estimates(spark, d):
    """Estimates of a count-min sketch; so wide that the codes of an hour do not collide in all rows, so they are exact here."""
    codes, group = _codes(spark, d), ["tenant_id", "hour_ms"]
    return registry.estimates(registry.count_table(codes, group, "code"), codes, group, "code")


@query(
    WITH_M
    + """, t AS (SELECT vin, seq, ts_event_ms AS ts, CAST(pack_temp_max_c AS DOUBLE) AS t FROM m WHERE pack_temp_max_c IS NOT NULL),
w AS (SELECT vin, seq, ts, t, min(ts) OVER f AS t0, arg_min(t, (ts, seq)) OVER f AS v0 FROM t WINDOW f AS (PARTITION BY vin ORDER BY ts RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW))
SELECT vin, seq, round((t - v0) / ((ts - t0) / 60000.0), 9) AS rise_c_per_min FROM w WHERE ts - t0 >= 30000"""
)
def rise_rate(spark, d):
    t = _m(spark, d, "ts_event_ms", "pack_temp_max_c").where("pack_temp_max_c is not null").withColumn("t", F.col("pack_temp_max_c").cast("double"))
    r = windows.trailing(t, 60_000, lambda w: {"first": F.min(F.struct("ts_event_ms", "seq", "t")).over(w)})
    span = F.col("ts_event_ms") - F.col("first.ts_event_ms")
    return r.where(span >= 30_000).select("vin", "seq", F.round((F.col("t") - F.col("first.t")) / (span / 60_000.0), 9).alias("rise_c_per_min"))


@query(
    WITH_M
    + """SELECT vin, seq, sum(CASE WHEN NOT hv_interlock_ok AND (coalesce(speed_kmh, 0) > 0 OR charge_power_kw > 0) THEN 1 ELSE 0 END)
OVER (PARTITION BY vin ORDER BY ts_event_ms RANGE BETWEEN 300000 PRECEDING AND CURRENT ROW)::BIGINT AS opens FROM m"""
)
def interlock_opens(spark, d):
    m = _m(spark, d, "ts_event_ms", "hv_interlock_ok", "speed_kmh", "charge_power_kw")
    open_ = (~F.col("hv_interlock_ok") & ((F.coalesce("speed_kmh", F.lit(0)) > 0) | (F.col("charge_power_kw") > 0))).cast("int")
    return windows.trailing(m.withColumn("o", open_), 300_000, lambda w: {"opens": F.sum(F.coalesce("o", F.lit(0))).over(w)}).select("vin", "seq", "opens")


STEPS_SQL = """, p AS (SELECT vin, seq, ts_event_ms - lag(ts_event_ms) OVER w AS dt, CAST(pack_current_a AS DOUBLE) AS i, CAST(pack_voltage_v AS DOUBLE) AS v,
lag(CAST(pack_current_a AS DOUBLE)) OVER w AS pi, lag(CAST(pack_voltage_v AS DOUBLE)) OVER w AS pv FROM m WINDOW w AS (PARTITION BY vin ORDER BY ts_event_ms, seq)) """


@query(
    WITH_M
    + STEPS_SQL
    + """SELECT vin, round(sum((pi + i) / 2 * (dt / 3600000.0)) FILTER (WHERE dt > 0 AND dt <= 300000), 6) AS ah, round(sum((pv * pi + v * i) / 2 * (dt / 3600000.0) / 1000) FILTER (WHERE dt > 0 AND dt <= 300000), 6) AS kwh,
CAST(count(*) FILTER (WHERE dt > 300000) AS BIGINT) AS gaps FROM p GROUP BY vin"""
)
def trapezoid_energy(spark, d):
    r = windows.trapezoid(_m(spark, d, "ts_event_ms", "pack_voltage_v", "pack_current_a"))
    return r.groupBy("vin").agg(F.round(F.sum("step_ah"), 6).alias("ah"), F.round(F.sum("step_kwh"), 6).alias("kwh"), F.sum("gap").alias("gaps"))


@query(WITH_M + "SELECT vin, seq, ts_event_ms FROM m QUALIFY ts_event_ms >= coalesce(max(ts_event_ms) OVER (PARTITION BY vin ORDER BY log_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
def monotonic_messages(spark, d):
    return windows.monotonic(_m(spark, d, "ts_event_ms")).select("vin", "seq", "ts_event_ms")


@query(WITH_M + "SELECT vin, seq, last_value(CASE WHEN evt = 2 THEN true WHEN evt = 3 THEN false END IGNORE NULLS) OVER (PARTITION BY vin ORDER BY ts_event_ms, seq ROWS UNBOUNDED PRECEDING) AS ignition FROM m")
def ignition_filled(spark, d):
    flag = F.when(F.col("evt") == 2, True).when(F.col("evt") == 3, False)
    return windows.carried(_m(spark, d, "ts_event_ms", "evt"), flag, "ignition").select("vin", "seq", "ignition")


@query(
    WITH_M
    + """, r AS (SELECT vin, seq, ts_event_ms AS ts, CAST(pack_voltage_v AS DOUBLE) AS v, abs(pack_current_a) < 1 AS rest FROM m WHERE pack_current_a IS NOT NULL),
x AS (SELECT *, CASE WHEN rest IS DISTINCT FROM lag(rest) OVER (PARTITION BY vin ORDER BY ts, seq) THEN 1 ELSE 0 END AS b FROM r),
y AS (SELECT *, sum(b) OVER (PARTITION BY vin ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT vin, min(ts) AS start_ms, max(ts) AS end_ms, arg_max(v, (ts, seq)) AS rest_voltage_v FROM y WHERE rest GROUP BY vin, run"""
)
def rest_runs(spark, d):
    m = _m(spark, d, "ts_event_ms", "pack_voltage_v", "pack_current_a").where("pack_current_a is not null").withColumn("rest", F.abs("pack_current_a") < 1)
    m = windows.previous(m, ["rest"])
    m = windows.running(m, {"run": (~F.col("rest").eqNullSafe(F.col("prev_rest"))).cast("int")})
    at = F.struct("ts_event_ms", "seq")
    return m.where("rest").groupBy("vin", "run").agg(F.min("ts_event_ms").alias("start_ms"), F.max("ts_event_ms").alias("end_ms"), F.max_by(F.col("pack_voltage_v").cast("double"), at).alias("rest_voltage_v")).drop("run")


@query(
    WITH_M.replace("WITH", "WITH RECURSIVE")
    + """, q AS (SELECT vin, ts_event_ms, seq, CAST(pack_temp_max_c AS DOUBLE) - CAST(ambient_c AS DOUBLE) AS v, row_number() OVER (PARTITION BY vin ORDER BY ts_event_ms, seq) AS rn FROM m WHERE pack_temp_max_c IS NOT NULL AND ambient_c IS NOT NULL),
e AS (SELECT vin, rn, ts_event_ms, seq, v, v AS mean, 0.0::DOUBLE AS var, 1 AS n, 0.0::DOUBLE AS z FROM q WHERE rn = 1
UNION ALL SELECT vin, rn, ts_event_ms, seq, v, CASE WHEN z > 4 THEN mean ELSE mean + 0.002::DOUBLE * (v - mean) END, CASE WHEN z > 4 THEN var ELSE 0.998::DOUBLE * (var + 0.002::DOUBLE * (v - mean) * (v - mean)) END, CASE WHEN z > 4 THEN n ELSE n + 1 END, z
 FROM (SELECT q.*, e.mean, e.var, e.n, CASE WHEN e.n >= 360 THEN (q.v - e.mean) / greatest(sqrt(e.var), 1e-9::DOUBLE) ELSE 0.0::DOUBLE END AS z FROM e JOIN q ON q.vin = e.vin AND q.rn = e.rn + 1))
SELECT vin, ts_event_ms, seq, round(v, 6) AS x, round(z, 6) AS z, z > 4 AS breach, round(mean, 6) AS mean FROM e"""
)
def delta_baseline(spark, d):
    m = _m(spark, d, "ts_event_ms", "pack_temp_max_c", "ambient_c").withColumn("delta", F.col("pack_temp_max_c").cast("double") - F.col("ambient_c").cast("double"))
    b = folds.ewma_baseline(m, "delta")
    return b.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in b.dtypes))


@query(
    WITH_M.replace("WITH", "WITH RECURSIVE")
    + """, q AS (SELECT vin, ts_event_ms, seq, row_number() OVER (PARTITION BY vin ORDER BY ts_event_ms, seq) AS rn FROM m),
e AS (SELECT vin, rn, ts_event_ms, seq, ts_event_ms AS last, true AS through FROM q WHERE rn = 1
UNION ALL SELECT q.vin, q.rn, q.ts_event_ms, q.seq, CASE WHEN q.ts_event_ms - e.last >= 300000 THEN q.ts_event_ms ELSE e.last END, q.ts_event_ms - e.last >= 300000 FROM e JOIN q ON q.vin = e.vin AND q.rn = e.rn + 1)
SELECT vin, ts_event_ms, seq FROM e WHERE through"""
)
def state_throttled(spark, d):
    return folds.throttle(_m(spark, d, "ts_event_ms"), 300_000)


USAGE_SQL = f"""WITH RECURSIVE m AS {MESSAGES_SQL},
o AS (SELECT * FROM m WHERE pack_voltage_v IS NOT NULL AND pack_current_a IS NOT NULL AND soc_pct IS NOT NULL AND odo_km IS NOT NULL AND charge_state IS NOT NULL
 QUALIFY ts_event_ms >= coalesce(max(ts_event_ms) OVER (PARTITION BY vin ORDER BY log_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
p AS (SELECT o.vin, log_offset, ts_event_ms AS ts, evt, charge_state AS cs, CAST(soc_pct AS DOUBLE) AS soc, odo_km AS odo, CAST(pack_voltage_v AS DOUBLE) AS v, CAST(pack_current_a AS DOUBLE) AS i, CAST(pack_temp_min_c AS DOUBLE) AS tmin, CAST(pack_temp_max_c AS DOUBLE) AS tmax,
 coalesce(speed_kmh > 0, false) AS moving, charge_state <> 1 AND pack_current_a < 0 AS into_, coalesce(abs(pack_current_a) / nullif(r.capacity_kwh * 1000 / nullif(r.nominal_voltage_v, 0), 0), 0) AS rate,
 row_number() OVER w AS rn, ts_event_ms - lag(ts_event_ms) OVER w AS dt, lag(CAST(pack_voltage_v AS DOUBLE)) OVER w AS pv, lag(CAST(pack_current_a AS DOUBLE)) OVER w AS pi
 FROM o LEFT JOIN {REGISTRY_SQL} r ON r.vin = o.vin WINDOW w AS (PARTITION BY o.vin ORDER BY ts_event_ms, log_offset)),
q AS (SELECT *, last_value(CASE WHEN abs(i) < 1 AND NOT coalesce(abs(pi) < 1, false) THEN ts END IGNORE NULLS) OVER (PARTITION BY vin ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rested,
 into_ OR (evt = 4 AND i < 0) AS bc, evt = 5 OR NOT into_ AS ec, evt = 2 OR moving AS bd FROM p),
e AS (SELECT vin, rn, false AS wc, bc AS c, false AS wd, bd AS d, ts AS moved FROM q WHERE rn = 1
UNION ALL SELECT vin, rn, wc, CASE WHEN wc THEN NOT ec ELSE bc END, wd, CASE WHEN wd THEN NOT (evt = 3 OR ts - mv >= 900000) ELSE bd END, CASE WHEN NOT wd AND bd THEN ts ELSE mv END
 FROM (SELECT q.*, e.c AS wc, e.d AS wd, CASE WHEN q.moving THEN q.ts ELSE e.moved END AS mv FROM e JOIN q ON q.vin = e.vin AND q.rn = e.rn + 1)),
k AS (SELECT q.*, x.kind, x.w, x.n FROM q JOIN (SELECT vin, rn, 1 AS kind, wc AS w, c AS n FROM e UNION ALL SELECT vin, rn, 2, wd, d FROM e) x ON x.vin = q.vin AND x.rn = q.rn),
s AS (SELECT *, sum(CASE WHEN n AND NOT w THEN 1 ELSE 0 END) OVER (PARTITION BY vin, kind ORDER BY rn ROWS UNBOUNDED PRECEDING) AS no, CASE WHEN tmin IS NOT NULL AND tmax IS NOT NULL THEN tmin END AS lo, CASE WHEN tmin IS NOT NULL AND tmax IS NOT NULL THEN tmax END AS hi,
 CASE WHEN abs(pi) < 1 AND ts - rested >= 1800000 THEN pv END AS rv FROM k),
a AS (SELECT vin, kind, no, min(ts) AS start_ms, max(CASE WHEN NOT n THEN ts END) AS end_ms, arg_min(soc, rn) AS s0, max(CASE WHEN NOT n THEN soc END) AS s1, max(CASE WHEN NOT n THEN odo END) - arg_min(odo, rn) AS km, max(CASE WHEN n AND NOT w THEN rv END) AS rv,
 coalesce(sum(CASE WHEN w AND dt > 0 AND dt <= 300000 THEN (pi + i) / 2 * (dt / 3600000.0::DOUBLE) END), 0) AS ah, coalesce(sum(CASE WHEN w AND dt > 0 AND dt <= 300000 THEN (pv * pi + v * i) / 2 * (dt / 3600000.0::DOUBLE) / 1000 END), 0) AS kwh,
 count(*) FILTER (WHERE w AND dt > 300000) AS gaps, count(*) AS samples, min(lo) AS lo, max(hi) AS hi, max(rate) AS rate, max(CASE WHEN n AND NOT w THEN lo END) AS lo0, max(CASE WHEN n AND NOT w THEN hi END) AS hi0, max(CASE WHEN n AND NOT w THEN rate END) AS rate0, max(CASE WHEN n AND NOT w THEN cs END) AS cs0
 FROM s WHERE n OR w GROUP BY ALL)
"""


@query(
    USAGE_SQL
    + """SELECT vin, kind, 1 AS phase, start_ms, NULL::BIGINT AS end_ms, round(s0, 6) AS soc_start_pct, NULL::DOUBLE AS soc_end_pct, 0.0::DOUBLE AS delta_ah, 0.0::DOUBLE AS delta_kwh, round(rv, 6) AS v_rest_before, round(lo0, 6) AS temp_min_c, round(hi0, 6) AS temp_max_c, round(rate0, 6) AS max_c_rate,
 CASE WHEN kind = 2 THEN '' WHEN cs0 = 3 THEN 'DC_FAST' ELSE 'AC' END AS charger_type, 0.0::DOUBLE AS distance_km, 0 AS gaps, 1 AS samples FROM a
UNION ALL SELECT vin, kind, 2, start_ms, end_ms, round(s0, 6), round(s1, 6), round(ah, 6), round(kwh, 6), round(rv, 6), round(coalesce(lo, 0), 6), round(coalesce(hi, 0), 6), round(rate, 6), CASE WHEN kind = 2 THEN '' WHEN cs0 = 3 THEN 'DC_FAST' ELSE 'AC' END, round(greatest(0, km), 6), CAST(gaps AS INTEGER), CAST(samples AS INTEGER)
FROM a WHERE end_ms IS NOT NULL"""
)
def tracked_sessions(spark, d):
    s = usage.vehicle_sessions(_with_capacity(spark, d))
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes))


def _with_capacity(spark, d):
    m = _m(spark, d, *(c for c in ALL if c not in ("oem",)))
    reg = _registry(spark, d).select("vin", F.when(F.col("nominal_voltage_v") > 0, F.col("capacity_kwh") * 1000 / F.col("nominal_voltage_v")).alias("cap_ah"))
    return registry.enrich(m, reg, "vin", ("cap_ah",))


SOH_SQL = f"""WITH s AS (SELECT DISTINCT * FROM vehicle_sessions WHERE kind = 1 AND phase = 2),
j AS (SELECT s.*, r.capacity_kwh * 1000 / r.nominal_voltage_v AS ah FROM s LEFT JOIN {REGISTRY_SQL} r ON r.vin = s.vin),
o AS (SELECT *, soc_end_pct - soc_start_pct AS d, abs(delta_ah) / ((soc_end_pct - soc_start_pct) / 100) / ah * 100 AS h FROM j),
obs AS (SELECT vin, session_id, end_ms, CASE WHEN ah IS NULL OR ah <= 0 THEN 'unknown_nominal_capacity' WHEN delta_ah IS NULL OR d IS NULL OR temp_min_c IS NULL OR temp_max_c IS NULL THEN 'non_finite_input'
 WHEN delta_ah >= 0 OR d <= 0 THEN 'not_a_charge' WHEN d < 20 THEN 'delta_soc_below_min' WHEN temp_min_c < 15 OR temp_max_c > 35 THEN 'temperature_out_of_range' WHEN gaps > 0 THEN 'telemetry_gaps'
 WHEN samples < 10 THEN 'too_few_samples' WHEN NOT h BETWEEN 50 AND 120 THEN 'implausible_soh' END AS reason, h,
 pow(h * sqrt(2.0::DOUBLE) * (CASE WHEN v_rest_before IS NOT NULL THEN 0.5 ELSE 1.0 END)::DOUBLE / d, 2) + pow(h * 0.005::DOUBLE, 2) AS var FROM o)
"""


def _observed(spark, d):
    s = table(spark, d, "vehicle_sessions").where("kind = 1 and phase = 2").distinct()
    reg = _registry(spark, d).select("vin", (F.col("capacity_kwh") * 1000 / F.col("nominal_voltage_v")).alias("nominal_ah"))
    return battery.observed(registry.enrich(s, reg, "vin", ("nominal_ah",)))


@query(SOH_SQL + "SELECT vin, session_id, end_ms, reason, CASE WHEN reason IS NULL THEN round(h, 6) END AS soh_pct, CASE WHEN reason IS NULL THEN round(var, 6) END AS variance FROM obs")
def soh_observations(spark, d):
    return _observed(spark, d).select("vin", "session_id", "end_ms", "reason", F.round("soh_pct", 6).alias("soh_pct"), F.round("variance", 6).alias("variance"))


KALMAN_SQL = (
    SOH_SQL.replace("WITH s AS", "WITH RECURSIVE s AS")
    + """, q AS (SELECT vin, end_ms, h, var, row_number() OVER (PARTITION BY vin ORDER BY end_ms, session_id) AS rn FROM obs WHERE reason IS NULL),
k AS (SELECT vin, rn, end_ms AS as_of, h AS x, 0.0::DOUBLE AS v, var AS p, 0.0::DOUBLE AS c, 0.0004::DOUBLE AS r FROM q WHERE rn = 1
UNION ALL SELECT vin, rn, as_of, x0 + p0 / (p0 + var) * (h - x0), v + c0 / (p0 + var) * (h - x0), (1 - p0 / (p0 + var)) * p0, (1 - p0 / (p0 + var)) * c0, r0 - c0 / (p0 + var) * c0 FROM (
 SELECT q.vin, q.rn, greatest(q.end_ms, k.as_of) AS as_of, q.h, q.var, k.v, k.x + k.v * dt AS x0, k.p + 2 * dt * k.c + dt * dt * k.r + 0.0001::DOUBLE * dt AS p0, k.c + dt * k.r AS c0, k.r + 0.00000025::DOUBLE * dt AS r0
 FROM (SELECT k.*, greatest(0.0::DOUBLE, (q.end_ms - k.as_of) / 86400000.0::DOUBLE) AS dt FROM k JOIN q ON q.vin = k.vin AND q.rn = k.rn + 1) k JOIN q ON q.vin = k.vin AND q.rn = k.rn + 1)),
"""
)


@query(KALMAN_SQL.rstrip().rstrip(",") + " SELECT vin, as_of AS as_of_ms, CAST(rn AS INTEGER) AS n, round(x, 6) AS soh_pct, round(v, 6) AS rate_pct_per_day, round(x - 1.96 * sqrt(p), 6) AS ci_low, round(x + 1.96 * sqrt(p), 6) AS ci_high FROM k")
def soh_kalman(spark, d):
    k = battery.with_interval(battery.kalman(_observed(spark, d)))
    return k.select(F.col("pack").alias("vin"), "as_of_ms", "n", *(F.round(c, 6).alias(c) for c in ("soh_pct", "rate_pct_per_day", "ci_low", "ci_high")))


@query(SQL["soh_kalman"])
def soh_stored(spark, d):
    """The rows of soh_kalman, with sessions coming in two batches that a store keeps between them, the second one twice."""
    o = _observed(spark, d).where("reason is null")
    store = battery.HealthStore(spark, scratch(spark))
    middle = o.select(F.percentile_approx("end_ms", 0.5)).first()[0] or 0
    store.apply(o.where(F.col("end_ms") <= middle), 0)
    for n in (1, 2):
        store.apply(o.where(F.col("end_ms") > middle), n)
    k = battery.with_interval(store.estimates())
    return k.select(F.col("pack").alias("vin"), "as_of_ms", "n", *(F.round(c, 6).alias(c) for c in ("soh_pct", "rate_pct_per_day", "ci_low", "ci_high")))


@query(
    SOH_SQL.replace("SELECT vin, session_id, end_ms, CASE WHEN ah IS NULL", "SELECT vin, session_id, end_ms, CASE WHEN reg IS NULL THEN 'unregistered_vin' WHEN coalesce(tenant_id, '') <> '' AND tenant_id <> coalesce(own, '') THEN 'tenant_mismatch' WHEN ah IS NULL").replace("SELECT s.*, ", "SELECT s.*, r.vin AS reg, r.tenant_id AS own, ")
    + "SELECT vin, session_id, reason, CASE WHEN reason IS NULL THEN round(h, 6) END AS soh_pct FROM obs"
)
def soh_gate(spark, d):
    s = table(spark, d, "vehicle_sessions").where("kind = 1 and phase = 2").distinct()
    return battery.gated(s, _registry(spark, d)).select("vin", "session_id", "reason", F.round("soh_pct", 6).alias("soh_pct"))


@query(
    KALMAN_SQL.rstrip().rstrip(",")
    + ", g AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY vin ORDER BY as_of DESC, rn DESC) <= 500) SELECT vin, as_of AS as_of_ms, round(x, 6) AS soh_pct, CAST(row_number() OVER (PARTITION BY vin ORDER BY as_of, rn) AS INTEGER) AS place FROM g"
)
def soh_history(spark, d):
    k = battery.kalman(_observed(spark, d)).withColumn("vin", F.col("pack"))
    none = _registry(spark, d).select("vin", F.lit(None).cast("string").alias("current_pack_id"))  # sessions name no packs here: the vehicle is the pack
    return battery.history(k, none).select("vin", "as_of_ms", F.round("soh_pct", 6).alias("soh_pct"), "place")


LATEST_SQL = KALMAN_SQL.rstrip().rstrip(",") + f", l AS (SELECT k.vin, k.x, r.tenant_id FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY vin ORDER BY rn DESC) = 1) k JOIN {REGISTRY_SQL} r ON r.vin = k.vin) "


def _latest_soh(spark, d):
    k = registry.latest(battery.kalman(_observed(spark, d)).withColumnRenamed("pack", "vin"), "vin", ["n"])
    return registry.enrich(k, _registry(spark, d), "vin", ("tenant_id",))


@query(LATEST_SQL + "SELECT tenant_id, count(*) AS packs, round(avg(x), 6) AS mean_soh FROM l GROUP BY tenant_id")
def soh_summary(spark, d):
    return _latest_soh(spark, d).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("packs"), F.round(F.avg("soh_pct"), 6).alias("mean_soh"))


@query(LATEST_SQL + "SELECT tenant_id, floor(x / 5) * 5 AS bin, count(*) AS n FROM l GROUP BY ALL")
def soh_histogram(spark, d):
    h = battery.histogram(_latest_soh(spark, d), "soh_pct", 5.0, ["tenant_id"])
    return h.withColumn("bin", F.col("bin").cast("double"))


@query(LATEST_SQL + "SELECT tenant_id, vin, round(x, 6) AS soh_pct, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY x, vin) AS INTEGER) AS rank FROM l QUALIFY rank <= 20")
def soh_lowest(spark, d):
    t = registry.top_by_group(_latest_soh(spark, d), ["tenant_id"], ["soh_pct", "vin"], 20)
    return t.select("tenant_id", "vin", F.round("soh_pct", 6).alias("soh_pct"), "rank")


RUL_NOW = 1_781_136_000_000


@query(
    KALMAN_SQL.rstrip().rstrip(",")
    + f""", t AS (SELECT vin, x, as_of, min(as_of) OVER (PARTITION BY vin) AS t0 FROM k),
f AS (SELECT vin, t0, count(*) AS n, (max(as_of) - t0) / 86400000.0::DOUBLE AS span, regr_slope(x, sqrt((as_of - t0) / 86400000.0::DOUBLE)) AS b, regr_intercept(x, sqrt((as_of - t0) / 86400000.0::DOUBLE)) AS a FROM t GROUP BY vin, t0)
SELECT vin, round(greatest(0, pow((80 - a) / b, 2) - ({RUL_NOW} - t0) / 86400000.0::DOUBLE), 3) AS days, round(-b, 6) AS fade_per_sqrt_day FROM f WHERE n >= 3 AND span >= 3 AND b < 0"""
)
def remaining_life(spark, d):
    """Days until a pack's health is 80 %; of three days of history on, as the tables have no more than ten."""
    k = battery.kalman(_observed(spark, d)).withColumnRenamed("pack", "vin")
    r = battery.remaining_life(k, "vin", "as_of_ms", "soh_pct", RUL_NOW, least_days=3.0)
    return r.select("vin", F.round("days", 3).alias("days"), F.round("fade_per_sqrt_day", 6).alias("fade_per_sqrt_day"))


@query(
    f"""WITH p AS (SELECT vin, minute_start_ms AS t, isolation_min_kohm / 100.0 AS y, min(minute_start_ms) OVER (PARTITION BY vin) AS t0 FROM (SELECT DISTINCT vin, minute_start_ms, emitted_ms, sample_count, isolation_min_kohm FROM rollup1m)
QUALIFY row_number() OVER (PARTITION BY vin, minute_start_ms ORDER BY emitted_ms DESC, sample_count DESC, isolation_min_kohm DESC) = 1),
q AS (SELECT p.vin, t, y, min(t) OVER (PARTITION BY p.vin) AS t0 FROM p JOIN (SELECT DISTINCT vin, minute_start_ms, emitted_ms, sample_count, isolation_min_kohm FROM rollup1m QUALIFY row_number() OVER (PARTITION BY vin, minute_start_ms ORDER BY emitted_ms DESC, sample_count DESC, isolation_min_kohm DESC) = 1) c ON c.vin = p.vin AND c.minute_start_ms = p.t WHERE c.sample_count <> 0),
f AS (SELECT vin, t0, count(*) AS n, (max(t) - t0) / 86400000.0 AS span, regr_slope(y, sqrt((t - t0) / 86400000.0)) AS b, regr_intercept(y, sqrt((t - t0) / 86400000.0)) AS a FROM q GROUP BY vin, t0)
SELECT vin, round(greatest(0, pow((5 - a) / b, 2) - ({RUL_NOW} - t0) / 86400000.0::DOUBLE), 1) AS days, round(-b, 6) AS fade_per_sqrt_day FROM f WHERE n >= 3 AND span >= 14 AND b < 0"""
)
def isolation_fade(spark, d):
    from amperelake.operators.rolling import current_minutes

    p = current_minutes(table(spark, d, "rollup1m"), "isolation_min_kohm").withColumn("y", F.col("isolation_min_kohm") / 100)
    return battery.remaining_life(p, "vin", "minute_start_ms", "y", RUL_NOW, 5.0).select("vin", F.round("days", 1).alias("days"), F.round("fade_per_sqrt_day", 6).alias("fade_per_sqrt_day"))


@query(
    WITH_M
    + """, p AS (SELECT vin, ts_event_ms AS ts, CAST(floor((ts_event_ms + 19800000) / 86400000) AS BIGINT) AS dn, CAST(pack_temp_max_c AS DOUBLE) - CAST(ambient_c AS DOUBLE) AS td, CAST(cell_v_max_mv - cell_v_min_mv AS DOUBLE) AS imb, CAST(isolation_kohm AS DOUBLE) AS iso,
 hv_interlock_ok AS ok, CASE WHEN hv_interlock_ok <> lag(hv_interlock_ok) OVER (PARTITION BY vin ORDER BY ts_event_ms, seq) THEN 1 ELSE 0 END AS fl, CAST(aux_12v_v AS DOUBLE) AS aux, CAST(soc_pct AS DOUBLE) AS soc, CASE WHEN len(dtc) > 0 THEN ts_event_ms END AS fault FROM m),
d AS (SELECT vin, dn, (dn + 1) * 86400000 - 19800000 AS e, min(min(fault)) OVER (PARTITION BY vin) AS fd FROM p GROUP BY vin, dn),
j AS (SELECT d.vin, d.dn, e, fd, p.dn = d.dn AS today, (p.ts - e) / 3600000.0::DOUBLE AS x, p.* EXCLUDE (vin, dn, ts) FROM d JOIN p ON p.vin = d.vin AND p.dn BETWEEN d.dn - 2 AND d.dn WHERE fd IS NULL OR fd >= e)
SELECT vin, strftime(DATE '1970-01-01' + CAST(dn AS INTEGER), '%Y-%m-%d') AS day_ist, round(avg(td), 6) AS td_mean, round(max(td), 6) AS td_max, round(avg(td) FILTER (WHERE today), 6) AS td_mean_24h, round(avg(imb), 6) AS imb_mean, max(imb) AS imb_max, round(avg(imb) FILTER (WHERE today), 6) AS imb_mean_24h,
 min(iso) AS iso_min, round(sum(iso) / count(*), 6) AS iso_mean, min(iso) FILTER (WHERE today) AS iso_min_24h, round(count(*) FILTER (WHERE NOT ok) / count(*), 6) AS hvil_false_frac, CAST(sum(fl) AS BIGINT) AS hvil_flaps,
 round(CASE WHEN count(td) >= 3 THEN regr_slope(td, x) END, 4) AS td_slope_per_h, round(CASE WHEN count(imb) >= 3 THEN regr_slope(imb, x) END, 4) AS imb_slope_per_h, round(CASE WHEN count(iso) >= 3 THEN regr_slope(iso, x) END, 3) AS iso_slope_per_h,
 round(min(aux), 6) AS aux_min, round(sum(aux) / count(*), 6) AS aux_mean, round(sum(soc) / count(*), 6) AS soc_mean, round(count(*) FILTER (WHERE soc > 80) / count(*), 6) AS soc_gt80_frac,
 CASE WHEN fd < e + 604800000 THEN 1 ELSE 0 END AS label, round(CASE WHEN fd < e + 604800000 THEN (fd - e) / 3600000.0::DOUBLE END, 6) AS lead_h FROM j GROUP BY vin, dn, e, fd"""
)
def fault_features(spark, d):
    m = _m(spark, d, "ts_event_ms", "pack_temp_max_c", "ambient_c", "cell_v_min_mv", "cell_v_max_mv", "isolation_kohm", "hv_interlock_ok", "aux_12v_v", "soc_pct", "dtc")
    f = features.trailing_features(features.daily_partials(m))
    places = {"td_slope_per_h": 4, "imb_slope_per_h": 4, "iso_slope_per_h": 3}
    return f.select("vin", F.date_format("day", "yyyy-MM-dd").alias("day_ist"), *(F.round(c, places.get(c, 6)).alias(c) if t == "double" else c for c, t in f.dtypes if c not in ("vin", "day")))


@query(
    WITH_M
    + f""", p AS (SELECT m.*, CAST(floor((ts_event_ms + 19800000) / 86400000) AS BIGINT) AS dn, ts_event_ms - lag(ts_event_ms) OVER w AS dt, CAST(pack_current_a AS DOUBLE) AS i, lag(CAST(pack_current_a AS DOUBLE)) OVER w AS pi FROM m WINDOW w AS (PARTITION BY vin ORDER BY ts_event_ms, seq)),
q AS (SELECT p.*, CAST((dn - min(dn) OVER (PARTITION BY p.vin)) // 7 AS INTEGER) AS week, r.capacity_kwh * 1000 / r.nominal_voltage_v AS cap FROM p LEFT JOIN {REGISTRY_SQL} r ON r.vin = p.vin)
SELECT vin, week, round(sum(CASE WHEN dt > 0 AND dt <= 300000 THEN abs((pi + i) / 2 * (dt / 3600000.0::DOUBLE)) END) / (2 * max(cap)), 6) AS efc_week, round(avg(CAST(pack_temp_max_c AS DOUBLE)), 6) AS temp_mean, round(avg(CAST(ambient_c AS DOUBLE)), 6) AS ambient_mean,
 round(avg(CASE WHEN soc_pct > 80 THEN 1.0::DOUBLE WHEN soc_pct IS NOT NULL THEN 0.0::DOUBLE END), 6) AS soc_gt80_frac, round(avg(CAST(charge_power_kw AS DOUBLE)), 6) AS charge_kw_mean FROM q GROUP BY vin, week"""
)
def weekly_features(spark, d):
    w = features.weekly_features(_with_capacity(spark, d))
    features.leakage_check(w.columns, {"vin", "week", "efc_week", "temp_mean", "ambient_mean", "soc_gt80_frac", "charge_kw_mean"})
    return w.select("vin", "week", *(F.round(c, 6).alias(c) for c in w.columns[2:]))


@query(
    WITH_M
    + f""", p AS (SELECT m.vin, seq, ts_event_ms AS ts, CAST(soc_pct AS DOUBLE) AS soc, charge_state IN (2, 3) AS c, CAST(pack_current_a AS DOUBLE) AS i, r.capacity_kwh * 1000 / r.nominal_voltage_v AS cap,
 ts_event_ms - lag(ts_event_ms) OVER w AS dt, lag(CAST(pack_current_a AS DOUBLE)) OVER w AS pi, lag(charge_state IN (2, 3)) OVER w AS pc FROM m LEFT JOIN {REGISTRY_SQL} r ON r.vin = m.vin WINDOW w AS (PARTITION BY m.vin ORDER BY ts_event_ms, seq)),
g AS (SELECT *, sum(CASE WHEN c IS DISTINCT FROM pc THEN 1 ELSE 0 END) OVER (PARTITION BY vin ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM p),
s AS (SELECT vin, run, cap, arg_min(soc, (ts, seq)) AS s0, arg_max(soc, (ts, seq)) AS s1, sum(CASE WHEN pc AND dt > 0 AND dt <= 300000 THEN abs((pi + i) / 2 * (dt / 3600000.0)) END) AS ah FROM g WHERE c GROUP BY 1, 2, 3)
SELECT vin, round(median(CASE WHEN s1 - s0 >= 20 THEN ah / ((s1 - s0) / 100) / cap * 100 END), 6) AS coulomb_soh FROM s GROUP BY vin"""
)
def coulomb_health(spark, d):
    m = _with_capacity(spark, d).withColumn("soc_pct", F.col("soc_pct").cast("double"))
    return features.charging_health(m).select("vin", F.round("coulomb_soh", 6).alias("coulomb_soh"))


@query(SOH_SQL + f", e AS (SELECT obs.h, r.model_code FROM obs JOIN {REGISTRY_SQL} r ON r.vin = obs.vin WHERE reason IS NULL) SELECT model_code, count(*) AS n, round(avg(abs(h - 100)), 6) AS mae, round(quantile_cont(abs(h - 100), 0.9), 6) AS p90 FROM e GROUP BY model_code")
def error_by_model(spark, d):
    o = registry.enrich(_observed(spark, d).where("reason is null"), _registry(spark, d), "vin", ("model_code",)).withColumn("new", F.lit(100.0))
    e = features.error_measures(o, "soh_pct", "new", ["model_code"])
    return e.select("model_code", "n", F.round("mae", 6).alias("mae"), F.round("p90", 6).alias("p90"))


@query()
def mean_interval(spark, d):
    return features.bootstrap_interval(_observed(spark, d).where("reason is null"), "soh_pct", id_col="session_id")


CURVE_SQL = """WITH s AS (SELECT round(imbalance_max_mv / 100, 3) AS score, CASE WHEN isolation_min_kohm < 2000 THEN 1 ELSE 0 END AS y FROM rollup1m WHERE imbalance_max_mv IS NOT NULL AND isolation_min_kohm IS NOT NULL),
g AS (SELECT score, sum(y) AS hit, count(*) AS n FROM s GROUP BY score),
c AS (SELECT score, hit, sum(hit) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, sum(hit) OVER () AS p FROM g)
"""


def _curve(spark, d):
    r = table(spark, d, "rollup1m").where("imbalance_max_mv is not null and isolation_min_kohm is not null")
    return features.precision_recall(r.select(F.round(F.col("imbalance_max_mv") / 100, 3).alias("s"), (F.col("isolation_min_kohm") < 2000).cast("int").alias("y")), "y", "s")


@query(CURVE_SQL + "SELECT score, round(tp / k, 9) AS precision, round(tp / p, 9) AS recall FROM c")
def precision_recall(spark, d):
    return _curve(spark, d).select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(CURVE_SQL + "SELECT round(sum(hit / p * tp / k), 9) AS average_precision FROM c")
def average_precision(spark, d):
    return features.average_precision(_curve(spark, d)).select(F.round("average_precision", 9).alias("average_precision"))


@query("SELECT vin, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS part FROM (SELECT vin, CAST(('0x' || substr(md5(vin), 1, 4)) AS INTEGER) % 100 AS b FROM (SELECT DISTINCT vin FROM vehicle_registry))")
def vehicle_split(spark, d):
    v = table(spark, d, "vehicle_registry").select("vin").distinct()
    b = F.conv(F.substring(F.md5(F.col("vin").cast("binary")), 1, 4), 16, 10).cast("int") % 100
    return v.select("vin", F.when(b < 60, "train").when(b < 80, "val").otherwise("test").alias("part"))


@query(
    f"""WITH s AS (SELECT DISTINCT * FROM vehicle_sessions WHERE phase = 2 AND kind = 1 AND end_ms > start_ms),
x AS (SELECT r.depot_id, unnest(generate_series(start_ms - start_ms % 900000, end_ms - 1, 900000)) AS slot_start, abs(delta_kwh) / ((end_ms - start_ms) / 3600000.0) AS kw FROM s JOIN {REGISTRY_SQL} r ON r.vin = s.vin)
SELECT depot_id, slot_start, round(sum(kw), 6) AS load_kw, CAST(count(*) FILTER (WHERE kw > 1e-9) AS BIGINT) AS active FROM x GROUP BY 1, 2"""
)
def depot_load(spark, d):
    l = slots.load_per_slot(_charging_slots(spark, d), "depot_id", "kw")
    return l.select("depot_id", "slot_start", F.round("load_kw", 6).alias("load_kw"), "active")


def _charging_slots(spark, d):
    s = table(spark, d, "vehicle_sessions").where("phase = 2 and kind = 1").distinct()
    s = registry.enrich(s, _registry(spark, d), "vin", ("depot_id",)).where("registered")
    s = s.withColumn("kw", F.abs("delta_kwh") / F.nullif((F.col("end_ms") - F.col("start_ms")) / 3_600_000, F.lit(0.0)))
    return slots.in_slots(s, "start_ms", "end_ms", 900_000)


SLOTS_SQL = f"""s AS (SELECT DISTINCT * FROM vehicle_sessions WHERE phase = 2 AND kind = 1 AND end_ms > start_ms),
x AS (SELECT DISTINCT r.depot_id AS site, s.vin AS member, CAST(unnest(generate_series(start_ms - start_ms % 900000, end_ms - 1, 900000)) // 900000 AS INTEGER) AS slot FROM s JOIN {REGISTRY_SQL} r ON r.vin = s.vin WHERE r.depot_id IS NOT NULL),
y AS (SELECT *, slot - row_number() OVER (PARTITION BY site, member ORDER BY slot) AS g FROM x),
z AS (SELECT site, member, min(slot) AS first, max(slot) AS last FROM y GROUP BY site, member, g)"""


@query(
    f"""WITH RECURSIVE {SLOTS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first, member) AS rn FROM z),
e AS (SELECT site, rn, member, first, last, 1 AS p, list_concat([last], list_transform(generate_series(2, {PLACES}), lambda i: -1)) AS busy FROM q WHERE rn = 1
UNION ALL SELECT site, rn, member, first, last, p, CASE WHEN p > 0 THEN list_concat(busy[:p - 1], [last], busy[p + 1:]) ELSE busy END FROM (
 SELECT q.*, e.busy, coalesce(list_position(list_transform(e.busy, lambda b: b < q.first), true), 0) AS p FROM e JOIN q ON q.site = e.site AND q.rn = e.rn + 1))
SELECT site, member, CAST(unnest(generate_series(first, last)) AS INTEGER) AS slot, CAST(CASE WHEN p > 0 THEN p - 1 END AS INTEGER) AS place FROM e"""
)
def depot_places(spark, d):
    a = _charging_slots(spark, d).select(F.col("depot_id").alias("site"), (F.col("slot_start") / 900_000).cast("int").alias("slot"), F.col("vin").alias("member"))
    return slots.sticky_places(a, PLACES, strict=False).select("site", "slot", "member", "place")


@query(
    WITH_M
    + f"""SELECT m.vin, count(*) AS messages, CAST(sum(CASE WHEN CASE WHEN r.depart_min_ist <= r.return_min_ist THEN k >= r.depart_min_ist AND k < r.return_min_ist ELSE k >= r.depart_min_ist OR k < r.return_min_ist END THEN 1 ELSE 0 END) AS BIGINT) AS on_duty
FROM (SELECT vin, CAST((ts_event_ms + 19800000) // 60000 % 1440 AS INTEGER) AS k FROM m) m JOIN {REGISTRY_SQL} r ON r.vin = m.vin GROUP BY m.vin"""
)
def duty_share(spark, d):
    e = registry.enrich(_m(spark, d, "ts_event_ms"), _registry(spark, d), "vin", ("depart_min_ist", "return_min_ist")).where("registered")
    e = slots.on_shift(e)
    return e.groupBy("vin").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.coalesce(F.col("on_duty"), F.lit(False)).cast("long")).alias("on_duty"))


PARTS = [(0, 0, 360, "night"), (1, 360, 600, "morning"), (2, 540, 1080, "day"), (3, 1080, 1380, "evening")]


@query(
    WITH_M
    + f""", p(ord, s, e, part) AS (VALUES {", ".join(map(str, PARTS))}), k AS (SELECT vin, seq, CAST((ts_event_ms + 19800000) // 60000 % 1440 AS INTEGER) AS minute FROM m)
SELECT k.vin, k.seq, k.minute, arg_min(p.part, p.ord) AS part FROM k LEFT JOIN p ON k.minute >= p.s AND k.minute < p.e GROUP BY 1, 2, 3"""
)
def day_part(spark, d):
    e = _m(spark, d, "ts_event_ms").select("vin", "seq", measures.local_minute(F.col("ts_event_ms")).alias("minute"))
    parts = spark.createDataFrame(PARTS, "ord int, s int, e int, part string")
    return registry.range_lookup(e, parts, "minute", "s", "e", "ord", ["part"], 60)


@query(
    """SELECT vin, vin[9] = (CASE t % 11 WHEN 10 THEN 'X' ELSE CAST(t % 11 AS VARCHAR) END) AS valid, vin[:3] AS maker FROM (SELECT vin, list_sum(list_transform(generate_series(1, 17),
lambda i: CAST(translate(vin, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789')[i] AS INTEGER) * [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2][i]))::BIGINT AS t FROM (SELECT DISTINCT vin FROM vehicle_registry))"""
)
def vin_check(spark, d):
    v = table(spark, d, "vehicle_registry").select("vin").distinct()
    return v.select("vin", identity.vin_valid(F.col("vin")).alias("valid"), identity.vin_maker(F.col("vin")).alias("maker"))


@query(
    """WITH c AS (SELECT unnest(dtc) AS code FROM telemetry) SELECT code, count(*) AS n, (instr('PCBU', code[1]) - 1) * 16384 + CAST(code[2] AS INTEGER) * 4096 + CAST('0x' || code[3:5] AS INTEGER) AS word, code AS again,
CASE code[1] WHEN 'P' THEN 'powertrain' WHEN 'C' THEN 'chassis' WHEN 'B' THEN 'body' ELSE 'network' END AS system FROM c GROUP BY code"""
)
def code_words(spark, d):
    c = table(spark, d, "telemetry").select(F.explode("dtc").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    w = identity.dtc_word(F.col("code"))
    return c.select("code", "n", w.cast("long").alias("word"), identity.dtc_of_word(w).alias("again"), identity.dtc_system(F.col("code")).alias("system"))


@query(
    WITH_M
    + f"""SELECT m.vin, seq, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(r.depot_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(r.depot_lat)) * pow(sin(radians(r.depot_lon - lon) / 2), 2)))), 6) AS depot_km
FROM m JOIN {REGISTRY_SQL} r ON r.vin = m.vin WHERE lat IS NOT NULL"""
)
def depot_distance(spark, d):
    e = registry.enrich(_m(spark, d, "lat", "lon"), _registry(spark, d), "vin", ("depot_lat", "depot_lon")).where("registered and lat is not null")
    return e.select("vin", "seq", F.round(measures.distance_km(F.col("lat"), F.col("lon"), F.col("depot_lat"), F.col("depot_lon")), 6).alias("depot_km"))


@query(
    WITH_M
    + """, b AS (SELECT vin, least(floor((lon + 180) / 360 * 32768), 32767)::BIGINT AS x, least(floor((lat + 90) / 180 * 32768), 32767)::BIGINT AS y FROM m WHERE lat IS NOT NULL AND lon IS NOT NULL),
c AS (SELECT vin, array_to_string(list_transform(range(0, 6), lambda k: substr('0123456789bcdefghjkmnpqrstuvwxyz', list_sum(list_transform(range(0, 5), lambda j: CASE WHEN (5 * k + j) % 2 = 0 THEN (x >> (14 - (5 * k + j) // 2)) & 1 ELSE (y >> (14 - (5 * k + j) // 2)) & 1 END * (16 >> j)))::INTEGER + 1, 1)), '') AS cell FROM b)
SELECT cell, count(*) AS messages, count(DISTINCT vin) AS vehicles FROM c GROUP BY cell"""
)
def geo_cells(spark, d):
    e = _m(spark, d, "lat", "lon").where("lat is not null and lon is not null")
    per = e.groupBy(measures.geohash(F.col("lat"), F.col("lon"), 6).alias("cell"), "vin").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cell").agg(F.sum("n").alias("messages"), F.count("vin").alias("vehicles"))


@query("SELECT vin, min(n) AS tables FROM (SELECT vin, 1 AS n FROM (SELECT vin FROM telemetry EXCEPT SELECT vin FROM rollup1m) UNION ALL SELECT vin, 2 AS n FROM (SELECT vin FROM telemetry INTERSECT SELECT vin FROM rollup1m) UNION ALL SELECT vin, 3 FROM (SELECT vin FROM rollup1m EXCEPT SELECT vin FROM telemetry)) GROUP BY vin")
def vehicle_sets(spark, d):
    t, r = (table(spark, d, n).select("vin").distinct() for n in ("telemetry", "rollup1m"))
    parts = (t.subtract(r), 1), (t.intersect(r), 2), (r.subtract(t), 3)
    a, b, c = (p.select("vin", F.lit(n).alias("tables")) for p, n in parts)
    return a.unionByName(b).unionByName(c)


@query(
    f"""WITH c AS ({wire_sql.checked("telemetry", "ts_ingest_ms", None, ["oem", "vin", "seq"])}), g AS (SELECT oem, vin, seq, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS fine FROM c GROUP BY ALL)
SELECT oem, CAST(sum(n) AS BIGINT) AS received, CAST(count(*) FILTER (WHERE fine > 0) AS BIGINT) AS accepted, CAST(sum(n - fine) AS BIGINT) AS rejected, CAST(sum(greatest(fine - 1, 0)) AS BIGINT) AS repeated, 0::BIGINT AS unaccounted FROM g GROUP BY oem"""
)
def accounting(spark, d):
    """Per OEM what was received, and that all of it was accepted, rejected or a repeat; `unaccounted` is what is left, 0."""
    rows = validate.route(table(spark, d, "telemetry"), validate.chain(MAKERS))
    per = rows.groupBy("oem", "vin", "seq").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("reason").isNull(), 1)).alias("fine"))
    total = per.groupBy("oem").agg(F.sum("n").alias("received"), F.sum((F.col("fine") > 0).cast("long")).alias("accepted"), F.sum(F.col("n") - F.col("fine")).alias("rejected"), F.sum(F.greatest(F.col("fine") - 1, F.lit(0))).alias("repeated"))
    return total.withColumn("unaccounted", F.col("received") - F.col("accepted") - F.col("rejected") - F.col("repeated"))


@query(
    WITH_M
    + """, b AS (SELECT oem, CAST(pow(2, ceil(log2(greatest(1, ts_ingest_ms - ts_event_ms)))) AS BIGINT) AS bound FROM m), g AS (SELECT oem, bound, count(*) AS n FROM b GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY oem ORDER BY bound) AS k, sum(n) OVER (PARTITION BY oem) AS a FROM g)
SELECT oem, min(bound) FILTER (WHERE k >= a * 0.5) AS p50, min(bound) FILTER (WHERE k >= a * 0.95) AS p95, min(bound) FILTER (WHERE k >= a * 0.99) AS p99 FROM c GROUP BY oem"""
)
def lag_quantiles(spark, d):
    m = _m(spark, d, "oem", "ts_event_ms", "ts_ingest_ms")
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1), F.col("ts_ingest_ms") - F.col("ts_event_ms"))))).cast("long")
    return features.quantiles_of_buckets(m.groupBy("oem", bound.alias("bound")).agg(F.count(F.lit(1)).alias("n")), ["oem"], "bound", "n")


@query(wire_sql.decoded())
def decoded(spark, d):
    return _plain(decode.decode(table(spark, d, "oem_raw")))


def _plain(out: DataFrame) -> DataFrame:
    """Decoded records with doubles for floats and the codes as text."""
    kinds = {c: F.round(F.col(c).cast("double"), 6).alias(c) for c, t in out.dtypes if t in ("float", "double")} | {"dtc": F.array_join("dtc", " ").alias("dtc")}
    return out.select(*(kinds.get(c, c) for c in out.columns if c not in ("body", "schema_version")))


def _of_oem(name):
    def f(spark, d):
        return _plain(decode.decode(table(spark, d, "oem_raw").where(F.col("oem") == name)))

    QUERIES[f"decoded_{name[-1]}"], SQL[f"decoded_{name[-1]}"] = f, f"SELECT * FROM ({wire_sql.decoded()}) WHERE oem = '{name}'"


for _name in decode.FORMATS:
    _of_oem(_name)


def _routed(spark, d):
    raw = decode.decode(table(spark, d, "oem_raw"))
    return validate.route(raw, validate.chain(MAKERS, "received_ms", "topic_vin"))


@query(f"SELECT oem, coalesce(reason, 'ACCEPTED') AS reason, count(*) AS n FROM ({wire_sql.routed()}) GROUP BY ALL")
def routed_reasons(spark, d):
    return _routed(spark, d).groupBy("oem", F.coalesce("reason", F.lit("ACCEPTED")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT coalesce(nullif(vin, ''), nullif(topic_vin, ''), 'unknown') AS key, reason, oem, body, 'x-dlq-reason=' || reason || ' x-error= x-oem=' || oem || ' x-received-ms=' || received_ms AS headers FROM ({wire_sql.routed()}) WHERE reason IS NOT NULL")
def dead_letters(spark, d):
    out = validate.dead_letters(_routed(spark, d))
    heads = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), " ")
    return out.select("key", "reason", "oem", F.decode("body", "UTF-8").alias("body"), heads.alias("headers"))


@query(wire_sql.checked("telemetry", "ts_ingest_ms", None, ["log_offset"]))
def telemetry_reasons(spark, d):
    return validate.route(table(spark, d, "telemetry"), validate.chain(MAKERS)).select("log_offset", "reason")


@query(WITH_M + "SELECT vin, seq, evt, charge_state, hv_interlock_ok, cell_v_min_mv, array_to_string(dtc, ' ') AS codes FROM m")
def encoded_again(spark, d):
    m = _m(spark, d, *ALL)
    out = decode.decode(cut(files.encode(m.select("vin", "seq", *ALL))))
    return out.select("vin", "seq", "evt", "charge_state", "hv_interlock_ok", "cell_v_min_mv", F.array_join("dtc", " ").alias("codes"))


@query(
    WITH_M
    + f""", s AS (SELECT m.vin, ts_ingest_ms AS t, lead(ts_ingest_ms) OVER (PARTITION BY m.vin ORDER BY ts_ingest_ms, seq) AS nx FROM m)
SELECT vin, t AS silent_from_ms, nx AS heard_ms, nx - t AS silent_ms FROM s WHERE nx - t > 600000"""
)
def silent_spells(spark, d):
    m = windows.previous(_m(spark, d, "ts_ingest_ms"), ["ts_ingest_ms"], ts="ts_ingest_ms")
    gap = F.col("ts_ingest_ms") - F.col("prev_ts_ingest_ms")
    return m.where(gap > 600_000).select("vin", F.col("prev_ts_ingest_ms").alias("silent_from_ms"), F.col("ts_ingest_ms").alias("heard_ms"), gap.alias("silent_ms"))


@query("SELECT vin, ts_event_ms // 86400000 AS day, count(*) AS n FROM (SELECT DISTINCT vin, ts_event_ms, seq FROM telemetry) GROUP BY ALL")
def stored_days(spark, d):
    path = scratch(spark)
    files.store_messages(table(spark, d, "telemetry"), path)
    return spark.read.parquet(path).groupBy("vin", F.col("day").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    WITH_M
    + """, l AS (SELECT vin, arg_max({'t': ts_event_ms, 's': soc_pct, 'v': speed_kmh, 'a': lat, 'o': lon, 'c': charge_state}, (ts_event_ms, seq)) AS r FROM m GROUP BY vin)
SELECT vin, '{"vin":"' || vin || '"' || coalesce(',"ts_event_ms":' || r.t, '') || coalesce(',"soc_pct":' || r.s, '') || coalesce(',"speed_kmh":' || r.v, '') || coalesce(',"lat":' || r.a, '') || coalesce(',"lon":' || r.o, '') || coalesce(',"charge_state":' || r.c, '') || '}' AS delta FROM l"""
)
def live_deltas(spark, d):
    return files.delta_json(rollup.latest_state(_m(spark, d, "ts_event_ms", "soc_pct", "speed_kmh", "lat", "lon", "odo_km", "charge_state")), ("ts_event_ms", "soc_pct", "speed_kmh", "lat", "lon", "charge_state"))


@query(
    f"""SELECT r.vin, r.depot_id, v.oem, v.chemistry, round(r.capacity_kwh * 1000 / r.nominal_voltage_v, 6) AS nominal_ah, CASE WHEN r.depart_min_ist < r.return_min_ist THEN r.return_min_ist - r.depart_min_ist ELSE r.return_min_ist - r.depart_min_ist + 1440 END AS shift_min
FROM {REGISTRY_SQL} r JOIN vehicle_model v ON v.code = r.model_code"""
)
def fleet_master(spark, d):
    r = registry.enrich(_registry(spark, d), table(spark, d, "vehicle_model").withColumnRenamed("code", "model_code"), "model_code", ("oem", "chemistry")).where("registered")
    shift = F.col("return_min_ist") - F.col("depart_min_ist")
    return r.select("vin", "depot_id", "oem", "chemistry", F.round(F.col("capacity_kwh") * 1000 / F.col("nominal_voltage_v"), 6).alias("nominal_ah"), F.when(shift > 0, shift).otherwise(shift + 1440).alias("shift_min"))


@query(f"SELECT depot_id, count(*) AS vehicles, round(sum(capacity_kwh), 6) AS capacity_kwh FROM {REGISTRY_SQL} GROUP BY depot_id")
def depot_fleet(spark, d):
    return _registry(spark, d).groupBy("depot_id").agg(F.count(F.lit(1)).alias("vehicles"), F.round(F.sum("capacity_kwh"), 6).alias("capacity_kwh"))


@query("SELECT session_id, vin, start_ms FROM vehicle_sessions s WHERE phase = 1 AND NOT EXISTS (SELECT 1 FROM vehicle_sessions e WHERE e.session_id = s.session_id AND e.phase = 2)")
def unended_sessions(spark, d):
    s = table(spark, d, "vehicle_sessions")
    return s.where("phase = 1").join(s.where("phase = 2").select("session_id").distinct(), "session_id", "left_anti").select("session_id", "vin", "start_ms")


OCV = [(0.0, 3.0), (10.0, 3.45), (50.0, 3.68), (90.0, 4.02), (100.0, 4.18)]
_OCV_SQL = "CASE WHEN soc <= 0 THEN 3.0::DOUBLE " + " ".join(f"WHEN soc < {x1} THEN {y0} + (soc - {x0}) * (({y1}::DOUBLE - {y0}::DOUBLE) / ({x1} - {x0}))" for (x0, y0), (x1, y1) in zip(OCV, OCV[1:])) + f" ELSE {OCV[-1][1]} END"


@query(
    WITH_M
    + f""", x AS (SELECT vin, seq, ts_event_ms AS ts, CAST(soc_pct AS DOUBLE) AS soc, CAST(pack_voltage_v AS DOUBLE) AS v, CAST(charge_power_kw AS DOUBLE) AS kw, CAST(isolation_kohm AS DOUBLE) AS iso FROM m)
SELECT x.vin, seq, CAST((ts + 19800000) // 86400000 + 3 AS BIGINT) % 7 AS weekday, round_even(soc * 10, 0)::BIGINT AS tenths, round({_OCV_SQL}, 6) AS ocv_v, round((v - sqrt(greatest(v * v - 4 * 0.1::DOUBLE * kw * 1000, 0))) / (2 * 0.1::DOUBLE), 6) AS amp, CASE WHEN v > 1 THEN round(iso * 1000 / v, 6) END AS ohm_per_volt,
 round(greatest(0, least(1, (ts - 1780000000000) / 1000000000.0::DOUBLE)), 9) AS progress, CASE WHEN r.capacity_kwh > 0 THEN round(25.0::DOUBLE * r.wh_per_km / 1000 / r.capacity_kwh * 100, 6) END AS reach_pct FROM x LEFT JOIN {REGISTRY_SQL} r ON r.vin = x.vin"""
)
def battery_measures(spark, d):
    """Weekday, half-even rounding, open-circuit voltage, current for a power, isolation per volt, progress and reach of each message."""
    e = registry.enrich(_m(spark, d, "ts_event_ms", "soc_pct", "pack_voltage_v", "charge_power_kw", "isolation_kohm"), _registry(spark, d), "vin", ("capacity_kwh", "wh_per_km"))
    c = lambda n: F.col(n).cast("double")
    return e.select(
        "vin", "seq", measures.local_weekday(F.col("ts_event_ms")).cast("long").alias("weekday"), measures.half_even(c("soc_pct") * 10).alias("tenths"), F.round(measures.interpolate(c("soc_pct"), OCV), 6).alias("ocv_v"),
        F.round(measures.current_for_power(c("pack_voltage_v"), F.lit(0.1), c("charge_power_kw") * 1000), 6).alias("amp"), F.round(measures.ohm_per_volt(c("isolation_kohm"), c("pack_voltage_v")), 6).alias("ohm_per_volt"),
        F.round(measures.progress(F.lit(1_780_000_000_000), F.lit(1_781_000_000_000), F.col("ts_event_ms")), 9).alias("progress"), F.round(measures.share_to_reach(F.lit(25.0), F.col("wh_per_km"), F.col("capacity_kwh")), 6).alias("reach_pct"),
    )


@query("SELECT vin, log_offset, CAST(row_number() OVER (PARTITION BY vin ORDER BY log_offset DESC) AS INTEGER) AS rank FROM telemetry QUALIFY rank <= 100")
def telemetry_tail(spark, d):
    """The last 100 rows of each vehicle's log; ranks are limited before the shuffle, so a hot vehicle is not gathered."""
    return registry.top_by_group(table(spark, d, "telemetry").select("vin", "log_offset"), ["vin"], [F.desc("log_offset")], 100)


@query(
    KALMAN_SQL.rstrip().rstrip(",")
    + """, b AS (SELECT vin, min(as_of) AS lo, max(as_of) AS hi FROM k GROUP BY vin),
e AS (SELECT vin, unnest(generate_series((lo + 19800000) // 86400000 + 1, (hi + 19800000) // 86400000 + 1)) * 86400000 - 19800000 AS at_ms FROM b)
SELECT e.vin, at_ms, round(k.x, 6) AS soh_pct FROM e ASOF JOIN (SELECT vin, as_of, arg_max(x, rn) AS x FROM k GROUP BY vin, as_of) k ON k.vin = e.vin AND e.at_ms >= k.as_of"""
)
def soh_snapshot(spark, d):
    """Each vehicle's state of health at every local midnight from its first estimate to the one after its last."""
    k = battery.kalman(_observed(spark, d)).withColumnRenamed("pack", "vin")
    day = lambda ms: F.floor((ms + 19_800_000) / 86_400_000)
    at = k.groupBy("vin").agg(F.min("as_of_ms").alias("lo"), F.max("as_of_ms").alias("hi")).select("vin", F.explode(F.sequence(day(F.col("lo")) + 1, day(F.col("hi")) + 1)).alias("day"))
    at = at.select("vin", (F.col("day") * 86_400_000 - 19_800_000).alias("at_ms"))
    last = k.groupBy("vin", "as_of_ms").agg(F.max_by("soh_pct", "n").alias("soh_pct"))
    return registry.as_of(at, last, "vin", "at_ms", "as_of_ms", ["soh_pct"]).select("vin", "at_ms", F.round("soh_pct", 6).alias("soh_pct"))


@query(f"SELECT f.vin, day_ist, label, part FROM ({SQL['fault_features']}) f JOIN ({SQL['vehicle_split']}) s ON s.vin = f.vin")
def fault_split(spark, d):
    """Feature rows with the part their vehicle belongs to; no vehicle is in two parts."""
    return fault_features(spark, d).select("vin", "day_ist", "label").join(vehicle_split(spark, d), "vin")


STAYS_FROM = 1_781_060_000_000


@query(
    f"""WITH r AS (SELECT vin, depart_min_ist AS d, return_min_ist AS r, here FROM (SELECT *, CASE WHEN depart_min_ist <= return_min_ist THEN NOT ({(STAYS_FROM + 19_800_000) // 60_000 % 1440} >= depart_min_ist AND {(STAYS_FROM + 19_800_000) // 60_000 % 1440} < return_min_ist) ELSE {(STAYS_FROM + 19_800_000) // 60_000 % 1440} >= return_min_ist AND {(STAYS_FROM + 19_800_000) // 60_000 % 1440} < depart_min_ist END AS here FROM {REGISTRY_SQL})),
e AS (SELECT vin, here, (CASE k WHEN 'D' THEN d ELSE r END - {(STAYS_FROM + 19_800_000) // 60_000 % 1440} + 1440) % 1440 + 1440 * n AS t, k FROM r, (SELECT unnest(['D', 'R']) AS k), (SELECT unnest([0, 1, 2]) AS n)),
p AS (SELECT *, lead(t) OVER (PARTITION BY vin ORDER BY t, k) AS z, min(CASE WHEN k = 'D' THEN t END) OVER (PARTITION BY vin) AS first FROM e),
s AS (SELECT vin, t AS a, z FROM p WHERE k = 'R' AND (NOT here OR t >= first) UNION ALL SELECT DISTINCT vin, 0, first FROM p WHERE here)
SELECT * FROM (SELECT vin, CAST(ceil(a / 15) AS INTEGER) AS plug_slot, CAST(CASE WHEN z < 2160 THEN z // 15 ELSE 144 END AS INTEGER) AS depart_slot, coalesce(z < 2160, false) AS has_departure FROM s WHERE a < 2160) WHERE plug_slot < 96 AND depart_slot > plug_slot"""
)
def depot_stays(spark, d):
    """When vehicles stand at their depots by their duty, from one instant on; those off duty then are there."""
    v = slots.on_shift(_registry(spark, d).withColumn("at", F.lit(STAYS_FROM)), "at").withColumn("at_depot", ~F.col("on_duty"))
    return slots.stays(v.select("vin", "depart_min_ist", "return_min_ist", "at_depot"), STAYS_FROM)


@query(
    f"""WITH {SLOTS_SQL.replace("SELECT DISTINCT r.depot_id AS site", "SELECT r.depot_id AS site, abs(delta_kwh) / ((end_ms - start_ms) / 3600000.0::DOUBLE) AS kw").split("y AS (")[0].rstrip().rstrip(",")},
p AS (SELECT site, member, slot, sum(kw) AS kw FROM x GROUP BY ALL),
t AS (SELECT r.depot_id AS site, r.vin AS member, r.capacity_kwh AS usable, min(slot) AS plug, max(slot) + 1 - 2 AS depart FROM p JOIN {REGISTRY_SQL} r ON r.vin = p.member AND r.depot_id = p.site GROUP BY ALL),
q AS (SELECT p.*, usable, plug, depart, 20 + sum(0.95::DOUBLE * kw * 0.25 / usable * 100) OVER (PARTITION BY p.site, p.member ORDER BY slot ROWS UNBOUNDED PRECEDING) AS soc FROM p JOIN t ON t.site = p.site AND t.member = p.member),
l AS (SELECT site, slot, sum(kw) AS kw, count(*) FILTER (WHERE kw > 1e-9) AS n FROM x GROUP BY ALL)
SELECT site, member, slot, violation FROM (
SELECT site, member, slot, 'LEVEL' AS violation FROM q WHERE NOT (abs(soc - 100) <= 1e-6 AND kw <= 50 + 1e-6) AND NOT (abs(kw) <= 1e-6 OR abs(kw - 7.4) <= 1e-6 OR abs(kw - 50) <= 1e-6)
UNION ALL SELECT site, member, slot, 'OUTSIDE_WINDOW' FROM q WHERE kw > 1e-6 AND NOT (slot >= plug AND slot < depart)
UNION ALL SELECT site, member, slot, 'SOC_RANGE' FROM q WHERE soc > 100 + 1e-6 OR soc < -1e-6
UNION ALL SELECT t.site, t.member, t.depart, 'DEPARTURE' FROM t LEFT JOIN (SELECT site, member, arg_max(soc, slot) AS soc FROM q WHERE slot < depart GROUP BY ALL) a ON a.site = t.site AND a.member = t.member WHERE coalesce(a.soc, 20) < 80 - 1e-6
UNION ALL SELECT site, NULL, slot, 'SITE_CAP' FROM l WHERE kw > 60 + 1e-6 UNION ALL SELECT site, NULL, slot, 'CONNECTORS' FROM l WHERE n > 3)"""
)
def plan_check(spark, d):
    """What past charging would break as a plan: from 20 % on, levels of 0, 7.4 and 50 kW, out of the plug two slots early, to
    reach 80 %, at sites of 60 kW and three connectors."""
    power = _charging_slots(spark, d).select(F.col("depot_id").alias("site"), F.col("vin").alias("member"), (F.col("slot_start") / 900_000).cast("int").alias("slot"), "kw")
    cap = _registry(spark, d).select(F.col("depot_id").alias("site"), F.col("vin").alias("member"), F.col("capacity_kwh").alias("usable_kwh"))
    tasks = power.groupBy("site", "member").agg(F.min("slot").alias("plug_slot"), (F.max("slot") - 1).alias("depart_slot")).join(cap, ["site", "member"])
    fixed = {"soc0_pct": F.lit(20.0), "eta": F.lit(0.95), "cap_pct": F.lit(100.0), "required_pct": F.lit(80.0), "levels_kw": F.array(F.lit(0.0), F.lit(7.4), F.lit(50.0))}
    limits = power.select("site").distinct().withColumns({"cap_kw": F.lit(60.0), "connectors": F.lit(3)})
    return slots.plan_violations(power, tasks.withColumns(fixed), limits)


@query("SELECT * FROM vehicle_model")
def models_by_csv(spark, d):
    """The models written as a reference file with a header and read back with its schema."""
    path = scratch(spark)
    files.write_csv(table(spark, d, "vehicle_model"), path)
    return files.read_csv(spark, path, "vehicle_models")


@query("WITH c AS (SELECT unnest(dtc) AS code FROM telemetry) SELECT code, CASE WHEN code[1] = 'P' THEN 'critical' WHEN code[1] = 'B' THEN 'info' ELSE 'warning' END AS severity, count(*) AS n FROM c GROUP BY ALL")
def code_severity(spark, d):
    """Codes with the severity of a catalogue file (spelled its own way); the default where it has none."""
    codes, path = table(spark, d, "telemetry").select(F.explode("dtc").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")), scratch(spark)
    known = codes.where("code like 'P%' or code like 'B%'").select(F.concat(F.lit(" "), F.lower("code")).alias("code"), F.lit("x").alias("system"), F.when(F.col("code").startswith("P"), "CRITICAL").otherwise("Info").alias("severity"), *(F.lit("x").alias(c) for c in ("description", "sim_fault", "runbook_id", "source_status")))
    files.write_csv(known, path)
    return files.with_severity(codes, files.read_csv(spark, path, "dtc_catalogue")).select("code", "severity", "n")


@query(
    """WITH t AS (SELECT raw_id, CASE raw_id % 4 WHEN 0 THEN 'v1/' || oem || '/' || topic_vin || '/telemetry' WHEN 1 THEN 'v1/' || oem WHEN 2 THEN 'v2/' || oem || '/' || topic_vin ELSE 'v1//' || topic_vin END AS topic FROM oem_raw), p AS (SELECT *, string_split(topic, '/') AS p FROM t),
o AS (SELECT *, p[1] = 'v1' AND len(p) >= 3 AND p[2] <> '' AND coalesce(p[3], '') <> '' AS ok FROM p) SELECT raw_id, CASE WHEN ok THEN p[2] ELSE 'unknown-topic:' || topic END AS oem, CASE WHEN ok THEN p[3] END AS vin, ok FROM o"""
)
def topics(spark, d):
    """Well-formed and malformed topics taken apart."""
    one = "CASE raw_id % 4 WHEN 0 THEN 'v1/' || oem || '/' || topic_vin || '/telemetry' WHEN 1 THEN 'v1/' || oem WHEN 2 THEN 'v2/' || oem || '/' || topic_vin ELSE 'v1//' || topic_vin END"
    t = table(spark, d, "oem_raw").select("raw_id", F.expr(one).alias("topic"))
    oem, vin, ok = decode.topic_parts(F.col("topic"))
    return t.select("raw_id", oem.alias("oem"), vin.alias("vin"), ok.alias("ok"))


SECRET = "a key for tests"
_PADS = [bytes(b ^ x for b in SECRET.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query(f"SELECT raw_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(CAST(received_ms // 1000 AS VARCHAR) || '.' || body)))) AS signature FROM oem_raw")
def signatures(spark, d):
    """The signature a sender of each body must present."""
    ts = F.floor(F.col("received_ms") / 1000).cast("string")
    return table(spark, d, "oem_raw").select("raw_id", decode.signature(F.col("body"), ts, SECRET).alias("signature"))


@query(CURVE_SQL + "SELECT score AS threshold, round(tp / k, 9) AS precision, round(tp / p, 9) AS recall FROM c WHERE tp / k >= 0.05 ORDER BY tp / p DESC, score DESC LIMIT 1")
def operating_point(spark, d):
    o = features.operating_point(_curve(spark, d), 0.05)
    return o.where("threshold is not null").select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))
