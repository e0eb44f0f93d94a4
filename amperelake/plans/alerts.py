"""The alert rules as queries, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from amperelake.common import messages, table
from amperelake.operators import registry, rules
from amperelake.plans.problems import MESSAGES_SQL

REGISTRY_SQL = "(SELECT * FROM vehicle_registry QUALIFY row_number() OVER (PARTITION BY vin ORDER BY updated_ms DESC) = 1)"
#: Messages in order with what the rules judge, as the SQL has it.
JUDGED_SQL = f"""WITH RECURSIVE m AS {MESSAGES_SQL},
o AS (SELECT * FROM m QUALIFY ts_event_ms >= coalesce(max(ts_event_ms) OVER (PARTITION BY vin ORDER BY log_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
i AS (SELECT *, ts_event_ms AS ts, CAST(pack_temp_max_c AS DOUBLE) AS temp, CAST(soc_pct AS DOUBLE) AS soc, CAST(cell_v_max_mv - cell_v_min_mv AS DOUBLE) AS imbalance,
 CASE WHEN pack_voltage_v > 1 THEN CAST(isolation_kohm AS DOUBLE) * 1000 / CAST(pack_voltage_v AS DOUBLE) END AS ohm_per_volt,
 coalesce(last_value(CASE WHEN evt = 2 THEN true WHEN evt = 3 THEN false END IGNORE NULLS) OVER (PARTITION BY vin ORDER BY ts_event_ms, log_offset ROWS UNBOUNDED PRECEDING), false) OR coalesce(charge_power_kw, 0) > 0 OR coalesce(speed_kmh, 0) > 0 AS active,
 min(CASE WHEN pack_temp_max_c IS NOT NULL THEN ts_event_ms END) OVER f AS t0, arg_min(CAST(pack_temp_max_c AS DOUBLE), (ts_event_ms, log_offset)) FILTER (WHERE pack_temp_max_c IS NOT NULL) OVER f AS v0
 FROM o WINDOW f AS (PARTITION BY vin ORDER BY ts_event_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN NOT hv_interlock_ok AND active THEN 1 ELSE 0 END AS op FROM i),
y AS (SELECT x.*, CASE WHEN ts - t0 >= 30000 THEN (temp - v0) / ((ts - t0) / 60000.0::DOUBLE) END AS rise_c_per_min, CASE WHEN NOT active THEN CAST(aux_12v_v AS DOUBLE) END AS parked_aux,
 sum(op) OVER (PARTITION BY x.vin ORDER BY ts, log_offset ROWS UNBOUNDED PRECEDING) - coalesce(sum(op) OVER (PARTITION BY x.vin ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 300001 PRECEDING), 0) AS opens,
 CASE WHEN r.capacity_kwh > 0 AND lat IS NOT NULL THEN 1.3::DOUBLE * 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians(r.depot_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(r.depot_lat)) * pow(sin(radians(r.depot_lon - lon) / 2), 2)))) * r.wh_per_km / 1000 / r.capacity_kwh * 100 END AS need_pct
 FROM x LEFT JOIN {REGISTRY_SQL} r ON r.vin = x.vin)
"""
DELTA_SQL = """, q AS (SELECT vin, ts, log_offset, CAST(pack_temp_max_c AS DOUBLE) - CAST(ambient_c AS DOUBLE) AS v, row_number() OVER (PARTITION BY vin ORDER BY ts, log_offset) AS rn FROM i WHERE pack_temp_max_c IS NOT NULL AND ambient_c IS NOT NULL),
e AS (SELECT vin, rn, ts, log_offset, v AS mean, 0.0::DOUBLE AS var, 1 AS n, 0.0::DOUBLE AS z FROM q WHERE rn = 1
UNION ALL SELECT vin, rn, ts, log_offset, CASE WHEN z > 4 THEN mean ELSE mean + 0.002::DOUBLE * (v - mean) END, CASE WHEN z > 4 THEN var ELSE 0.998::DOUBLE * (var + 0.002::DOUBLE * (v - mean) * (v - mean)) END, CASE WHEN z > 4 THEN n ELSE n + 1 END, z
 FROM (SELECT q.*, e.mean, e.var, e.n, CASE WHEN e.n >= 360 THEN (q.v - e.mean) / greatest(sqrt(e.var), 1e-9::DOUBLE) ELSE 0.0::DOUBLE END AS z FROM e JOIN q ON q.vin = e.vin AND q.rn = e.rn + 1))
"""
COLUMNS = ("rule", "severity", "detail", "vin", "at_ms", "state", "start_ms", "alert_id")


def _held_sql(samples: str, rule: str, severity: str, hold: int, clear: int) -> str:
    """Transitions of `samples` (vin, detail, ts, log_offset, c), c being 1 or 0."""
    key = "vin, detail"
    return f"""SELECT '{rule}' AS rule, '{severity}' AS severity, detail, vin, at_ms, state, start_ms FROM (
WITH s AS ({samples}),
b AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER (PARTITION BY {key} ORDER BY ts, log_offset) THEN 1 ELSE 0 END AS nw, row_number() OVER (PARTITION BY {key} ORDER BY ts, log_offset) AS rn FROM s),
g AS (SELECT *, sum(nw) OVER (PARTITION BY {key} ORDER BY ts, log_offset ROWS UNBOUNDED PRECEDING) AS run FROM b),
f AS (SELECT *, min(ts) OVER (PARTITION BY {key}, run) AS t0, min(rn) OVER (PARTITION BY {key}, run) AS r0 FROM g),
h AS (SELECT {key}, run, c, t0, min(ts) AS at_ms FROM f WHERE ts - t0 >= CASE WHEN c = 1 THEN {hold * 1000} ELSE {clear * 1000} END AND (rn > r0 OR CASE WHEN c = 1 THEN {hold} ELSE {clear} END = 0) GROUP BY ALL),
k AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY {key} ORDER BY run), 0) AS before FROM h),
z AS (SELECT * FROM k WHERE before <> c)
SELECT {key}, at_ms, CASE WHEN c = 1 THEN 'FIRING' ELSE 'RESOLVED' END AS state, CASE WHEN c = 1 THEN t0 ELSE lag(t0) OVER (PARTITION BY {key} ORDER BY run) END AS start_ms FROM z)"""


def _sql(names: tuple[str, ...]) -> str:
    parts = [_held_sql(f"SELECT vin, '' AS detail, ts, log_offset, CAST(({c.replace('D', '') if c.endswith('D') else c}) AS INTEGER) AS c FROM y WHERE ({c.replace('D', '') if c.endswith('D') else c}) IS NOT NULL", r, s, h, k) for r, s, c, h, k in rules.LEVELS if r in names]
    if rules.DELTA[0] in names:
        parts.append(_held_sql("SELECT vin, '' AS detail, ts, log_offset, CAST(z > 4 AS INTEGER) AS c FROM e", *rules.DELTA))
    if rules.DTC[0] in names:
        parts.append(_held_sql("SELECT i.vin, d.code AS detail, ts, log_offset, CAST(coalesce(list_contains(i.dtc, d.code), false) AS INTEGER) AS c FROM i JOIN (SELECT DISTINCT vin, unnest(dtc) AS code FROM i) d ON d.vin = i.vin", rules.DTC[0], "warning", *rules.DTC[1:]))
    if rules.STALE[0] in names:
        parts.append(f"""SELECT 'TELEMETRY_STALE' AS rule, 'warning' AS severity, '' AS detail, vin, unnest([a, b]) AS at_ms, unnest(['FIRING', 'RESOLVED']) AS state, a AS start_ms FROM (
SELECT vin, greatest(a, begin_) AS a, least(b, begin_ + len_) AS b FROM (SELECT *, day * 86400000 - 19800000 + depart_min_ist * 60000 AS begin_, (CASE WHEN depart_min_ist <= return_min_ist THEN return_min_ist - depart_min_ist ELSE return_min_ist - depart_min_ist + 1440 END) * 60000 AS len_ FROM (
SELECT t.vin, a, b, depart_min_ist, return_min_ist, unnest(generate_series((a + 19800000) // 86400000 - 1, (b + 19800000) // 86400000)) AS day FROM (
SELECT vin, lag(ts_ingest_ms) OVER (PARTITION BY vin ORDER BY ts_ingest_ms, log_offset) + 600001 AS a, ts_ingest_ms AS b FROM m) t JOIN {REGISTRY_SQL} r ON r.vin = t.vin WHERE a < b))) WHERE a < b""")
    both = " UNION ALL ".join(parts)
    name = "vin || '|' || rule || ':' || severity || CASE WHEN detail <> '' THEN ':' || detail ELSE '' END || '|' || CAST(start_ms AS VARCHAR)"
    h = f"sha1(unhex('{rules.NAMESPACE}') || CAST({name} AS BLOB))"
    id_ = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INTEGER) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
    return JUDGED_SQL + (DELTA_SQL if rules.DELTA[0] in names else "") + f"SELECT rule, severity, detail, vin, CAST(at_ms AS BIGINT) AS at_ms, state, CAST(start_ms AS BIGINT) AS start_ms, {id_} AS alert_id FROM (SELECT *, {h} AS h FROM ({both}))"


def _of(names: tuple[str, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        reg = registry.latest(table(spark, d, "vehicle_registry"), "vin", ["updated_ms"])
        return rules.transitions(messages(table(spark, d, "telemetry"), *rules.INPUT), reg, None, names).select(*COLUMNS)

    return run


def recent_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest transitions from warning on of each tenant."""
    reg = registry.latest(table(spark, d, "vehicle_registry"), "vin", ["updated_ms"])
    return rules.recent(QUERIES["alert_transitions"](spark, d), reg).select("tenant_id", "rank", "rule", "severity", "detail", "vin", "at_ms", "state", "alert_id")


QUERIES = {f"alert_{n.lower()}": _of((n,)) for n in rules.NAMES} | {"alert_transitions": _of(rules.NAMES), "recent_alerts": recent_alerts}
SQL = {f"alert_{n.lower()}": _sql((n,)) for n in rules.NAMES} | {"alert_transitions": _sql(rules.NAMES)}
SQL["recent_alerts"] = f"""SELECT r.tenant_id, CAST(row_number() OVER (PARTITION BY r.tenant_id ORDER BY at_ms DESC, alert_id, state) AS INTEGER) AS rank, rule, severity, detail, t.vin, at_ms, state, alert_id
FROM ({SQL["alert_transitions"]}) t JOIN {REGISTRY_SQL} r ON r.vin = t.vin WHERE severity IN ('warning', 'critical') AND coalesce(r.tenant_id, '') <> '' QUALIFY rank <= 50"""
