"""The p1 to p6 queries over the tables of a folder, with SQL for those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperelake.common import messages, scratch, table
from amperelake.operators import late, rolling, seen, sessions, spikes, units

MESSAGES_SQL = "(SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY vin, seq ORDER BY log_offset) = 1)"

SESSIONS_SQL = f"""
WITH m AS (SELECT vin, ts_event_ms AS t, ts_event_ms - lag(ts_event_ms) OVER (PARTITION BY vin ORDER BY ts_event_ms) AS d FROM {MESSAGES_SQL}),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 900000 THEN 1 ELSE 0 END) OVER (PARTITION BY vin ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM m)
SELECT vin, min(t) AS start_ms, max(t) AS end_ms, max(t) - min(t) AS duration_ms, count(*) AS message_count,
       CAST(count(*) FILTER (WHERE d > 300000 AND d <= 900000) AS INTEGER) AS gaps
FROM s GROUP BY vin, sid"""

MINUTES_SQL = """
WITH cur AS (SELECT * FROM (SELECT DISTINCT vin, minute_start_ms, emitted_ms, sample_count, energy_kwh, distance_km FROM rollup1m)
  QUALIFY row_number() OVER (PARTITION BY vin, minute_start_ms ORDER BY emitted_ms DESC, sample_count DESC, energy_kwh DESC, distance_km DESC) = 1),
daily AS (SELECT vin, DATE '1970-01-01' + CAST(floor((minute_start_ms + 19800000) / 86400000) AS INTEGER) AS d, count(*) AS n,
  sum(CAST(energy_kwh AS DECIMAL(38,9))) AS e, sum(CAST(distance_km AS DECIMAL(38,9))) AS k FROM cur WHERE sample_count <> 0 GROUP BY 1, 2),
bounds AS (SELECT vin, min(d) AS lo, max(d) AS hi FROM daily GROUP BY vin),
spine AS (SELECT vin, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM bounds),
spans AS (SELECT unnest([7, 30]) AS span_days),
j AS (SELECT s.vin, s.d, p.span_days, coalesce(sum(x.n), 0) AS n, coalesce(sum(x.e), 0) AS e, coalesce(sum(x.k), 0) AS k
  FROM spine s CROSS JOIN spans p LEFT JOIN daily x ON x.vin = s.vin AND x.d <= s.d AND x.d > s.d - p.span_days GROUP BY 1, 2, 3)
"""

LAG_SQL = f"""
WITH m AS (SELECT *, ts_event_ms - ts_event_ms % 60000 AS minute FROM {MESSAGES_SQL}),
l AS (SELECT *, ts_ingest_ms - minute - 60000 AS lag FROM m)
"""


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sweep_sessions(messages(table(spark, d, "telemetry"), "ts_event_ms"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_sessions(spark, d).select("vin", "start_ms", "end_ms")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    msgs = messages(table(spark, d, "telemetry"), "soc_pct", "speed_kmh", "pack_voltage_v", "pack_current_a", "charge_state", "charge_power_kw", "ts_event_ms")
    minutes = rolling.current_minutes(table(spark, d, "rollup1m"), "isolation_min_kohm")
    return spikes.wrong_telemetry(msgs).unionByName(spikes.wrong_rollup(minutes))


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "oem_raw"), table(spark, d, "telemetry"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.other_units(p3_units(spark, d))


def p4_minutes(spark: SparkSession, d: str) -> DataFrame:
    msgs = messages(table(spark, d, "telemetry"), "ts_event_ms", "ts_ingest_ms", *late.INPUT)
    cols = [f"round({c.split()[0]}, 9) AS {c.split()[0]}" for c in late.MEASURES.split(", ")]
    return late.late_minutes(msgs).selectExpr("vin", "minute_start_ms", "on_time", "correcting", "lost", "first_published_ms", "last_corrected_ms", "sample_count", *cols)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    msgs = messages(table(spark, d, "telemetry"), "ts_event_ms", "ts_ingest_ms", *late.INPUT)
    return late.outcomes(late.late_minutes(msgs))


def _arrivals(spark: SparkSession, d: str) -> list[seen.Arrivals]:
    return seen.replayed(table(spark, d, "telemetry"), scratch(spark))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (a.surplus for a in _arrivals(spark, d)))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (a.kept for a in _arrivals(spark, d)))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    minutes = rolling.current_minutes(table(spark, d, "rollup1m"), "energy_kwh", "distance_km")
    out = rolling.trailing_totals(minutes)
    return out.select("vin", "day_ist", "span_days", "minutes", *(F.round(c, 6).alias(c) for c in out.columns[4:]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    minutes = rolling.current_minutes(table(spark, d, "rollup1m"), "energy_kwh", "distance_km")
    return rolling.trailing_totals(minutes).where("minutes = 0").select("vin", "day_ist", "span_days")


QUERIES = {f.__name__: f for f in (p1_found, p1_sessions, p2_found, p3_found, p3_units, p4_found, p4_minutes, p5_found, p5_kept, p6_found, p6_totals)}

SQL = {
    "p1_found": f"SELECT vin, start_ms, end_ms FROM ({SESSIONS_SQL})",
    "p1_sessions": SESSIONS_SQL,
    "p4_found": LAG_SQL
    + """SELECT DISTINCT vin, minute AS minute_start_ms, CASE WHEN lag > 7200000 THEN 'lost' ELSE 'corrected' END AS outcome FROM l WHERE lag > 30000""",
    "p4_minutes": LAG_SQL
    + """, ok AS (SELECT *, lag <= 7200000 AS live FROM l)
SELECT vin, minute AS minute_start_ms, CAST(count(*) FILTER (WHERE lag <= 30000) AS INTEGER) AS on_time,
  CAST(count(*) FILTER (WHERE lag > 30000 AND live) AS INTEGER) AS correcting, CAST(count(*) FILTER (WHERE NOT live) AS INTEGER) AS lost,
  CASE WHEN count(*) FILTER (WHERE lag <= 30000) > 0 THEN minute + 90000 END AS first_published_ms,
  max(ts_ingest_ms) FILTER (WHERE lag > 30000 AND live) AS last_corrected_ms, CAST(count(*) FILTER (WHERE live) AS INTEGER) AS sample_count,
  round(min(CAST(soc_pct AS DOUBLE)) FILTER (WHERE live), 9) AS soc_min_pct, round(max(CAST(soc_pct AS DOUBLE)) FILTER (WHERE live), 9) AS soc_max_pct,
  round(avg(CAST(soc_pct AS DOUBLE)) FILTER (WHERE live), 9) AS soc_avg_pct,
  CASE WHEN bool_or(live) THEN round(coalesce(avg(CAST(speed_kmh AS DOUBLE)) FILTER (WHERE live), 0), 9) END AS speed_avg_kmh,
  round(max(odo_km) FILTER (WHERE live) - min(odo_km) FILTER (WHERE live), 9) AS distance_km,
  round(avg(CAST(pack_voltage_v AS DOUBLE) * CAST(pack_current_a AS DOUBLE)) FILTER (WHERE live) / 60000, 9) AS energy_kwh,
  round(avg(CAST(charge_power_kw AS DOUBLE)) FILTER (WHERE live) / 60, 9) AS charge_kwh_grid, round(CAST(max(pack_temp_max_c) FILTER (WHERE live) AS DOUBLE), 9) AS temp_max_c,
  CAST(max(cell_v_max_mv - cell_v_min_mv) FILTER (WHERE live) AS DOUBLE) AS imbalance_max_mv, round(CAST(min(isolation_kohm) FILTER (WHERE live) AS DOUBLE), 9) AS isolation_min_kohm
FROM ok GROUP BY vin, minute""",
    "p5_found": "SELECT log_offset FROM telemetry QUALIFY row_number() OVER (PARTITION BY vin, seq ORDER BY log_offset) > 1",
    "p5_kept": "SELECT log_offset FROM telemetry QUALIFY row_number() OVER (PARTITION BY vin, seq ORDER BY log_offset) = 1",
    "p6_found": MINUTES_SQL + "SELECT vin, strftime(d, '%Y-%m-%d') AS day_ist, CAST(span_days AS INTEGER) AS span_days FROM j WHERE n = 0",
    "p6_totals": MINUTES_SQL
    + """SELECT vin, strftime(d, '%Y-%m-%d') AS day_ist, CAST(span_days AS INTEGER) AS span_days, CAST(n AS BIGINT) AS minutes,
  round(CAST(e AS DOUBLE), 6) AS total_energy_kwh, round(CAST(k AS DOUBLE), 6) AS total_distance_km,
  round(CAST(e AS DOUBLE) / span_days, 6) AS avg_energy_kwh, round(CAST(k AS DOUBLE) / span_days, 6) AS avg_distance_km FROM j""",
}
