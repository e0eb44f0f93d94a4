"""Named queries that run as streams over what a folder holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from amperelake.common import cut, scratch, table
from amperelake.functions import measures
from amperelake.operators import late, registry, seen
from amperelake.plans import alerts, core, problems
from amperelake.plans.problems import MESSAGES_SQL
from amperelake.streaming import pipeline, vehicles


def _stream(spark, d, files=3):
    """The telemetry of a folder as a stream of several batches: its rows in ranges of the log, one file after the other."""
    path, rows = scratch(spark), table(spark, d, "telemetry")
    edges = rows.select(F.percentile_approx("log_offset", [k / files for k in range(1, files)], 1000)).first()[0] or []
    at = F.coalesce("log_offset", F.lit(2**63 - 1))
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):
        part = rows if lo is None else rows.where(at > lo)
        (part if hi is None else part.where(at <= hi)).coalesce(1).write.parquet(f"{path}/part={k}")
    return pipeline.telemetry_stream(spark, f"{path}/part=*/", 1)


def stream_messages(spark, d):
    return pipeline.drain(pipeline.without_repeats(_stream(spark, d)).select("vin", "seq"))


def stream_minutes(spark, d):
    minutes = pipeline.corrected_minutes(_stream(spark, d), scratch(spark))
    return minutes.select("vin", "minute_start_ms", "on_time", "correcting", "lost", "first_published_ms", "last_corrected_ms", "sample_count", *(F.round(c.split()[0], 9).alias(c.split()[0]) for c in late.MEASURES.split(", ")))


def _watched(spark, d):
    reg = registry.latest(table(spark, d, "vehicle_registry"), "vin", ["updated_ms"])
    return vehicles.watched(_stream(spark, d), reg, scratch(spark), flush=True)


def stream_vehicles(spark, d):
    """Messages per vehicle and minute: those the minute was put out with, and those that came late for it."""
    t = _watched(spark, d).where("tag in ('minute', 'late')")
    return t.groupBy("vin", F.col("at_ms").alias("minute_start_ms")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("messages"))


def stream_alerts(spark, d):
    """The transitions that the stream of vehicles gives; the rows of `alert_transitions` without ids."""
    t = _watched(spark, d).where("tag in ('FIRING', 'RESOLVED')")
    return t.select("rule", "severity", "detail", "vin", "at_ms", F.col("tag").alias("state"), F.col("about_ms").alias("start_ms"))


def _merged(spark, d, cols, merge):
    """A table that every batch of first arrivals is merged into, version by version; `merge(table or None, batch)`."""
    path, n_of = scratch(spark), []
    known = seen.SeenStore(spark, f"{path}/seen")

    def write(batch, n):
        batch = cut(batch.select("vin", "seq", "log_offset", *cols))
        now = spark.read.parquet(f"{path}/table/{n_of[-1]}") if n_of else None
        merge(now, seen.kept_rows(batch, known.apply(batch, n).kept)).write.mode("overwrite").parquet(f"{path}/table/{n}")
        n_of.append(n)

    pipeline.each_batch(_stream(spark, d), write, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/table/{n_of[-1]}")


def stream_state(spark, d):
    """The newest state of each vehicle, merged batch by batch; the rows of latest_state."""
    cols = ("ts_event_ms", "soc_pct", "odo_km", "charge_state")
    out = _merged(spark, d, cols, lambda now, b: pipeline.upsert(now, b.select("vin", "seq", *cols), "vin", ["ts_event_ms", "seq"]))
    return out.select("vin", "ts_event_ms", "seq", F.col("soc_pct").cast("double").alias("soc_pct"), "odo_km", "charge_state")


def stream_topk(spark, d):
    """Fault codes per tenant and hour, counted batch by batch; the rows of topk_codes."""
    reg, keys = registry.latest(table(spark, d, "vehicle_registry"), "vin", ["updated_ms"]), ["tenant_id", "hour_ms", "code"]

    def merge(now, batch):
        e = registry.enrich(batch, reg).select("tenant_id", measures.hour_start(F.col("ts_event_ms")).alias("hour_ms"), F.explode("dtc").alias("code"))
        new = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return new if now is None else now.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))

    return registry.top_by_group(_merged(spark, d, ("ts_event_ms", "dtc"), merge), keys[:2], [F.desc("n"), F.asc("code")], 10)


QUERIES = {f.__name__: f for f in (stream_messages, stream_minutes, stream_vehicles, stream_alerts, stream_state, stream_topk)}
SQL = {
    "stream_messages": f"SELECT vin, seq FROM {MESSAGES_SQL}",
    "stream_minutes": problems.SQL["p4_minutes"],
    "stream_state": core.SQL["latest_state"],
    "stream_topk": core.SQL["topk_codes"],
    "stream_vehicles": f"SELECT vin, ts_event_ms - ts_event_ms % 60000 AS minute_start_ms, count(*) AS messages FROM {MESSAGES_SQL} GROUP BY ALL",
    "stream_alerts": f"SELECT * EXCLUDE (alert_id) FROM ({alerts.SQL['alert_transitions']})",
}
