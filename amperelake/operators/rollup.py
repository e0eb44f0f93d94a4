"""One-minute aggregates per vehicle, and the newest state of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperelake.functions.measures import minute_start
from amperelake.operators.registry import latest


def minute_aggregates() -> list[Column]:
    """The columns of a minute, for frames and streams: counts, charge level, speed, distance, energy, warmest cell, imbalance, isolation.

    The mean speed is 0 without positions; the largest temperature and imbalance begin at 0 and are null without readings.
    """
    d = lambda c: F.col(c).cast("double")
    imbalance = d("cell_v_max_mv") - d("cell_v_min_mv")
    n = F.count(F.lit(1))
    return [
        n.alias("sample_count"),
        F.min(d("soc_pct")).alias("soc_min_pct"),
        F.max(d("soc_pct")).alias("soc_max_pct"),
        F.avg(d("soc_pct")).alias("soc_avg_pct"),
        F.coalesce(F.avg(d("speed_kmh")), F.lit(0.0)).alias("speed_avg_kmh"),
        (F.max("odo_km") - F.min("odo_km")).alias("distance_km"),
        (F.avg(d("pack_voltage_v") * d("pack_current_a")) / 60_000).alias("energy_kwh"),
        (F.avg(d("charge_power_kw")) / 60).alias("charge_kwh_grid"),
        F.when(F.count("pack_temp_max_c") > 0, F.greatest(F.lit(0.0), F.max(d("pack_temp_max_c")))).alias("temp_max_c"),
        F.when(F.count(imbalance) > 0, F.greatest(F.lit(0.0), F.max(imbalance))).alias("imbalance_max_mv"),
        F.min(d("isolation_kohm")).alias("isolation_min_kohm"),
    ]


def minute_rollup(messages: DataFrame) -> DataFrame:
    """Per vehicle and minute of event time the `minute_aggregates`.

    One aggregation with map-side combine; a hot vehicle spreads over its minutes.
    """
    return messages.groupBy("vin", minute_start(F.col("ts_event_ms")).alias("minute_start_ms")).agg(*minute_aggregates())


def latest_state(messages: DataFrame, cols: tuple[str, ...] = ("soc_pct", "speed_kmh", "lat", "lon", "odo_km", "charge_state")) -> DataFrame:
    """The newest message of each vehicle by event time, then seq."""
    return latest(messages.select("vin", "ts_event_ms", "seq", *cols), "vin", ["ts_event_ms", "seq"])
