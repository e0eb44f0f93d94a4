"""Synthetic fleets and telemetry for tests and load: every value comes from a hash of seed, vehicle and step, so the same
seed gives the same rows on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amperelake.functions.identity import VIN_DIGITS, VIN_LETTERS, VIN_WEIGHTS

MODELS = (("oem_a", "0EA", "VA52C", 52.0, 358.0, 198.0), ("oem_b", "0EB", "MR18K", 18.5, 307.0, 118.0), ("oem_c", "0EC", "GH88T", 88.0, 414.0, 305.0))


def _u(seed: int, *cols) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_003)) / 1_000_003.0


def fleet(spark: SparkSession, vehicles: int, seed: int = 1, depots: int = 4, tenants: int = 2) -> DataFrame:
    """vin (valid check digit), oem, tenant, depot, model, capacity, voltage, consumption, shift; depots go round."""
    pick = F.floor(_u(seed, F.col("id")) * len(MODELS)).cast("int")
    models = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(m, ("oem", "wmi", "model_code", "capacity_kwh", "nominal_voltage_v", "wh_per_km")))) for m in MODELS))
    v = spark.range(vehicles).withColumn("m", F.element_at(models, pick + 1))
    open_ = F.concat(F.col("m.wmi"), F.col("m.model_code"), F.lit("0R"), F.lit("M"), F.lpad(F.col("id").cast("string"), 6, "0"))
    digits = F.split(F.translate(open_, VIN_LETTERS, VIN_DIGITS), "")
    rest = F.aggregate(F.zip_with(digits, F.array(*map(F.lit, VIN_WEIGHTS)), lambda d, w: d.cast("int") * w), F.lit(0), lambda a, x: a + x) % 11
    vin = F.concat(F.substring(open_, 1, 8), F.when(rest == 10, "X").otherwise(rest.cast("string")), F.substring(open_, 10, 8))
    start = (F.floor(_u(seed + 1, F.col("id")) * 24) * 60).cast("int")
    return v.select(
        vin.alias("vin"), "m.oem", F.concat(F.lit("t"), F.col("id") % tenants).alias("tenant_id"), F.concat(F.lit("d"), F.col("id") % depots).alias("depot_id"), "m.model_code", "m.capacity_kwh", "m.nominal_voltage_v", "m.wh_per_km",
        start.alias("depart_min_ist"), ((start + 480) % 1440).cast("int").alias("return_min_ist"),
    )


def telemetry(vehicles: DataFrame, start_ms: int, steps: int, step_ms: int = 10_000, seed: int = 1, repeat_share: float = 0.01, late_share: float = 0.01, late_ms: int = 600_000) -> DataFrame:
    """Canonical messages of a fleet in steps, with repeated deliveries and late arrivals at the given shares."""
    t = vehicles.select("vin", "oem", "nominal_voltage_v", "capacity_kwh").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("seq", F.col("seq").cast("long"))
    u = lambda k: _u(seed * 100 + k, F.col("vin"), F.col("seq"))
    phase = F.sin(F.col("seq") / 180.0 + _u(seed, F.col("vin")) * 6.28)
    speed = F.greatest(F.lit(0.0), 40 * phase + 20 * (u(1) - 0.5))
    amp = F.when(phase < -0.3, -25 + 2 * u(2)).otherwise(speed * 1.2 + 10 * (u(2) - 0.5))
    soc = 60 + 30 * F.cos(F.col("seq") / 180.0)
    clock = start_ms + F.col("seq") * step_ms
    late = F.when(u(3) < late_share, u(4) * late_ms).otherwise(u(4) * 2000)
    t = t.select(
        "vin", "oem", clock.alias("ts_event_ms"), (clock + late).cast("long").alias("ts_ingest_ms"), "seq", (12.9 + 0.1 * _u(seed, F.col("vin")) + F.col("seq") / 1e5).alias("lat"), (77.5 + F.col("seq") / 1e5).alias("lon"),
        speed.cast("float").alias("speed_kmh"), (1000 + F.col("seq") * 0.1).alias("odo_km"), soc.cast("float").alias("soc_pct"), (F.col("nominal_voltage_v") + 0.3 * soc - 0.05 * amp + u(5)).cast("float").alias("pack_voltage_v"),
        amp.cast("float").alias("pack_current_a"), (28 + 4 * u(6)).cast("float").alias("pack_temp_min_c"), (33 + 4 * u(6)).cast("float").alias("pack_temp_max_c"), (3600 + 10 * u(7)).cast("long").alias("cell_v_min_mv"), (3630 + 10 * u(7)).cast("long").alias("cell_v_max_mv"),
        (2500 + 100 * u(8)).cast("float").alias("isolation_kohm"), F.lit(True).alias("hv_interlock_ok"), (12.8 + u(9)).cast("float").alias("aux_12v_v"), (25 + 5 * u(10)).cast("float").alias("ambient_c"),
        F.when(phase < -0.3, 2).otherwise(1).alias("charge_state"), F.when(phase < -0.3, 7.0).otherwise(0.0).cast("float").alias("charge_power_kw"), F.array().cast("array<string>").alias("dtc"), F.lit(1).alias("evt"), F.lit(1).alias("schema_version"),
    )
    again = t.where(_u(seed * 100 + 11, F.col("vin"), F.col("seq")) < repeat_share).withColumn("ts_ingest_ms", F.col("ts_ingest_ms") + 1000)
    both = t.unionByName(again)
    return both.withColumn("log_offset", (F.col("ts_ingest_ms") - start_ms) * 1_000_003 + F.pmod(F.xxhash64("vin", "seq"), F.lit(1_000_003)))
