"""An ordered chain of checks; the first that fails names the reason a record is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperelake.functions.identity import dtc_valid, vin_format_ok, vin_maker, vin_valid

# Bounds of plausible readings, inclusive; earliest event clock.
RANGES = {
    "soc_pct": (0, 100), "pack_voltage_v": (0, 1000), "pack_current_a": (-1000, 1000), "odo_km": (0, 5_000_000), "isolation_kohm": (0, 100_000), "aux_12v_v": (0, 20),
    "ambient_c": (-40, 60), "charge_power_kw": (0, 400),
}
GROUP_RANGES = {"lat": (-90, 90), "lon": (-180, 180), "speed_kmh": (0, 250), "pack_temp_min_c": (-40, 90), "pack_temp_max_c": (-40, 90), "cell_v_min_mv": (1500, 5000), "cell_v_max_mv": (1500, 5000)}
EARLIEST_MS, AHEAD_MS = 1_577_836_800_000, 86_400_000
DLQ_BYTES = 65_536


def out_of_range(received: str = "ts_ingest_ms") -> Column:
    """Whether any reading is implausible; optional ones only where present, missing required ones and NaN always."""
    bad = F.lit(False)
    for c, (lo, hi) in RANGES.items():
        bad = bad | ~F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    for c, (lo, hi) in GROUP_RANGES.items():
        bad = bad | F.coalesce(~F.col(c).between(lo, hi), F.lit(False))
    for lo, hi in (("pack_temp_min_c", "pack_temp_max_c"), ("cell_v_min_mv", "cell_v_max_mv")):
        bad = bad | F.coalesce(F.col(lo) > F.col(hi), F.lit(False))
    clock = F.col("ts_event_ms").between(F.lit(EARLIEST_MS), F.col(received) + AHEAD_MS)
    return bad | ~F.coalesce(clock, F.lit(False)) | ~F.coalesce(F.col("charge_state").between(1, 4) & F.col("evt").between(1, 8), F.lit(False))


def chain(makers: dict[str, str], received: str = "ts_ingest_ms", topic_vin: str | None = None) -> list[tuple[str, Column]]:
    """The standard checks as (reason, failed), in order; `makers` maps the first three VIN places to the OEM that may send.

    The list is plain data: steps can be added, dropped or moved before it goes to `route`.
    """
    vin = F.col("vin")
    owner = F.create_map(*(F.lit(x) for kv in makers.items() for x in kv))[vin_maker(vin)]
    spoofed = F.coalesce(owner != F.col("oem"), F.lit(True))
    if topic_vin:
        spoofed = spoofed | (F.coalesce(F.col(topic_vin), F.lit("")) != "") & (F.col(topic_vin) != vin)
    return [
        ("UNKNOWN_SCHEMA_VERSION", ~F.coalesce(F.col("schema_version") == 1, F.lit(False))),
        ("VIN_FORMAT", ~vin_format_ok(vin)),
        ("VIN_CHECKSUM", ~vin_valid(vin)),
        ("IDENTITY_MISMATCH", spoofed),
        ("DTC_FORMAT", ~dtc_valid(F.col("dtc"))),
        ("RANGE", out_of_range(received)),
    ]


def route(records: DataFrame, checks: list[tuple[str, Column]], reason: str = "reason") -> DataFrame:
    """`records` with `reason`: kept where one is set already, else that of the first check that fails, else null."""
    found = F.coalesce(F.col(reason), *(F.when(bad, why) for why, bad in checks)) if reason in records.columns else F.coalesce(*(F.when(bad, why) for why, bad in checks))
    return records.withColumn(reason, found)


def dead_letters(routed: DataFrame, body: str = "body", topic_vin: str = "topic_vin", received: str = "received_ms") -> DataFrame:
    """Rejected records for the dead-letter table: key, reason, oem, at most 64 KiB of the body (the table's format), and
    the headers x-dlq-reason, x-oem, x-error and x-received-ms."""
    key = F.coalesce(F.nullif("vin", F.lit("")), F.nullif(topic_vin, F.lit("")), F.lit("unknown"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    error = text("error") if "error" in routed.columns else F.lit("")
    headers = F.create_map(F.lit("x-dlq-reason"), F.col("reason"), F.lit("x-oem"), text("oem"), F.lit("x-error"), error, F.lit("x-received-ms"), text(received))
    return routed.where("reason is not null").select(key.alias("key"), "reason", "oem", F.substring(F.col(body).cast("binary"), 1, DLQ_BYTES).alias("body"), headers.alias("headers"))
