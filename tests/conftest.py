import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from amperelake.common import session

    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TELEMETRY = (
    "log_offset long, batch_id long, event_id string, vin string, oem string, ts_event_ms long, ts_ingest_ms long, seq long, lat double, lon double, speed_kmh float, odo_km double, "
    "soc_pct float, pack_voltage_v float, pack_current_a float, pack_temp_min_c float, pack_temp_max_c float, cell_v_min_mv long, cell_v_max_mv long, isolation_kohm float, "
    "hv_interlock_ok boolean, aux_12v_v float, ambient_c float, charge_state int, charge_power_kw float, dtc array<string>, evt int, schema_version int"
)
PLAIN = {
    "batch_id": 1, "event_id": "e", "vin": "A", "oem": "oem_a", "lat": 12.9, "lon": 77.5, "speed_kmh": 30.0, "odo_km": 100.0, "soc_pct": 60.0, "pack_voltage_v": 360.0, "pack_current_a": 20.0,
    "pack_temp_min_c": 25.0, "pack_temp_max_c": 30.0, "cell_v_min_mv": 3700, "cell_v_max_mv": 3720, "isolation_kohm": 2500.0, "hv_interlock_ok": True, "aux_12v_v": 13.0, "ambient_c": 25.0,
    "charge_state": 1, "charge_power_kw": 0.0, "dtc": [], "evt": 1, "schema_version": 1,
}
NAMES = [c.split()[0] for c in TELEMETRY.split(", ")]
#: Columns that operators use inside; a table that brings them along must not disturb.
CLASHING = ("k", "t", "block", "b", "rank", "n", "open", "delta", "key", "value", "registered", "bucket", "pos", "keep", "_r", "_own", "reason", "score", "id")


@pytest.fixture(scope="session")
def telemetry(spark):
    def make(rows, clash=True):
        full = []
        for i, r in enumerate(rows):
            base = dict(PLAIN) | {"log_offset": i, "ts_event_ms": 1_780_000_000_000 + i * 10_000, "ts_ingest_ms": 1_780_000_001_000 + i * 10_000, "seq": i} | r
            full.append(tuple(base[c] for c in NAMES))
        df = spark.createDataFrame(full, TELEMETRY)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *(F.lit("x").alias(c) for c in CLASHING))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """A message with each column null in turn, repeats, ties, and one with everything null but its offset."""
    rows = [{}, {"seq": 0, "log_offset": 500}, {"seq": 0, "log_offset": 501}, {"seq": 900, "ts_event_ms": 1_780_000_000_000}]
    rows += [{c: None, "seq": 1000 + i, "log_offset": 1000 + i} | ({"seq": None} if c == "seq" else {}) for i, c in enumerate(NAMES) if c != "log_offset"]
    return [*rows, {c: None for c in NAMES if c != "log_offset"} | {"log_offset": 2000}]
