"""The ten alert rules: each fires and resolves where it should, late rows drive none, and the stream gives the batch's rows."""

import random

import pytest
from pyspark.sql import functions as F

from amperelake.common import messages
from amperelake.operators import rules
from amperelake.streaming import pipeline, vehicles

T0 = 1_780_000_000_000
REGISTRY = "vin string, depot_lat double, depot_lon double, capacity_kwh double, wh_per_km double, depart_min_ist int, return_min_ist int"


@pytest.fixture(scope="module")
def fleet():
    """Rows of vehicles named after the rule they break, in order of arrival."""
    far = {"lat": 13.4, "lon": 77.5}
    rows = [{"vin": "rise", "pack_temp_max_c": 30.0 + max(0, i - 40) * (i < 50)} for i in range(100)]
    rows += [{"vin": "lock", "hv_interlock_ok": i not in (50, 60)} for i in range(160)]
    rows += [{"vin": "aux", "speed_kmh": 0.0, "aux_12v_v": 11.0 if 10 <= i < 90 else 13.0} for i in range(160)]
    rows += [{"vin": v, "soc_pct": 20.0, **far} for v in ("far", "unknown") for i in range(20)]
    rows += [{"vin": "delta", "pack_temp_max_c": 60.0 if i >= 400 else 30.0 + i % 2} for i in range(480)]
    rows += [{"vin": "hot", "pack_temp_max_c": 56.0 if 20 <= i < 60 else 30.0} for i in range(120)]
    rows += [{"vin": "cells", "cell_v_max_mv": 3820 if 10 <= i < 60 else 3720} for i in range(140)]
    rows += [{"vin": "iso", "isolation_kohm": 35.0 if 10 <= i < 30 else 179.0 if i < 60 else 2500.0} for i in range(120)]
    rows += [{"vin": "codes", "dtc": ["P0A7E", "U0111"] if i < 10 else ["U0111"] if i < 20 else []} for i in range(40)]
    rows += [{"vin": "quiet"} for i in range(6)]
    n = {}
    for k, r in enumerate(rows):
        i = n[r["vin"]] = n.get(r["vin"], -1) + 1
        wait = 90_000_000 if r["vin"] == "quiet" and i >= 3 else 0
        r |= {"seq": i, "log_offset": k, "ts_event_ms": T0 + i * 10_000, "ts_ingest_ms": T0 + i * 10_000 + 500 + wait}
    late = [{"vin": v, "seq": 9000 + j, "log_offset": 5000 + j, "ts_event_ms": T0 + 60_000 + j, "ts_ingest_ms": T0 + 99_000_000 + j, "pack_temp_max_c": 99.0, "isolation_kohm": 1.0, "dtc": ["B1000"]} for j, v in enumerate(("hot", "iso", "codes", "delta") * 3)]
    return rows + late


@pytest.fixture(scope="module")
def reg(spark):
    return spark.createDataFrame([("far", 12.9, 77.5, 20.0, 120.0, None, None), ("quiet", 12.9, 77.5, 20.0, 120.0, 0, 720), ("hot", None, None, 0.0, None, 600, 60)], REGISTRY)


def of(rows):
    return {(x.vin, x.rule, x.severity, x.detail, x.state): (x.at_ms - T0) // 10_000 for x in rows}


def test_each_rule_fires_and_resolves(telemetry, fleet, reg):
    rows = rules.transitions(messages(telemetry(fleet, clash=False), *rules.INPUT), reg).collect()
    got = of(rows)
    about = lambda vin: {k[1:]: v for k, v in got.items() if k[0] == vin}
    assert about("aux") == {("AUX_12V_LOW", "warning", "", "FIRING"): 70, ("AUX_12V_LOW", "warning", "", "RESOLVED"): 150}
    assert about("lock") == {("HV_INTERLOCK_OPEN", "critical", "", "FIRING"): 60, ("HV_INTERLOCK_OPEN", "critical", "", "RESOLVED"): 141}
    assert about("rise")["THERMAL_RISE_RATE", "critical", "", "FIRING"] == 42 and about("rise")["THERMAL_RISE_RATE", "critical", "", "RESOLVED"] > 75
    assert about("far") == {("CHARGE_NEEDED", "info", "", "FIRING"): 6} and about("unknown") == {}
    assert about("delta")["THERMAL_DELTA_ANOMALY", "warning", "", "FIRING"] == 460
    assert {k: v for k, v in about("hot").items() if k[0] == "THERMAL_OVERTEMP"} == {("THERMAL_OVERTEMP", s, "", t): v for s in ("warning", "critical") for t, v in (("FIRING", 23), ("RESOLVED", 90))}
    assert about("cells") == {("CELL_IMBALANCE", s, "", "FIRING"): 40 for s in ("warning", "critical")} | {("CELL_IMBALANCE", s, "", "RESOLVED"): 120 for s in ("warning", "critical")}
    assert about("iso") == {("ISOLATION_LOW", "warning", "", "FIRING"): 1, ("ISOLATION_LOW", "warning", "", "RESOLVED"): 90, ("ISOLATION_LOW", "critical", "", "FIRING"): 11, ("ISOLATION_LOW", "critical", "", "RESOLVED"): 60}
    assert about("codes") == {("DTC_RAISED", "warning", c, s): v for c, s, v in (("P0A7E", "FIRING", 0), ("U0111", "FIRING", 0), ("P0A7E", "RESOLVED", 16), ("U0111", "RESOLVED", 26))}
    stale = sorted((x.at_ms, x.state, x.start_ms) for x in rows if x.vin == "quiet")
    assert len(stale) >= 2 and all(x[2] >= T0 + 20_000 + 600_001 for x in stale)
    assert {x.rule for x in rows} == set(rules.NAMES)
    assert len({x.alert_id for x in rows}) == len({(x.vin, x.rule, x.severity, x.detail, x.start_ms) for x in rows})


def test_severity_from_the_catalogue_and_odd_rows(spark, telemetry, odd_rows, reg):
    catalogue = spark.createDataFrame([("P0A7E", "critical"), ("P0A7E", "critical")], "code string, severity string")
    m = messages(telemetry([{"dtc": ["P0A7E", None, "P0A7E"], "seq": i} for i in range(3)]), *rules.INPUT)
    assert [(x.severity, x.detail, x.state) for x in rules.transitions(m, reg, catalogue, ("DTC_RAISED",)).collect()] == [("critical", "P0A7E", "FIRING")]
    odd = messages(telemetry(odd_rows), *rules.INPUT)
    rules.transitions(odd, reg).collect()
    assert rules.transitions(odd.limit(0), reg).count() == 0


def sequence(v):
    return sorted(map(tuple, v), key=repr)


@pytest.mark.parametrize(("arrow", "files"), [(7, 1), (10_000, 4)])
def test_the_stream_gives_the_rows_of_the_batch(spark, telemetry, fleet, reg, tmp_path, arrow, files):
    df = telemetry(fleet + fleet[100:160], clash=False)
    path, n = str(tmp_path / "in"), len(fleet) // files + 1
    for k in range(files):
        df.where(f"log_offset >= {k * n} and log_offset < {(k + 1) * n}" if k < files - 1 else f"log_offset >= {k * n}").repartition(2).write.parquet(f"{path}/part={k}")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(conf)
    spark.conf.set(conf, str(arrow))
    try:
        out = vehicles.watched(pipeline.telemetry_stream(spark, f"{path}/part=*/", 2), reg, str(tmp_path / "state"), flush=True).cache()
        again = vehicles.VehicleStore(spark, str(tmp_path / "state/vehicles")).apply(df.limit(0), reg, 0).count()
    finally:
        spark.conf.set(conf, had)
    assert again > 0
    want = rules.transitions(messages(df, *rules.INPUT), reg)
    cols = ("vin", "rule", "severity", "detail", "at_ms", "state", "start_ms")
    got = out.where("tag in ('FIRING', 'RESOLVED')").withColumnsRenamed({"tag": "state", "about_ms": "start_ms"})
    assert sequence(got.select(*cols).collect()) == sequence(want.select(*cols).collect())
    minute = lambda c: c - F.pmod(c, F.lit(60_000))
    counts = out.where("tag = 'minute'").groupBy("vin", "at_ms").agg(F.count("n").alias("times"), F.sum("n").alias("n"))
    assert counts.where("times > 1").count() == 0
    late = out.where("tag = 'late'").groupBy("vin", "at_ms").agg(F.count("vin").alias("late"))
    every = messages(df, "ts_event_ms").groupBy("vin", minute(F.col("ts_event_ms")).alias("at_ms")).agg(F.count("vin").alias("all"))
    both = every.join(counts, ["vin", "at_ms"], "left").join(late, ["vin", "at_ms"], "left").fillna(0)
    assert both.where("all <> n + late").count() == 0 and (files == 1) == (late.count() == 0)


def test_a_vehicle_keeps_its_episodes_and_emits_each_minute_once():
    blank = dict.fromkeys(("vin", *vehicles.COLS))
    row = lambda s, **k: blank | {"ts_event_ms": s * 1000, "ts_ingest_ms": s * 1000, "soc_pct": 50.0} | k
    v = vehicles.Vehicle("A")
    for s in (65, 50, 125):  # 50 is late within the allowance, 125 closes minute 0
        v.add(row(s, pack_temp_max_c=60.0))
    assert [x[1:3] for x in v.end_of_batch() if x[1] == "minute"] == [("minute", 0)]
    v = vehicles.Vehicle("A", v.kept())
    v.add(row(59))
    assert [x[1:4] for x in v.end_of_batch()] == [("late", 0, 59_000)]
    v = vehicles.Vehicle("A", v.kept())
    r, out = random.Random(1), []
    for s in range(130, 700, 10):
        v.add(row(s, pack_temp_max_c=60.0 if s < 200 else 30.0))
        if r.random() < 0.3:
            out += v.end_of_batch()
            v = vehicles.Vehicle("A", v.kept())
    out += v.end_of_batch(flush=True)
    over = [(x[1], x[2], x[3]) for x in out if x[6] == "THERMAL_OVERTEMP"]
    assert over == [("RESOLVED", 500_000, 65_000)] * 2  # fired before, with the restored start
    minutes = [x[2] for x in out if x[1] == "minute"]
    assert minutes == sorted(minutes) and len(set(minutes)) == len(minutes)
