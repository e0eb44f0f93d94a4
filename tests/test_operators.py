"""Operators of the engine against brute force, closed forms and known answers."""

import hashlib
import hmac
import json
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from amperelake.common import messages
from amperelake.functions import identity, measures
from amperelake.operators import battery, features, folds, registry, rollup, slots, usage, validate, windows
from amperelake.sources import decode

T0 = 1_780_000_000_000


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_identity_functions(spark):
    good = "1M8GDM9AXKP042788"
    r = one(
        spark,
        identity.vin_valid(F.lit(good)).alias("ok"), identity.vin_valid(F.lit("1M8GDM9A1KP042788")).alias("bad"), identity.vin_valid(F.lit("short")).alias("short"), identity.vin_valid(F.lit(None).cast("string")).alias("null"),
        identity.dtcs_of_hex(F.lit("0A7EC111")).alias("codes"), identity.dtcs_of_hex(F.lit("")).alias("none"), identity.dtc_word(F.lit("U0111")).alias("word"), identity.dtc_word(F.lit("X0111")).alias("noword"),
        identity.uuid5("6f1c2d8a4b3e4f519a770c5e21d3884b", F.lit("A|R|1")).alias("id"), identity.dtc_valid(F.array(F.lit("P0A7E"), F.lit("P4A7E"))).alias("dv"),
    )
    assert (r.ok, r.bad, r.short, r.null) == (True, False, False, False)
    assert r.codes == ["P0A7E", "U0111"] and r.none == [] and r.word == 0xC111 and r.noword is None and r.dv is False
    assert r.id == str(uuid.uuid5(uuid.UUID("6f1c2d8a4b3e4f519a770c5e21d3884b"), "A|R|1"))


def test_measures(spark):
    lit = F.lit
    r = one(
        spark,
        measures.geohash(lit(57.64911), lit(10.40744), 11).alias("g"), measures.distance_km(lit(0.0), lit(0.0), lit(0.0), lit(90.0)).alias("d"),
        *(measures.half_even(lit(x)).alias(f"h{i}") for i, x in enumerate((2.5, 3.5, -2.5))),
        measures.local_weekday(lit(1_780_272_000_000)).alias("wd"), measures.local_minute(lit(0)).alias("lm"),
        measures.interpolate(lit(0.25), [(0.0, 3.0), (0.5, 3.5), (1.0, 4.0)]).alias("ip"), measures.current_for_power(lit(400.0), lit(0.1), lit(3990.0)).alias("i"),
        *(measures.within_shift(lit(m), lit(s), lit(e)).alias(f"s{i}") for i, (m, s, e) in enumerate(((600, 600, 840), (840, 600, 840), (10, 1380, 60), (700, 1380, 60)))),
        measures.power_levels(lit(7.4), 3).alias("pl"), measures.progress(lit(0), lit(10), lit(15)).alias("p"),
    )
    assert r.g == "u4pruydqqvj" and r.d == pytest.approx(math.pi * 6371 / 2)
    assert (r.h0, r.h1, r.h2) == (2, 4, -2) and r.wd == 0 and r.lm == 330
    assert r.ip == pytest.approx(3.25) and r.i == pytest.approx(10.0, rel=1e-3)
    assert (r.s0, r.s1, r.s2, r.s3) == (True, False, True, False) and r.pl == [0.0, 3.7, 7.4] and r.p == 1.0


def test_signature_and_topic(spark):
    r = one(spark, decode.signature(F.lit('{"a":1}'), F.lit("17"), "s3cret" * 20).alias("s"), *(c.alias(n) for c, n in zip(decode.topic_parts(F.lit("v1/oem_a/VIN/x")), "abc")), decode.topic_parts(F.lit("zz/1"))[0].alias("u"))
    assert r.s == hmac.new(b"s3cret" * 20, b'17.{"a":1}', hashlib.sha256).hexdigest()
    assert (r.a, r.b, r.c, r.u) == ("oem_a", "VIN", True, "unknown-topic:zz/1")


def machine(samples, hold, clear):
    """The alert machine, sample by sample."""
    out, phase, start, off = [], 0, 0, None
    for t, on in samples:
        if phase == 0 and on:
            phase, start, fresh = 1, t, True
        else:
            fresh = False
        if phase == 1:
            if not on:
                phase = 0
            elif hold == 0 or (not fresh and t - start >= hold):
                phase, off = 2, None
                out.append((t, "FIRING", start))
        elif phase == 2:
            if on:
                off = None
            else:
                first, off = off is None, t if off is None else off
                if clear == 0 or (not first and t - off >= clear):
                    phase = 0
                    out.append((t, "RESOLVED", start))
    return out


@pytest.mark.parametrize(("hold", "clear"), [(30, 60), (0, 60), (30, 0), (0, 0)])
def test_held_is_the_alert_machine(spark, hold, clear):
    r = random.Random(hold + clear)
    rows, want = [], []
    for v in "ABCD":
        t, samples = T0, []
        for i in range(150):
            t += r.choice([0, 5_000, 10_000, 20_000, 40_000])
            on = r.random() < 0.5 if i % 40 > 20 else i % 40 > 8
            samples.append((t, on))
            rows.append((v, t, i, on))
        rows.append((v, t, 999, None))
        want += [(v, *x) for x in machine(samples, hold * 1000, clear * 1000)]
    df = spark.createDataFrame(rows, "vin string, ts_event_ms long, seq long, on boolean")
    got = windows.held(df, F.col("on"), hold * 1000, clear * 1000)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_trapezoid_of_a_constant_charge(telemetry):
    m = messages(telemetry([{"pack_current_a": -50.0, "pack_voltage_v": 400.0, "charge_state": 2, "ts_event_ms": T0 + i * 10_000} for i in range(361)]), "ts_event_ms", "pack_voltage_v", "pack_current_a")
    r = windows.trapezoid(m).agg(F.sum("step_ah"), F.sum("step_kwh"), F.sum("gap")).first()
    assert r[0] == pytest.approx(-50) and r[1] == pytest.approx(-20) and r[2] == 0


def test_charge_with_rest_before(telemetry):
    rows = [{"pack_current_a": 0.2, "pack_voltage_v": 380.0, "speed_kmh": 0.0, "ts_event_ms": T0 + i * 600_000} for i in range(5)]
    rows += [{"pack_current_a": -50.0, "charge_state": 3, "speed_kmh": None, "soc_pct": 30.0 + i, "ts_event_ms": T0 + 2_500_000 + i * 60_000} for i in range(61)]
    rows += [{"pack_current_a": 0.0, "evt": 5, "soc_pct": 90.0, "ts_event_ms": T0 + 2_500_000 + 61 * 60_000}]
    m = messages(telemetry(rows), "ts_event_ms", "evt", "charge_state", *(c for c in usage.INPUT if c not in ("ts_event_ms", "evt", "charge_state"))).withColumn("cap_ah", F.lit(100.0))
    got = usage.vehicle_sessions(m).where("kind = 1").orderBy("phase").collect()
    assert [(r.phase, r.charger_type, r.v_rest_before) for r in got] == [(1, "DC_FAST", 380.0), (2, "DC_FAST", 380.0)]
    assert got[1].delta_ah == pytest.approx(-50.0 - 25 / 60, rel=1e-6) and got[1].samples == 62 and got[1].gaps == 0 and got[1].max_c_rate == 0.5


def by_hand(rows, idle_ms=900_000):
    """START and END of one vehicle's sessions, message by message."""
    out, charge, drive, moved = [], None, None, 0
    for r in rows:
        ts, into, moving = r["ts_event_ms"], r["charge_state"] != 1 and r["pack_current_a"] < 0, r["speed_kmh"] > 0
        moved = ts if moving else moved
        if charge is None:
            if into or (r["evt"] == 4 and r["pack_current_a"] < 0):
                charge = ts
                out.append((1, 1, ts, None))
        elif r["evt"] == 5 or not into:
            out.append((1, 2, charge, ts))
            charge = None
        if drive is None:
            if r["evt"] == 2 or moving:
                drive = moved = ts
                out.append((2, 1, ts, None))
        elif r["evt"] == 3 or ts - moved >= idle_ms:
            out.append((2, 2, drive, ts))
            drive = None
    return out


def test_sessions_as_by_hand_over_block_borders(telemetry):
    r = random.Random(5)
    rows, at = [], T0
    for _ in range(700):
        at += r.choice([10_000, 10_000, 200_000, 400_000, 0, 5_000_000])
        rows.append({"ts_event_ms": at, "evt": r.choice([1, 1, 1, 2, 3, 4, 5]), "speed_kmh": r.choice([0.0, 0.0, 0.0, 9.0]), "charge_state": r.choice([1, 2]), "pack_current_a": r.choice([-9.0, 3.0])})
    late = [{**rows[5], "log_offset": 2000, "seq": 2000, "evt": 2}]
    m = messages(telemetry(rows + late), *usage.INPUT).withColumn("cap_ah", F.lit(None).cast("double"))
    got = usage.vehicle_sessions(m).select("kind", "phase", "start_ms", "end_ms").collect()
    key = lambda x: (x[0], x[2], x[1], x[3] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(by_hand(rows), key=key)
    assert usage.vehicle_sessions(m.limit(0)).count() == 0


def test_baseline_freezes_while_breaching(telemetry):
    rows = [{"ambient_c": 20.0 + 0.1 * (i % 2)} for i in range(50)] + [{"ambient_c": 60.0}] * 3
    m = messages(telemetry(rows), "ts_event_ms", "ambient_c")
    got = folds.ewma_baseline(m, "ambient_c", alpha=0.1, least=10).orderBy("ts_event_ms").collect()
    assert [r.breach for r in got] == [False] * 50 + [True] * 3 and len({r.mean for r in got[49:]}) == 1


def test_throttle(telemetry):
    m = messages(telemetry([{"ts_event_ms": T0 + s * 1000} for s in (0, 1, 4, 5, 6, 9, 11)]), "ts_event_ms")
    assert [r[1] - T0 for r in folds.throttle(m, 5000).orderBy("ts_event_ms").collect()] == [0, 5000, 11000]
    assert [r[1] - T0 for r in folds.throttle(m, 5000, changed=F.col("ts_event_ms") == T0 + 1000).orderBy("ts_event_ms").collect()][:2] == [0, 1000]


def test_kalman_and_gate(spark):
    base = {"soc_start_pct": 30.0, "soc_end_pct": 90.0, "delta_ah": -60.0, "temp_min_c": 25.0, "temp_max_c": 30.0, "gaps": 0, "samples": 360, "v_rest_before": None, "nominal_ah": 100.0, "vin": "A", "session_id": "s", "end_ms": 0}
    cases = [({}, None), ({"nominal_ah": None}, "unknown_nominal_capacity"), ({"delta_ah": float("nan")}, "non_finite_input"), ({"delta_ah": 1.0}, "not_a_charge"), ({"soc_end_pct": 45.0}, "delta_soc_below_min"), ({"temp_max_c": 36.0}, "temperature_out_of_range"), ({"gaps": 1}, "telemetry_gaps"), ({"samples": 9}, "too_few_samples"), ({"delta_ah": -10.0}, "implausible_soh")]
    names = list(base)
    schema = "soc_start_pct double, soc_end_pct double, delta_ah double, temp_min_c double, temp_max_c double, gaps int, samples int, v_rest_before double, nominal_ah double, vin string, session_id string, end_ms long"
    df = spark.createDataFrame([tuple((base | c | {"session_id": f"s{i}"})[n] for n in names) for i, (c, _) in enumerate(cases)], schema)
    got = {r.session_id: r for r in battery.observed(df).collect()}
    assert [got[f"s{i}"].reason for i in range(len(cases))] == [w for _, w in cases]
    assert got["s0"].soh_pct == pytest.approx(100.0)
    obs = spark.createDataFrame([("A", "a", 10 * 86_400_000, 90.0, 4.0), ("A", "b", 10 * 86_400_000, 92.0, 4.0), ("B", "a", 0, 80.0, 1.0), (None, "x", 0, 1.0, 1.0)], "vin string, session_id string, end_ms long, soh_pct double, variance double")
    k = {(r.pack, r.n): r for r in battery.kalman(obs).collect()}
    assert k["A", 2].p00 == pytest.approx(2.0) and k["A", 2].soh_pct == pytest.approx(91.0) and len(k) == 3


def test_remaining_life(spark):
    pts = [("A", d * 86_400_000, 98 - 0.3 * math.sqrt(d)) for d in range(0, 391, 10)] + [("B", 0, 90.0), ("B", 1, 80.0)]
    r = battery.remaining_life(spark.createDataFrame(pts, "vin string, t long, y double"), "vin", "t", "y", 390 * 86_400_000).collect()
    assert [(x.vin, round(x.days)) for x in r] == [("A", 3600 - 390)]


RAW = "raw_id long, oem string, topic_vin string, fw_version string, received_ms long, body string"
VIN_A, VIN_B = "0EAVA52C9RM000326", "0EBMR18K4RM000029"


def msg_a(**over):
    d = {"vin": VIN_A, "schema": 1, "ts": "2026-06-01T00:00:00.123Z", "seq": 42, "evt": "DTC_RAISED", "pos": {"lat": 13.0, "lon": 80.2, "speed_kmh": 42.5}, "odo_km": 18234.125, "soc_pct": 63.25, "pack": {"voltage_v": 362.4, "current_a": 21.7, "temp_min_c": 30.4, "temp_max_c": 33.1, "cell_min_mv": 3765, "cell_max_mv": 3779, "isolation_kohm": 2480, "hv_interlock_ok": True}, "aux_12v_v": 13.9, "ambient_c": 31.5, "charge": {"state": "IDLE", "power_kw": 0}, "dtc": ["P0A7E", "U0111"]}
    for k, v in over.items():
        at = d
        *path, last = k.split("__")
        for p in path:
            at = at[p]
        if v is ...:
            del at[last]
        else:
            at[last] = v
    return json.dumps(d)


def test_decoders_and_reasons(spark):
    c = f"1;0ECSH26L9SK000262;1781136031957;821515;1;12.87;77.43;65.4;74450.8;93.2;282.4;28.6;42.4;44.2;;;1996;1;13.20;29.8;1;0.00;0A7EC111"
    b = {"vehicleId": VIN_B, "version": 1, "epoch": 1781136009, "sequence": 7, "eventType": "PERIODIC", "location": {"latitude": 12.9, "longitude": 77.4, "speedMph": 10}, "odometerMiles": 100, "battery": {"soc": 0.5, "voltage": 306.7, "current": 0.6, "tempMinF": 32, "tempMaxF": 212, "isolationKohm": 1915}, "hvInterlock": True, "auxVolts": 13.2, "ambientF": 50, "charging": {"status": "AC", "powerKw": 3}, "dtcs": []}
    cases = [
        ("oem_a", msg_a(), None), ("oem_a", msg_a()[:-5], "DECODE"), ("oem_a", "[1]", "SCHEMA"), ("oem_a", msg_a(schema=2), "UNKNOWN_SCHEMA_VERSION"), ("oem_a", msg_a(schema="1"), "SCHEMA"), ("oem_a", msg_a(seq=...), "SCHEMA"),
        ("oem_a", msg_a(soc_pct="63"), "SCHEMA"), ("oem_a", msg_a(evt="NOPE"), "SCHEMA"), ("oem_a", msg_a(ts="yesterday"), "SCHEMA"), ("oem_a", msg_a(pos__lat=...), "SCHEMA"), ("oem_a", msg_a(pack__temp_min_c=...), "SCHEMA"), ("oem_a", msg_a(pos=...), None),
        ("oem_b", json.dumps([b, b]), None), ("oem_b", json.dumps(b), None), ("oem_b", "{", "DECODE"), ("oem_b", json.dumps([b] * 501), "OVERSIZE"),
        ("oem_c", c, None), ("oem_c", c + ";", "DECODE"), ("oem_c", "x" + c, "SCHEMA"), ("oem_c", c.replace(";12.87;", ";;"), "SCHEMA"), ("oem_c", c[:-1], "DTC_FORMAT"), ("oem_c", c.replace(";1996;", ";abc;"), "SCHEMA"),
        ("oem_x", "{}", "UNKNOWN_OEM"), (None, "{}", "UNKNOWN_OEM"), ("oem_a", None, "DECODE"), ("oem_c", "", "DECODE"),
    ]
    df = spark.createDataFrame([(i, o, None, None, 1_790_000_000_000, body) for i, (o, body, _) in enumerate(cases)], RAW)
    out = decode.decode(df)
    got = out.collect()
    for i, (_, body, reason) in enumerate(cases):
        assert {r.reason for r in got if r.raw_id == i} == {reason}, (body, reason)
    by = {r.raw_id: r for r in got}
    assert by[0].ts_event_ms == 1_780_272_000_123 and by[0].dtc == ["P0A7E", "U0111"] and by[0].evt == 8 and by[11].lat is None
    assert sum(r.raw_id == 12 for r in got) == 2 and (by[13].pack_temp_min_c, by[13].pack_temp_max_c, by[13].ambient_c, by[13].soc_pct) == (0.0, 100.0, 10.0, 50.0)
    assert by[13].odo_km == pytest.approx(160.9344) and by[16].dtc == ["P0A7E", "U0111"] and by[16].seq == 821515
    routed = validate.route(out, validate.chain({"0EA": "oem_a", "0EB": "oem_b", "0EC": "oem_c"}, "received_ms", "topic_vin"))
    letters = validate.dead_letters(routed)
    assert letters.count() == routed.where("reason is not null").count()
    assert decode.decode(df.limit(0)).count() == 0


def test_validation_order(telemetry):
    ok = {"vin": VIN_A}
    cases = [({}, None), ({"schema_version": 2, "vin": "bad"}, "UNKNOWN_SCHEMA_VERSION"), ({"vin": "bad"}, "VIN_FORMAT"), ({"vin": VIN_A[:-1] + "7"}, "VIN_CHECKSUM"), ({"oem": "oem_b"}, "IDENTITY_MISMATCH"), ({"dtc": ["Z"], "soc_pct": 200.0}, "DTC_FORMAT"), ({"soc_pct": 100.5}, "RANGE"), ({"soc_pct": float("nan")}, "RANGE"), ({"soc_pct": None}, "RANGE"), ({"lat": None, "lon": None, "speed_kmh": None}, None), ({"pack_temp_min_c": 40.0}, "RANGE"), ({"ts_event_ms": 1}, "RANGE"), ({"evt": 9}, "RANGE")]
    t = telemetry([ok | c for c, _ in cases], clash=False)
    got = validate.route(t, validate.chain({"0EA": "oem_a"})).orderBy("log_offset").collect()
    assert [r.reason for r in got] == [w for _, w in cases]


def test_registry_latest_and_as_of(spark):
    reg = spark.createDataFrame([("A", 1, "x"), ("A", 5, "y"), ("B", 2, None), (None, 9, "z")], "vin string, updated_ms long, depot string")
    assert sorted(map(tuple, registry.latest(reg, "vin", ["updated_ms"], F.col("depot").isNull()).collect())) == [("A", 5, "y")]
    ev = spark.createDataFrame([("A", 0), ("A", 1), ("A", 4), ("A", 5), ("C", 5)], "vin string, t long")
    assert [tuple(r) for r in registry.as_of(ev, reg, "vin", "t", "updated_ms", ["depot"], 2).orderBy("vin", "t").collect()] == [("A", 0, None), ("A", 1, "x"), ("A", 4, "x"), ("A", 5, "y"), ("C", 5, None)]


def test_sketches(spark):
    items = spark.createDataFrame([("g", x) for x in "AABACABBBB"], "g string, x string")
    top = registry.heavy_hitters(items, ["g"], "x", 2).orderBy("rank").collect()
    assert [(r.x, r.n) for r in top] == [("B", 5), ("A", 4)]
    assert {(r.x, r.n) for r in registry.heavy_hitters_sketch(items, ["g"], "x", 2).collect()} == {("B", 5), ("A", 4)}


def test_range_lookup_first_listed_wins(spark):
    p = spark.createDataFrame([(i,) for i in (5, 15, 25, 99)], "m int")
    r = spark.createDataFrame([(1, 0, 20, "a"), (0, 10, 30, "b")], "ord int, s int, e int, name string")
    assert sorted((x.m, x.name) for x in registry.range_lookup(p, r, "m", "s", "e", "ord", ["name"], 10).collect()) == [(5, "a"), (15, "b"), (25, "b"), (99, None)]


def test_rollup_zero_floors(telemetry):
    minute = T0 - T0 % 60_000
    m = messages(telemetry([{"ts_event_ms": minute + i, "pack_temp_max_c": -5.0 - i, "speed_kmh": None} for i in range(3)]), *(c for c in ("ts_event_ms", "soc_pct", "speed_kmh", "odo_km", "pack_voltage_v", "pack_current_a", "charge_power_kw", "pack_temp_max_c", "cell_v_min_mv", "cell_v_max_mv", "isolation_kohm")))
    r = rollup.minute_rollup(m).first()
    assert (r.sample_count, r.temp_max_c, r.speed_avg_kmh, r.imbalance_max_mv) == (3, 0.0, 0.0, 20.0)


def test_places_are_sticky_and_slots_cover(spark):
    a = spark.createDataFrame([("s", t, m) for t, ms in enumerate(["ab", "bc", "bc", "c", "", "ab"]) for m in ms] + [("s", 1, "b"), (None, 1, "x")], "site string, slot int, member string")
    got = {(r.slot, r.member): r.place for r in slots.sticky_places(a, 2).collect()}
    assert got == {(0, "a"): 0, (0, "b"): 1, (1, "b"): 1, (1, "c"): 0, (2, "b"): 1, (2, "c"): 0, (3, "c"): 0, (5, "a"): 0, (5, "b"): 1}
    full = slots.sticky_places(a.union(spark.createDataFrame([("s", 2, "a")], a.schema)), 2, strict=False).where("slot = 2").collect()
    assert {r.member: r.place for r in full} == {"a": None, "b": 1, "c": 0}
    with pytest.raises(Exception, match="more than 1 members in slot 0"):
        slots.sticky_places(a, 1).collect()
    r = random.Random(3)
    many = [(s, t, f"m{k}") for s in "xy" for t in range(300) for k in range(6) if r.random() < 0.6]
    placed = slots.sticky_places(spark.createDataFrame(many, a.schema), 6).collect()
    assert len(placed) == len(many) == len({(p.site, p.slot, p.place) for p in placed})
    at = {(p.site, p.member, p.slot): p.place for p in placed}
    assert all(at[s, m, t] == at[s, m, t + 1] for s, m, t in at if (s, m, t + 1) in at)
    iv = spark.createDataFrame([("s", 5, 25, 2.0), ("s", 20, 30, 1.0), ("s", 9, 9, 1.0)], "site string, a long, b long, kw double")
    load = slots.load_per_slot(slots.in_slots(iv, "a", "b", 10), "site", "kw")
    assert {(r.slot_start, r.load_kw, r.active) for r in load.collect()} == {(0, 2.0, 1), (10, 2.0, 1), (20, 3.0, 2)}
    lim = spark.createDataFrame([("s", 2.5, 1)], "site string, cap_kw double, connectors int")
    assert {(r.slot_start, r.violation) for r in slots.over_limits(load, lim, "site").collect()} == {(20, "SITE_CAP"), (20, "CONNECTORS")}


def test_measures_of_predictions(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1), (None, 0.5)], "y int, s double")
    c = features.precision_recall(df, "y", "s")
    assert [(r.score, round(r.precision, 3), r.recall) for r in c.orderBy(F.desc("score")).collect()] == [(0.9, 1.0, 0.5), (0.8, 0.5, 0.5), (0.7, 0.5, 1.0), (0.1, 0.4, 1.0)]
    assert features.operating_point(c).first().threshold == 0.7
    assert features.average_precision(c).first()[0] == pytest.approx(0.75)
    ci = features.bootstrap_interval(spark.range(400).selectExpr("id", "cast(id % 10 as double) as v"), "v", 100, id_col="id").first()
    assert 4.0 < ci.low < 4.5 < ci.high < 5.0
    parts = features.split_by_vehicle(spark.range(1000).selectExpr("concat('v', id % 100) as vin")).groupBy("vin").agg(F.countDistinct("part").alias("n"))
    assert parts.where("n > 1").count() == 0


def test_features_do_not_use_the_future(telemetry):
    day = 86_400_000
    rows = [{"ts_event_ms": 20_000 * day + d * day + i * 3_600_000, "dtc": ["P0A7E"] if d == 5 else []} for d in range(8) for i in range(3)]
    cols = ("ts_event_ms", "pack_temp_max_c", "ambient_c", "cell_v_min_mv", "cell_v_max_mv", "isolation_kohm", "hv_interlock_ok", "aux_12v_v", "soc_pct", "dtc")
    base = features.trailing_features(features.daily_partials(messages(telemetry(rows), *cols))).orderBy("day").collect()
    assert len(base) == 5 and all(r.label == 1 and r.lead_h > 0 for r in base)
    for r in rows[15:]:
        r["pack_temp_max_c"] = 80.0
    again = features.trailing_features(features.daily_partials(messages(telemetry(rows), *cols))).orderBy("day").collect()
    assert [r.td_max for r in again] == [r.td_max for r in base]


def test_slopes_are_least_squares_over_three_days(telemetry):
    day, r = 86_400_000, random.Random(4)
    base = 20_000 * day - 19_800_000
    rows = [{"ts_event_ms": base + d * day + r.randrange(day), "pack_temp_max_c": r.uniform(20, 50), "ambient_c": 20.0, "dtc": []} for d in (0, 1, 3, 4) for _ in range(20)]
    cols = ("ts_event_ms", "pack_temp_max_c", "ambient_c", "cell_v_min_mv", "cell_v_max_mv", "isolation_kohm", "hv_interlock_ok", "aux_12v_v", "soc_pct", "dtc")
    got = features.trailing_features(features.daily_partials(messages(telemetry(rows), *cols))).orderBy("day").collect()
    for d, x in zip((0, 1, 3, 4), got):
        pts = [(q["ts_event_ms"] / 3_600_000, q["pack_temp_max_c"] - 20) for q in rows if base + (d - 2) * day <= q["ts_event_ms"] < base + (d + 1) * day]
        assert x.td_slope_per_h == pytest.approx(np.polyfit([p[0] - pts[0][0] for p in pts], [p[1] for p in pts], 1)[0], rel=1e-4)
    with pytest.raises(ValueError, match="soh_true"):
        features.leakage_check(["vin", "soh_true"], {"vin"})


def test_health_in_batches_is_health_at_once(spark, tmp_path):
    r = random.Random(2)
    obs = [(f"P{k % 3}", f"s{k}", 10**12 + k * 40_000_000, 95 - 0.01 * k + r.uniform(-1, 1), 0.5) for k in range(40)]
    df = spark.createDataFrame(obs, "vin string, session_id string, end_ms long, soh_pct double, variance double")
    store = battery.HealthStore(spark, str(tmp_path / "h"))
    for n, part in enumerate([df.where("end_ms < 1000000600000000 and session_id <= 's2'"), df, df.where("vin = 'P1'")]):
        store.apply(part.where(f"end_ms < {10**12 + (n + 1) * 20 * 40_000_000}"), n)
        store.apply(part, n)
    assert store.estimates().count() == 40 and store.states().count() == 3
    parts = [df.where(f"end_ms < {10**12 + 17 * 40_000_000}"), df]
    store = battery.HealthStore(spark, str(tmp_path / "g"))
    for n, part in enumerate(parts):
        store.apply(part.union(part), n)
    by = lambda rows: {(x.pack, x.n, c): x[c] for x in rows for c in ("soh_pct", "rate_pct_per_day", "p11")}
    assert by(store.estimates().collect()) == pytest.approx(by(battery.kalman(df).collect()))


def test_gate_and_history(spark):
    s = spark.createDataFrame([("A", "t1", -50.0), ("A", "t2", -50.0), ("A", "", -50.0), ("B", "t1", -50.0), ("A", None, 50.0)], "vin string, tenant_id string, delta_ah double")
    s = s.selectExpr("*", "20.0D as soc_start_pct", "70.0D as soc_end_pct", "20.0D as temp_min_c", "30.0D as temp_max_c", "0 as gaps", "50 as samples", "cast(null as double) as v_rest_before")
    reg = spark.createDataFrame([("A", "t1", 38.0, 380.0)], "vin string, tenant_id string, capacity_kwh double, nominal_voltage_v double")
    got = battery.gated(s, reg).collect()
    assert sorted((x.reason or "", x.soh_pct or 0) for x in got) == [("", 100.0), ("", 100.0), ("not_a_charge", 0), ("tenant_mismatch", 0), ("unregistered_vin", 0)]
    e = spark.createDataFrame([("A", "old", 1, 1), ("A", "new", 2, 1), ("A", "new", 3, 2), ("A", "new", 4, 3)], "vin string, pack string, as_of_ms long, n int")
    now = spark.createDataFrame([("A", None)], "vin string, current_pack_id string")
    assert [(x.as_of_ms, x.place) for x in battery.history(e, now, 2).orderBy("place").collect()] == [(3, 1), (4, 2)]
    assert battery.history(e, now.selectExpr("vin", "'old' as current_pack_id")).count() == 1


def test_requests_sketch_and_vehicle_numbers(spark):
    sign = lambda t, b: hmac.new(b"k", f"{t}.{b}".encode(), hashlib.sha256).hexdigest()
    rows = [("id", "1000", sign(1000, "x"), "x", "oem_a", 1_000_000), ("id", "1000", sign(1000, "x"), "y", "oem_a", 1_000_000), ("no", "1000", sign(1000, "x"), "x", "oem_a", 1_000_000), ("id", "1000", sign(1000, "x"), "x", "oem_a", 1_400_000), ("id", "1e3", "", "x", "oem_a", 1), ("id", "1000", sign(1000, "x").upper(), "x", "oem_b", 1_000_000), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key_id string, timestamp string, signature string, body string, oem string, received_ms long")
    assert [x.reason for x in decode.authenticated(df, {"id": ("k", {"oem_a"})}).collect()] == [None, "AUTH", "AUTH", "AUTH", "AUTH", "IDENTITY_MISMATCH", "AUTH"]
    items = spark.createDataFrame([("g", f"c{min(i % 97, i % 13)}") for i in range(3000)] + [("g", None), ("h", "c1")], "g string, code string")
    est = registry.estimates(registry.count_table(items, ["g"], "code", width=16), items.union(spark.createDataFrame([("h", "never")], items.schema)), ["g"], "code", width=16)
    true = {(x.g, x.code): x["count"] for x in items.groupBy("g", "code").count().collect()}
    got = {(x.g, x.code): x.estimate for x in est.collect()}
    assert got["h", "never"] in (0, 1) and all(got[k] >= n for k, n in true.items() if k[1]) and got["h", "c1"] == 1
    v = spark.range(1).select(identity.vin_build(F.lit("0EA"), F.lit("VA52C"), F.lit(2024), F.lit("M"), F.lit(7)).alias("v"), identity.vin_year_code(F.lit(2010)).alias("a"), identity.vin_year_code(F.lit(1979)).alias("b"), identity.vin_build(F.lit("0E"), F.lit("VA52C"), F.lit(2024), F.lit("M"), F.lit(7)).alias("n")).first()
    assert v.v[9] == "R" and v.v.endswith("M000007") and v.a == "A" and v.b == "9" and v.n is None
    assert spark.createDataFrame([(v.v,)], "v string").select(identity.vin_valid(F.col("v"))).first()[0]


def test_what_a_plan_breaks(spark):
    power = [("s", "a", 0, 7.0), ("s", "a", 1, 7.0), ("s", "b", 1, 5.0), ("s", "b", 5, 7.0), ("s", "c", 2, 3.0)]
    task = lambda m, **k: {"site": "s", "member": m, "soc0_pct": 50.0, "usable_kwh": 10.0, "eta": 1.0, "cap_pct": 100.0, "required_pct": 60.0, "plug_slot": 0, "depart_slot": 4, "levels_kw": [0.0, 7.0]} | k
    tasks = [task("a"), task("b"), task("c", soc0_pct=95.0, cap_pct=96.0, levels_kw=[3.0]), task("d", required_pct=50.1)]
    p = spark.createDataFrame(power, "site string, member string, slot int, kw double")
    t = spark.createDataFrame([tuple(x.values()) for x in tasks], "site string, member string, soc0_pct double, usable_kwh double, eta double, cap_pct double, required_pct double, plug_slot int, depart_slot int, levels_kw array<double>")
    lim = spark.createDataFrame([("s", 10.0, 1)], "site string, cap_kw double, connectors int")
    got = sorted(tuple(x) for x in slots.plan_violations(p, t, lim).fillna("", ["member"]).collect())
    want = [("s", "", 1, "CONNECTORS"), ("s", "", 1, "SITE_CAP"), ("s", "b", 1, "LEVEL"), ("s", "b", 5, "OUTSIDE_WINDOW"), ("s", "c", 2, "SOC_RANGE"), ("s", "d", 4, "DEPARTURE")]
    assert got == want
    assert slots.plan_violations(p.limit(0), t.limit(0)).count() == 0


def test_stays_follow_duty(spark):
    start = 1_781_060_000_000
    now = (start + 19_800_000) // 60_000 % 1440
    v = [("in", (now + 100) % 1440, (now + 500) % 1440, True), ("out", (now + 700) % 1440, (now + 61) % 1440, False), (None, None, None, True)]
    df = spark.createDataFrame(v, "vin string, depart_min_ist int, return_min_ist int, at_depot boolean")
    got = sorted(map(tuple, slots.stays(df, start).collect()))
    assert got == [("in", 0, 6, True), ("in", 34, 102, True), ("out", 5, 46, True)]
