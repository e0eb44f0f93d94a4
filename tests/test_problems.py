"""The p operators on small fixtures: brute force, defined results for odd input, invariants."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from amperelake.common import messages
from amperelake.operators import late, rolling, seen, sessions, spikes, units
from amperelake.operators.fingertree import FingerTree
from amperelake.sources.versions import Behind

T0 = 1_780_000_000_000


def brute_sessions(events, gap, pause):
    out = []
    for vin in {v for v, _ in events}:
        ts = sorted(t for v, t in events if v == vin)
        start, n, pauses = ts[0], 1, 0
        for a, b in zip(ts, ts[1:]):
            if b - a > gap:
                out.append((vin, start, a, a - start, n, pauses))
                start, n, pauses = b, 0, 0
            elif b - a > pause:
                pauses += 1
            n += 1
        out.append((vin, start, ts[-1], ts[-1] - start, n, pauses))
    return sorted(out)


def test_sessions_against_brute_force_over_block_borders(spark):
    r = random.Random(3)
    events = [(v, T0 + r.choice([0, 300, 301, 900, 901, 2000]) * 1000 * r.randint(0, 60)) for v in "ABC" for _ in range(120)]
    events += events[:20]
    df = spark.createDataFrame(events, "vin string, ts_event_ms long")
    got = sorted(map(tuple, sessions.sweep_sessions(df, block_ms=1_800_000).collect()))
    assert got == brute_sessions(events, 900_000, 300_000)


def test_session_edges(spark, telemetry, odd_rows):
    df = spark.createDataFrame([("A", T0), ("A", T0 + 900_000), ("A", T0 + 1_800_001), (None, T0), ("B", None)], "vin string, ts_event_ms long")
    assert sorted(map(tuple, sessions.sweep_sessions(df).collect())) == [("A", T0, T0 + 900_000, 900_000, 2, 1), ("A", T0 + 1_800_001, T0 + 1_800_001, 0, 1, 0)]
    assert sessions.sweep_sessions(df.limit(0)).count() == 0
    assert sessions.sweep_sessions(messages(telemetry(odd_rows), "ts_event_ms")).count() > 0


def test_messages_keep_the_first_arrival_and_rows_without_number(telemetry, odd_rows):
    m = messages(telemetry(odd_rows), "ts_event_ms")
    rows = m.collect()
    assert len([r for r in rows if r.seq is None]) == 2
    assert [r.log_offset for r in rows if r.seq == 0] == [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 9), st.booleans()), max_size=250))
def test_finger_tree_is_a_sorted_map_of_sums(ops):
    tree, plain, floor = FingerTree(lambda a, b: a + b, width=4), {}, 0
    for key, value, evict in ops:
        if evict:
            floor = max(floor, key // 2)
            gone = tree.evict(floor)
            assert gone == sorted((k, v) for k, v in plain.items() if k < floor)
            plain = {k: v for k, v in plain.items() if k >= floor}
        elif key >= floor:
            plain[key] = plain.get(key, 0) + value
            assert tree.insert(key, value) == plain[key]
        assert list(tree.items()) == sorted(plain.items())
        assert tree.total() == (sum(plain.values()) or None)
        assert (tree.range(50, 200) or 0) == sum(v for k, v in plain.items() if 50 <= k < 200)
        assert tree.first() == min(plain, default=None)


def test_late_minutes(spark, telemetry, odd_rows):
    minute = T0 - T0 % 60_000
    end = minute + 60_000
    lags = [30_000, 30_001, 7_200_000, 7_200_001]
    m = messages(telemetry([{"ts_event_ms": minute + 5, "ts_ingest_ms": end + x, "soc_pct": 50.0 + i} for i, x in enumerate(lags)]), "ts_event_ms", "ts_ingest_ms", *late.INPUT)
    row = late.late_minutes(m).collect()
    assert [(r.on_time, r.correcting, r.lost, r.sample_count, r.soc_max_pct, r.last_corrected_ms) for r in row] == [(1, 2, 1, 3, 52.0, end + 7_200_000)]
    assert sorted(r.outcome for r in late.outcomes(late.late_minutes(m)).collect()) == ["corrected", "lost"]
    odd = messages(telemetry(odd_rows), "ts_event_ms", "ts_ingest_ms", *late.INPUT)
    assert late.late_minutes(odd).count() > 0 and late.late_minutes(odd.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 65_535), min_size=1, max_size=300), st.integers(0, 60_000), st.integers(0, 5_000))
def test_bitmaps_keep_their_bits_in_every_form(places, start, run):
    bits = np.zeros(65_536, bool)
    bits[sorted(places)] = True
    bits[start : start + run] = True
    data = seen.packed(np.flatnonzero(bits))
    assert (seen.unpacked(data) == bits).all() and len(data) <= 8_193
    assert seen.packed(np.flatnonzero(np.arange(65_536) % 2))[:1] == b"b" and len(seen.packed(np.arange(65_536))) == 5


def arrivals(r):
    rows = [(r.choice("ABC"), r.choice([0, 1, 65_535, 65_536, 170_000, -5, r.randint(0, 99)]), i) for i in range(600)]
    rows += [("A", 7, 1000 + i) for i in range(300)] + [("B", None, 5000), ("B", None, 5001), (None, 3, 6000), (None, 3, 6001)]
    first = {}
    for v, s, o in rows:
        k = (v, s if s is not None else ("own", o))
        first[k] = min(o, first.get(k, o))
    return rows, set(first.values())


def test_minutes_are_corrected_by_later_batches(spark, telemetry, tmp_path):
    r = random.Random(8)
    minute = T0 - T0 % 60_000
    rows = [{"vin": r.choice("AB"), "seq": i, "ts_event_ms": (t := minute + r.randint(0, 3_600_000)), "ts_ingest_ms": t + r.choice([1000, 100_000, 3_000_000, 7_300_000]), "soc_pct": float(r.randint(10, 90)), "pack_temp_max_c": r.choice([None, 30.0])} for i in range(400)]
    m = messages(telemetry(rows), "ts_event_ms", "ts_ingest_ms", *late.INPUT).cache()
    rounded = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in df.collect())
    whole = rounded(late.late_minutes(m))
    assert any(x[3] for x in whole) and any(x[4] for x in whole)
    for name, parts in (("in order", [m.where("ts_ingest_ms % 3 = 0"), m.where("ts_ingest_ms % 3 = 1"), m.where("ts_ingest_ms % 3 = 2")]), ("by clock", [m.where(f"seq % 400 < {k}").where(f"seq % 400 >= {k - 200}") for k in (400, 200)])):
        store, seen_minutes = late.MinuteStore(spark, str(tmp_path / name), block_ms=600_000), []
        for k, part in enumerate(parts):
            seen_minutes += [(x.vin, x.minute_start_ms) for x in store.apply(part, k).collect()]
        assert rounded(store.minutes()) == whole
        assert len(seen_minutes) > len(set(seen_minutes))  # some were published, then corrected
        again = late.MinuteStore(spark, str(tmp_path / name), block_ms=600_000)
        assert again.apply(parts[-1], len(parts) - 1).count() > 0 and rounded(again.minutes()) == whole
    n, version = again.latest()
    one = m.where("vin = 'A'").limit(1)
    again.apply(one.withColumn("seq", F.lit(5000).cast("long")), 77)
    assert sum(version["groups"][b] != f for b, f in again.latest()[1]["groups"].items()) == 1  # only its block is written
    assert late.MinuteStore(spark, str(tmp_path / "none")).apply(m.limit(0), 0).count() == 0


def test_seen_bitmaps_over_batches(spark, tmp_path):
    rows, kept = arrivals(random.Random(5))
    df = spark.createDataFrame(rows, "vin string, seq long, log_offset long").selectExpr("*", "1 as kind", "'x' as bits", "2 as high", "3 as low", "4 as vin_id", "5 as first")
    got = seen.select_arrivals(df.repartition(5), seen.new_ids(df))
    assert sorted(x[0] for x in got.surplus.collect()) == sorted(o for *_, o in rows if o not in kept)
    assert {x[0] for x in got.kept.collect()} == kept
    total, surplus = set(), []
    for a in seen.replayed(df, str(tmp_path / "all"), 4):
        new = {x[0] for x in a.kept.collect()}
        assert not new & total
        total |= new
        surplus += [x[0] for x in a.surplus.collect()]
    assert total == kept and sorted(surplus) == sorted(o for *_, o in rows if o not in kept)
    assert sum(a.kept.count() + a.surplus.count() for a in seen.replayed(df.limit(0), str(tmp_path / "none"), 2)) == 0


def test_seen_store_survives_replays_crashes_and_a_second_writer(spark, tmp_path):
    rows, kept = arrivals(random.Random(6))
    df = spark.createDataFrame(rows, "vin string, seq long, log_offset long").cache()
    part = lambda lo, hi: df.where(f"log_offset >= {lo} and log_offset < {hi}")
    ids = lambda a: sorted(x[0] for x in a.kept.collect())
    path = str(tmp_path / "seen")
    first = ids(seen.SeenStore(spark, path).apply(part(0, 200), 10))
    assert ids(seen.SeenStore(spark, path).apply(part(0, 200), 10)) == first  # the caller lost its result and asks again
    (tmp_path / "seen" / "applied" / "10").unlink()  # the writer went away right after it had published
    assert ids(seen.SeenStore(spark, path).apply(part(0, 200), 10)) == first

    class Stale(seen.SeenStore):
        def latest(self):
            return 0, None

    other = Stale(spark, path)
    with pytest.raises(Behind):
        other.apply(part(200, 400), 11)
    second = ids(seen.SeenStore(spark, path).apply(part(200, 400), 11))
    third = ids(seen.SeenStore(spark, path).apply(part(400, 9000), 3))  # a lower id that was not applied
    assert {*first, *second, *third} == kept and len(first) + len(second) + len(third) == len(kept)
    again = seen.SeenStore(spark, path)
    assert ids(again.apply(part(400, 9000), 3)) == third and ids(again.apply(part(0, 200), 10)) == first
    n, m = again.latest()
    assert n == 3 and again.apply(part(0, 9000), 12).kept.where("log_offset <> 5000 and log_offset <> 5001").count() == 0
    untouched = again.apply(spark.createDataFrame([("D", 1, 7000)], df.schema), 13)
    assert ids(untouched) == [7000]
    moved = again.latest()[1]["groups"]
    assert sum(m["groups"].get(g) != f for g, f in moved.items()) == 1  # only the group that grew was written


def test_dictionary_is_exact_and_grows(spark):
    a = spark.createDataFrame([(f"v{i}",) for i in range(500)] + [(None,)], "vin string")
    b = spark.createDataFrame([(f"v{i}",) for i in range(400, 900)], "vin string")
    one = seen.new_ids(a, shards=8)
    two = {r.vin: r.vin_id for r in one.unionByName(seen.new_ids(b, one, shards=8)).collect()}
    assert len(two) == 901 and len(set(two.values())) == 901 and min(two.values()) >= 0


ROLLUP = "vin string, minute_start_ms long, emitted_ms long, sample_count int, energy_kwh double, distance_km double, isolation_min_kohm double"


def test_trailing_totals(spark):
    day = 86_400_000
    base = 20_000 * day - 19_800_000
    rows = [("A", base + d * day + m * 60_000, 5, 1, 0.1 * (d + 1), 1.0, 1.0) for d in (0, 1, 9, 40) for m in (0, 1439)]
    rows += [("A", base + 9 * day, 9, 1, 7.0, 2.0, 1.0), ("A", base + 50 * day, 4, 3, 9.0, 9.0, 9.0), ("A", base + 50 * day, 5, 0, None, None, None), ("A", base, 5, 1, 0.1, 1.0, 1.0), (None, base, 1, 1, 1.0, 1.0, 1.0)]
    cur = rolling.current_minutes(spark.createDataFrame(rows, ROLLUP), "energy_kwh", "distance_km")
    out = {(r.day_ist, r.span_days): r for r in rolling.trailing_totals(cur).collect()}
    per = {0: 0.2, 1: 0.4, 9: 7.0 + 1.0, 40: 2 * 4.1}
    assert len(out) == 41 * 2
    days = sorted({d for d, _ in out})
    for i, name in enumerate(days):
        for span in (7, 30):
            want = sum(v for d, v in per.items() if i - span < d <= i)
            assert out[name, span].total_energy_kwh == pytest.approx(want, abs=1e-9)
            assert (out[name, span].minutes == 0) == (want == 0)
    assert rolling.trailing_totals(cur.limit(0)).count() == 0


def test_spikes_stuck_and_bounds_are_found_and_level_changes_are_not():
    r = np.random.default_rng(1)
    n = 1200
    soc = np.linspace(90, 20, n)
    amp = r.normal(40, 20, n)
    volt = 330 + 0.5 * soc - 0.03 * amp + r.normal(0, 0.5, n)
    volt[700:] += 8  # another pack
    bad_v, bad_a = {50, 51, 300, 640}, {120, 900}
    for i in bad_v:
        volt[i] += 60
    volt[420:430] = volt[420]
    volt[1000] = 0.0
    for i in bad_a:
        amp[i] += 500
    v, a = spikes.wrong_pack(volt, amp, soc, np.zeros(n), np.ones(n), np.full(n, 30.0), np.arange(n) * 10_000)
    assert set(np.flatnonzero(v)) == bad_v | set(range(420, 430)) | {1000}
    assert set(np.flatnonzero(a)) == bad_a


def test_the_ellipsoids_decide(monkeypatch):
    r = np.random.default_rng(3)
    x = 50 + r.normal(0, 1, 800)
    x[400:] += 30  # a lasting change of level
    spikes_at = [60, 61, 300, 390, 620]
    x[spikes_at] += 25
    flags = lambda: set(np.flatnonzero(spikes.wrong(x, np.zeros(800, int), np.zeros(800, bool), {0: 0.5})))
    assert flags() == set(spikes_at)
    monkeypatch.setattr(spikes, "phase_space", lambda u, d1, d2: np.zeros(len(u)))
    assert flags() == set()
    monkeypatch.setattr(spikes, "phase_space", lambda u, d1, d2: np.full(len(u), 2.0))
    assert len(flags()) > 100
    monkeypatch.undo()
    # a difference counts beside the value: at 4 deviations on one axis alone inside, on two outside
    u = np.zeros(600)
    u[5], d = 4.6, np.zeros(600)
    assert spikes.phase_space(u, d, d)[5] < 1 < spikes.phase_space(u, u, d)[5]


def test_surroundings_keep_to_their_state():
    r = np.random.default_rng(4)
    x, ok, state = r.normal(size=200), r.random(200) < 0.8, r.integers(0, 4, 200)
    state[:2] = 9
    left, right, p1, n1, p2, n2 = spikes.around(x, ok, state)
    for i in range(200):
        before = [x[j] for j in range(i) if ok[j] and state[j] == state[i]]
        after = [x[j] for j in range(i + 1, 200) if ok[j] and state[j] == state[i]]
        want = [float(np.median(s)) if len(s) >= 3 else None for s in (before[-6:], after[:6])]
        want = [w if w is not None else o for w, o in zip(want, want[::-1])]
        assert [left[i], right[i]] == pytest.approx([float("nan") if w is None else w for w in want], nan_ok=True)
        if before and after:
            assert p1[i] == before[-1] and n1[i] == after[0] and p2[i] == before[-2 if len(before) > 1 else -1]


def test_blocks_are_of_one_size(spark):
    df = spark.createDataFrame([("A", i * 60_000) for i in range(101)] + [("B", 5)], "vin string, t long")
    rows = spikes.in_blocks(df, "t", 3_000_000, 100, 5).collect()
    own = [r.rank // r.size for r in rows if r.vin == "A" and r.rank // r.size == r.b]
    assert sorted(own) == [0] * 51 + [1] * 50 and len(rows) == 101 + 10 + 1


def test_stuck_runs_are_seen_over_block_borders(spark):
    r = np.random.default_rng(2)
    x = 2500 * np.exp(r.normal(0, 0.04, 400))
    x[95:105] = x[95]
    x[300] = 700.0
    rows = [("A", int(T0 - T0 % 60_000 + i * 60_000), float(v)) for i, v in enumerate(x)] + [("A", None, 1.0), (None, 5, 2.0), ("B", 60_000, None)]
    df = spark.createDataFrame(rows, "vin string, minute_start_ms long, isolation_min_kohm double")
    got = {(z.ref_no - (T0 - T0 % 60_000)) // 60_000 for z in spikes.wrong_rollup(df, block=100, halo=20).collect()}
    assert got == set(range(95, 105)) | {300}


def test_wrong_telemetry_survives_odd_rows(telemetry, odd_rows):
    cols = ("soc_pct", "speed_kmh", "pack_voltage_v", "pack_current_a", "charge_state", "charge_power_kw", "ts_event_ms")
    m = messages(telemetry(odd_rows + [{"seq": 5000, "log_offset": 9000, "pack_voltage_v": 1000.0}]), *cols)
    got = {(r.field_name, r.ref_no) for r in spikes.wrong_telemetry(m).collect()}
    assert ("pack_voltage_v", 5000) in got
    assert spikes.wrong_telemetry(m.limit(0)).count() == 0


RAW = "raw_id long, oem string, topic_vin string, fw_version string, received_ms long, body string"


def body_b(vin, at, temp, odo, speed, soc):
    return f'[{{"vehicleId":"{vin}","epoch":{at},"odometerMiles":{odo},"location":{{"speedMph":{speed}}},"battery":{{"soc":{soc},"tempMaxF":{temp}}}}}]'


def test_units_from_mixture_text_and_neighbours(spark):
    r = random.Random(4)
    rows, want, i = [], {}, 0
    for k in range(400):
        rows.append((i, "oem_a", "R", "a", 1, f'{{"pack":{{"temp_max_c":{r.uniform(24, 45):.1f}}},"odo_km":{1000 + k},"pos":{{"speed_kmh":{r.uniform(5, 80):.1f}}},"soc_pct":{r.uniform(10, 95):.1f}}}'))
        i += 1
    for fw, vin, (ft, fo, fs, fq), unit in (
        ("imp", "B1", (lambda c: c * 1.8 + 32, lambda k: k / 1.609344, lambda s: s / 1.609344, lambda q: q / 100), ("F", "mi", "mph", "ratio")),
        ("si", "B2", (lambda c: c + 273.15, lambda k: k * 1000, lambda s: s / 3.6, lambda q: q * 10), ("K", "m", "m/s", "permille")),
    ):
        for k in range(300):
            c, km, s, q = r.uniform(24, 45), 20_000 + k, r.uniform(5, 80), r.uniform(10, 95)
            rows.append((i, "oem_b", vin, None if k % 20 == 7 else fw, 1, body_b(vin, 1000 + k, round(ft(c), 2), round(fo(km), 2), round(fs(s), 3), round(fq(q), 4))))
            want[i] = (unit, c, km, s, q)
            i += 1
    text = i
    rows += [
        (text, "oem_b", "B1", "imp", 1, body_b("B1", 1500, '"31.5 ℃"', '"1,20,000 Metres"', '"36 km/h"', '"0.5"')),
        (text + 1, "oem_b", "B1", "imp", 1, '[{"vehicleId":"B1","battery":{"soc":0.5'),
        (text + 2, "oem_b", "B1", "imp", 1, None),
        (text + 3, "oem_b", None, None, None, '[{"battery":{"soc":null,"tempMaxF":"n/a"}}]'),
        (text + 4, "oem_b", "B1", "imp", 1, body_b("B1", 1501, 80, 100, 0, 0)),
    ]
    tel = spark.createDataFrame([("B1", 20_000.0), ("B2", 20_000.0), ("R", 1000.0), (None, 5.0)], "vin string, odo_km double")
    got = {(x.raw_id, x.field_name): x for x in units.common_units(spark.createDataFrame(rows, RAW), tel).collect()}
    for k, (u, c, km, s, q) in want.items():
        for f, unit, value in zip(("tempMaxF", "odometerMiles", "speedMph", "soc"), u, (c, km, s, q)):
            assert got[k, f].unit == unit and got[k, f].value == pytest.approx(value, rel=0.01)
    assert [(got[text, f].unit, round(got[text, f].value, 2)) for f in units.QUANTITIES] == [("C", 31.5), ("m", 120.0), ("km/h", 36.0), ("ratio", 50.0)]
    assert not any((text + j, f) in got for j in (1, 2, 3) for f in units.QUANTITIES)
    assert got[text + 4, "speedMph"].unit == "mph"
    two = [(9001, "oem_b", "B1", "imp", 1, "[" + body_b("B1", 1600, '"20 C"', 1, 2, 0.5)[1:-1] + "," + body_b("B1", 1601, '"30 C"', 1, 2, 0.5)[1:-1] + "]"), (9002, "oem_b", "B1", None, 1, body_b("B1", 1, '"7 C"', 1, 2, 3)[1:-1]), (9003, "oem_b", "B1", "imp", 1, "[]")]
    got = units.common_units(spark.createDataFrame(two, RAW).selectExpr("*", "1 as at", "2 as record_no", "3 as n", "4 as likely")).where("field_name = 'tempMaxF'").collect()
    assert sorted((x.raw_id, x.record_no, x.value) for x in got) == [(9001, 0, 20.0), (9001, 1, 30.0), (9002, 0, 7.0)]
    assert units.common_units(spark.createDataFrame([], RAW)).count() == 0
