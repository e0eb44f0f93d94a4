"""Charge and drive sessions of vehicles as islands in the order of their messages.

Whether a session is open after a message is a running state, worked out so that no vehicle has to fit into one task:

* A message opens, closes or switches a charge session, whatever came before. So the state after it is what the last
  opening or closing message set, switched as often as there were switching ones since: a running count, carried over
  blocks of time.
* A drive session also ends after a quarter of an hour without movement, which depends on when it began. But a moving
  message leaves it open and an ignition-off at standstill leaves it closed, whatever came before. From one such message
  to the next is a stretch; stretches are worked each by itself, streamed in order, anywhere in the cluster.

What a session adds up (charge, energy, gaps, extremes) is an aggregation over its messages with map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperelake.common import cut
from amperelake.operators import windows
from amperelake.operators.prefix import blocked_running

# Event and charge-state codes, and limits of the sessions.
IGN_ON, IGN_OFF, PLUG_IN, PLUG_OUT, IDLE, DC = 2, 3, 4, 5, 1, 3
MAX_GAP_MS, IDLE_END_MS, REST_MIN_MS, REST_A = 300_000, 900_000, 1_800_000, 1.0
CHARGE, DRIVE, START, END = 1, 2, 1, 2
NEEDED = ("pack_voltage_v", "pack_current_a", "soc_pct", "odo_km", "charge_state")
#: Columns of messages that sessions read besides vin, log_offset and `cap_ah` (nominal Ah or null).
INPUT = ("ts_event_ms", "evt", "speed_kmh", "pack_temp_min_c", "pack_temp_max_c", *NEEDED)


def _stretch_states(batches: Iterator) -> Iterator:
    """Adds `driving` (open after the message) to rows sorted by stretch and order; a stretch begins with the message
    that sets the state (`sets` 1 or 0; null in what comes before the first of them, where no session is open)."""
    import numpy as np
    import pyarrow as pa

    unit, is_open, moved = None, False, 0
    for b in batches:
        vin, stretch, ts, evt, sets, moving = (b.column(c).to_pylist() for c in ("vin", "stretch", "ts_event_ms", "evt", "sets", "moving"))
        out = np.zeros(b.num_rows, bool)
        for i, s in enumerate(sets):
            if (vin[i], stretch[i]) != unit:
                unit, is_open, moved = (vin[i], stretch[i]), False, 0
            t = ts[i]
            if s is not None:
                is_open, moved = s == 1, t
            elif is_open:
                moved = t if moving[i] else moved
                is_open = not (evt[i] == IGN_OFF or t - moved >= IDLE_END_MS)
            elif moving[i] or evt[i] == IGN_ON:
                is_open, moved = True, t
            out[i] = is_open
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "driving"])


def states(messages: DataFrame) -> DataFrame:
    """Messages in order with `charging`/`driving` (open after the message) and `was_charging`/`was_driving` (before it),
    the step from the message before (`step_ah`, `step_kwh`, `gap`) and `rest_v`: the voltage of the message before if
    the pack had been at rest for half an hour then."""
    d = lambda c: F.col(c).cast("double").alias(c)
    m = windows.monotonic(messages.where("vin is not null and ts_event_ms is not null and log_offset is not null").dropna(subset=list(NEEDED)))
    m = m.select("vin", "log_offset", "ts_event_ms", "evt", "charge_state", *(d(c) for c in (*NEEDED[:-1], "speed_kmh", "pack_temp_min_c", "pack_temp_max_c", "cap_ah")))
    m = cut(m)  # each carry over blocks reads its input twice
    amp, off = F.col("pack_current_a"), F.coalesce(F.col("evt") == IGN_OFF, F.lit(False))
    into = (F.col("charge_state") != IDLE) & (amp < 0)
    plug = lambda e: F.coalesce(F.col("evt") == e, F.lit(False))
    switch = F.when(into, plug(PLUG_OUT)).otherwise(plug(PLUG_IN) & (amp < 0))
    moving = F.coalesce(F.col("speed_kmh") > 0, F.lit(False))
    m = m.withColumns({"moving": moving, "switch": switch.cast("int"), "sets_charge": F.when(~switch, into.cast("int")), "sets": F.when(moving & ~off, 1).when(~moving & off, 0)})
    m = windows.with_block(m).withColumns({"_here": F.struct("ts_event_ms", "log_offset", "pack_voltage_v", "pack_current_a"), "_set": F.col("sets").isNotNull().cast("int")})
    m = blocked_running(m, "vin", "_block", ["ts_event_ms", "log_offset"], {"switches": "switch", "stretch": "_set"}, {"_prev": "_here"}).drop("_here", "_set")
    prev = lambda c: F.col(f"_prev.{c}")
    resting = F.abs("pack_current_a") < REST_A
    was_resting = F.coalesce(F.abs(prev("pack_current_a")) < REST_A, F.lit(False))
    m = m.withColumns({
        "_last": F.when(F.col("sets_charge").isNotNull(), F.struct("ts_event_ms", "log_offset", F.col("sets_charge").alias("v"), F.col("switches").alias("n"))),
        "_rest": F.when(resting & ~was_resting, F.struct("ts_event_ms", "log_offset")),
    })
    m = blocked_running(m, "vin", "_block", ["ts_event_ms", "log_offset"], {}, {"_set": "_last", "_rested": "_rest"})
    before = F.pmod(F.coalesce(F.col("_set.v") - F.col("_set.n"), F.lit(0)) + F.col("switches") - F.col("switch"), F.lit(2)) == 1
    dt = F.col("ts_event_ms") - prev("ts_event_ms")
    ok, hours = (dt > 0) & (dt <= MAX_GAP_MS), dt / 3_600_000
    m = m.withColumns({
        "was_charging": before,
        "charging": F.when(F.col("sets_charge").isNotNull(), F.col("sets_charge") == 1).otherwise(~before),
        "step_ah": F.when(ok, (prev("pack_current_a") + amp) / 2 * hours),
        "step_kwh": F.when(ok, (prev("pack_voltage_v") * prev("pack_current_a") + F.col("pack_voltage_v") * amp) / 2 * hours / 1000),
        "gap": (F.coalesce(dt, F.lit(0)) > MAX_GAP_MS).cast("int"),
        "rest_v": F.when(was_resting & (F.col("ts_event_ms") - F.col("_rested.ts_event_ms") >= REST_MIN_MS), prev("pack_voltage_v")),
    }).drop("_block", "_prev", "_last", "_rest", "_set", "_rested", "sets_charge", "switch", "switches")
    schema = ", ".join(f"{c} {t}" for c, t in m.dtypes) + ", driving boolean"
    m = m.repartition("vin", "stretch").sortWithinPartitions("vin", "stretch", "ts_event_ms", "log_offset").mapInArrow(_stretch_states, schema)
    m = cut(m.drop("moving", "sets", "stretch"))
    m = windows.previous(m, ["driving"], tie="log_offset").withColumn("was_driving", F.coalesce("prev_driving", F.lit(False)))
    return m.drop("prev_driving")


def vehicle_sessions(messages: DataFrame) -> DataFrame:
    """START and END rows of charge (kind 1) and drive (kind 2) sessions, from messages (one row per message) with `cap_ah`.

    Charge: from charging with current into the pack to plug-out or its end; drive: from ignition or movement to ignition
    off or fifteen minutes without movement; no message both begins and ends one session. Charge and energy are
    integrated over steps up to five minutes, longer ones are gaps; temperatures are null on START rows without them and
    0 on END rows. Messages older than one that arrived before take no part, nor do those without vin, clock, place in the
    log, voltage, current, charge level, odometer or charge state; an empty input gives no row.
    """
    m = states(messages)
    flag = lambda now, was: (F.col(now) & ~F.col(was)).cast("int")
    m = windows.running(m, {"n_charge": flag("charging", "was_charging"), "n_drive": flag("driving", "was_driving")}, tie="log_offset")
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(n).alias("number"), F.col(now).alias("now"), F.col(was).alias("was")) for k, n, now, was in ((CHARGE, "n_charge", "charging", "was_charging"), (DRIVE, "n_drive", "driving", "was_driving"))]
    m = m.withColumn("s", F.explode(F.filter(F.array(*kinds), lambda s: s["now"] | s["was"])))
    first = F.col("s.now") & ~F.col("s.was")
    both = F.col("pack_temp_min_c").isNotNull() & F.col("pack_temp_max_c").isNotNull()
    rate = F.coalesce(F.when(F.col("cap_ah") != 0, F.abs("pack_current_a") / F.col("cap_ah")), F.lit(0.0))
    at_start = F.struct("ts_event_ms", "soc_pct", "odo_km", "rest_v", F.when(both, F.col("pack_temp_min_c")).alias("tmin"), F.when(both, F.col("pack_temp_max_c")).alias("tmax"), rate.alias("rate"), (F.col("charge_state") == DC).alias("dc"))
    at_end = F.struct("ts_event_ms", "soc_pct", "odo_km")
    g = m.groupBy("vin", F.col("s.kind").alias("kind"), F.col("s.number").alias("number")).agg(
        F.max(F.when(first, at_start)).alias("a"), F.max(F.when(~F.col("s.now"), at_end)).alias("z"),
        F.coalesce(F.sum(F.when(~first, F.col("step_ah"))), F.lit(0.0)).alias("ah"), F.coalesce(F.sum(F.when(~first, F.col("step_kwh"))), F.lit(0.0)).alias("kwh"),
        F.coalesce(F.sum(F.when(~first, F.col("gap"))), F.lit(0)).cast("int").alias("gaps"), F.count(F.lit(1)).cast("int").alias("samples"),
        F.min(F.when(both, F.col("pack_temp_min_c"))).alias("tmin"), F.max(F.when(both, F.col("pack_temp_max_c"))).alias("tmax"), F.max(rate).alias("rate"),
    )
    null, zero = F.lit(None), F.lit(0.0)
    kind = F.when(F.col("kind") == DRIVE, "").when(F.col("a.dc"), "DC_FAST").otherwise("AC")

    def row(phase, end, soc_end, ah, kwh, tmin, tmax, rate, km, gaps, samples):
        return F.struct(F.lit(phase).alias("phase"), F.col("a.ts_event_ms").alias("start_ms"), end.cast("long").alias("end_ms"), F.col("a.soc_pct").alias("soc_start_pct"), soc_end.cast("double").alias("soc_end_pct"), ah.alias("delta_ah"), kwh.alias("delta_kwh"), F.col("a.rest_v").alias("v_rest_before"), tmin.alias("temp_min_c"), tmax.alias("temp_max_c"), rate.alias("max_c_rate"), kind.alias("charger_type"), km.alias("distance_km"), gaps.alias("gaps"), samples.alias("samples"))

    start = row(START, null, null, zero, zero, F.col("a.tmin"), F.col("a.tmax"), F.col("a.rate"), zero, F.lit(0), F.lit(1))
    km = F.greatest(zero, F.col("z.odo_km") - F.col("a.odo_km"))
    end = row(END, F.col("z.ts_event_ms"), F.col("z.soc_pct"), F.col("ah"), F.col("kwh"), F.coalesce("tmin", zero), F.coalesce("tmax", zero), F.col("rate"), km, F.col("gaps"), F.col("samples"))
    rows = F.when(F.col("z").isNotNull(), F.array(start, end)).otherwise(F.array(start))
    return g.select("vin", "kind", F.explode(rows).alias("r")).select("vin", "kind", "r.*")
