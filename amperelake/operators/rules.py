"""The alert rules: what each judges of a message, and the transitions of their sustained conditions.

A vehicle's messages are judged in the order they arrived, and only those not older than one before (late ones are in the
minutes but never drive a rule). Each rule gives samples (on, off, or none where it does not judge a message);
`windows.held` makes transitions of them. Everything a rule needs of other messages is carried over blocks of time, so a
hot vehicle is spread; the one exception is the baseline of THERMAL_DELTA_ANOMALY, whose state depends on its own past
verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperelake.common import cut, maybe_broadcast
from amperelake.functions import identity, measures
from amperelake.operators import folds, registry, windows

#: Fixed value: the namespace of alert ids.
NAMESPACE = "6f1c2d8a4b3e4f519a770c5e21d3884b"
# Rules that judge one number of a message against a limit: severity, condition, seconds to hold, seconds to clear.
LEVELS = (
    ("THERMAL_OVERTEMP", "warning", "temp >= 48", 30, 300),
    ("THERMAL_OVERTEMP", "critical", "temp >= 55", 30, 300),
    ("THERMAL_RISE_RATE", "critical", "rise_c_per_min >= 2.0D", 0, 300),
    ("CELL_IMBALANCE", "warning", "imbalance >= 50", 300, 600),
    ("CELL_IMBALANCE", "critical", "imbalance >= 100", 300, 600),
    ("ISOLATION_LOW", "warning", "ohm_per_volt < 500", 10, 300),
    ("ISOLATION_LOW", "critical", "ohm_per_volt < 100", 10, 300),
    ("HV_INTERLOCK_OPEN", "critical", "opens >= 2", 0, 600),
    ("AUX_12V_LOW", "warning", "parked_aux < 11.8D", 600, 600),
    ("CHARGE_NEEDED", "info", "active AND soc < 15 + need_pct", 60, 600),
)
DELTA, DTC, STALE = ("THERMAL_DELTA_ANOMALY", "warning", 600, 1800), ("DTC_RAISED", 0, 60), ("TELEMETRY_STALE", "warning", 600)
NAMES = tuple(dict.fromkeys([r[0] for r in LEVELS] + [DELTA[0], DTC[0], STALE[0]]))
RISE_MS, RISE_SPAN_MS, OPENS_MS = 60_000, 30_000, 300_000
#: Columns of messages that the rules read besides vin, seq and log_offset.
INPUT = ("ts_event_ms", "ts_ingest_ms", "evt", "lat", "lon", "speed_kmh", "soc_pct", "pack_voltage_v", "pack_temp_max_c", "ambient_c", "cell_v_min_mv", "cell_v_max_mv", "isolation_kohm", "hv_interlock_ok", "aux_12v_v", "charge_power_kw", "dtc")
SITE = ("depot_lat", "depot_lon", "capacity_kwh", "wh_per_km")
SAMPLES = ("vin", "rule", "severity", "detail", "ts_event_ms", "log_offset", "on", "hold_ms", "clear_ms")


def judged(messages: DataFrame, reg: DataFrame, rules: tuple[str, ...] = NAMES) -> DataFrame:
    """Messages in time order with the numbers that LEVELS compares (only those that `rules` need are worked out).

    `active`: ignition on, charging or moving. A number is null where its rule does not judge the message: no sensor
    group, too short a span, not parked, no place, no known vehicle.
    """
    d = lambda c: F.col(c).cast("double")
    m = messages.withColumns({"temp": d("pack_temp_max_c"), "soc": d("soc_pct"), "imbalance": d("cell_v_max_mv") - d("cell_v_min_mv"), "ohm_per_volt": measures.ohm_per_volt(d("isolation_kohm"), d("pack_voltage_v"))})
    if {"HV_INTERLOCK_OPEN", "AUX_12V_LOW", "CHARGE_NEEDED"} & set(rules):
        m = windows.carried(m, F.when(F.col("evt") == 2, True).when(F.col("evt") == 3, False), "ignition", tie="log_offset")
        m = m.withColumn("active", F.coalesce("ignition", F.lit(False)) | (F.coalesce("charge_power_kw", F.lit(0)) > 0) | (F.coalesce("speed_kmh", F.lit(0)) > 0))
        m = m.withColumn("parked_aux", F.when(~F.col("active"), d("aux_12v_v")))
    else:
        m = m.withColumns({"active": F.lit(None).cast("boolean"), "parked_aux": F.lit(None).cast("double")})
    if "THERMAL_RISE_RATE" in rules:
        m = windows.trailing(m, RISE_MS, lambda w: {"_first": F.min(F.when(F.col("temp").isNotNull(), F.struct("ts_event_ms", "log_offset", "temp"))).over(w)})
        span = F.col("ts_event_ms") - F.col("_first.ts_event_ms")
        m = m.withColumn("rise_c_per_min", F.when(span >= RISE_SPAN_MS, (F.col("temp") - F.col("_first.temp")) / (span / 60_000.0))).drop("_first")
    else:
        m = m.withColumn("rise_c_per_min", F.lit(None).cast("double"))
    if "HV_INTERLOCK_OPEN" in rules:
        m = m.withColumn("_open", F.coalesce((~F.col("hv_interlock_ok") & F.col("active")).cast("int"), F.lit(0)))
        m = windows.trailing(m, OPENS_MS, lambda w: {"opens": F.sum("_open").over(w)}, after={"_later": ("_open", "log_offset")})
        m = m.withColumn("opens", F.col("opens") - F.col("_later")).drop("_open", "_later")
    else:
        m = m.withColumn("opens", F.lit(None).cast("long"))
    if "CHARGE_NEEDED" in rules:
        m = registry.enrich(m, reg, "vin", SITE)
        km = measures.road_km(F.col("lat"), F.col("lon"), F.col("depot_lat"), F.col("depot_lon"))
        need = F.when(F.col("registered") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), measures.share_to_reach(km, F.col("wh_per_km"), F.col("capacity_kwh")))
        m = m.withColumn("need_pct", need).drop("registered", *SITE)
    else:
        m = m.withColumn("need_pct", F.lit(None).cast("double"))
    return m


def in_order(messages: DataFrame) -> DataFrame:
    """The messages that drive rules: with vin, clock and place in the log, and not older than one that arrived before."""
    return windows.monotonic(messages.where("vin is not null and ts_event_ms is not null and log_offset is not null"))


def samples(messages: DataFrame, reg: DataFrame, catalogue: DataFrame | None = None, rules: tuple[str, ...] = NAMES) -> DataFrame:
    """SAMPLES of `rules` (all but TELEMETRY_STALE, which has no messages to judge) for messages in order.

    Of a vehicle only the rules that were ever on are kept: an off sample tells nothing where nothing was on before. So
    what the machines sort is a small part of messages times rules. Codes are judged one by one, at each message of the
    vehicles that ever had them; `catalogue` (code, severity) tells their severity, `warning` by default.
    """
    out = None
    levels = [r for r in LEVELS if r[0] in rules]
    if levels:
        bit = lambda e, k: F.when(e, F.lit(1 << k)).otherwise(0)
        on = [F.expr(c) for _, _, c, _, _ in levels]
        masks = judged(messages, reg, rules).select("vin", "ts_event_ms", "log_offset", sum((bit(e.isNotNull(), k) for k, e in enumerate(on)), F.lit(0)).alias("_known"), sum((bit(e, k) for k, e in enumerate(on)), F.lit(0)).alias("_on"))
        masks = cut(masks)
        ever = maybe_broadcast(cut(masks.groupBy("vin").agg(F.bit_or("_on").alias("_ever")).where("_ever <> 0")))
        kinds = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(1 << k).alias("bit"), F.lit(h * 1000).alias("hold_ms"), F.lit(c * 1000).alias("clear_ms")) for k, (r, s, _, h, c) in enumerate(levels)))
        each = masks.join(ever, "vin").withColumn("r", F.explode(F.filter(kinds, lambda x: (F.col("_known").bitwiseAND(F.col("_ever")).bitwiseAND(x["bit"])) != 0)))
        out = each.select("vin", "r.rule", "r.severity", F.lit("").alias("detail"), "ts_event_ms", "log_offset", (F.col("_on").bitwiseAND(F.col("r.bit")) != 0).alias("on"), "r.hold_ms", "r.clear_ms")
    if DELTA[0] in rules:
        name, severity, hold, clear = DELTA
        x = messages.select("vin", "ts_event_ms", F.col("log_offset").alias("seq"), (F.col("pack_temp_max_c").cast("double") - F.col("ambient_c").cast("double")).alias("delta"))
        b = folds.ewma_baseline(x, "delta").select("vin", F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit("").alias("detail"), "ts_event_ms", F.col("seq").alias("log_offset"), F.col("breach").alias("on"), F.lit(hold * 1000).alias("hold_ms"), F.lit(clear * 1000).alias("clear_ms"))
        b = cut(b)  # folded once
        b = b.join(maybe_broadcast(cut(b.where("on").select("vin").distinct())), "vin", "left_semi").select(*SAMPLES)
        out = b if out is None else out.unionByName(b)
    if DTC[0] in rules:
        name, hold, clear = DTC
        codes = messages.select("vin", F.explode("dtc").alias("code")).where("code is not null").distinct()
        if catalogue is not None:
            codes = codes.join(maybe_broadcast(catalogue.select("code", F.col("severity").alias("_s")).dropDuplicates(["code"])), "code", "left")
        else:
            codes = codes.withColumn("_s", F.lit(None).cast("string"))
        codes = maybe_broadcast(cut(codes.groupBy("vin").agg(F.sort_array(F.collect_list(F.struct("code", F.coalesce("_s", F.lit("warning")).alias("severity")))).alias("_codes"))))
        c = _while_any_code(cut(messages.select("vin", "ts_event_ms", "log_offset", "dtc").join(codes, "vin")), clear * 1000).withColumn("c", F.explode("_codes"))
        c = c.select("vin", F.lit(name).alias("rule"), "c.severity", F.col("c.code").alias("detail"), "ts_event_ms", "log_offset", F.coalesce(F.array_contains("dtc", F.col("c.code")), F.lit(False)).alias("on"), F.lit(hold * 1000).alias("hold_ms"), F.lit(clear * 1000).alias("clear_ms"))
        out = c if out is None else out.unionByName(c)
    return out


def _while_any_code(messages: DataFrame, clear_ms: int) -> DataFrame:
    """The messages at which some code may turn on or off: those with a code, the first one without, and those after it up
    to the first that is `clear_ms` later. All others would only say of every code of the vehicle that it is still off."""
    any_ = F.coalesce(F.size("dtc") > 0, F.lit(False))
    m = windows.previous(messages.withColumn("_any", any_), ["_any", "ts_event_ms"], tie="log_offset")
    m = windows.carried(m, F.when(~F.col("_any") & F.coalesce("prev__any", F.lit(False)), F.col("ts_event_ms")), "_off", tie="log_offset")
    return m.where(F.col("_any") | F.coalesce("prev__any", F.lit(False)) | (F.col("prev_ts_event_ms") < F.col("_off") + clear_ms)).drop("_any", "prev__any", "prev_ts_event_ms", "_off")


def silences(messages: DataFrame, reg: DataFrame, silent_ms: int = STALE[2] * 1000) -> DataFrame:
    """Spells in which a vehicle on duty was not heard of for more than `silent_ms` on the gateway's clock: vin, start_ms
    (from when on it was silent too long and on duty), end_ms (heard of again, or off duty).

    As a sweep at every millisecond would see it between two arrivals, whatever order they have by event time; what comes
    after a vehicle's last arrival is not known here. A spell over several duties counts in each of them; the days of a
    spell are few, or as many as it lasts.
    """
    m = windows.previous(messages.where("vin is not null and ts_ingest_ms is not null").select("vin", "log_offset", "ts_ingest_ms"), ["ts_ingest_ms"], ts="ts_ingest_ms", tie="log_offset")
    s = m.where(F.col("ts_ingest_ms") - F.col("prev_ts_ingest_ms") > silent_ms + 1).select("vin", (F.col("prev_ts_ingest_ms") + silent_ms + 1).alias("a"), F.col("ts_ingest_ms").alias("b"))
    s = registry.enrich(s, reg, "vin", ("depart_min_ist", "return_min_ist")).where("registered and depart_min_ist is not null and return_min_ist is not null")
    day = lambda ms: F.floor((ms + measures.IST_OFFSET_MS) / 86_400_000)
    s = s.withColumn("day", F.explode(F.sequence(day(F.col("a")) - 1, day(F.col("b")))))
    begin = F.col("day") * 86_400_000 - measures.IST_OFFSET_MS + F.col("depart_min_ist") * 60_000
    length = F.when(F.col("depart_min_ist") <= F.col("return_min_ist"), F.col("return_min_ist") - F.col("depart_min_ist")).otherwise(F.col("return_min_ist") - F.col("depart_min_ist") + 1440) * 60_000
    s = s.select("vin", F.greatest("a", begin).cast("long").alias("start_ms"), F.least("b", begin + length).cast("long").alias("end_ms"))
    return s.where("start_ms < end_ms")


def transitions(messages: DataFrame, reg: DataFrame, catalogue: DataFrame | None = None, rules: tuple[str, ...] = NAMES) -> DataFrame:
    """rule, severity, detail (the code of DTC_RAISED, else empty), vin, at_ms, state (FIRING or RESOLVED), start_ms and
    alert_id of each transition, for messages with INPUT (one row per message) and a registry with one row per vehicle.

    Messages without vin, event clock or place in the log are not judged; null readings are those of absent groups; a null
    list of codes is empty; unknown vehicles have no CHARGE_NEEDED and no TELEMETRY_STALE; an empty input gives no row.
    The id is the same whenever the same episode is computed again.
    """
    parts = []
    if set(rules) - {STALE[0]}:
        s = cut(samples(cut(in_order(messages)), reg, catalogue, rules))  # `held` reads them several times
        key = F.concat_ws("|", "vin", "rule", "severity", "detail").alias("key")
        t = windows.held(s.select(key, "ts_event_ms", "log_offset", "on", "hold_ms", "clear_ms"), F.col("on"), F.col("hold_ms"), F.col("clear_ms"), tie="log_offset", key="key").withColumn("k", F.split("key", r"\|", -1))
        parts.append(t.select(F.col("k")[1].alias("rule"), F.col("k")[2].alias("severity"), F.col("k")[3].alias("detail"), F.col("k")[0].alias("vin"), "at_ms", "state", "start_ms"))
    if STALE[0] in rules:
        ends = F.explode(F.array(F.struct(F.col("start_ms").alias("at_ms"), F.lit("FIRING").alias("state")), F.struct(F.col("end_ms").alias("at_ms"), F.lit("RESOLVED").alias("state")))).alias("e")
        parts.append(silences(messages, reg).select("vin", "start_ms", ends).select(F.lit(STALE[0]).alias("rule"), F.lit(STALE[1]).alias("severity"), F.lit("").alias("detail"), "vin", "e.at_ms", "e.state", "start_ms"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = F.concat_ws(":", "rule", "severity", F.nullif("detail", F.lit("")))
    return out.withColumn("alert_id", identity.uuid5(NAMESPACE, F.concat_ws("|", "vin", named, F.col("start_ms").cast("string"))))


#: Severities from the least on.
SEVERITIES = ("info", "warning", "critical")


def recent(alerts: DataFrame, reg: DataFrame, least: str = "warning", most: int = 50) -> DataFrame:
    """For each tenant its newest `most` (1 to 200) transitions of at least a severity, newest first (`rank`); a tenant
    sees its own vehicles only, and alerts of vehicles without tenant are nobody's."""
    a = registry.enrich(alerts, reg, "vin", ("tenant_id",)).where(F.col("tenant_id") != "").drop("registered")
    a = a.where(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) > SEVERITIES.index(least))
    return registry.top_by_group(a, ["tenant_id"], [F.desc("at_ms"), "alert_id", "state"], min(200, max(1, most)))
