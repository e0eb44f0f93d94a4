"""Payloads of three wire formats decoded into canonical columns, or a reason why not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperelake.functions.measures import KM_PER_MILE

# Names of events and charge states on the wire, and the one schema version known.
EVENTS = {"PERIODIC": 1, "IGN_ON": 2, "IGN_OFF": 3, "PLUG_IN": 4, "PLUG_OUT": 5, "HARSH_BRAKE": 6, "HARSH_ACCEL": 7, "DTC_RAISED": 8}
CHARGES = {"IDLE": 1, "AC": 2, "DC_FAST": 3, "FAULT": 4}
SCHEMA = 1
MAX_BODY, MAX_RECORDS = 262_144, 500

CANONICAL = (
    "vin string", "ts_event_ms long", "seq long", "evt int", "lat double", "lon double", "speed_kmh float", "odo_km double", "soc_pct float", "pack_voltage_v float",
    "pack_current_a float", "pack_temp_min_c float", "pack_temp_max_c float", "cell_v_min_mv long", "cell_v_max_mv long", "isolation_kohm float", "hv_interlock_ok boolean",
    "aux_12v_v float", "ambient_c float", "charge_state int", "charge_power_kw float", "dtc array<string>", "schema_version int",
)
NAMES = tuple(c.split()[0] for c in CANONICAL)
GROUPS = {"gps": ("lat", "lon", "speed_kmh"), "temp": ("pack_temp_min_c", "pack_temp_max_c"), "cell": ("cell_v_min_mv", "cell_v_max_mv")}
OPTIONAL = {c for g in GROUPS.values() for c in g} | {"dtc"}

# Where each canonical column stands in a payload.
PATHS_A = {
    "vin": "vin", "ts_event_ms": "ts", "seq": "seq", "evt": "evt", "lat": "pos.lat", "lon": "pos.lon", "speed_kmh": "pos.speed_kmh", "odo_km": "odo_km", "soc_pct": "soc_pct",
    "pack_voltage_v": "pack.voltage_v", "pack_current_a": "pack.current_a", "pack_temp_min_c": "pack.temp_min_c", "pack_temp_max_c": "pack.temp_max_c",
    "cell_v_min_mv": "pack.cell_min_mv", "cell_v_max_mv": "pack.cell_max_mv", "isolation_kohm": "pack.isolation_kohm", "hv_interlock_ok": "pack.hv_interlock_ok",
    "aux_12v_v": "aux_12v_v", "ambient_c": "ambient_c", "charge_state": "charge.state", "charge_power_kw": "charge.power_kw", "dtc": "dtc", "schema_version": "schema",
}
PATHS_B = {
    "vin": "vehicleId", "ts_event_ms": "epoch", "seq": "sequence", "evt": "eventType", "lat": "location.latitude", "lon": "location.longitude", "speed_kmh": "location.speedMph",
    "odo_km": "odometerMiles", "soc_pct": "battery.soc", "pack_voltage_v": "battery.voltage", "pack_current_a": "battery.current", "pack_temp_min_c": "battery.tempMinF",
    "pack_temp_max_c": "battery.tempMaxF", "cell_v_min_mv": "battery.cellMinMv", "cell_v_max_mv": "battery.cellMaxMv", "isolation_kohm": "battery.isolationKohm",
    "hv_interlock_ok": "hvInterlock", "aux_12v_v": "auxVolts", "ambient_c": "ambientF", "charge_state": "charging.status", "charge_power_kw": "charging.powerKw", "dtc": "dtcs", "schema_version": "version",
}
PLACES_C = {
    "schema_version": 0, "vin": 1, "ts_event_ms": 2, "seq": 3, "evt": 4, "lat": 5, "lon": 6, "speed_kmh": 7, "odo_km": 8, "soc_pct": 9, "pack_voltage_v": 10, "pack_current_a": 11,
    "pack_temp_min_c": 12, "pack_temp_max_c": 13, "cell_v_min_mv": 14, "cell_v_max_mv": 15, "isolation_kohm": 16, "hv_interlock_ok": 17, "aux_12v_v": 18, "ambient_c": 19,
    "charge_state": 20, "charge_power_kw": 21, "dtc": 22,
}

TEXTS = {"vin", "evt", "charge_state"}
WHOLE = {"seq", "cell_v_min_mv", "cell_v_max_mv", "schema_version"}


NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Format:
    """One wire format: whether a body is JSON or lines, and the SQL of an array of one struct (canonical columns and
    `reason`) for a record `_r` (its `json` or its `line`) of a body with `_reason`.

    The SQL binds what is used several times by lambdas, so it is computed once for a record, and only for records of the
    format; it is text, as building it call by call would take longer than running it.
    """

    rows: str
    sql: str


def _nested(paths: dict[str, str], kind: Callable[[str], str]) -> str:
    """The type of a struct with a leaf per path."""
    tree: dict = {}
    for c, p in paths.items():
        *up, leaf = p.split(".")
        at = tree
        for u in up:
            at = at.setdefault(u, {})
        at[leaf] = kind(c)
    text = lambda t: "struct<" + ", ".join(f"`{k}`: {text(v) if isinstance(v, dict) else v}" for k, v in t.items()) + ">"
    return text(tree)


def _names(table: dict[str, int], value: str) -> str:
    return f"try_element_at(map({', '.join(f'{k!r}, {v}' for k, v in table.items())}), {value})"


def _either(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


def _partial(has: Callable[[str], str]) -> str:
    """Whether a group of sensors is there in part only."""
    return _either([f"(({' + '.join(f'int({has(c)})' for c in g)}) NOT IN (0, {len(g)}))" for g in GROUPS.values()])


def _row(values: dict[str, str], reason: str) -> str:
    """The struct of a record: canonical columns where there is no reason, else nulls, and the reason."""
    cols = ", ".join(f"'{n}', CAST({values[n]} AS {t})" for n, t in (c.split(" ") for c in CANONICAL))
    blank = ", ".join(f"'{n}', CAST(NULL AS {t})" for n, t in (c.split(" ") for c in CANONICAL))
    return f"transform(array({reason}), why -> CASE WHEN why IS NULL THEN named_struct({cols}, 'reason', why) ELSE named_struct({blank}, 'reason', why) END)"


def json_format(paths: dict[str, str], unit: Callable[[str, str], str], clock: Callable[[str], str], seconds: bool) -> Format:
    """A nested JSON format. Each leaf is taken twice, as it is (for its kind) and typed; a leaf is absent if it is not there
    or a JSON null, and of a wrong kind if it is there with another kind than its column's."""
    text = {*TEXTS, *(() if seconds else ("ts_event_ms",))}
    whole = {*WHOLE, *(("ts_event_ms",) if seconds else ())}

    def typed(c: str) -> str:
        return "string" if c in text else "boolean" if c == "hv_interlock_ok" else "array<string>" if c == "dtc" else "bigint" if c in whole else "double"

    k, v = (lambda c: f"x.k.{c}"), (lambda c: f"x.t.{paths[c]}")

    def fine(c: str) -> str:
        if c in text:
            return f"{k(c)} = 'STRING'"
        if c == "hv_interlock_ok":
            return f"{k(c)} = 'BOOLEAN'"
        if c == "dtc":
            return f"startswith({k(c)}, 'ARRAY')"
        if c in whole:
            return f"{k(c)} = 'BIGINT' AND {v(c)} IS NOT NULL" + ("" if c == "ts_event_ms" else f" AND {v(c)} >= 0")
        return f"({k(c)} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({k(c)}, 'DECIMAL'))"

    bad = _either([f"({k(c)} IS NOT NULL AND NOT coalesce({fine(c)}, false))" for c in paths] + [f"{k(c)} IS NULL" for c in paths if c not in OPTIONAL])
    evt, charge, ts = _names(EVENTS, v("evt")), _names(CHARGES, v("charge_state")), clock(v("ts_event_ms"))
    gps = " AND ".join(f"{v(c)} IS NULL" for c in GROUPS["gps"])
    version = k("schema_version")
    reason = (
        f"CASE WHEN _reason IS NOT NULL THEN _reason WHEN x.top IS NULL OR NOT x.top THEN 'SCHEMA' WHEN {version} IS NULL OR {version} <> 'BIGINT' OR coalesce({v('schema_version')} < 0, true) THEN 'SCHEMA' "
        f"WHEN {v('schema_version')} <> {SCHEMA} THEN 'UNKNOWN_SCHEMA_VERSION' WHEN {bad} OR {evt} IS NULL OR {charge} IS NULL OR {ts} IS NULL OR {_partial(lambda c: f'{v(c)} IS NOT NULL')} OR (x.holder IS NOT NULL AND {gps}) THEN 'SCHEMA' END"
    )
    values = {c: unit(c, v(c)) for c in paths} | {"evt": evt, "charge_state": charge, "ts_event_ms": ts, "dtc": f"coalesce({v('dtc')}, array())"}
    kinds = ", ".join(f"'{c}', nullif(schema_of_variant(w.v.{p}), 'VOID')" for c, p in paths.items())
    holder = paths["lat"].split(".")[0]
    both = f"named_struct('v', try_variant_get(_r.json, '$', '{_nested(paths, lambda c: 'variant')}'), 't', try_variant_get(_r.json, '$', '{_nested(paths, typed)}'), 'holder', nullif(schema_of_variant(try_variant_get(_r.json, '$.{holder}', 'variant')), 'VOID'))"
    got = f"transform(array({both}), w -> named_struct('k', named_struct({kinds}), 't', w.t, 'top', w.v IS NOT NULL, 'holder', w.holder))"
    return Format("json", f"flatten(transform({got}, x -> {_row(values, reason)}))")


def lines_format(places: dict[str, int]) -> Format:
    """A format of text lines with fields between semicolons; carriage returns at the end are dropped."""
    at = lambda c: f"coalesce(try_element_at(p, {places[c] + 1}), '')"
    values, bad = {"vin": at("vin"), "hv_interlock_ok": f"{at('hv_interlock_ok')} = '1'", "dtc": "codes"}, []
    for n, t in (c.split(" ") for c in CANONICAL):
        if n in values:
            continue
        whole = t in ("int", "long")
        values[n] = f"try_cast({at(n)} AS {'bigint' if whole else 'double'})"
        form = "^[0-9]+$" if n in WHOLE else "^[+-]?[0-9]+$" if whole else NUMBER
        fine = f"({at(n)} RLIKE '{form}' AND {values[n]} IS NOT NULL)"
        bad.append(f"(NOT {fine} AND {at(n)} <> '')" if n in OPTIONAL else f"NOT {fine}")
    partial = _partial(lambda c: f"{at(c)} <> ''")
    reason = (
        f"CASE WHEN _reason IS NOT NULL THEN _reason WHEN _r.line IS NULL OR size(p) <> {len(places)} THEN 'DECODE' WHEN NOT {at('schema_version')} RLIKE '^[0-9]+$' THEN 'SCHEMA' "
        f"WHEN coalesce({values['schema_version']}, -1) <> {SCHEMA} THEN 'UNKNOWN_SCHEMA_VERSION' WHEN {at('hv_interlock_ok')} NOT IN ('0', '1') OR {partial} OR {_either(bad)} THEN 'SCHEMA' WHEN NOT {at('dtc')} RLIKE '^([0-9A-Fa-f]{{4}})*$' THEN 'DTC_FORMAT' END"
    )
    word = "CAST(conv(substring(h, i * 4 + 1, 4), 16, 10) AS int)"
    code = f"transform(array({word}), n -> concat(substring('PCBU', (shiftright(n, 14) & 3) + 1, 1), CAST(shiftright(n, 12) & 3 AS string), lpad(conv(CAST(n & 4095 AS string), 10, 16), 3, '0')))[0]"
    codes = f"CASE WHEN h RLIKE '^([0-9A-Fa-f]{{4}})+$' THEN transform(sequence(0, CAST(length(h) DIV 4 AS int) - 1), i -> {code}) ELSE CAST(array() AS array<string>) END"
    inner = f"transform(array({at('dtc')}), h -> {codes})"
    return Format("lines", f"flatten(transform(array(split(regexp_replace(_r.line, '\\\\r+$', ''), ';', -1)), p -> flatten(transform({inner}, codes -> {_row(values, reason)}))))")


def _imperial(c: str, v: str) -> str:
    """Miles, °F (in single precision) and a ratio for the charge level."""
    if c in ("pack_temp_min_c", "pack_temp_max_c", "ambient_c"):
        return f"CAST(CAST(CAST({v} AS float) - 32.0F AS float) * 5.0F AS float) / 9.0F"
    return f"{v} * {KM_PER_MILE}D" if c in ("odo_km", "speed_kmh") else f"{v} * 100" if c == "soc_pct" else v


#: The registry of formats by OEM; a new format is one more entry.
FORMATS: dict[str, Format] = {
    "oem_a": json_format(PATHS_A, lambda c, v: v, lambda text: f"unix_millis(try_to_timestamp({text}))", seconds=False),
    "oem_b": json_format(PATHS_B, _imperial, lambda s: f"{s} * 1000", seconds=True),
    "oem_c": lines_format(PLACES_C),
}


def decode(raw: DataFrame, formats: dict[str, Format] | None = None) -> DataFrame:
    """All records of `raw` (`oem`, `body`, ...) in the format of their OEM: the columns of `raw`, `record_no`, the canonical
    columns, and `reason` (null where decoding went well). A JSON array is a batch of its elements, a text of its lines.

    One scan whatever the number of formats: bodies are taken apart once, and each record goes through its own format.
    Reasons for whole bodies: OVERSIZE over 256 KiB or 500 records, DECODE for what is no JSON, UNKNOWN_OEM; such bodies
    are one row. Columns of `raw` with canonical names are replaced. Null and empty bodies are DECODE; repeated bodies
    give repeated rows; an empty table gives none.
    """
    formats = FORMATS if formats is None else formats
    keep = [c for c in raw.columns if c not in (*NAMES, "record", "record_no", "reason", "body_reason", "_v", "_many", "_lines", "_reason", "_r")]
    kinds = {k: [o for o, f in formats.items() if f.rows == k] for k in ("json", "lines")}
    of = {k: f"oem IN ({', '.join(map(repr, os))})" if os else "false" for k, os in kinds.items()}
    none = "array(named_struct('json', CAST(NULL AS variant), 'line', CAST(NULL AS string)))"
    r = raw.select(*keep).withColumns({"_v": F.expr(f"CASE WHEN {of['json']} THEN try_parse_json(body) END"), "_lines": F.expr(rf"CASE WHEN {of['lines']} THEN split(regexp_replace(body, '\\n+$', ''), '\\n') END")})
    r = r.withColumn("_many", F.expr("CASE WHEN startswith(schema_of_variant(_v), 'ARRAY') THEN try_variant_get(_v, '$', 'array<variant>') END"))
    r = r.withColumn("_reason", F.expr(f"CASE WHEN oem IS NULL OR NOT ({of['json']} OR {of['lines']}) THEN 'UNKNOWN_OEM' WHEN octet_length(body) > {MAX_BODY} OR size(_many) > {MAX_RECORDS} OR size(_lines) > {MAX_RECORDS} THEN 'OVERSIZE' WHEN {of['json']} AND _v IS NULL THEN 'DECODE' END"))
    records = f"CASE WHEN _reason IS NOT NULL THEN {none} WHEN _many IS NOT NULL THEN transform(_many, v -> named_struct('json', v, 'line', CAST(NULL AS string))) WHEN _lines IS NOT NULL THEN transform(_lines, l -> named_struct('json', CAST(NULL AS variant), 'line', l)) ELSE array(named_struct('json', _v, 'line', CAST(NULL AS string))) END"
    r = r.select(*keep, "_reason", F.expr(f"posexplode_outer({records}) AS (record_no, _r)"))
    nothing = _row({n: "NULL" for n in NAMES}, "_reason")
    cases = " ".join(f"WHEN oem = {o!r} THEN {f.sql}" for o, f in formats.items())
    return r.select(*keep, "record_no", F.expr(f"inline(CASE {cases} ELSE {nothing} END)"))


def topic_parts(topic: Column) -> tuple[Column, Column, Column]:
    """(oem, vin, well formed) of a topic `v1/{oem}/{vin}/...`; the OEM of any other is `unknown-topic:<topic>`."""
    p = F.split(topic, "/")
    ok = F.coalesce((F.try_element_at(p, F.lit(1)) == "v1") & (F.size(p) >= 3) & (F.try_element_at(p, F.lit(2)) != "") & (F.try_element_at(p, F.lit(3)) != ""), F.lit(False))
    return F.when(ok, F.try_element_at(p, F.lit(2))).otherwise(F.concat(F.lit("unknown-topic:"), topic)), F.when(ok, F.try_element_at(p, F.lit(3))), ok


def signature(body: Column, timestamp: Column, secret: str) -> Column:
    """Hex HMAC-SHA-256 of `timestamp.body`: two nested digests over padded keys, all in the JVM."""
    key = secret.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.concat_ws(".", timestamp, body).cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


#: How far a sender's clock may be from the receiver's.
SKEW_S = 300


def authenticated(requests: DataFrame, keys: dict[str, tuple[str, set[str]]]) -> DataFrame:
    """`requests` (key_id, timestamp, signature, body, oem, received_ms) with `reason`: AUTH for an unknown key, a timestamp
    that is no whole second or over five minutes off, or a signature that is not the HMAC of timestamp and body;
    IDENTITY_MISMATCH for an OEM the key may not send for; else null. `keys`: secret and OEMs by key id, a few."""
    at = F.col("timestamp").try_cast("long")
    known, signed, may = F.col("key_id").isin(*keys), F.lit(None).cast("string"), F.lit(False)
    for k, (secret, oems) in keys.items():
        mine = F.col("key_id") == k
        signed = F.when(mine, signature(F.col("body"), F.col("timestamp"), secret)).otherwise(signed)
        may = F.when(mine, F.col("oem").isin(*oems)).otherwise(may)
    near = F.abs(F.col("received_ms") / 1000 - at) <= SKEW_S
    fine = F.coalesce(known & at.isNotNull() & near & (F.lower("signature") == signed), F.lit(False))
    return requests.withColumn("reason", F.when(~fine, "AUTH").when(~F.coalesce(may, F.lit(False)), "IDENTITY_MISMATCH"))
