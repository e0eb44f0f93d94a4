"""SQL of the wire formats and of the checks behind them, for the queries on raw bodies."""

from __future__ import annotations

from amperelake.functions.identity import VIN_DIGITS, VIN_LETTERS, VIN_WEIGHTS
from amperelake.functions.measures import KM_PER_MILE
from amperelake.operators.validate import AHEAD_MS, EARLIEST_MS, GROUP_RANGES, RANGES
from amperelake.sources.decode import CANONICAL, CHARGES, EVENTS, GROUPS, OPTIONAL, PATHS_A, PATHS_B, PLACES_C, TEXTS, WHOLE

# The OEM that may send for the first three places of a vehicle number.
MAKERS = {"0EA": "oem_a", "0EB": "oem_b", "0EC": "oem_c"}
TYPES = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
COLUMNS = [(n, TYPES[t]) for n, t in (c.split() for c in CANONICAL)]


def _names(table: dict[str, int], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


def _partial(has) -> str:
    return " OR ".join(f"({' + '.join(f'CAST({has(c)} AS INTEGER)' for c in g)}) NOT IN (0, {len(g)})" for g in GROUPS.values())


def _json(oem: str, paths: dict[str, str], seconds: bool) -> str:
    text = {*TEXTS, *(() if seconds else ("ts_event_ms",))}
    whole = {*WHOLE, *(("ts_event_ms",) if seconds else ())}
    kind = lambda c: f"nullif(json_type(r, '$.{paths[c]}'), 'NULL')"
    raw = lambda c: f"(r->>'$.{paths[c]}')"
    ok = lambda c: f"{kind(c)} " + ("= 'VARCHAR'" if c in text else "= 'BOOLEAN'" if c == "hv_interlock_ok" else "= 'ARRAY'" if c == "dtc" else "= 'UBIGINT'" if c in whole else "IN ('UBIGINT', 'BIGINT', 'DOUBLE')")
    bad = " OR ".join([f"({kind(c)} IS NOT NULL AND NOT {ok(c)})" for c in paths] + [f"{kind(c)} IS NULL" for c in paths if c not in OPTIONAL])

    def value(n: str, t: str) -> str:
        x = f"TRY_CAST({raw(n)} AS {'BIGINT' if n in whole else 'DOUBLE'})"
        if n == "ts_event_ms":
            return f"{x} * 1000" if seconds else f"epoch_ms(TRY_CAST({raw(n)} AS TIMESTAMPTZ))"
        if n in ("evt", "charge_state"):
            return _names(EVENTS if n == "evt" else CHARGES, raw(n))
        if n == "dtc":
            return f"coalesce(TRY_CAST(r->'$.{paths[n]}' AS VARCHAR[]), [])"
        if n in ("vin", "hv_interlock_ok"):
            return raw(n)
        if seconds and n in ("pack_temp_min_c", "pack_temp_max_c", "ambient_c"):
            return f"(CAST({x} AS FLOAT) - CAST(32 AS FLOAT)) * CAST(5 AS FLOAT) / CAST(9 AS FLOAT)"
        return f"{x} * {KM_PER_MILE}::DOUBLE" if seconds and n in ("odo_km", "speed_kmh") else f"{x} * 100" if seconds and n == "soc_pct" else x

    version = "schema_version"
    why = f"""CASE WHEN r IS NULL THEN 'DECODE' WHEN json_type(r) <> 'OBJECT' OR {kind(version)} IS NULL OR {kind(version)} <> 'UBIGINT' THEN 'SCHEMA' WHEN {raw(version)} <> '1' THEN 'UNKNOWN_SCHEMA_VERSION'
 WHEN {bad} OR {value("evt", "")} IS NULL OR {value("charge_state", "")} IS NULL OR {value("ts_event_ms", "")} IS NULL OR {_partial(lambda c: f"{kind(c)} IS NOT NULL")} OR (nullif(json_type(r, '$.{paths["lat"].split(".")[0]}'), 'NULL') IS NOT NULL AND {kind("lat")} IS NULL) THEN 'SCHEMA' END"""
    cols = ", ".join(f"CASE WHEN why IS NULL THEN CAST({value(n, t)} AS {t}) END AS {n}" for n, t in COLUMNS)
    return f"""SELECT raw_id, oem, topic_vin, fw_version, received_ms, body, record_no, {cols}, why AS reason FROM (SELECT *, {why} AS why FROM (
SELECT *, unnest(CASE WHEN b IS NULL THEN [NULL] WHEN json_type(b) = 'ARRAY' THEN b->'$[*]' ELSE [b] END) AS r, CAST(unnest(CASE WHEN b IS NOT NULL AND json_type(b) = 'ARRAY' THEN range(0, CAST(json_array_length(b) AS BIGINT)) ELSE [0] END) AS INTEGER) AS record_no
FROM (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS b FROM oem_raw WHERE oem = '{oem}')))"""


def _lines(oem: str) -> str:
    at = lambda c: f"coalesce(f[{PLACES_C[c] + 1}], '')"
    values, bad = {"vin": at("vin"), "hv_interlock_ok": f"{at('hv_interlock_ok')} = '1'"}, []
    for n, t in COLUMNS:
        if n in (*values, "dtc"):
            continue
        whole = t in ("BIGINT", "INTEGER")
        values[n] = f"TRY_CAST({at(n)} AS {'BIGINT' if whole else 'DOUBLE'})"
        form = "[0-9]+" if n in WHOLE else "[+-]?[0-9]+" if whole else "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
        fine = f"(regexp_full_match({at(n)}, '{form}') AND {values[n]} IS NOT NULL)"
        bad.append(f"(NOT {fine} AND {at(n)} <> '')" if n in OPTIONAL else f"NOT {fine}")
    w = f"CAST('0x' || {at('dtc')}[i * 4 + 1 : i * 4 + 4] AS INTEGER)"
    values["dtc"] = f"list_transform(range(0, length({at('dtc')}) // 4), lambda i: 'PCBU'[({w} >> 14) + 1] || (({w} >> 12) & 3) || upper(lpad(printf('%x', {w} & 4095), 3, '0')))"
    why = f"""CASE WHEN len(f) <> {len(PLACES_C)} THEN 'DECODE' WHEN NOT regexp_full_match({at("schema_version")}, '[0-9]+') THEN 'SCHEMA' WHEN {at("schema_version")} <> '1' THEN 'UNKNOWN_SCHEMA_VERSION'
 WHEN {at("hv_interlock_ok")} NOT IN ('0', '1') OR {_partial(lambda c: f"{at(c)} <> ''")} OR {" OR ".join(bad)} THEN 'SCHEMA' WHEN NOT regexp_full_match({at("dtc")}, '([0-9A-Fa-f]{{4}})*') THEN 'DTC_FORMAT' END"""
    cols = ", ".join(f"CASE WHEN why IS NULL THEN CAST({values[n]} AS {t}) END AS {n}" for n, t in COLUMNS)
    return f"""SELECT raw_id, oem, topic_vin, fw_version, received_ms, body, record_no, {cols}, why AS reason FROM (SELECT *, {why} AS why FROM (
SELECT *, string_split(regexp_replace(line, '\\r+$', ''), ';') AS f FROM (SELECT *, unnest(ls) AS line, CAST(unnest(range(0, len(ls))) AS INTEGER) AS record_no FROM (SELECT *, string_split(regexp_replace(body, '\\n+$', ''), chr(10)) AS ls FROM oem_raw WHERE oem = '{oem}'))))"""


def records() -> str:
    return " UNION ALL ".join([_json("oem_a", PATHS_A, False), _json("oem_b", PATHS_B, True), _lines("oem_c")])


def decoded() -> str:
    """All columns of decoded records: floats as doubles, codes as one text."""
    kinds = {n: f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n, t in COLUMNS if t in ("FLOAT", "DOUBLE")} | {"dtc": "array_to_string(dtc, ' ') AS dtc"}
    cols = ", ".join(kinds.get(n, n) for n, _ in COLUMNS if n != "schema_version")
    return f"SELECT raw_id, oem, topic_vin, fw_version, received_ms, record_no, {cols}, reason FROM ({records()})"


def checked(source: str, received: str, topic_vin: str | None, keep: list[str], had: str = "NULL") -> str:
    """`keep` and the reason of each row of `source`: the one it `had`, else that of the first check that fails."""
    digits = f"list_sum(list_transform(generate_series(1, 17), lambda i: TRY_CAST(translate(vin, '{VIN_LETTERS}', '{VIN_DIGITS}')[i] AS INTEGER) * {list(VIN_WEIGHTS)}[i]))::BIGINT % 11"
    owner = "CASE vin[:3] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MAKERS.items()) + " END"
    spoofed = f"coalesce({owner} <> oem, true)" + (f" OR (coalesce({topic_vin}, '') <> '' AND {topic_vin} <> vin)" if topic_vin else "")
    out = [f"NOT coalesce({c} BETWEEN {lo} AND {hi}, false)" for c, (lo, hi) in RANGES.items()] + [f"coalesce({c} NOT BETWEEN {lo} AND {hi}, false)" for c, (lo, hi) in GROUP_RANGES.items()]
    out += ["coalesce(pack_temp_min_c > pack_temp_max_c, false)", "coalesce(cell_v_min_mv > cell_v_max_mv, false)", f"NOT coalesce(ts_event_ms BETWEEN {EARLIEST_MS} AND {received} + {AHEAD_MS}, false)", "NOT coalesce(charge_state BETWEEN 1 AND 4 AND evt BETWEEN 1 AND 8, false)"]
    return f"""SELECT {", ".join(keep)}, coalesce({had}, CASE WHEN NOT coalesce(schema_version = 1, false) THEN 'UNKNOWN_SCHEMA_VERSION' WHEN NOT coalesce(regexp_full_match(vin, '[A-HJ-NPR-Z0-9]{{17}}'), false) THEN 'VIN_FORMAT'
 WHEN vin[9] <> (CASE {digits} WHEN 10 THEN 'X' ELSE CAST({digits} AS VARCHAR) END) THEN 'VIN_CHECKSUM' WHEN {spoofed} THEN 'IDENTITY_MISMATCH' WHEN len(list_filter(dtc, lambda c: NOT regexp_full_match(c, '[PCBU][0-3][0-9A-F]{{3}}'))) > 0 THEN 'DTC_FORMAT'
 WHEN {" OR ".join(out)} THEN 'RANGE' END) AS reason FROM {source}"""


def routed() -> str:
    return checked(f"(SELECT * FROM ({records()}))", "received_ms", "topic_vin", ["raw_id", "oem", "vin", "topic_vin", "received_ms", "body"], "reason")
