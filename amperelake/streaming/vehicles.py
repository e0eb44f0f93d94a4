"""One pass over each vehicle's arrivals, batch after batch: alert rules and minutes under the vehicle's own watermark.

A batch's rows are sorted by vehicle and arrival within partitions, each vehicle's state before its rows, and streamed
through one `Vehicle` at a time: memory does not grow with a vehicle's rows, and what comes out does not depend on how
Spark cuts them into Arrow batches. One vehicle is one task here, as each row meets the state the row before left.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperelake.common import cut
from amperelake.functions.measures import ROAD_FACTOR
from amperelake.operators import registry, rules
from amperelake.sources.versions import VersionedStore

GROUPS, LATE_MS, MINUTE_MS, IST_MS, DAY_MS = 64, 30_000, 60_000, 19_800_000, 86_400_000
SHIFT = ("depart_min_ist", "return_min_ist")
#: A row as it is streamed: types of what is not a double.
TYPES = {"ts_event_ms": "long", "ts_ingest_ms": "long", "log_offset": "long", "evt": "int", "hv_interlock_ok": "boolean", "dtc": "array<string>", **dict.fromkeys(SHIFT, "int")}
COLS = ("log_offset", *rules.INPUT, *rules.SITE, *SHIFT)
#: What comes out: `minute` (at_ms its start, n messages, soc_min), `late` (at_ms the minute, about_ms the event), and
#: transitions of the rules (tag FIRING or RESOLVED, at_ms, about_ms the start of the episode).
TAGGED = "vin string, tag string, at_ms long, about_ms long, n long, soc_min double, rule string, severity string, detail string"


class Vehicle:
    """What is kept of one vehicle, as one JSON text, and what a message does to it.

    `conditions` has for each sustained condition its present outcome and since when, whether its alert is on, and when
    that alert's episode began. An outcome that has lasted for the time it needs (over at least two samples, if that time
    is not 0) turns the alert on or off. Windows keep the samples that may still be in a frame, the baseline three numbers.
    """

    LEVELS = {(r, s): (h * 1000, c * 1000) for r, s, _, h, c in rules.LEVELS}

    def __init__(self, vin: str, kept: str | None = None, late_ms: int = LATE_MS):
        self.vin, self.late_ms, self.out = vin, late_ms, []
        k = json.loads(kept) if kept else {}
        self.conditions: dict[str, list] = k.get("conditions", {})
        self.minutes = {int(m): v for m, v in k.get("minutes", {}).items()}
        self.newest, self.put_out, self.heard, self.on = k.get("newest", -1), k.get("put_out", -1), k.get("heard"), k.get("on", False)
        self.temps, self.opens, self.base = k.get("temps", []), k.get("opens", []), k.get("base", [0.0, 0.0, 0])

    def kept(self) -> str:
        names = ("conditions", "minutes", "newest", "put_out", "heard", "on", "temps", "opens", "base")
        return json.dumps({n: getattr(self, n) for n in names})

    def _tell(self, tag, at, about, rule, severity, detail=""):
        self.out.append((self.vin, tag, at, about, None, None, rule, severity, detail))

    def judge(self, rule: str, severity: str, ts: int, now: bool | None, hold: int, clear: int, detail: str = "") -> None:
        if now is None:
            return
        key = f"{rule}|{severity}|{detail}"
        outcome, since, alert, start = self.conditions.get(key) or (None, ts, False, None)
        begins = outcome is not now
        since = ts if begins else since
        need = hold if now else clear
        if now is not alert and ts - since >= need and not (begins and need):
            alert, start = now, since if now else start
            self._tell("FIRING" if now else "RESOLVED", ts, start, rule, severity, detail)
        if now or alert:
            self.conditions[key] = [now, since, alert, start]
        else:  # off without an alert is the same as never judged
            self.conditions.pop(key, None)

    def add(self, r: dict) -> None:
        ts, ingest = r["ts_event_ms"], r["ts_ingest_ms"]
        if ingest is not None:
            self._silence(ingest, r)
        if ts is None:
            return
        self._minute(ts, r["soc_pct"])
        if ts < self.newest:
            return
        self.newest = ts
        self.on = {2: True, 3: False}.get(r["evt"], self.on)
        active = self.on or (r["charge_power_kw"] or 0) > 0 or (r["speed_kmh"] or 0) > 0
        for (rule, severity), value in self._numbers(ts, r, active).items():
            self.judge(rule, severity, ts, value, *self.LEVELS[rule, severity])
        temp, ambient = r["pack_temp_max_c"], r["ambient_c"]
        if temp is not None and ambient is not None:
            name, severity, hold, clear = rules.DELTA
            self.judge(name, severity, ts, self._unusual(temp - ambient), hold * 1000, clear * 1000)
        name, hold, clear = rules.DTC
        codes = {c for c in r["dtc"] or () if c is not None}
        told = {k.rsplit("|", 1)[1] for k in self.conditions if k.startswith(name)}
        for code in sorted(codes | told):
            self.judge(name, "warning", ts, code in codes, hold * 1000, clear * 1000, code)

    def _numbers(self, ts: int, r: dict, active: bool) -> dict[tuple, bool | None]:
        """The outcome of each level; None where its rule does not judge this message."""
        temp, lo, hi, volt, iso = r["pack_temp_max_c"], r["cell_v_min_mv"], r["cell_v_max_mv"], r["pack_voltage_v"], r["isolation_kohm"]
        rise = None
        if temp is not None:
            self.temps = [x for x in self.temps if x[0] >= ts - rules.RISE_MS] + [[ts, temp]]
            span = ts - self.temps[0][0]
            rise = (temp - self.temps[0][1]) / (span / 60_000.0) if span >= rules.RISE_SPAN_MS else None
        self.opens = [t for t in self.opens if t >= ts - rules.OPENS_MS] + ([ts] if r["hv_interlock_ok"] is False and active else [])
        imbalance = None if lo is None or hi is None else hi - lo
        ohm = iso * 1000 / volt if volt is not None and volt > 1 and iso is not None else None
        at_least = lambda x, limit: None if x is None else x >= limit
        below = lambda x, limit: None if x is None else x < limit
        need = self._to_depot(r)
        return {
            ("THERMAL_OVERTEMP", "warning"): at_least(temp, 48), ("THERMAL_OVERTEMP", "critical"): at_least(temp, 55), ("THERMAL_RISE_RATE", "critical"): at_least(rise, 2.0),
            ("CELL_IMBALANCE", "warning"): at_least(imbalance, 50), ("CELL_IMBALANCE", "critical"): at_least(imbalance, 100), ("ISOLATION_LOW", "warning"): below(ohm, 500), ("ISOLATION_LOW", "critical"): below(ohm, 100),
            ("HV_INTERLOCK_OPEN", "critical"): len(self.opens) >= 2, ("AUX_12V_LOW", "warning"): None if active else below(r["aux_12v_v"], 11.8),
            ("CHARGE_NEEDED", "info"): False if not active and need is None else None if need is None or (active and r["soc_pct"] is None) else active and r["soc_pct"] < 15 + need,
        }

    @staticmethod
    def _to_depot(r: dict) -> float | None:
        lat, lon, dlat, dlon, cap, wh = (r[c] for c in ("lat", "lon", *rules.SITE))
        if None in (lat, lon, dlat, dlon, cap, wh) or cap <= 0:
            return None
        a, b = math.radians(lat), math.radians(dlat)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(dlon - lon) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h))) * ROAD_FACTOR * wh / 1000 / cap * 100

    def _unusual(self, x: float, alpha: float = 0.002, least: int = 360) -> bool:
        """Whether x is over four deviations above the vehicle's baseline, which such values do not move."""
        mean, var, n = self.base
        breach = n >= least and (x - mean) / max(var**0.5, 1e-9) > 4
        if not breach:
            d = x - mean
            self.base = [x, 0.0, 1] if n == 0 else [mean + alpha * d, (1 - alpha) * (var + alpha * d * d), n + 1]
        return breach

    def _silence(self, ingest: int, r: dict) -> None:
        """Spells without an arrival while on duty, told when the vehicle is heard of again."""
        a, self.heard = self.heard, ingest if self.heard is None else max(self.heard, ingest)
        name, severity, silent = rules.STALE
        depart, back = (r[c] for c in SHIFT)
        if a is None or depart is None or back is None:
            return
        a += silent * 1000 + 1
        length = (back - depart if depart <= back else back - depart + 1440) * MINUTE_MS
        for day in range((a + IST_MS) // DAY_MS - 1, (ingest + IST_MS) // DAY_MS + 1) if a < ingest else ():
            begin = day * DAY_MS - IST_MS + depart * MINUTE_MS
            lo, hi = max(a, begin), min(ingest, begin + length)
            if lo < hi:
                self._tell("FIRING", lo, lo, name, severity)
                self._tell("RESOLVED", hi, lo, name, severity)

    def _minute(self, ts: int, soc: float | None) -> None:
        minute = ts - ts % MINUTE_MS
        if minute < self.put_out:
            self.out.append((self.vin, "late", minute, ts, None, None, None, None, None))
            return
        n, lo = self.minutes.get(minute, (0, None))
        self.minutes[minute] = (n + 1, soc if lo is None else lo if soc is None else min(lo, soc))

    def end_of_batch(self, flush: bool = False) -> list[tuple]:
        """What the batch brought, and the minutes that ended `late_ms` before the newest event (all open ones, oldest
        first, on `flush`); a minute that was put out is never opened again."""
        past = sorted(m for m in self.minutes if flush or m + MINUTE_MS <= self.newest - self.late_ms)
        self.out += [(self.vin, "minute", m, None, *self.minutes.pop(m), None, None, None) for m in past]
        if past:
            self.put_out = max(self.put_out, past[-1] + MINUTE_MS)
        out, self.out = self.out, []
        return out


def _run(late_ms: int, flush: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        shape = pa.schema([(n, types[t]) for n, t in (c.split() for c in (TAGGED + ", kept string").split(", "))])
        now, out = None, []

        def end():
            rows = [(*r, None) for r in now.end_of_batch(flush)] if now else []
            return [*rows, (now.vin, "kept", *[None] * 7, now.kept())] if now else rows

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

        for b in batches:
            for r in b.to_pylist():
                if now is None or now.vin != r["vin"]:
                    out += end()
                    now = Vehicle(r["vin"], r["kept"], late_ms)
                if r["kept"] is None:
                    now.add(r)
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        out += end()
        if out:
            yield batch()

    return run


class VehicleStore(VersionedStore):
    """The state of every vehicle between batches, in a shared folder; a batch reads and writes the groups of its vehicles
    only. A batch id that was applied gives its rows of then."""

    def __init__(self, spark, path: str, late_ms: int = LATE_MS):
        super().__init__(spark, path)
        self.late_ms = late_ms

    def apply(self, batch: DataFrame, reg: DataFrame, batch_id: int, flush: bool = False) -> DataFrame:
        """TAGGED rows of a batch of messages (repeats taken off before), with a registry of one row per vehicle; on
        `flush` also all minutes still open, of every vehicle."""
        n, m = self.latest()
        had = self.applied(batch_id)
        if had is None:
            cols = [F.col(c).cast(TYPES.get(c, "double")).alias(c) for c in COLS]
            rows = registry.enrich(batch.where("vin is not null"), reg, "vin", (*rules.SITE, *SHIFT)).select("vin", *cols, F.lit(None).cast("string").alias("kept"))
            group = F.pmod(F.xxhash64("vin"), F.lit(GROUPS)).cast("int").alias("group")
            touched = [r.group for r in rows.select(group).distinct().collect()]  # at most GROUPS
            folders = [f for g, f in (m["groups"] if m else {}).items() if flush or int(g) in touched]
            if folders:
                rows = rows.unionByName(self.spark.read.schema("vin string, kept string").parquet(*(f"{self.path}/{f}" for f in folders)), allowMissingColumns=True)
            rows = rows.repartition("vin").sortWithinPartitions("vin", F.col("kept").asc_nulls_last(), "log_offset")
            out = cut(rows.mapInArrow(_run(self.late_ms, flush), TAGGED + ", kept string"))
            name = f"vehicles/{uuid.uuid4().hex}"
            state = out.where("tag = 'kept'").select("vin", "kept", group)
            state.repartition("group").write.partitionBy("group").parquet(f"{self.path}/{name}")
            out.where("tag <> 'kept'").drop("kept").write.parquet(f"{self.path}/results/{name}")
            changed = [r.group for r in state.select("group").distinct().collect()]
            groups = (m["groups"] if m else {}) | {str(g): f"{name}/group={g}" for g in changed}
            had = self.publish(n, batch_id, {"groups": groups, "results": f"results/{name}"})
        return self.spark.read.schema(TAGGED).parquet(f"{self.path}/{self.version(had)['results']}")


def watched(stream: DataFrame, reg: DataFrame, path: str, flush: bool = False, late_ms: int = LATE_MS) -> DataFrame:
    """All TAGGED rows of what `stream` delivers, repeats taken off by a `SeenStore` as the batch queries do. State and
    results are under `path`; a batch that is run again after a crash gives the same rows."""
    from functools import reduce

    from amperelake.operators import seen
    from amperelake.streaming.pipeline import each_batch

    spark = stream.sparkSession
    known, store, ids = seen.SeenStore(spark, f"{path}/seen"), VehicleStore(spark, f"{path}/vehicles", late_ms), []

    def write(batch, n):
        batch = cut(batch.select("vin", "seq", "log_offset", *rules.INPUT))
        store.apply(seen.kept_rows(batch, known.apply(batch, n).kept), reg, n)
        ids.append(n)

    each_batch(stream, write, f"{path}/checkpoint")
    empty = spark.createDataFrame([], "vin string, seq long, log_offset long").select("*", *(F.lit(None).cast(TYPES.get(c, "double")).alias(c) for c in rules.INPUT))
    parts = [store.apply(empty, reg, n) for n in sorted(set(ids))]
    if flush:
        parts.append(store.apply(empty, reg, -1, flush=True))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], TAGGED)
