"""Readings recorded in several units and spellings, brought to common units."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperelake.common import cut, maybe_broadcast
from amperelake.operators.prefix import blocked_running

#: A posterior under this leaves the unit of a reading uncertain.
SURE = 0.9
EM_ROUNDS = 60
BLOCK_S = 3600


@dataclass(frozen=True)
class Quantity:
    """One field: JSON path in an oem_b body, units with (factor, offset) to the common unit, spellings, and its log scale."""

    path: str
    key_unit: str
    units: dict[str, tuple[float, float]]
    spellings: dict[str, tuple[str, ...]]
    shift: float = 0.0  # added to the common value before its logarithm is taken (kelvin for temperatures)
    step: float = 0.02  # bin width on the log scale


# Conversion factors and unit spellings.
QUANTITIES = {
    "tempMaxF": Quantity(
        "battery.tempMaxF", "F", {"F": (5 / 9, -160 / 9), "C": (1.0, 0.0), "K": (1.0, -273.15)},
        {"F": ("f", "degf", "fahrenheit", "degfahrenheit", "degreesfahrenheit", "℉"), "C": ("c", "degc", "celsius", "degcelsius", "degreescelsius", "centigrade", "℃"), "K": ("k", "degk", "kelvin", "kelvins")},
        273.15, 0.004,
    ),
    "odometerMiles": Quantity(
        "odometerMiles", "mi", {"mi": (1.609344, 0.0), "km": (1.0, 0.0), "m": (0.001, 0.0)},
        {"mi": ("mi", "mile", "miles", "mls"), "km": ("km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"), "m": ("m", "mtr", "metre", "metres", "meter", "meters")},
        0.0, 0.01,
    ),
    "speedMph": Quantity(
        "location.speedMph", "mph", {"mph": (1.609344, 0.0), "km/h": (1.0, 0.0), "m/s": (3.6, 0.0)},
        {"mph": ("mph", "mi/h", "miles/h", "milesperhour"), "km/h": ("km/h", "kmh", "kph", "kmph", "kilometresperhour"), "m/s": ("m/s", "mps", "ms", "metrespersecond")},
    ),
    "soc": Quantity(
        "battery.soc", "ratio", {"ratio": (100.0, 0.0), "%": (1.0, 0.0), "permille": (0.1, 0.0)},
        {"ratio": ("ratio", "fraction"), "%": ("%", "pct", "percent", "percentage"), "permille": ("‰", "permille", "permil")},
    ),
}

NUMBER = r"^\s*([+-]?(?:[0-9][0-9,]*)?\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*(.*?)\s*$"


def readings(oem_raw: DataFrame) -> DataFrame:
    """The present readings of parseable oem_b bodies: raw_id, record_no, vin, fw, at (epoch s), and per field `<f>_x` and `<f>_u`.

    `_x` is the number (thousands separators removed), `_u` the unit written beside it or null. A body is an object or an
    array, every element of which is a record; one that is no JSON has no readings; a value that holds no number is not
    present.
    """
    v = oem_raw.where("oem = 'oem_b'").select("raw_id", "topic_vin", "fw_version", "received_ms", F.try_parse_json("body").alias("v")).where("v is not null")
    many = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    v = v.select("raw_id", "topic_vin", "fw_version", "received_ms", F.posexplode(many).alias("record_no", "v"))
    out = v.select(
        "raw_id",
        "record_no",
        F.coalesce(F.try_variant_get("v", "$.vehicleId", "string"), "topic_vin").alias("vin"),
        F.col("fw_version").alias("fw"),
        F.coalesce(F.try_variant_get("v", "$.epoch", "double").cast("long"), F.floor(F.col("received_ms") / 1000)).alias("at"),
        *(F.try_variant_get("v", f"$.{q.path}", "string").alias(f) for f, q in QUANTITIES.items()),
    )
    for f, q in QUANTITIES.items():
        token = F.regexp_replace(F.lower(F.regexp_extract(f, NUMBER, 2)), r"[^a-z%‰℃℉/]", "")
        unit = F.lit(None).cast("string")
        for u, words in q.spellings.items():
            unit = F.when(token.isin(*words), u).otherwise(unit)
        x = F.regexp_replace(F.regexp_extract(f, NUMBER, 1), ",", "").try_cast("double")
        out = out.withColumns({f"{f}_x": x, f"{f}_u": F.when(x.isNotNull(), unit)})
    return out.drop(*QUANTITIES)


def reference(oem_raw: DataFrame) -> DataFrame:
    """Readings of oem_a and oem_c, which are in common units: vin and one column per field."""
    a = oem_raw.where("oem = 'oem_a'").withColumn("v", F.try_parse_json("body")).where("v is not null")
    get = lambda p: F.try_variant_get("v", p, "double")
    a = a.select(F.col("topic_vin").alias("vin"), get("$.pack.temp_max_c").alias("tempMaxF"), get("$.odo_km").alias("odometerMiles"), get("$.pos.speed_kmh").alias("speedMph"), get("$.soc_pct").alias("soc"))
    c = oem_raw.where("oem = 'oem_c'").withColumn("p", F.split("body", ";"))
    at = lambda i: F.try_element_at("p", F.lit(i + 1)).try_cast("double")
    c = c.select(F.col("topic_vin").alias("vin"), at(13).alias("tempMaxF"), at(8).alias("odometerMiles"), at(7).alias("speedMph"), at(9).alias("soc"))
    return a.unionByName(c)


def _log(f: str, common, ref):
    """Position on the field's log scale; odometers relative to the vehicle's own known reading (no place without one)."""
    q = QUANTITIES[f]
    value = common / ref if f == "odometerMiles" else common + q.shift
    return np.where(value > 0, np.log(np.where(value > 0, value, 1.0)), np.nan)


class Mixture:
    """Per field a base density on the log scale; a unit's component is that density offset by the unit's conversion to
    the common unit, so only weights of the units are fitted, per firmware.

    Densities are histograms, smoothed over neighbouring bins, with a floor for values never seen.
    """

    FLOOR = 1e-5

    def __init__(self, base: dict[str, dict[int, float]]):
        self.base = {}
        for f in QUANTITIES:
            bins = base.get(f) or {0: 1.0}
            lo, hi = min(bins) - 20, max(bins) + 20
            h = np.zeros(hi - lo + 1)
            for b, n in bins.items():
                h[b - lo] = n
            k = np.exp(-0.5 * (np.arange(-8, 9) / 3.0) ** 2)
            h = np.convolve(h, k / k.sum(), "same")
            self.base[f] = (lo, h / h.sum())

    def likelihood(self, f: str, x: np.ndarray, ref: np.ndarray) -> np.ndarray:
        """(readings, units); 1 for every unit where the reading has no place on the scale (0, or no reference)."""
        q, (lo, h) = QUANTITIES[f], self.base[f]
        out = np.ones((len(x), len(q.units)))
        at = [_log(f, x * a + b, ref) for a, b in q.units.values()]
        blank = np.isnan(x) | (x == 0) | np.all([np.isnan(z) for z in at], axis=0)
        for j, z in enumerate(at):
            i = np.where(np.isnan(z), -1, np.floor(np.nan_to_num(z) / q.step) - lo).astype(int)
            inside = (i >= 0) & (i < len(h))
            out[:, j] = np.where(inside, h[np.clip(i, 0, len(h) - 1)], 0.0) + self.FLOOR
        out[blank] = 1.0
        return out

    def fit(self, f: str, x: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
        """Weights of the units among `n` readings at each `x` (odometers relative to the vehicle)."""
        like = self.likelihood(f, x, np.ones(len(x)))
        w = np.full(like.shape[1], 1 / like.shape[1])
        for _ in range(rounds):
            p = like * w
            p /= p.sum(axis=1, keepdims=True)
            w = (p * n[:, None]).sum(axis=0) + 0.1
            w /= w.sum()
        return w


#: Names of the fitted weights in a row: one per field and unit.
WEIGHTS = [f"w_{f}_{j}" for f, q in QUANTITIES.items() for j in range(len(q.units))]


def _bin(f: str, x):
    """A reading's bin before its unit is known: fine enough that one value stands for the bin."""
    return F.round(x, 0) if f == "tempMaxF" else F.round(F.log(F.abs(x)) * 100, 0)


def base_densities(rows: DataFrame, known: DataFrame, refs: DataFrame) -> Mixture:
    """The common distributions, from histograms counted over all rows; the driver gets a few thousand bins, never readings."""
    written = rows.select("vin", *(F.when(F.col(f"{f}_u").isNotNull(), _common(f)).alias(f) for f in QUANTITIES))
    common = known.select("vin", *QUANTITIES).unionByName(written).join(refs, "vin", "left")
    place = {f: F.col(f) / F.col("ref") if f == "odometerMiles" else F.col(f) + q.shift for f, q in QUANTITIES.items()}
    bins = [F.struct(F.lit(f).alias("f"), F.floor(F.log(F.when(place[f] > 0, place[f])) / q.step).cast("int").alias("b")) for f, q in QUANTITIES.items()]
    got = common.select(F.inline(F.array(*bins))).where("b is not null").groupBy("f", "b").count().collect()
    base: dict[str, dict[int, float]] = {f: {} for f in QUANTITIES}
    for r in got:
        base[r.f][r.b] = float(r["count"])
    return Mixture(base)


def firmware_weights(rows: DataFrame, mix: Mixture) -> DataFrame:
    """fw, the fitted WEIGHTS, `likely` (the most likely unit of each field, as a number) and how many readings they rest on.

    Readings are counted into bins first, so a firmware that most rows have is a few thousand bins like any other.
    """
    bare = []
    for f in QUANTITIES:
        x = F.when(F.col(f"{f}_u").isNull() & (F.col(f"{f}_x") != 0), F.col(f"{f}_x"))
        x = x / F.col("ref") if f == "odometerMiles" else x
        bare.append(F.struct(F.lit(f).alias("f"), _bin(f, x).alias("b"), x.alias("x")))
    bins = rows.where("fw is not null").select("fw", F.inline(F.array(*bare))).where("x is not null").groupBy("fw", "f", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))

    def fitted(key, pdf):
        import pandas as pd

        out, likely = [], 0
        for f, q in QUANTITIES.items():
            g = pdf[pdf["f"] == f].sort_values("b")
            w = mix.fit(f, g["x"].to_numpy(float), g["n"].to_numpy(float))
            out += w.tolist()
            likely = likely * len(q.units) + int(w.argmax())
        return pd.DataFrame([[key[0], *out, likely, float(pdf["n"].sum())]], columns=["fw", *WEIGHTS, "likely", "n"])

    return bins.groupBy("fw").applyInPandas(fitted, "fw string, " + ", ".join(f"{w} double" for w in WEIGHTS) + ", likely int, n double")


def _common(f: str):
    q, x, u = QUANTITIES[f], F.col(f"{f}_x"), F.col(f"{f}_u")
    out = F.lit(None).cast("double")
    for unit, (a, b) in q.units.items():
        out = F.when(u == unit, x * a + b).otherwise(out)
    return out


def _firmware_around(rows: DataFrame) -> DataFrame:
    """Adds `before` and `after`: the vehicle's nearest known firmware by event time on each side, for rows without one."""
    r = rows.withColumns({"_b": F.floor(F.col("at") / BLOCK_S), "_k": F.when(F.col("fw").isNotNull(), F.struct("at", "fw"))})
    r = blocked_running(r, "vin", "_b", ["at", "raw_id", "record_no"], {}, {"_p": "_k"})
    r = r.withColumns({"_nb": -F.col("_b"), "_nat": -F.col("at"), "_k": F.when(F.col("fw").isNotNull(), F.struct((-F.col("at")).alias("at"), "fw"))})
    r = blocked_running(r, "vin", "_nb", ["_nat", "raw_id", "record_no"], {}, {"_n": "_k"})
    return r.withColumns({"before": F.col("_p.fw"), "after": F.col("_n.fw")}).drop("_b", "_k", "_p", "_n", "_nb", "_nat")


RESULT = "raw_id long, record_no int, vin string, field_name string, value double, unit string, written boolean, posterior double, uncertain boolean"


def common_units(oem_raw: DataFrame, telemetry: DataFrame | None = None) -> DataFrame:
    """One row per present reading of the four oem_b fields, in °C, km, km/h and percent, with the unit it was recorded in.

    A unit written in the value decides. Otherwise the reading's posterior over the units does: weights of the units
    among the readings of the same firmware (fitted as a mixture on the log scale whose components are the common
    distribution, taken from oem_a, oem_c and readings with written units, offset by the conversion factors), times the
    density of the value under each unit; odometers count relative to the vehicle's largest `odo_km` in `telemetry`. A
    record without firmware is a mixture: over those next to it in the vehicle's time first, then over all, weighed by
    how well the record's readings fit together. Of all firmwares those that agree in the most likely unit of every field
    count as one, so a row has at most 2 + 81 candidates however many firmwares there are. `uncertain` marks posteriors
    under 0.9.

    Bodies are parsed once, into a table that the histograms, the firmwares around and the result read. Every record of
    a body has its readings (`record_no`). Null bodies and bodies that do not parse have no row; a reading of 0 takes the
    unit of its firmware; rows of other OEMs are only the reference; repeated records give repeated rows; an empty table
    gives no row.
    """
    rows = cut(readings(oem_raw))
    known = reference(oem_raw)
    odo = known.select("vin", F.col("odometerMiles").alias("odo")) if telemetry is None else telemetry.select("vin", F.col("odo_km").alias("odo"))
    refs = maybe_broadcast(cut(odo.where("odo > 0 and vin is not null").groupBy("vin").agg(F.max("odo").alias("ref"))))
    mix = base_densities(rows, known, refs)
    weights = cut(firmware_weights(rows.join(refs, "vin", "left"), mix))
    kinds = weights.groupBy("likely").agg(F.sum("n").alias("n"), *((F.sum(F.col(w) * F.col("n")) / F.sum("n")).alias(w) for w in WEIGHTS)).orderBy("likely").toPandas()  # at most 81 rows
    general = kinds[WEIGHTS].to_numpy(float) if len(kinds) else np.full((1, len(WEIGHTS)), 1 / 3)
    share = kinds["n"].to_numpy(float) / kinds["n"].sum() if len(kinds) else np.ones(1)
    side = maybe_broadcast(weights)
    around = rows.where("vin is null").unionByName(_firmware_around(rows.where("vin is not null")), allowMissingColumns=True).join(refs, "vin", "left")
    of = lambda name: side.select(F.col("fw").alias(f"_{name}"), F.array(*WEIGHTS).alias(f"w_{name}"))
    for name in ("fw", "before", "after"):
        key = F.col("fw") if name == "fw" else F.when(F.col("fw").isNull(), F.col(name))
        around = around.join(of(name), key == F.col(f"_{name}"), "left").drop(f"_{name}")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            bare_fw = pdf["fw"].isna().to_numpy()
            stated = [np.array([w if w is not None else [np.nan] * len(WEIGHTS) for w in pdf[f"w_{c}"]], float) for c in ("fw", "before", "after")]
            stated[0][~bare_fw & np.isnan(stated[0][:, 0])] = 1 / 3  # a firmware none of whose readings tells
            alone = bare_fw  # rows that the general kinds are candidates for
            ref, like, at = pdf["ref"].to_numpy(float), {}, 0
            place = {}
            for f, q in QUANTITIES.items():
                x = pdf[f"{f}_x"].to_numpy(float)
                li = mix.likelihood(f, x, ref)
                li[~(np.isfinite(x) & pdf[f"{f}_u"].isna().to_numpy())] = 1.0
                like[f], place[f] = li, slice(at, at + len(q.units))
                at += len(q.units)
            total = {f: np.zeros_like(like[f]) for f in QUANTITIES}
            weighed = np.zeros(n)
            candidates = [(w, np.where(np.isnan(w[:, 0]), 0.0, 1.0)) for w in stated]
            candidates += [(np.broadcast_to(g, (n, len(WEIGHTS))), np.where(alone, 1e-3 * s, 0.0)) for g, s in zip(general, share)]
            for w, prior in candidates:
                on = np.flatnonzero(prior > 0)
                if not len(on):
                    continue
                joint = {f: like[f][on] * w[on][:, place[f]] for f in QUANTITIES}
                each = prior[on] * np.prod([j.sum(axis=1) for j in joint.values()], axis=0)
                weighed[on] += each
                for f, j in joint.items():
                    total[f][on] += each[:, None] * j / np.maximum(j.sum(axis=1, keepdims=True), 1e-300)
            for f, q in QUANTITIES.items():
                x = pdf[f"{f}_x"].to_numpy(float)
                post = total[f] / np.maximum(weighed, 1e-300)[:, None]
                units = np.array(list(q.units))
                written = pdf[f"{f}_u"].notna().to_numpy()
                unit = np.where(written, pdf[f"{f}_u"].to_numpy(object), units[post.argmax(axis=1)])
                sure = np.where(written, 1.0, post.max(axis=1))
                a, b = (np.array([q.units[u][i] for u in unit]) for i in (0, 1))
                out = pd.DataFrame({"raw_id": pdf["raw_id"], "record_no": pdf["record_no"], "vin": pdf["vin"], "field_name": f, "value": x * a + b, "unit": unit, "written": written, "posterior": sure, "uncertain": sure < SURE})
                yield out[np.isfinite(x)]

    return around.mapInPandas(run, RESULT)


def other_units(common: DataFrame) -> DataFrame:
    """raw_id and field_name of the readings whose unit is not the one their key stands for."""
    stands = F.create_map(*(F.lit(x) for f, q in QUANTITIES.items() for x in (f, q.key_unit)))
    return common.where(F.col("unit") != stands[F.col("field_name")]).select("raw_id", "field_name")
