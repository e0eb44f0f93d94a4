"""Wrong readings of a source: spikes by phase-space thresholding, stuck values by zero differences, impossible ones by bounds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperelake.operators.prefix import blocked_running

#: Successive readings with exactly one value that make a stuck run.
STUCK = 8
#: Readings on each side that say what surrounds a reading, and readings of a neighbouring block seen besides one's own.
REACH = 6
HALO = 64
BLOCK = 16_384
#: The ellipsoids' half axes are the universal threshold sqrt(2 ln n) times this, in robust deviations of the operating state.
AXES = 1.4
#: Most rounds; they end when one finds nothing new.
ROUNDS = 8


def scale(x: np.ndarray, floor: float) -> float:
    """Robust standard deviation (median absolute deviation), at least `floor`."""
    x = x[np.isfinite(x)]
    return floor if x.size == 0 else max(floor, 1.4826 * float(np.median(np.abs(x - np.median(x)))))


def stuck(x: np.ndarray, least: int = STUCK) -> np.ndarray:
    """Readings in runs of at least `least` zero differences plus one; missing readings end a run."""
    if x.size == 0:
        return np.zeros(0, bool)
    new = np.concatenate([[True], ~(x[1:] == x[:-1])])
    run = np.cumsum(new) - 1
    return (np.bincount(run)[run] >= least) & np.isfinite(x)


def robust_fit(a: np.ndarray, y: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Iteratively reweighted least squares with bounded influence; returns the fitted values."""
    w = np.ones(len(y))
    fit = np.full(len(y), np.median(y))
    for _ in range(rounds):
        r = y - fit
        s = scale(r, 1e-6)
        w = 1.0 / (1.0 + (r / (2.5 * s)) ** 2)
        aw = a * w[:, None]
        fit = a @ np.linalg.solve(aw.T @ a + 1e-9 * len(y) * np.eye(a.shape[1]), aw.T @ y)
    return fit


def surroundings(x: np.ndarray, ok: np.ndarray, state: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """For each reading, the median of the `reach` good readings of its state before it, and of those after it.

    Where a side has fewer than three (their median would not be robust), it takes the other side's.
    """
    return around(x, ok, state, reach)[:2]


def around(x: np.ndarray, ok: np.ndarray, state: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """`surroundings`, and of the good readings of its state the last and the one before it, the next and the one after it.

    A state with fewer than three good readings has no surroundings (NaN); a side that is missing takes the other's. All
    states are laid out one after the other with `reach` blanks between, so no window goes from one into the next.
    """
    if not len(x):
        return (x,) * 6
    order = np.argsort(state, kind="stable")
    s, good = state[order], ok[order]
    number = np.cumsum(np.append(0, s[1:] != s[:-1]))
    per = np.bincount(number, weights=good).astype(int)
    begin = np.append(0, np.cumsum(per + reach)[:-1])[number]  # blanks of each reading's state in the layout
    lo = np.cumsum(good) - good - np.append(0, np.cumsum(per)[:-1])[number]
    hi = lo + good
    v = np.full(per.sum() + (len(per) + 1) * reach, np.nan)
    v[(begin + reach + lo)[good]] = x[order][good]
    med = _nanmedian(np.lib.stride_tricks.sliding_window_view(v, reach))
    here = begin + reach
    back = np.empty(len(x), int)
    back[order] = np.arange(len(x))
    left, right, p1, p2, n1, n2 = (q[back] for q in (med[begin + lo], med[here + hi], v[here + lo - 1], v[here + lo - 2], v[here + hi], v[here + hi + 1]))
    p2, n2 = np.where(np.isnan(p2), p1, p2), np.where(np.isnan(n2), n1, n2)
    both = lambda a, b: (np.where(np.isnan(a), b, a), np.where(np.isnan(b), a, b))
    return *both(left, right), *both(p1, n1), *both(p2, n2)


def _nanmedian(win: np.ndarray) -> np.ndarray:
    s = np.sort(win, axis=1)
    n = np.sum(~np.isnan(s), axis=1)
    i = np.arange(len(s))
    out = (s[i, np.maximum((n - 1) // 2, 0)] + s[i, n // 2]) / 2
    return np.where(n >= 3, out, np.nan)


def two_sided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smaller of two differences where they have one sign, else 0: what lies on one side only (a lasting change of
    level, the neighbour of a spike) vanishes."""
    out = np.where(np.sign(a) == np.sign(b), np.where(np.abs(a) < np.abs(b), a, b), 0.0)
    return np.where(np.isfinite(out), out, 0.0)


def phase_space(u: np.ndarray, d1: np.ndarray, d2: np.ndarray, axes: float = AXES) -> np.ndarray:
    """How far outside the ellipsoids over value, first and second difference (each in its own robust deviations) each
    reading is: the largest of its three squared distances, over 1 outside.

    Half axes are `axes` times the universal threshold of the number of readings; value and second difference of a series
    go together, so their ellipse is turned by the slope between them.
    """
    lam = axes * math.sqrt(2 * math.log(max(len(u), 5)))
    u, d1, d2 = u / lam, d1 / lam, d2 / lam
    slope = math.atan2(float(u @ d2), float(u @ u) or 1e-12)
    c, t = math.cos(slope), math.sin(slope)
    spread = math.sqrt(1 + abs(math.sin(2 * slope)))  # deviation of the sum of two quantities that go together
    va, vb = (u * c + d2 * t) / spread, d2 * c - u * t
    return np.maximum(u**2 + d1**2, va**2 + vb**2)


def wrong(x: np.ndarray, state: np.ndarray, bad: np.ndarray, floors: dict, level: np.ndarray | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """Flags of the readings `x` of one source in order: impossible (`bad`), stuck, or outside the ellipsoids.

    `level` is what other quantities explain of x; it is taken off first. A reading's value is its deviation from the good
    readings before and after it of the same `group` (`state` if none is given), its differences are those to the last
    and next good ones, all `two_sided`. They are scaled by their robust deviations within the state, at least `floors`
    of it; a reading whose group is too small is held against the readings of any group, by twice the largest deviation.

    A round flags what lies outside and is not nearer to the ellipsoid than the reading before or after it; flagged
    readings are no good ones in the next round, so what only stood beside a spike comes back inside. In the end a flag
    stays only if the reading is outside the ellipsoids of the good readings that are left.
    """
    held = stuck(x)
    out = bad | held
    rest = x - level if level is not None else x
    group = state if group is None else group
    states, of = np.unique(state, return_inverse=True)

    def distance(ok):
        near = around(rest, ok, group)
        alone = np.isnan(near[0])
        if alone.any():
            wide = around(rest, ok, np.zeros(len(x), int))
            near = tuple(np.where(alone, p, q) for q, p in zip(near, wide))
        left, right, p1, n1, p2, n2 = near
        scaled = []
        for before, after in ((rest - left, rest - right), (rest - p1, rest - n1), (rest - 2 * p1 + p2, rest - 2 * n1 + n2)):
            usual = np.array([scale(before[(of == k) & ok & ~alone], floors.get(s, 1e-9)) for k, s in enumerate(states)])
            per = np.where(alone, 2 * usual.max(), usual[of]) if len(x) else np.ones(0)
            scaled.append(two_sided(before, after) / per)
        return phase_space(*scaled)

    for _ in range(ROUNDS):
        ok = ~out & np.isfinite(rest)
        far = np.where(ok, distance(ok), 0.0)
        beside = np.maximum(np.append(0.0, far[:-1]), np.append(far[1:], 0.0)) if len(far) else far
        new = (far > 1) & (far >= beside)
        if not new.any():
            break
        out = out | new
    spikes = out & ~bad & ~held
    if spikes.any():
        out = bad | held | (spikes & (distance(~out & np.isfinite(rest)) > 1))
    return out & np.isfinite(x)


def operating_state(charge_state: np.ndarray, speed: np.ndarray, both_sides: bool = False) -> np.ndarray:
    """0 standing, 1 driving, 2 AC, 3 DC. A halt within two readings of movement is driving, or only one with movement on both sides."""
    moving = np.nan_to_num(speed) > 0
    win = np.lib.stride_tricks.sliding_window_view(np.pad(moving, 2), 5)
    near = win.any(axis=1) if not both_sides else moving | (win[:, :2].any(axis=1) & win[:, 3:].any(axis=1))
    return np.where(charge_state == 2, 2, np.where(charge_state == 3, 3, np.where(near, 1, 0)))


def stretches(clock: np.ndarray, soc: np.ndarray) -> np.ndarray:
    """Number of the stretch each reading is in: a new one begins after a quarter of an hour or two points of charge level."""
    if len(clock) == 0:
        return np.zeros(0, int)
    gap = np.abs(np.diff(clock)) > 900_000
    jump = np.nan_to_num(np.abs(np.diff(soc))) > 2
    return np.concatenate([[0], np.cumsum(gap | jump)])


#: Least robust deviations by operating state: sensor resolution and ordinary noise, in volts, amperes, and log kilohm.
VOLT_FLOOR = {0: 0.6, 1: 1.6, 2: 0.6, 3: 0.6}
AMP_FLOOR = {0: 0.3, 1: 10.0, 2: 0.3, 3: 0.8}
LOG_FLOOR = {0: 0.06}
#: What no such pack can show: shares of the vehicle's own median voltage, amperes, kilohm.
VOLT_SHARE = (0.55, 1.5)
AMP_MOST = 900.0
ISOLATION = (1.0, 50_000.0)


def wrong_pack(volt: np.ndarray, amp: np.ndarray, soc: np.ndarray, power: np.ndarray, charge_state: np.ndarray, speed: np.ndarray, clock: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of one vehicle's voltage and current readings in order (NaN: missing, never flagged).

    The vehicle's own rest voltage over state of charge and its resistance are fitted robustly and taken off the voltage,
    its charging power is taken off the current; what remains is held against its surroundings in the same stretch. Where
    standing ends and driving begins is not sharp, so a current is wrong only if it is for either reading of the state.
    """
    state, strict, stretch = operating_state(charge_state, speed), operating_state(charge_state, speed, True), stretches(clock, soc)
    usual = float(np.nanmedian(volt)) if np.isfinite(volt).any() else 1.0
    bad_v, bad_a = (volt < VOLT_SHARE[0] * usual) | (volt > VOLT_SHARE[1] * usual) | (volt <= 0), np.abs(amp) >= AMP_MOST
    q = np.where(np.isfinite(soc), soc, np.nanmedian(soc) if np.isfinite(soc).any() else 50.0) / 100
    level_a = -np.where(np.isfinite(power), power, 0.0) * 1000 / max(usual, 1.0)
    wrong_a = np.logical_and(*(wrong(amp, s, bad_a & np.isfinite(amp), AMP_FLOOR, level=level_a, group=stretch * 4 + s) for s in (state, strict)))
    real = np.isfinite(amp) & (~wrong_a | stuck(amp)) & ~bad_a  # a wrong current says nothing about the voltage beside it
    before, after = surroundings(amp - level_a, real, state)
    usual_a = np.nan_to_num((before + after) / 2) + level_a
    load = np.where(real, amp, usual_a) / 100
    a = np.column_stack([np.ones(len(q)), q, q**2, q**3, load])
    fit = ~bad_v & np.isfinite(volt) & real
    level_v = np.full(len(volt), usual)
    if fit.sum() >= 30:
        y = robust_fit(a[fit], volt[fit])
        level_v = a @ np.linalg.lstsq(a[fit], y, rcond=None)[0]
    return wrong(volt, state, bad_v & np.isfinite(volt), VOLT_FLOOR, level=level_v, group=stretch), wrong_a


def wrong_isolation(kohm: np.ndarray) -> np.ndarray:
    """Flags of one vehicle's isolation readings in order; scatter is proportional, so logarithms are compared."""
    bad = (kohm <= ISOLATION[0]) | (kohm >= ISOLATION[1])
    x = np.log(np.where(bad, 1.0, np.maximum(kohm, 1e-9)))
    return wrong(x, np.zeros(len(x), int), bad, LOG_FLOOR) | (stuck(kohm) & np.isfinite(kohm))


def in_blocks(readings: DataFrame, order: str, width: int, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """`readings` (vin, `order`, ...) with their rank in the vehicle and the block `b` to work in; rows within `halo` of a
    block's border are in both blocks. A vehicle's blocks are of one `size`, at most `block`, so none is left with a few
    readings. Ranks come from block totals over ranges of `order`, so a hot vehicle is spread."""
    r = readings.where(f"vin is not null and {order} is not null").withColumns({"_range": F.floor(F.col(order) / width), "_one": F.lit(1)})
    r = blocked_running(r, "vin", "_range", [order], {"rank": "_one"}, whole={"_n": "rank"})
    r = r.withColumns({"rank": F.col("rank") - 1, "size": F.ceil(F.col("_n") / F.ceil(F.col("_n") / block))}).drop("_range", "_one")
    own, at = F.floor(F.col("rank") / F.col("size")), F.pmod("rank", "size")
    near = F.array_compact(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when((at >= F.col("size") - halo) & ((own + 1) * F.col("size") < F.col("_n")), own + 1)))
    return r.withColumn("b", F.explode(near)).drop("_n")


FOUND = "field_name string, vin string, ref_no long"


def wrong_telemetry(messages: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Wrong `pack_voltage_v` and `pack_current_a` of `messages` (one row per message): field_name, vin, ref_no (`seq`).

    A vehicle is worked in blocks of `block` readings by `seq`, with `halo` readings of the next ones around, so one task
    holds at most block + 2 halo readings and a stuck run is seen over block borders. Readings that are null or not a
    number are passed over; rows without vin or seq have no place in the order and are left out; a state with few
    readings is held against the vehicle's other readings; an empty input gives no row.
    """
    cols = ("soc_pct", "speed_kmh", "pack_voltage_v", "pack_current_a", "charge_state", "charge_power_kw", "ts_event_ms")
    r = in_blocks(messages.select("vin", "seq", *(F.col(c).cast("double") for c in cols)), "seq", 50_000, block, halo)

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("rank", kind="stable")
        col = {c: pdf[c].to_numpy(float) for c in cols}
        v, a = wrong_pack(col["pack_voltage_v"], col["pack_current_a"], col["soc_pct"], col["charge_power_kw"], col["charge_state"], col["speed_kmh"], np.nan_to_num(col["ts_event_ms"]))
        own, seq = (pdf["rank"] // pdf["size"]).to_numpy() == key[1], pdf["seq"].to_numpy()
        parts = [pd.DataFrame({"field_name": n, "vin": key[0], "ref_no": seq[f & own]}) for n, f in (("pack_voltage_v", v), ("pack_current_a", a))]
        return pd.concat(parts)

    return r.groupBy("vin", "b").applyInPandas(run, FOUND)


def wrong_rollup(minutes: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Wrong `isolation_min_kohm` of `minutes` (one row per minute), as `wrong_telemetry`; ref_no is `minute_start_ms`."""
    r = in_blocks(minutes.select("vin", "minute_start_ms", F.col("isolation_min_kohm").cast("double")), "minute_start_ms", 30 * 86_400_000, block, halo)

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("rank", kind="stable")
        f = wrong_isolation(pdf["isolation_min_kohm"].to_numpy(float)) & ((pdf["rank"] // pdf["size"]).to_numpy() == key[1])
        return pd.DataFrame({"field_name": "isolation_min_kohm", "vin": key[0], "ref_no": pdf["minute_start_ms"].to_numpy()[f]})

    return r.groupBy("vin", "b").applyInPandas(run, FOUND)
