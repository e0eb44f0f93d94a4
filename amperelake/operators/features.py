"""Feature tables over trailing local days, labels ahead of them, and measures of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperelake.common import cut
from amperelake.operators.rolling import local_day
from amperelake.operators.windows import previous


def daily_partials(messages: DataFrame) -> DataFrame:
    """Per vehicle and local day the sums that the trailing features are made of; one row a day, however many messages."""
    r = previous(messages, ["hv_interlock_ok"])
    td = F.col("pack_temp_max_c").cast("double") - F.col("ambient_c").cast("double")
    imb = (F.col("cell_v_max_mv") - F.col("cell_v_min_mv")).cast("double")
    flap = (F.col("hv_interlock_ok") != F.col("prev_hv_interlock_ok")).cast("int")
    soc = F.col("soc_pct").cast("double")
    iso = F.col("isolation_kohm").cast("double")
    x = F.pmod(F.col("ts_event_ms") + 19_800_000, F.lit(86_400_000)) / 3_600_000.0  # hour of the local day

    def line(y, name):
        return [F.regr_count(y, x).alias(f"{name}_ln"), F.regr_avgx(y, x).alias(f"{name}_lx"), F.regr_avgy(y, x).alias(f"{name}_ly"), F.regr_sxx(y, x).alias(f"{name}_lxx"), F.regr_sxy(y, x).alias(f"{name}_lxy")]

    return r.groupBy("vin", local_day("ts_event_ms").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(td).alias("td_sum"), F.count(td).alias("td_n"), F.max(td).alias("td_max"),
        F.sum(imb).alias("imb_sum"), F.count(imb).alias("imb_n"), F.max(imb).alias("imb_max"),
        F.min(F.col("isolation_kohm").cast("double")).alias("iso_min"), F.sum(F.col("isolation_kohm").cast("double")).alias("iso_sum"),
        F.sum((~F.col("hv_interlock_ok")).cast("int")).alias("open_n"), F.sum(F.coalesce(flap, F.lit(0))).alias("flaps"),
        F.min(F.col("aux_12v_v").cast("double")).alias("aux_min"), F.sum(F.col("aux_12v_v").cast("double")).alias("aux_sum"),
        F.sum(soc).alias("soc_sum"), F.sum((soc > 80).cast("int")).alias("soc_high"),
        F.min(F.when(F.size("dtc") > 0, F.col("ts_event_ms"))).alias("first_dtc"),
        *line(td, "td"), *line(imb, "imb"), *line(iso, "iso"),
    )


def _slope(name: str, w) -> Column:
    """Least-squares slope per hour over the frame's days (at most a few), from their counts, means and centred sums."""
    parts = F.collect_list(F.struct("_d", *(F.coalesce(f"{name}_{k}", F.lit(0.0)).cast("double").alias(k) for k in ("ln", "lx", "ly", "lxx", "lxy")))).over(w)
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy")))

    def add(a, e):
        n = a["n"] + e["ln"]
        dx, dy = e["lx"] + (e["_d"] - F.col("_d")) * 24.0 - a["x"], e["ly"] - a["y"]
        share = F.coalesce(F.try_divide(e["ln"], n), F.lit(0.0))
        both = a["n"] * share
        return F.struct(n.alias("n"), (a["x"] + dx * share).alias("x"), (a["y"] + dy * share).alias("y"), (a["xx"] + e["lxx"] + dx * dx * both).alias("xx"), (a["xy"] + e["lxy"] + dx * dy * both).alias("xy"))

    return F.aggregate(parts, zero, add, lambda a: F.when(a["n"] >= 3, F.try_divide(a["xy"], a["xx"])))


def trailing_features(daily: DataFrame, days: int = 3, horizon_days: int = 7) -> DataFrame:
    """One row per vehicle-day with messages: features of the `days` local days up to it, `label` whether a fault code comes
    within `horizon_days` after it, `lead_h` to it. Days after the vehicle's first code are left out, so nothing of the future is used.
    """
    num = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long")
    d = daily.withColumn("_d", num)
    w = Window.partitionBy("vin").orderBy("_d").rangeBetween(-(days - 1), 0)
    first = F.min("first_dtc").over(Window.partitionBy("vin"))
    mean = lambda s, n: F.try_divide(F.sum(s).over(w), F.sum(n).over(w))
    end = (F.col("_d") + 1) * 86_400_000 - 19_800_000
    out = d.select(
        "vin", "day", first.alias("_f"), end.cast("long").alias("_end"),
        mean("td_sum", "td_n").alias("td_mean"), F.max("td_max").over(w).alias("td_max"), F.try_divide("td_sum", "td_n").alias("td_mean_24h"),
        mean("imb_sum", "imb_n").alias("imb_mean"), F.max("imb_max").over(w).alias("imb_max"), F.try_divide("imb_sum", "imb_n").alias("imb_mean_24h"),
        F.min("iso_min").over(w).alias("iso_min"), mean("iso_sum", "n").alias("iso_mean"), F.col("iso_min").alias("iso_min_24h"),
        mean("open_n", "n").alias("hvil_false_frac"), F.sum("flaps").over(w).alias("hvil_flaps"),
        _slope("td", w).alias("td_slope_per_h"), _slope("imb", w).alias("imb_slope_per_h"), _slope("iso", w).alias("iso_slope_per_h"),
        F.min("aux_min").over(w).alias("aux_min"), mean("aux_sum", "n").alias("aux_mean"), mean("soc_sum", "n").alias("soc_mean"), mean("soc_high", "n").alias("soc_gt80_frac"),
    )
    ahead = F.col("_f").isNotNull() & (F.col("_f") < F.col("_end") + horizon_days * 86_400_000)
    out = out.where(F.col("_f").isNull() | (F.col("_f") >= F.col("_end")))
    return out.withColumns({"label": ahead.cast("int"), "lead_h": F.when(ahead, (F.col("_f") - F.col("_end")) / 3_600_000)}).drop("_f", "_end")


def charging_health(messages: DataFrame, least_soc: float = 20.0) -> DataFrame:
    """vin, coulomb_soh: the median over charging stretches (messages on end in a charging state) with a rise of at least
    `least_soc` of charge in Ah over the rise, as a share of nominal `cap_ah`; null where there is none."""
    from amperelake.operators.windows import running, trapezoid

    r = cut(trapezoid(messages).select("vin", "ts_event_ms", "seq", "soc_pct", "charge_state", "cap_ah", "step_ah"))  # each carry over blocks reads its input twice
    r = r.withColumn("_c", (F.col("charge_state").isin(2, 3)).cast("int"))
    r = previous(r, ["_c"])
    r = running(r, {"_island": (F.coalesce(F.col("prev__c"), F.lit(-1)) != F.col("_c")).cast("int")})
    first = F.col("prev__c") == F.col("_c")
    runs = r.where("_c = 1").groupBy("vin", "_island", "cap_ah").agg(
        F.min_by("soc_pct", F.struct("ts_event_ms", "seq")).alias("s0"), F.max_by("soc_pct", F.struct("ts_event_ms", "seq")).alias("s1"), F.sum(F.when(first, F.abs("step_ah"))).alias("ah")
    )
    soh = F.when(F.col("s1") - F.col("s0") >= least_soc, F.col("ah") / ((F.col("s1") - F.col("s0")).cast("double") / 100) / F.col("cap_ah") * 100)
    return runs.groupBy("vin").agg(F.median(soh).alias("coulomb_soh"))


def split_by_vehicle(df: DataFrame, key: str = "vin", shares: tuple[int, int] = (60, 20)) -> DataFrame:
    """Adds `part` (train, val, test) by a hash of the vehicle, so that no vehicle is in two parts."""
    b = F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(100))
    return df.withColumn("part", F.when(b < shares[0], "train").when(b < sum(shares), "val").otherwise("test"))


def error_measures(df: DataFrame, truth: str, guess: str, group: list[str] | None = None) -> DataFrame:
    """Mean absolute error and its 90th percentile, per group."""
    e = F.abs(F.col(truth) - F.col(guess))
    agg = (F.count(e).alias("n"), F.avg(e).alias("mae"), F.percentile(e, F.lit(0.9)).alias("p90"))
    return df.groupBy(*group).agg(*agg) if group else df.agg(*agg)


def weekly_features(messages: DataFrame) -> DataFrame:
    """Per vehicle and week since its first local day: equivalent full cycles (charge moved over twice the nominal `cap_ah`),
    mean temperatures, share of messages over 80 % of charge, mean charging power. Null where nothing was measured."""
    from amperelake.operators.windows import trapezoid

    m = trapezoid(messages).withColumn("_day", local_day("ts_event_ms"))
    first = messages.groupBy("vin").agg(F.min(local_day("ts_event_ms")).alias("_first"))
    d = lambda c: F.col(c).cast("double")
    m = m.join(first, "vin").withColumn("week", F.floor(F.datediff("_day", "_first") / 7).cast("int"))
    return m.groupBy("vin", "week").agg(
        F.try_divide(F.sum(F.abs("step_ah")), 2 * F.max("cap_ah")).alias("efc_week"), F.avg(d("pack_temp_max_c")).alias("temp_mean"), F.avg(d("ambient_c")).alias("ambient_mean"),
        F.avg((d("soc_pct") > 80).cast("double")).alias("soc_gt80_frac"), F.avg(d("charge_power_kw")).alias("charge_kw_mean"),
    )


def leakage_check(columns: list[str], observable: set[str], labels: set[str] = frozenset()) -> None:
    """Raises if a table of features has columns that are not observable (a label's source, the future); `labels` may be there."""
    if bad := sorted(set(columns) - observable - labels):
        raise ValueError(f"unexpected columns: {bad}")


def bootstrap_interval(df: DataFrame, value: str, rounds: int = 1000, seed: int = 1, id_col: str = "vin") -> DataFrame:
    """2.5 and 97.5 % points of the mean over Poisson resamples, drawn from a hash of row id and round (repeatable).

    A task adds its rows into `rounds` sums as it reads them, so `rounds` rows per task are all that is shuffled. Null
    values are left out; without rows both ends are null.
    """
    import numpy as np

    cuts = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])  # of the Poisson distribution with mean 1
    salt = (np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed * 0x5851F42D4C957F2D % 2**64)

    def run(batches):
        import pandas as pd

        w, wv = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            h, v = b["h"].to_numpy(np.int64).view(np.uint64), b["v"].to_numpy(float)
            for i in range(0, len(h), 512):
                with np.errstate(over="ignore"):
                    z = h[i : i + 512, None] ^ salt
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                n = np.searchsorted(cuts, (z >> np.uint64(11)) / 2.0**53, "right")
                w += n.sum(axis=0)
                wv += v[i : i + 512] @ n
        yield pd.DataFrame({"r": np.arange(rounds), "w": w, "wv": wv})

    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(value).cast("double").alias("v"))
    means = rows.mapInPandas(run, "r int, w double, wv double").groupBy("r").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def precision_recall(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, precision, recall at each distinct score from the highest down; counts per score are summed over ranges of
    scores first, so no single task sorts all rows."""
    from amperelake.operators.prefix import blocked_running

    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("hit"), F.count(F.lit(1)).alias("all"))
    per = per.withColumns({"_one": F.lit(0), "_low": -F.col("score")})
    per = per.withColumn("_blk", F.floor(F.col("_low") * 16))
    run = blocked_running(per, "_one", "_blk", ["_low"], {"tp": "hit", "n": "all"})
    total = per.groupBy("_one").agg(F.sum("hit").alias("positives"))  # one row
    return run.join(F.broadcast(total), "_one").select("score", "hit", (F.col("tp") / F.col("n")).alias("precision"), F.try_divide("tp", "positives").alias("recall"), F.try_divide("hit", "positives").alias("gain"))


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum(F.col("gain") * F.col("precision")).alias("average_precision"))


def operating_point(curve: DataFrame, least_precision: float = 0.5) -> DataFrame:
    """The threshold with the largest recall among those with at least `least_precision`."""
    ok = curve.where(F.col("precision") >= least_precision)
    return ok.agg(F.max_by(F.struct("score", "precision", "recall"), F.struct("recall", "score")).alias("p")).select(F.col("p.score").alias("threshold"), "p.precision", "p.recall")


def quantiles_of_buckets(buckets: DataFrame, group: list[str], bound: str, n: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """For each share the smallest bucket bound whose cumulative count reaches it."""
    w = Window.partitionBy(*group)
    c = buckets.withColumns({"_cum": F.sum(n).over(w.orderBy(bound)), "_all": F.sum(n).over(w)})
    return c.groupBy(*group).agg(*(F.min(F.when(F.col("_cum") >= F.col("_all") * s, F.col(bound))).alias(f"p{round(s * 100)}") for s in shares))
