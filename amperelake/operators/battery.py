"""State of health from charge sessions: observations, a Kalman fold per pack, remaining life, summaries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperelake.common import cut
from amperelake.operators.registry import enrich, top_by_group
from amperelake.sources.versions import VersionedStore

# Gates of an observation, noise of charge-level readings and of the state.
MIN_DELTA, TEMPS, MIN_SAMPLES, PLAUSIBLE = 20.0, (15.0, 35.0), 10, (50.0, 120.0)
SOC_SIGMA, SOC_SIGMA_RESTED, GAIN_SIGMA = 1.0, 0.5, 0.005
LEVEL_VAR, RATE_VAR, RATE_PRIOR = 0.01**2, 0.0005**2, 0.02**2
END_OF_LIFE, MIN_POINTS, MIN_SPAN_DAYS = 80.0, 3, 14.0


def _finite(c: str) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))


def observed(sessions: DataFrame) -> DataFrame:
    """Adds `reason`, `soh_pct` and `variance` to charge sessions with `nominal_ah` (null: unknown vehicle).

    The reasons are tried in order, the first that holds is given; where none does, the charge counted over the change of
    charge level gives the capacity as a share of the nominal one, with the variance of both readings.
    """
    d = F.col("soc_end_pct") - F.col("soc_start_pct")
    soh = F.abs("delta_ah") / (d / 100) / F.col("nominal_ah") * 100
    finite = _finite("soc_start_pct") & _finite("soc_end_pct") & _finite("delta_ah") & _finite("temp_min_c") & _finite("temp_max_c")
    reason = (
        F.when(~F.coalesce(_finite("nominal_ah") & (F.col("nominal_ah") > 0), F.lit(False)), "unknown_nominal_capacity")
        .when(~finite, "non_finite_input")
        .when((F.col("delta_ah") >= 0) | (d <= 0), "not_a_charge")
        .when(d < MIN_DELTA, "delta_soc_below_min")
        .when((F.col("temp_min_c") < TEMPS[0]) | (F.col("temp_max_c") > TEMPS[1]), "temperature_out_of_range")
        .when(F.col("gaps") > 0, "telemetry_gaps")
        .when(F.col("samples") < MIN_SAMPLES, "too_few_samples")
        .when(~soh.between(*PLAUSIBLE), "implausible_soh")
    )
    sigma = F.when(F.col("v_rest_before").isNotNull(), SOC_SIGMA_RESTED).otherwise(SOC_SIGMA)
    variance = F.pow(soh * F.sqrt(F.lit(2.0)) * sigma / d, 2) + F.pow(soh * GAIN_SIGMA, 2)
    out = sessions.withColumn("reason", reason)
    return out.withColumns({"soh_pct": F.when(F.col("reason").isNull(), soh), "variance": F.when(F.col("reason").isNull(), variance)})


FILTERED = "pack string, as_of_ms long, soh_pct double, rate_pct_per_day double, p00 double, p01 double, p11 double, n int"


def kalman(observations: DataFrame, pack: str = "vin", at: str = "end_ms", tie: str = "session_id", before: DataFrame | None = None) -> DataFrame:
    """The state after each observation (level and daily rate with covariance), folded per pack in order of `at`, `tie`,
    from the states `before` (one row per pack, as returned here) where there are any.

    The fold is streamed over sorted partitions with a few numbers of state, so a pack's history is never held; sessions,
    not messages, are folded, a few a day. Observations with nulls in pack, soh_pct, variance or `at` are left out.
    """
    rows = observations.select(F.col(pack).cast("string").alias("pack"), F.col(at).alias("at"), F.col(tie).alias("tie"), "soh_pct", "variance").dropna(subset=["pack", "at", "soh_pct", "variance"])
    if before is not None:
        rows = before.select("pack", F.col("as_of_ms").alias("at"), F.struct("soh_pct", "rate_pct_per_day", "p00", "p01", "p11", "n").alias("kept")).unionByName(rows, allowMissingColumns=True)
    else:
        rows = rows.withColumn("kept", F.lit(None).cast("struct<soh_pct: double, rate_pct_per_day: double, p00: double, p01: double, p11: double, n: int>"))
    rows = rows.select("pack", "at", "tie", "soh_pct", "variance", *(F.col(f"kept.{c}").alias(f"k_{c}") for c in ("soh_pct", "rate_pct_per_day", "p00", "p01", "p11", "n")))
    rows = rows.repartition("pack").sortWithinPartitions("pack", F.col("k_n").isNull(), "at", "tie")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        now, x, v, p, q, r, clock, n = None, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0
        for b in batches:
            out = []
            for pack_, t, y, noise, kx, kv, kp, kq, kr, kn in zip(*(b[c] for c in ("pack", "at", "soh_pct", "variance", "k_soh_pct", "k_rate_pct_per_day", "k_p00", "k_p01", "k_p11", "k_n"))):
                if kn == kn and kn is not None:
                    now, x, v, p, q, r, clock, n = pack_, kx, kv, kp, kq, kr, int(t), int(kn)
                    continue
                if pack_ != now:
                    now, x, v, p, q, r, clock, n = pack_, y, 0.0, noise, 0.0, RATE_PRIOR, t, 1
                else:
                    days = max(0.0, (t - clock) / 86_400_000)
                    x, p, q, r = x + v * days, p + 2 * days * q + days * days * r + LEVEL_VAR * days, q + days * r, r + RATE_VAR * days
                    total, miss = p + noise, y - x
                    gain, drift = p / total, q / total
                    x, v, r = x + gain * miss, v + drift * miss, r - drift * q
                    p, q, clock, n = (1 - gain) * p, (1 - gain) * q, max(clock, t), n + 1
                out.append((now, clock, x, v, p, q, r, n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FILTERED.split(", ")])

    return rows.mapInPandas(run, FILTERED)


class HealthStore(VersionedStore):
    """State of health kept between batches of observations: all estimates so far, and each pack's newest state.

    An observation (pack and session) that is there already is passed over, so sessions that are delivered again, in one
    batch or in a later one, change nothing; a batch id that was applied is not applied again.
    """

    KEYS = "pack string, session_id string"

    def _table(self, m: dict | None, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in m[name])) if m else self.spark.createDataFrame([], schema)

    def estimates(self) -> DataFrame:
        return self._table(self.latest()[1], "estimates", FILTERED)

    def states(self) -> DataFrame:
        return self._table(self.latest()[1], "states", FILTERED)

    def apply(self, observations: DataFrame, batch_id: int) -> int:
        """Take in accepted observations (vin, session_id, end_ms, soh_pct, variance); returns the version made."""
        n, m = self.latest()
        if (had := self.applied(batch_id)) is not None:
            return had
        o = observations.dropDuplicates(["vin", "session_id"])
        known = self._table(m, "keys", self.KEYS).withColumnRenamed("pack", "vin")
        o = cut(o.join(known, ["vin", "session_id"], "left_anti"))
        name = uuid.uuid4().hex
        states = self._table(m, "states", FILTERED)
        new = cut(kalman(o, before=states))
        o.select(F.col("vin").alias("pack"), "session_id").write.parquet(f"{self.path}/keys/{name}")
        new.write.parquet(f"{self.path}/estimates/{name}")
        newest = states.unionByName(new).groupBy("pack").agg(F.max_by(F.struct(*new.columns), "n").alias("s")).select("s.*")
        newest.write.parquet(f"{self.path}/states/{name}")
        more = {k: [*(m[k] if m else []), f"{k}/{name}"] for k in ("keys", "estimates")}
        return self.publish(n, batch_id, {"groups": {"states": f"states/{name}"}, "states": [f"states/{name}"], **more})


def gated(sessions: DataFrame, registry: DataFrame) -> DataFrame:
    """Charge sessions with `reason`: unregistered_vin, tenant_mismatch (where the session names a tenant), or that of
    `observed`, with `soh_pct` and `variance` where there is none. `registry`: vin, tenant_id, capacity_kwh, nominal_voltage_v."""
    reg = registry.select("vin", F.col("tenant_id").alias("_tenant"), (F.col("capacity_kwh") * 1000 / F.nullif("nominal_voltage_v", F.lit(0.0))).alias("nominal_ah"))
    j = observed(enrich(sessions.withColumn("_had", F.coalesce("tenant_id", F.lit(""))), reg, "vin", ("_tenant", "nominal_ah")))
    why = F.when(~F.col("registered"), "unregistered_vin").when((F.col("_had") != "") & (F.col("_had") != F.coalesce("_tenant", F.lit(""))), "tenant_mismatch").otherwise(F.col("reason"))
    out = j.withColumn("reason", why).drop("_tenant", "_had", "registered")
    return out.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("soh_pct", "variance")})


def history(estimates: DataFrame, pack_of: DataFrame, most: int = 500) -> DataFrame:
    """The newest `most` estimates of each vehicle's present pack, oldest first (`place`). `estimates`: vin, pack, as_of_ms;
    `pack_of`: vin, current_pack_id (null: the pack of the vehicle's newest estimate)."""
    newest = estimates.groupBy("vin").agg(F.max_by("pack", F.struct("as_of_ms", "n")).alias("_last"))
    e = estimates.join(newest, "vin").join(pack_of.select("vin", F.col("current_pack_id").alias("_now")), "vin", "left")
    e = e.where(F.col("pack") == F.coalesce("_now", "_last")).drop("_now", "_last")
    e = top_by_group(e, ["vin"], [F.desc("as_of_ms"), F.desc("n")], most)
    return e.withColumn("place", F.row_number().over(Window.partitionBy("vin").orderBy(F.desc("rank")))).drop("rank")


def with_interval(states: DataFrame) -> DataFrame:
    """Adds the 95 % interval of the level."""
    half = 1.96 * F.sqrt("p00")
    return states.withColumns({"ci_low": F.col("soh_pct") - half, "ci_high": F.col("soh_pct") + half})


def remaining_life(points: DataFrame, key: str, at: str, value: str, now_ms: int, end_of_life: float = END_OF_LIFE, least_days: float = MIN_SPAN_DAYS) -> DataFrame:
    """key, days, fade_per_sqrt_day: least squares of value over the root of days since the key's first point.

    Keys with under three points, under `least_days`, or no fade have no row.
    """
    p = points.where(F.col(value).isNotNull() & F.col(at).isNotNull())
    first = p.groupBy(key).agg(F.min(at).alias("_t0"))  # an aggregate and a join: a key's points need not be in one task
    p = p.join(first, key).withColumn("_d", (F.col(at) - F.col("_t0")) / 86_400_000)
    fit = p.groupBy(key, "_t0").agg(
        F.count(F.lit(1)).alias("n"), F.max("_d").alias("span"), F.regr_slope(F.col(value), F.sqrt("_d")).alias("b"), F.regr_intercept(F.col(value), F.sqrt("_d")).alias("a")
    )
    fit = fit.where((F.col("n") >= MIN_POINTS) & (F.col("span") >= least_days) & (F.col("b") < 0))
    days = F.pow((end_of_life - F.col("a")) / F.col("b"), 2) - (F.lit(now_ms) - F.col("_t0")) / 86_400_000
    return fit.select(key, F.greatest(F.lit(0.0), days).alias("days"), (-F.col("b")).alias("fade_per_sqrt_day"))


def histogram(values: DataFrame, col: str, width: float, group: list[str] | None = None) -> DataFrame:
    """Counts per bin of `width` (the bin is named by its lower bound); nulls are left out."""
    return values.where(F.col(col).isNotNull()).groupBy(*(group or []), (F.floor(F.col(col) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
