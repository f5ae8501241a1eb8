"""Time series: integrals, downsampling, spectra, pulses and energy audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trapezoid(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Adds the running integral of each key's series."""
    w = Window.partitionBy(key).orderBy(t)
    step = F.coalesce((F.col(t) - F.lag(t).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2, F.lit(0.0))
    return df.withColumn("__s", step).withColumn("integral", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def impulse(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(t)
    part = (F.col(t) - F.lag(t).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return df.withColumn("__s", part).groupBy(key).agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias("impulse"))


def downsample(df: DataFrame, key: str, t: str, value: str, step: int) -> DataFrame:
    """Every ``step``-th sample, and the last and the peak of each series."""
    w = Window.partitionBy(key)
    n = F.row_number().over(w.orderBy(t))
    peak = F.row_number().over(w.orderBy(F.desc(F.abs(value)), t)) == 1
    return df.withColumns({"__n": n, "__p": peak, "__c": F.count("*").over(w)}).where(((F.col("__n") - 1) % step == 0) | F.col("__p") | (F.col("__n") == F.col("__c"))).drop("__n", "__p", "__c")


def true_peak(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.abs(value)).alias("peak"), F.min_by(t, F.struct(-F.abs(value), t)).alias("t_peak"))


def pulses(df: DataFrame, key: str, t: str, depth: str, behavior: DataFrame | None = None) -> DataFrame:
    """Contact of each run: t_start, t_end, duration, contact_steps, density and to_peak.

    Density is the share of engaged samples in all of a run; to_peak goes from the first contact
    to the engaged sample whose ``depth`` is farthest from that at the first contact (ties: the
    first). ``behavior`` (key, behavior) tells which runs have no contact and are left out;
    without it these are the runs that are never engaged.
    """
    on = F.col("engaged")
    found = df.groupBy(key).agg(F.count("*").alias("__n"), F.count_if(on).alias("contact_steps"), F.min(F.when(on, F.col(t))).alias("t_start"), F.max(F.when(on, F.col(t))).alias("t_end"), F.min_by(depth, F.when(on, F.col(t))).alias("__from"))
    if behavior is None:
        found = found.where("contact_steps > 0")
    else:
        found = found.join(behavior.where("behavior = 'no-contact'").select(key), key, "left_anti")
    far = df.where(on).join(found.select(key, "__from"), key).select(key, t, F.abs(F.col(depth) - F.col("__from")).alias("__far")).where("__far is not null")
    peak = far.groupBy(key).agg(F.min_by(t, F.struct(-F.col("__far"), t)).alias("__peak"))
    return found.join(peak, key, "left").select(key, "t_start", "t_end", (F.col("t_end") - F.col("t_start")).alias("duration"), "contact_steps", (F.col("contact_steps") / F.col("__n")).alias("density"), (F.col("__peak") - F.col("t_start")).alias("to_peak"))


#: Fixed values of the energy audit: percent at which a share warns and fails; least internal energy, as a share of the first kinetic one, at which hourglass energy is judged; least change of the kinetic energy at which an impact is seen.
DRIFT, HOURGLASS, SLIDING = (2.0, 5.0), (10.0, 20.0), (5.0, 10.0)
INTERNAL_FLOOR, KINETIC_FLAT = 1e-3, 5e-3


def energy_audit(glstat: DataFrame) -> DataFrame:
    """Energy balance of each run of (run_id, t, ke, ie, hourglass, sliding, total); what is not a finite number is passed over.

    Drift is that of the total, of its first value; hourglass is a share of the largest internal
    energy, and judged only where that is not nothing beside the first kinetic energy; sliding is
    a share of the first kinetic energy. What was dissipated is told only where the kinetic
    energy changes at all. A share that has no base is NULL, and so is its level.
    """
    real = {c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in ("ke", "ie", "hourglass", "sliding", "total")}
    last = lambda c: F.max_by(real[c], F.when(real[c].isNotNull(), F.col("t")))
    found = glstat.groupBy("run_id").agg(
        F.min_by(real["ke"], "t").alias("ke0"), F.min_by(real["total"], "t").alias("te0"), last("ke").alias("ke1"), last("total").alias("te1"), F.max(real["ke"]).alias("ke_high"), F.min(real["ke"]).alias("ke_low"),
        F.max(real["ie"]).alias("ie_peak"), F.max(real["hourglass"]).alias("hg_peak"), F.coalesce(F.max(F.abs(real["sliding"])), F.lit(0.0)).alias("sl_peak"),
    )
    c = F.col
    base = F.when(c("ke0") > 0, c("ke0")).otherwise(c("ke_high"))
    seen = F.coalesce((base > 0) & ((c("ke_high") - c("ke_low")) / base >= KINETIC_FLAT), F.lit(False))
    told = found.select(
        "run_id", seen.alias("impact_visible"), F.coalesce((c("ke0") > 0) & (c("ie_peak") >= INTERNAL_FLOOR * c("ke0")), F.lit(False)).alias("internal_significant"),
        F.round(F.when(seen & (c("ke0") > 0), F.greatest(100 * (c("ke0") - c("ke1")) / c("ke0"), F.lit(0.0))), 2).alias("dissipated_pct"),
        F.round(F.when(c("te0") > 0, F.abs(c("te1") - c("te0")) / c("te0") * 100), 4).alias("drift_pct"),
        F.round(F.when(c("ie_peak") > 0, 100 * c("hg_peak") / c("ie_peak")), 2).alias("hourglass_pct"), F.round(F.when(c("ke0") > 0, 100 * c("sl_peak") / c("ke0")), 2).alias("sliding_pct"),
    )
    level = lambda v, limits: F.when(v >= limits[1], "fail").when(v >= limits[0], "warn").when(v.isNotNull(), "pass")
    told = told.withColumns({"drift_level": level(c("drift_pct"), DRIFT), "hourglass_level": F.when(c("internal_significant"), level(c("hourglass_pct"), HOURGLASS)), "sliding_level": level(c("sliding_pct"), SLIDING)})
    levels = F.array("drift_level", "hourglass_level", "sliding_level")
    has = lambda name: F.exists(levels, lambda v: F.coalesce(v == name, F.lit(False)))
    return told.withColumn("verdict", F.when(has("fail"), "fail").when(has("warn"), "warn").when(has("pass"), "pass").otherwise("unknown"))


#: Fixed values of recovery: share of the peak at which a series has recovered; least samples of a series, and from its peak on.
RECOVERED, SERIES, AFTER_PEAK = 0.05, 8, 6


def recovery(motions: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """Recovery and damping of the parts at the worst position, of motions (pos_id, part_id, t, acc).

    The worst position has the largest sum of its parts' peaks (ties: the least). A part recovers
    at the first sample from its peak on that is at or under a share of it, or else with its last
    one. Damping is ln(peak / reached) over the natural angular frequency times that time, within
    0 and 1: the frequency is that of ``frequencies`` (part_id, frequency), or else half the sign
    changes about the mean after the peak, of two at least, over their time. Series of few
    samples are NULL. Windows are of one series each.
    """
    real = motions.where(F.col("t").isNotNull() & F.col("acc").isNotNull() & (F.abs("acc") < float("inf")) & ~F.isnan("acc"))
    peaks = real.groupBy("pos_id", "part_id").agg(F.max("acc").alias("peak"), F.count("*").alias("n"), F.min_by("t", F.struct(-F.col("acc"), "t")).alias("t_peak"))
    worst = peaks.groupBy("pos_id").agg(F.sum("peak").alias("sum")).orderBy(F.desc("sum"), "pos_id").limit(1).select("pos_id")
    chosen = peaks.join(F.broadcast(worst), "pos_id", "left_semi")  # one row
    after = real.join(chosen, ["pos_id", "part_id"]).where(F.col("t") >= F.col("t_peak"))
    w = Window.partitionBy("part_id").orderBy("t")
    whole = Window.partitionBy("part_id")
    signed = after.withColumn("sign", F.signum(F.col("acc") - F.avg("acc").over(whole))).withColumn("turn", (F.lag("sign").over(w) != F.col("sign")).cast("int"))
    low = F.col("acc") <= RECOVERED * F.col("peak")
    found = signed.groupBy("part_id").agg(
        F.first("peak").alias("peak"), F.first("n").alias("n"), F.count("*").alias("m"), F.first("t_peak").alias("t0"), F.min(F.when(low, F.col("t"))).alias("t_low"), F.max("t").alias("t1"), F.max_by("acc", "t").alias("last"), F.coalesce(F.sum("turn"), F.lit(0)).alias("sign_changes"),
    )
    found = chosen.select("pos_id", "part_id").join(found, "part_id", "left")
    found = found.join(frequencies, "part_id", "left") if frequencies is not None else found.withColumn("frequency", F.lit(None).cast("double"))
    c = F.col
    ok = (c("n") >= SERIES) & (c("m") >= AFTER_PEAK) & (c("peak") > 0)
    span = c("t1") - c("t0")
    tau = F.when(c("t_low") > c("t0"), c("t_low") - c("t0")).otherwise(span)
    own = F.when(c("frequency") > 0, c("frequency")).when((span > 0) & (c("sign_changes") >= 2), 0.5 * c("sign_changes") / span)
    ratio = F.when(c("t_low").isNotNull(), F.lit(1 / RECOVERED)).otherwise(F.greatest(c("peak") / F.greatest(c("last"), F.lit(1e-30)), F.lit(1 + 1e-9)))
    zeta = F.when((own > 0) & (tau > 0), F.greatest(F.least(F.ln(ratio) / (2 * np.pi * own * tau), F.lit(1.0)), F.lit(0.0)))
    return found.select("pos_id", "part_id", F.when(ok, tau).alias("recovery"), F.when(ok, zeta).alias("damping"), F.when(ok, c("sign_changes")).otherwise(0).alias("sign_changes"), F.coalesce(ok, F.lit(False)).alias("has_data"))


def dominant_frequency(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Frequency and amplitude of the largest line of each series' spectrum, mean taken out. A series is one run's samples."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna().sort_values(t)
        x, y = frame[t].to_numpy(float), frame[value].to_numpy(float)
        if len(x) < 4 or x[-1] <= x[0]:
            return pd.DataFrame({key: frame[key].head(1), "frequency": np.nan, "amplitude": np.nan})
        grid = np.linspace(x[0], x[-1], len(x))
        lines = np.abs(np.fft.rfft(np.interp(grid, x, y) - y.mean())) * 2 / len(x)
        best = 1 + int(lines[1:].argmax())
        return pd.DataFrame({key: frame[key].head(1), "frequency": best / (grid[-1] - grid[0]) * (len(x) - 1) / len(x), "amplitude": lines[best]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, t, value).groupBy(key).applyInPandas(run, f"{key} {kind}, frequency double, amplitude double")


def shock_spectrum(df: DataFrame, key: str, t: str, value: str, low: float = 10.0, high: float = 2000.0, damping: float = 0.05) -> DataFrame:
    """Largest response of damped oscillators in third octaves to each series as base acceleration (average-acceleration Newmark)."""
    bands = low * 2 ** (np.arange(int(np.floor(3 * np.log2(high / low))) + 1) / 3)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna().sort_values(t)
        x, a = frame[t].to_numpy(float), frame[value].to_numpy(float)
        if len(x) < 3:
            return pd.DataFrame({key: [], "frequency": [], "response": []})
        w = 2 * np.pi * bands
        u, v = np.zeros_like(w), np.zeros_like(w)
        acc = -a[0] - 0 * w
        peak = np.zeros_like(w)
        for i in range(1, len(x)):
            h = x[i] - x[i - 1]
            u1, v1 = u + h * v + h * h / 4 * acc, v + h / 2 * acc
            acc = (-a[i] - 2 * damping * w * v1 - w * w * u1) / (1 + damping * w * h + w * w * h * h / 4)
            u, v = u1 + h * h / 4 * acc, v1 + h / 2 * acc
            peak = np.maximum(peak, np.abs(2 * damping * w * v + w * w * u))
        return pd.DataFrame({key: np.repeat(frame[key].iloc[0], len(w)), "frequency": bands, "response": peak})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, t, value).groupBy(key).applyInPandas(run, f"{key} {kind}, frequency double, response double")
