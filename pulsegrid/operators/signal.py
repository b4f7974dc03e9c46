"""Intervals, morphology and quality from recordings and their fiducials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, spectral

#: Fixed: plausible ranges in ms.
RANGES = {"rr": (300, 2000), "pr": (80, 400), "qrs": (80, 240), "qtc": (300, 600)}


def median_within(value: Column, low: float, high: float) -> Column:
    """The median of the values in [low, high], NaN and null dropped; null with none."""
    return F.percentile(F.when(value.between(low, high) & ~F.isnan(value), value), F.lit(0.5))


def rr_intervals(beats: DataFrame, fs: Column) -> DataFrame:
    """recording_id, beat_idx, rr (seconds) to the next beat, below 2 s."""
    order = Window.partitionBy("recording_id").orderBy("beat_idx")
    return beats.select("recording_id", "beat_idx", ((F.lead("r_peak").over(order) - F.col("r_peak")) / fs).alias("rr")).where("rr < 2.0")


def intervals(beats: DataFrame) -> DataFrame:
    """Medians of RR, PR, QRS, QT and QTc in ms and the heart rate of each recording; `partial` under seven beats."""
    order = Window.partitionBy("recording_id").orderBy("beat_idx")
    ms = lambda c: c / F.col("fs") * 1000
    rows = beats.withColumns({
        "rr": ms(F.lead("r_peak").over(order) - F.col("r_peak")),
        "pr": ms(F.col("r_onset") - F.col("p_onset") + 1),
        "qrs": F.when(F.col("s_peak") > F.col("q_peak"), ms(F.col("s_peak") - F.col("q_peak") + 1)),
        "qt": ms(F.col("t_offset") - F.col("q_peak") + 1),
    })
    rows = rows.withColumn("qtc", F.col("qt") / F.sqrt(F.col("rr") / 1000))
    out = rows.groupBy("recording_id").agg(*(median_within(F.col(k), *RANGES[k]).alias(f"{k}_ms") for k in RANGES), F.count("r_peak").alias("beats"))
    return out.withColumns({"heart_rate": F.round(60000 / F.col("rr_ms"), 1), "status": F.when(F.col("beats") < 7, "partial").otherwise("completed")})


def interpretation(hr: Column, pr: Column, qtc: Column, qrs: Column) -> Column:
    """A struct of plain readings; null measures are `Unable to determine`. Durations count in four places, so that what doubles add to a bound is not over it."""
    unknown = "Unable to determine"
    pr, qtc, qrs = (F.round(c, 4) for c in (pr, qtc, qrs))
    return F.struct(
        F.when(hr.isNull(), unknown).when(hr < 60, "Bradycardia").when(hr > 100, "Tachycardia").otherwise("Normal").alias("rate"),
        F.when(pr.isNull(), unknown).when(pr < 120, "Short").when(pr > 200, "Prolonged").otherwise("Normal").alias("pr"),
        F.when(qtc.isNull(), unknown).when(qtc > 460, "Prolonged").otherwise("Normal").alias("qtc"),
        F.when(qrs.isNull(), unknown).when(qrs > 120, "Wide").when(qrs < 80, "Narrow").otherwise("Normal").alias("qrs"),
    )


def t_polarity(t: Column) -> Column:
    return F.when(t.isNull(), "undetermined").when(t > 0.10, "positive").when(t < -0.10, "negative").otherwise("flat")


def r_s_ratio(r: Column, s: Column) -> Column:
    return F.when(F.abs(s) > 1e-6, F.round(r / F.abs(s), 2))


def rounded(value: Column, places: int) -> Column:
    """The value rounded, its sign kept where that gives zero: -0.0 and 0.0 are a whole turn apart for an axis."""
    return F.when(value < 0, -F.round(-value, places)).otherwise(F.round(value, places))


def median(items: Column) -> Column:
    """The median of an array's numbers, NaN and null dropped; null with none."""
    known = F.array_sort(F.filter(items, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(known)
    return F.when(n > 0, (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2)


def timing_lead(beats: DataFrame, least: int = 4) -> DataFrame:
    """recording_id, timing: lead II if it has so many peaks, else I; recordings with neither are left out."""
    place = F.when(F.col("lead") == "II", 0).when(F.col("lead") == "I", 1)
    return beats.where("r_peak is not null").groupBy("recording_id", "lead").agg(F.count("*").alias("n")).where((F.col("n") >= least) & place.isNotNull()).groupBy("recording_id").agg(F.min_by("lead", place).alias("timing"))


def _beat(x: Column, beat: Column, fs: float) -> Column:
    """struct<r, s, st, t> of one beat: amplitudes over the 40 ms before R onset; null where a window is not in the signal."""
    base_w, smooth, n = round(0.04 * fs), max(1, round(0.01 * fs)), F.size(x)
    on, off, at = beat["on"], beat["off"], beat["off"] + round(0.06 * fs)
    base = F.when(on > 0, median(F.slice(x, F.greatest(on - base_w, F.lit(0)) + 1, F.least(on, F.lit(base_w))))).otherwise(F.get(x, on))
    qrs = F.slice(x, on + 1, off - on + 1)
    around = lambda p: median(F.slice(x, F.greatest(p - smooth, F.lit(0)) + 1, p + smooth + 1 - F.greatest(p - smooth, F.lit(0))))
    st = F.when((at - smooth >= 0) & (at + smooth < n), around(at) - base)
    first, end = off + round(0.08 * fs), F.least(n, off + round(0.40 * fs))
    late = F.transform(F.slice(x, first + 1, F.greatest(end - first, F.lit(0))), lambda v, i: F.struct(F.abs(v - base).alias("size"), (-i).alias("i"), (v - base).alias("v")))
    peak = beat["peak"]
    t = F.when(peak.isNull(), F.array_max(late)["v"]).when((peak >= 0) & (peak < n), around(peak) - base)
    return F.struct((F.array_max(qrs) - base).alias("r"), (F.array_min(qrs) - base).alias("s"), st.alias("st"), t.alias("t"))


def morphology(recordings: DataFrame, beats: DataFrame, fs: float) -> DataFrame:
    """recording_id, lead, status, timing, beats, r, s, st, t, t_polarity, rs_ratio, axis: medians over a recording's beats.

    recordings: recording_id, lead, samples; beats: recording_id, lead, beat_idx, r_peak, r_onset, r_offset, t_peak (samples from 0). Beats are
    those of the timing lead: without one the status is `failed`, without a usable beat `partially_completed`. A beat is usable with its R onset and offset
    in the signal. A recording's beats are an array beside each lead, so no signal is repeated for its beats.
    """
    whole = lambda c: F.when(~F.isnan(c), F.col(c)).cast("int")
    beat = F.struct("beat_idx", whole("r_onset").alias("on"), whole("r_offset").alias("off"), whole("t_peak").alias("peak"))
    held = beats.join(timing_lead(beats).withColumnRenamed("timing", "lead"), ["recording_id", "lead"]).groupBy("recording_id", F.col("lead").alias("timing")).agg(F.array_sort(F.collect_list(beat)).alias("held"))
    rows = recordings.join(held, "recording_id", "left").withColumn("x", F.col("samples").cast("array<double>"))
    usable = F.filter("held", lambda b: b["on"].isNotNull() & b["off"].isNotNull() & (b["off"] > b["on"]) & (b["on"] >= 0) & (b["off"] < F.size("x")))
    rows = rows.withColumn("held", F.coalesce(usable, F.array().cast("array<struct<beat_idx:int,on:int,off:int,peak:int>>"))).withColumn("found", F.transform("held", lambda b: _beat(F.col("x"), b, fs)))
    three = lambda c: rounded(median(F.transform("found", c)), 3)
    rows = rows.withColumns({"r": three(lambda f: f["r"]), "s": three(lambda f: f["s"]), "st": three(lambda f: f["st"]), "t": three(lambda f: f["t"]), "net": three(lambda f: f["r"] + f["s"])})
    net = lambda lead: F.max(F.when(F.col("lead") == lead, F.col("net")))
    axis = rows.groupBy("recording_id").agg(net("I").alias("one"), net("aVF").alias("avf")).select("recording_id", arrays.axis_degrees(F.col("one"), F.col("avf")).alias("axis"))
    status = F.when(F.col("timing").isNull(), "failed").when(F.size("held") == 0, "partially_completed").otherwise("completed")
    return rows.join(axis, "recording_id").select("recording_id", "lead", status.alias("status"), "timing", F.size("held").alias("beats"), "r", "s", "st", "t", t_polarity(F.col("t")).alias("t_polarity"), r_s_ratio(F.col("r"), F.col("s")).alias("rs_ratio"), "axis")


#: Fixed: leads that are measured, and the electrodes that each depends on.
ELECTRODES = {"I": ["RA", "LA"], "II": ["RA", "LL"], "V1": ["V1"], "V2": ["V2"], "V3": ["V3"], "V4": ["V4"], "V5": ["V5"], "V6": ["V6"]}


def quality(recordings: DataFrame, fs: int, beats: DataFrame | None = None) -> DataFrame:
    """recording_id, leads, acceptable, overall, failures, electrodes and a hint on the noise, from (recording_id, lead, samples).

    Measured leads only are judged. A dead lead fails as invalid_signal and is not judged further; another by
    each criterion that it fails: stationarity, heart_rate (where beats are given: recording_id, lead, n), snr.
    A recording with under twelve leads has failed, and nothing else is said of it.
    """
    x = F.col("samples")
    counts = recordings.groupBy("recording_id").agg(F.count("*").alias("leads"))
    clean = arrays.cleaned(x.cast("array<double>"))
    rows = recordings.where(F.col("lead").isin(*ELECTRODES)).withColumns({
        "_power": spectral.quality_udf(fs)(clean),
        "invalid": F.coalesce(arrays.dead(x), F.lit(True)), "flat": F.coalesce(arrays.flat_line(x, fs), F.lit(False)),
    })
    # a NaN is no verdict
    rows = rows.select("*", F.nanvl("_power.snr", F.lit(None).cast("double")).alias("snr"), F.col("_power.drift").alias("drift"), F.col("_power.buzz").alias("buzz")).drop("_power")
    rate = F.lit(False)
    if beats is not None:
        rows = rows.join(beats, ["recording_id", "lead"], "left")
        minutes = F.size("samples") / F.lit(60.0 * fs)
        rate = F.coalesce(~(F.col("n") / minutes).between(24, 300), F.lit(False))
    noisy = ~F.col("invalid") & F.coalesce(F.col("snr") < 0.5, F.lit(False))
    named = F.array_compact(F.array(*(F.when(c, n) for n, c in (("stationarity", F.col("flat")), ("heart_rate", rate), ("snr", noisy)))))
    failed = F.when(F.col("invalid"), F.array(F.lit("invalid_signal"))).otherwise(named)
    points = F.create_map(*(y for k, v in ELECTRODES.items() for y in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = rows.withColumns({"noisy": noisy, "failed": failed}).withColumn("bad", F.size("failed") > 0)
    judged = rows.groupBy("recording_id").agg(
        F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"),
        F.array_sort(F.flatten(F.collect_list(F.transform("failed", lambda f: F.concat("lead", F.lit(":"), f))))).alias("failures"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("bad"), F.element_at(points, F.col("lead"))))))).alias("electrodes"),
        F.avg(F.when(F.col("noisy"), F.col("drift"))).alias("drift"), F.avg(F.when(F.col("noisy"), F.col("buzz"))).alias("buzz"),
    )
    overall = F.when(F.col("leads") < 12, "failed").when(F.col("bad") == 0, "all_acceptable").when(F.col("good") > 0, "partial").otherwise("all_unacceptable")
    hint = F.when(F.col("drift").isNull(), "").when(F.col("drift") >= 0.5, "baseline wander").when(F.col("buzz") >= 0.3, "high frequency").otherwise("broadband")
    full = lambda c: F.when(F.col("leads") >= 12, c)
    return counts.join(judged, "recording_id", "left").select("recording_id", "leads", full(F.col("good")).alias("acceptable"), overall.alias("overall"), full(F.col("failures")).alias("failures"), full(F.col("electrodes")).alias("electrodes"), full(hint).alias("hint"))
