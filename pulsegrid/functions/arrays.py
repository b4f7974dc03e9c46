"""Signals as arrays: lead algebra, padding, scaling, windows, predicates and label vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the order of the twelve leads.
LEADS = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")


def derived_leads(one: Column, two: Column) -> dict[str, Column]:
    """The four limb leads that follow from I and II, sample by sample."""
    both = lambda f: F.zip_with(one, two, f)
    return {"III": both(lambda a, b: b - a), "aVR": both(lambda a, b: -(a + b) / 2), "aVL": both(lambda a, b: a - b / 2), "aVF": both(lambda a, b: b - a / 2)}


def padded(samples: Column, length: int) -> Column:
    """The first `length` samples, with zeros after the last."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0), length)), 1, length)


def cleaned(samples: Column) -> Column:
    """Zero for null and non-finite samples."""
    return F.transform(samples, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def min_max(samples: Column, eps: float = 1e-8) -> Column:
    """Samples scaled to [-1, 1]."""
    low, high = F.array_min(samples), F.array_max(samples)
    return F.transform(samples, lambda x: 2 * (x - low) / (high - low + eps) - 1)


def downsampled(samples: Column, most: int) -> Column:
    """Every step-th sample, step = max(1, n // most), rounded to four places."""
    step = F.greatest(F.lit(1), F.floor(F.size(samples) / most).cast("int"))
    return F.transform(F.filter(samples, lambda _, i: i % step == 0), lambda x: F.round(x.cast("double"), 4))


def window_starts(n: Column, win: int, hop: int | None = None) -> Column:
    """Starts 0, hop, ... of whole windows, with a last one that ends at n if the grid misses it; one start for a short signal."""
    hop = hop or win // 4
    last = (n - win).cast("int")
    grid = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(hop))
    return F.when(n <= win, F.array(F.lit(0))).when(last % hop == 0, grid).otherwise(F.concat(grid, F.array(last)))


def windows(samples: Column, win: int, hop: int | None = None) -> Column:
    """array<struct<start, samples>>: the windows, zero-padded where the signal is short."""
    return F.transform(window_starts(F.size(samples), win, hop), lambda s: F.struct(s.alias("start"), padded(F.slice(samples, s + 1, win), win).alias("samples")))


def dead(samples: Column) -> Column:
    """Whether a lead holds non-finite samples or one value only."""
    broken = F.exists(samples, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return broken | (F.array_min(samples) == F.array_max(samples))


def flat_line(samples: Column, fs: int, seconds: float = 0.2, stride: int = 10) -> Column:
    """Whether some window of that many seconds, every stride-th start, holds one value only."""
    win = max(2, round(seconds * fs))
    starts = F.when(F.size(samples) >= win, F.sequence(F.lit(0), F.size(samples) - win, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda s: F.array_min(F.slice(samples, s + 1, win)) == F.array_max(F.slice(samples, s + 1, win)))


def multi_hot(codes: Column, labels: list[str]) -> Column:
    """1.0 at each label that the codes hold; unknown codes are ignored."""
    return F.array(*(F.array_contains(codes, label).cast("float") for label in labels))


def axis_degrees(one: Column, avf: Column) -> Column:
    """The frontal axis; null where both parts vanish. A negative zero in aVF, left by rounding, is below the axis: -180 with a negative I."""
    # Spark's atan2 drops the sign of a zero
    below = (one < 0) & (avf == 0) & F.startswith(avf.cast("string"), F.lit("-"))
    return F.when((F.abs(one) >= 1e-6) | (F.abs(avf) >= 1e-6), F.when(below, -180.0).otherwise(F.round(F.degrees(F.atan2(avf, one)), 0)))


def axis_class(axis: Column) -> Column:
    return F.when(axis.isNull(), "undetermined").when(axis.between(-30, 90), "normal").when(axis > 90, "right").when(axis.between(-90, -30), "left").otherwise("extreme")


def chunks(items: Column, parts: int) -> Column:
    """Near-equal parts of ceil(n / parts) items."""
    size = F.greatest(F.lit(1), F.ceil(F.size(items) / parts).cast("int"))
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(items, s, size))


def lead_subset(leads: Column, wanted: list[str | int]) -> Column:
    """array<array<double>> in the order of LEADS with all but the wanted leads (names in any case, or places from 0) as zeros."""
    names = [x.lower() for x in LEADS]
    keep = [names.index(w.strip().lower()) if isinstance(w, str) else w for w in wanted]
    return F.transform(leads, lambda x, i: F.when(i.isin(keep), x).otherwise(F.transform(x, lambda _: F.lit(0.0))))


def loaded(leads: Column, length: int, wanted: list[str | int] | None = None) -> Column:
    """Leads as a model reads them: broken samples are zero, leads that are not wanted are silent, all are of one length."""
    clean = F.transform(leads, cleaned)
    kept = clean if wanted is None else lead_subset(clean, wanted)
    return F.transform(kept, lambda x: padded(x, length))
