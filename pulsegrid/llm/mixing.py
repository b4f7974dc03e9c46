"""Temperature mixing of sources: exponentiated token shares, met by budgeted block permutations.

Weights are w ~ p^a for the sources' token shares p. Bisection finds the exponent a in [0, 1]: the
largest that reaches the target entropy (a share of that of equal weights), or the smallest that
repeats no source's documents more than `max_repeat` times; given both, the repetition limit wins.

The weights are realised exactly, up to a document: the budget is cut into blocks, each source gives
each block its weight's share of it, reading its documents in passes, each pass in a permutation of
its own, and each block is permuted again. Sources are Spark rows; the driver gets a bounded histogram
of their totals for the bisection. Running sums within a source go over ranges of the hash,
then within a range, so that a source with most of the documents is not one task's.

The default budget is the least that uses every document once, so mixing repeats rare sources and
drops nothing. A null source is a source; null and empty texts count one token (the end). Rows that
share an id are placed each. An empty table gives no rows. Columns other than doc_id, source and
text are not read (mixed() keeps all).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Documents of a source in a range of the hash, on average.
RANGE = 2048
BLOCK_TOKENS = 1 << 20
#: Sources whose quotas are broadcast (about 100 bytes each); more are joined by salted keys.
BROADCAST_SOURCES = 1000
SALTS = 64
#: Parts of a source's total within which sources count as equal when the exponent is looked for.
FINE = 1000


def words() -> Column:
    """Tokens of a text for mixing: its words and an end."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long") + 1


def weights(shares: list[float], exponent: float) -> list[float]:
    powers = [p**exponent for p in shares]
    total = sum(powers)
    return [x / total for x in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def repeats(shares: list[float], w: list[float]) -> float:
    """Passes over the source that is read most often, when each is read once at least."""
    ratios = [x / p for x, p in zip(w, shares, strict=True)]
    return max(ratios) / min(ratios)


def bisect(good, rounds: int = 60) -> float:
    """The border between exponents that are good (below) and those that are not (above), in [0, 1]."""
    if good(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def exponent(shares: list[float], target_entropy: float | None = None, max_repeat: float | None = None, times: list[int] | None = None) -> float:
    """The exponent for a target entropy (a share of log n) and a repetition limit; 1 with neither. `times`: sources that have each share."""
    times = times or [1] * len(shares)
    n = sum(times)
    if n < 2:
        return 1.0
    p, k = np.array(shares), np.array(times, dtype=np.float64)

    def spread(a: float) -> float:
        w = p**a
        w /= (w * k).sum()
        return -float((k * w * np.log(w)).sum())

    a = 1.0
    if target_entropy is not None:
        a = bisect(lambda x: spread(x) >= target_entropy * math.log(n))
    if max_repeat is not None and repeats(shares, weights(shares, a)) > max_repeat:
        a = 1 - bisect(lambda x: repeats(shares, weights(shares, 1 - x)) <= max_repeat)
    return a


def shares_of(totals: DataFrame) -> tuple[list[float], list[int]]:
    """Shares of tokens and how many sources have each, of (source, total): exact for the smallest and the largest source, means over FINE else.

    Sources whose totals differ by less than one part in FINE are taken together, so the driver gets a few ten thousand
    rows whatever the number of sources.
    """
    all_ = totals.agg(F.min("total").alias("least"), F.max("total").alias("most"), F.sum("total").alias("all")).first()
    if not all_["all"]:
        return [], []
    step = F.when(F.col("total") == all_["least"], -1).when(F.col("total") == all_["most"], -2).otherwise(F.floor(F.log("total") * FINE))
    rows = totals.groupBy(step.alias("step")).agg(F.avg("total").alias("mean"), F.count("*").alias("n")).orderBy("step").collect()
    return [r["mean"] / all_["all"] for r in rows], [r["n"] for r in rows]


def with_quota(rows: DataFrame, quota: DataFrame, sources: int, broadcast: int = BROADCAST_SOURCES) -> DataFrame:
    """Each row with the quota of its source: from a broadcast, or past that many sources by keys salted by `row`."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    if sources <= broadcast:
        return rows.join(F.broadcast(quota), same)
    salted = quota.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_mine", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_mine") == F.col("_salt"))).drop("_mine", "_salt")


def placed(docs: DataFrame, target_entropy: float | None = 0.95, max_repeat: float | None = 4.0, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """doc_id, mark (a hash of the text), source, tokens, copy, block, place of each copy of each document."""
    counted = shared.settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("tokens"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row")))
    totals = shared.settled(counted.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs")))
    shares, times = shares_of(totals)
    a = exponent(shares, target_entropy, max_repeat, times)
    # the weights are powers over their sum; the least budget reads each source once
    power = F.pow(F.col("total").cast("double"), F.lit(a))
    about = totals.agg(F.sum(power).alias("all"), F.max(F.col("total") / power).alias("most"), F.count("*").alias("sources")).first()
    budget = budget or (about["most"] or 0) * (about["all"] or 0)
    blocks = max(1, round(budget / block_tokens))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE)).cast("long")
    quota = totals.select(F.col("source").alias("_source"), F.col("total").alias("_total"), (power / F.lit(about["all"] or 1.0) * F.lit(float(budget))).alias("_quota"), ranges.alias("_ranges"))
    joined = with_quota(counted, quota, about["sources"])
    # a pass more than the quota fills is cut below, by what is read before
    passes = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_quota") / F.col("_total") - 1e-9) - 1).cast("int"))))
    key = F.xxhash64(F.lit(seed), "copy", "doc_id", "row")
    passes = passes.withColumn("_key", key).withColumn("_range", F.floor(F.shiftrightunsigned("_key", 11) / F.lit(float(1 << 53)) * F.col("_ranges")).cast("long")).drop("_source")
    group = [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "copy", "_range"]
    names = ["_s", "_n", "copy", "_range"]
    passes = passes.select("*", *group[:2])
    sums = passes.groupBy(*names).agg(F.sum("tokens").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_s", "_n", "copy").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    within = Window.partitionBy(*names).orderBy("_key", "row").rowsBetween(Window.unboundedPreceding, -1)
    read = F.col("copy") * F.col("_total") + F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    read_ = passes.join(before, names).withColumn("_read", read).where(F.col("_read") < F.col("_quota") - 1e-6)
    block = F.least(F.lit(blocks - 1), F.floor(F.col("_read") / F.col("_quota") * blocks)).cast("long")
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "copy", "doc_id", "row"), "row")
    return read_.withColumn("block", block).withColumn("place", F.row_number().over(order)).select("doc_id", "mark", "source", "tokens", "copy", "block", "place")


def plan(docs: DataFrame, target_entropy: float | None = 0.95, max_repeat: float | None = 4.0, **how) -> DataFrame:
    """doc_id, source, tokens, copy, block, place: where each copy of each document goes; a place is unique in its block."""
    return placed(docs, target_entropy, max_repeat, **how).drop("mark")


def mixed(docs: DataFrame, target_entropy: float | None = 0.95, max_repeat: float | None = 2.0, **how) -> DataFrame:
    """The documents, each as often as the plan has it; rows that share id and text are repeated alike."""
    id_, mark, copies, copy = shared.free(docs, "_id", "_mark", "_copies", "_copy")
    times = placed(docs, target_entropy, max_repeat, **how).groupBy(F.col("doc_id").alias(id_), F.col("mark").alias(mark)).agg((F.max("copy") + 1).alias(copies))
    again = docs.join(times, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(mark)))
    return again.select(*docs.columns, F.explode(F.sequence(F.lit(1), copies)).alias(copy)).select(*docs.columns)
