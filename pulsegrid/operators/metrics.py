"""Evaluation aggregates: accuracy, score summaries, deltas, calibration, ROC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def action_accuracy(turns: DataFrame) -> DataFrame:
    """gt_action, total, correct, pct by action, and overall, for turns (gt_action, action_correct) that have both."""
    known = turns.where("gt_action is not null and gt_action <> '' and action_correct is not null")
    out = known.groupBy("gt_action").agg(F.count("*").alias("total"), F.sum(F.col("action_correct").cast("int")).alias("correct"))
    whole = out.agg(F.sum("total").alias("total"), F.sum("correct").alias("correct")).where("total is not null").select(F.lit("overall").alias("gt_action"), "total", "correct")
    return out.unionByName(whole).withColumn("pct", F.round(100 * F.col("correct") / F.col("total"), 4))


def score_summary(scores: DataFrame, criteria: list[str]) -> DataFrame:
    """model, mean of each criterion (0 with none), count of rows with any, errors."""
    any_ = F.coalesce(*(F.col(c) for c in criteria)).isNotNull()
    return scores.groupBy("model").agg(
        *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in criteria),
        F.sum(any_.cast("int")).alias("count"),
        F.sum((F.coalesce("error", F.lit("")) != "").cast("int")).alias("errors"),
    )


def relative_score(pairs: DataFrame) -> DataFrame:
    """For each type, each domain and overall: mean of a2 / a1 in percent, means of both, count."""
    once = pairs.select("a1", "a2", F.explode(F.array(F.concat(F.lit("type:"), "type"), F.concat(F.lit("domain:"), "domain"), F.lit("overall"))).alias("group"))
    return once.groupBy("group").agg(
        F.round(100 * F.avg(F.try_divide("a2", "a1")), 4).alias("relative"), F.round(F.avg("a1"), 4).alias("mean_a1"), F.round(F.avg("a2"), 4).alias("mean_a2"), F.count("*").alias("n")
    )


def answer_delta(judged: DataFrame) -> DataFrame:
    """Means of 0/1 judgements without and with retrieval (missing: 0), the difference of the rounded means, what was fixed and what regressed."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    before, after = zero("norag_correct"), zero("rag_correct")
    mean = lambda c: F.round(F.avg(c), 4)
    return judged.agg(
        mean(before).alias("norag"), mean(after).alias("rag"), F.round(mean(after) - mean(before), 4).alias("delta"),
        F.sum(((before == 0) & (after == 1)).cast("int")).alias("fixed"), F.sum(((before == 1) & (after == 0)).cast("int")).alias("regressed"), F.count("*").alias("n"),
    )


def with_below(by_score: DataFrame) -> DataFrame:
    """by_score (score, n, ...) with `below`: how many rows have a smaller score.

    Scores are dealt by ranges: a range's running count is local, and only the ranges' totals are summed in one place.
    """
    dealt = by_score.repartitionByRange("score").select("*", F.spark_partition_id().alias("part"))
    local = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("within", F.coalesce(F.sum("n").over(local), F.lit(0)))
    parts = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    before = parts.alias("a").join(F.broadcast(parts.alias("b")), F.col("a.part") > F.col("b.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.total"), F.lit(0)).alias("before"))
    return inside.join(before, "part").withColumn("below", F.col("before") + F.col("within")).drop("part", "within", "before")


def quantiles(scores: DataFrame, score: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact quantiles, interpolated between neighbours, by name; null without scores. No task holds all scores."""
    by_score = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"))
    size = by_score.agg(F.sum("n").alias("size"))  # one row
    rows = with_below(by_score).join(F.broadcast(size))
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("score")))
    ends = {name: (F.floor(F.lit(p) * (F.col("size") - 1)), F.ceil(F.lit(p) * (F.col("size") - 1))) for name, p in shares.items()}
    found = rows.agg(F.max("size").alias("size"), *(at(place).alias(f"{name}_{side}") for name, both in ends.items() for side, place in zip(("low", "high"), both, strict=True)))
    part = lambda p: F.lit(p) * (F.col("size") - 1) - F.floor(F.lit(p) * (F.col("size") - 1))
    return found.select(*((F.col(f"{name}_low") + part(p) * (F.col(f"{name}_high") - F.col(f"{name}_low"))).alias(name) for name, p in shares.items()))


def calibration(scores: DataFrame, target: float = 0.95) -> DataFrame:
    """One row: the threshold (the target quantile of the normals, interpolated), percentiles, mean, population deviation."""
    normal = scores.where("label = 0")
    cuts = quantiles(normal, "score", {"threshold": target} | {f"p{p}": p / 100 for p in (50, 90, 95, 98, 99, 100)})
    about = normal.agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.count("*").alias("n"))
    return cuts.select(*(F.round(c, 6).alias(c) for c in cuts.columns)).join(F.broadcast(about))  # a row each


def roc(scores: DataFrame, threshold: float) -> DataFrame:
    """auc (by average ranks), sensitivity and specificity at the threshold, for (score, label)."""
    by_score = scores.where("score is not null").groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    rank = with_below(by_score).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    got = rank.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.when(F.col("score") >= threshold, F.col("pos"))).alias("tp"), F.sum(F.when(F.col("score") < threshold, F.col("n") - F.col("pos"))).alias("tn"))
    negatives = F.col("n") - F.col("p")
    return got.select(
        F.round(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * negatives), 6).alias("auc"),
        F.round(F.try_divide(F.coalesce("tp", F.lit(0)), "p"), 6).alias("sensitivity"),
        F.round(F.try_divide(F.coalesce("tn", F.lit(0)), negatives), 6).alias("specificity"),
    )
