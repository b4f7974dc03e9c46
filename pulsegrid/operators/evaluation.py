"""Joins and summaries of evaluation runs: which reply answers what, what was scored, what a run did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dialogue import by_pos
from .etl import literal_map

#: Fixed: categories in the order in which a model's reply is looked for, and the failed reply.
CATEGORIES = ("post_classification", "post_measurement", "direct")
FAILED = "response_fail"


def filled(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def next_replies(turns: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Tool turns with the reply right after them: an assistant's, not a failed one, with content."""
    after = lambda c: F.lead(c).over(by_pos())
    rows = turns.withColumns({"_role": after("role"), "_action": after("action"), "reply": after("content")})
    answered = (F.col("_role") == "assistant") & (F.coalesce("_action", F.lit("")) != FAILED) & filled("reply")
    return rows.where(F.col("action").isin(*tools) & answered).select("sample_id", "pos", "action", "reply")


def replies_for(truth: DataFrame, replies: DataFrame) -> DataFrame:
    """truth (sample_id, user_query, category, ...) with the model's `reply` to the same query, and its category.

    A query answered in several categories takes the first of CATEGORIES; one without answer has nulls.
    """
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    known = replies.where(F.col("category").isin(*CATEGORIES))
    best = known.groupBy("sample_id", "user_query").agg(F.min_by(F.struct("reply", F.col("category").alias("found_in")), F.struct(order, "reply")).alias("_r"))
    return truth.join(best, ["sample_id", "user_query"], "left").withColumns({"reply": F.col("_r.reply"), "found_in": F.col("_r.found_in")}).drop("_r")


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """The rows of all sources, each key from the first source that has it."""
    rows = [s.withColumn("_source", F.lit(n)) for n, s in enumerate(sources)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    rest = [c for c in sources[0].columns if c != key]
    first = every.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_source", *rest)).alias("_r"))
    return first.select(key, "_r.*")


def zipped(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of two tables by their place in `order` within sample_id, as long as the shorter."""
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy(order))
    return left.withColumn("place", nth).drop(order).join(right.withColumn("place", nth).drop(order), ["sample_id", "place"])


def task_grid(ids: DataFrame, models: list[str]) -> DataFrame:
    """Each id once for each loaded model; no join, as models are names in the plan."""
    return ids.select("*", F.explode(F.array(*map(F.lit, models)).cast("array<string>")).alias("model"))


def both_scored(scores: DataFrame, group: str, one: str, two: str) -> DataFrame:
    """Means of two scores by group over the rows that have both."""
    return scores.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(group).agg(F.round(F.avg(one), 6).alias(one), F.round(F.avg(two), 6).alias(two), F.count("*").alias("n"))


def dialogue_quality(scores: DataFrame, group: str) -> DataFrame:
    """Means of naturalness and cefr by group; a row that lacks one counts as an error."""
    good = F.col("naturalness").isNotNull() & F.col("cefr").isNotNull()
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0)), 6).alias(c)
    return scores.groupBy(group).agg(mean("naturalness"), mean("cefr"), F.count_if(good).alias("count"), F.count_if(~good).alias("errors"))


def mean_or_zero(scores: DataFrame, score: str) -> DataFrame:
    """One row: the mean of the 0/1 scores, 0 with none."""
    return scores.agg(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("mean"), F.count(score).alias("n"))


def outcomes(files: DataFrame, codes: DataFrame) -> DataFrame:
    """One row of counts for labelling (recording_id, label) with codes (recording_id, scp_codes):
    updated, skipped (labelled before), missing (no codes), errors (codes that can't be read)."""
    found = codes.groupBy("recording_id").agg(F.min_by("scp_codes", "scp_codes").alias("_codes"), F.lit(True).alias("_there"))
    done = F.col("label").isNotNull()
    there = F.coalesce("_there", F.lit(False))
    bad = there & literal_map(F.col("_codes")).isNull()
    return files.join(found, "recording_id", "left").agg(
        F.count_if(~done & there & ~bad).alias("updated"), F.count_if(done).alias("skipped"), F.count_if(~done & ~there).alias("missing"), F.count_if(~done & bad).alias("errors")
    )


def fleet(workers: DataFrame, group: str | None = None) -> DataFrame:
    """Names of all models in order, sums of speed and queue_length, workers, for (models, speed, queue_length)."""
    totals = workers.groupBy(*([group] if group else [])).agg(F.sum("speed").alias("speed"), F.sum("queue_length").alias("queue_length"), F.count("*").alias("workers"))
    names = workers.select(*([group] if group else []), F.explode("models").alias("model")).distinct().groupBy(*([group] if group else [])).agg(F.array_sort(F.collect_list("model")).alias("models"))
    return totals.join(names, group, "left") if group else totals.join(F.broadcast(names))  # one row


def peak_mask(n: Column, peaks: Column, around: int = 240) -> Column:
    """1 for samples up to `around` from a peak, else 0; all 1 without peaks."""
    at = F.sequence(F.lit(0), n - 1)
    near = F.transform(at, lambda i: F.exists(peaks, lambda p: F.abs(i - p) <= around).cast("double"))
    return F.when(F.size(F.coalesce(peaks, F.array().cast("array<int>"))) > 0, near).otherwise(F.transform(at, lambda _: F.lit(1.0)))


def masked_error(passes: Column, mask: Column) -> Column:
    """The mean over passes (array<array<double>>) of sum(loss * mask) / sum(mask); null where the mask is empty."""
    add = lambda a, x: a + x
    total = F.aggregate(mask, F.lit(0.0), add)
    each = F.transform(passes, lambda loss: F.try_divide(F.aggregate(F.zip_with(loss, mask, lambda x, m: x * m), F.lit(0.0), add), total))
    return F.try_divide(F.aggregate(each, F.lit(0.0), add), F.size(passes).cast("double"))


def truth_text(codes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """recording_id, text: `code (description) [likelihood p%]` of each code in its order, by semicolon; the code stands for a missing description, and a likelihood of 0 or none is not told."""
    rows = codes.select("recording_id", F.posexplode(F.map_entries(literal_map(F.col("scp_codes")))).alias("place", "e")).select("recording_id", "place", F.col("e.key").alias("code"), F.col("e.value").alias("likelihood")).join(descriptions, "code", "left")
    named = F.format_string("%s (%s)", "code", F.coalesce("description", "code"))
    line = F.when(F.col("likelihood") > 0, F.concat(named, F.format_string(" [likelihood %.0f%%]", "likelihood"))).otherwise(named)
    held = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("_l"))
    return held.select("recording_id", F.array_join(F.transform("_l", lambda x: x.line), "; ").alias("text"))


#: Fixed: columns of global measurements with the label and unit of each; of those with one label the first that has a number counts.
MEASUREMENTS = (
    ("HR__Global", "Heart rate", "bpm"), ("HR_Ventr_Global", "Heart rate", "bpm"), ("PR_Int_Global", "PR interval", "ms"), ("QRS_Dur_Global", "QRS duration", "ms"),
    ("QT_Int_Global", "QT interval", "ms"), ("QT_IntBazett_Global", "QTc (Bazett)", "ms"), ("QT_IntCorr_Global", "QTc (Bazett)", "ms"),
)


def measurement_text(measured: DataFrame) -> DataFrame:
    """ecg_id, text: `label: value unit` of each label that has a number (one decimal), by semicolon; rows without any are left out."""
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    parts = []
    for label in dict.fromkeys(m[1] for m in MEASUREMENTS):
        unit = next(m[2] for m in MEASUREMENTS if m[1] == label)
        value = F.coalesce(*(number(c) for c, named, _ in MEASUREMENTS if named == label))
        parts.append(F.when(value.isNotNull(), F.format_string(f"{label}: %.1f {unit}", value)))
    text = F.array_join(F.array_compact(F.array(*parts)), "; ")
    return measured.select(F.col("ecg_id").try_cast("double").cast("long").alias("ecg_id"), text.alias("text")).where("ecg_id is not null and text <> ''")


def with_gold(items: DataFrame, records: DataFrame, key: str = "gold_id") -> DataFrame:
    """items with the record that each names; an id that no record has is an error, not a lost row."""
    known = records.withColumn("_known", F.lit(True))
    joined = items.join(known, items[key] == known["doc_id"], "left")
    wrong = F.raise_error(F.concat(F.lit("no record has the id "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn("_known", F.when(F.col("_known").isNull(), wrong.cast("boolean")).otherwise(F.col("_known"))).where("_known").drop("_known")


def of_selected(responses: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The responses whose id was selected, once each however often it was."""
    return responses.join(ids.select(key), key, "left_semi")


def counts(rows: DataFrame, *groups: str) -> DataFrame:
    """How many records a topic, type or the like has; null is one of its own."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n"))


def reassembled(actions: Column, replies: Column, tools: list[str], category: Column) -> Column:
    """array<struct<category, action, reply>>: replies in order, beside the actions that are no tool's."""
    said = F.filter(actions, lambda a: ~a.isin(*tools))
    kind = F.coalesce(category, F.lit("ECG_Inquiry"))
    return F.transform(replies, lambda r, i: F.struct(kind.alias("category"), F.coalesce(F.get(said, i), F.lit("response")).alias("action"), r.alias("reply")))


def chunks_with_tail(items: Column, n: int) -> Column:
    """Pieces of n items; a tail that fits within 1.5 n with the piece before is one with it."""
    size = F.size(items)
    pieces = F.greatest(F.lit(1), F.when((size % n) * 2 <= n, F.floor(size / n)).otherwise(F.ceil(size / n)).cast("int"))
    return F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.slice(items, i * n + 1, F.when(i == pieces - 1, F.greatest(size - i * n, F.lit(0))).otherwise(n)))


def overlapping(items: Column, step: int, extra: int = 10) -> Column:
    """Pieces of step + extra items, every `step` items."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i + 1, step + extra))
