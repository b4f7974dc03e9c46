"""Multi-turn dialogues in long form: (sample_id, pos, role, action, content, ...)."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources import exists

#: Fixed: tool actions, and those whose answers are shown to the user.
CLASSIFICATION, MEASUREMENT, FOLLOW_UP = "call_classification_tool", "call_measurement_tool", "response_followup"
SHOWN = ("response", "response_followup", "system_bye")


def by_pos() -> WindowSpec:
    return Window.partitionBy("sample_id").orderBy("pos")


def valid(turns: DataFrame) -> DataFrame:
    """Turns with a role, a user's with content, an assistant's with content or tool output."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    said = F.when(F.col("role") == "user", has("content")).when(F.col("role") == "assistant", has("content") | has("tool_output")).otherwise(F.lit(True))
    return turns.where(has("role") & said)


#: The turns of a dialogue as JSON, as far as its actions are concerned.
TURNS = "array<struct<role:string,action:string,content:string>>"


def contains_action(turns: Column, action: str) -> Column:
    """Whether any turn of a dialogue (JSON) has the action; false for what is no JSON."""
    return F.coalesce(F.exists(F.from_json(turns, TURNS), lambda t: F.coalesce(t.action == action, F.lit(False))), F.lit(False))


def answered(turns: Column) -> Column:
    """Whether an assistant's turn of a dialogue (JSON) is an answer that says something."""
    says = lambda t: (t.role == "assistant") & (t.action == "response") & (F.coalesce(F.trim(t.content), F.lit("")) != "")
    return F.coalesce(F.exists(F.from_json(turns, TURNS), lambda t: F.coalesce(says(t), F.lit(False))), F.lit(False))


def categorised(turns: DataFrame) -> DataFrame:
    """Assistant turns with the last user query before them and a category by the turn before them."""
    action, role = F.lag("action").over(by_pos()), F.lag("role").over(by_pos())
    category = F.when(action == CLASSIFICATION, "post_classification").when(action == MEASUREMENT, "post_measurement").when((role == "user") | (action == FOLLOW_UP), "direct")
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(by_pos().rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumns({"category": category, "user_query": asked}).where("role = 'assistant'")


def by_previous_action(turns: DataFrame) -> DataFrame:
    """Answers (gt_action `response`) of turns (sample_id, pos, gt_action, gt_tool_output) with a category by the turn before; what is no tool's is direct, and has no tool output."""
    before, output = F.lag("gt_action").over(by_pos()), F.lag("gt_tool_output").over(by_pos())
    category = F.when(before == CLASSIFICATION, "post_classification").when(before == MEASUREMENT, "post_measurement").otherwise("direct_response")
    rows = turns.withColumns({"category": category, "_output": output}).where("gt_action = 'response'")
    return rows.withColumn("tool_output", F.when(F.col("category") != "direct_response", F.col("_output"))).drop("_output")


def aligned(truth: DataFrame, made: DataFrame) -> DataFrame:
    """Turns of two versions of a dialogue, joined by ordinal; a side that is longer stays, with nulls beside it."""
    nth = lambda df, p: df.select("sample_id", F.row_number().over(by_pos()).alias("turn_index"), F.col("action").alias(f"{p}_action"), F.col("content").alias(f"{p}_content"))
    both = nth(truth, "gt").join(nth(made, "gen"), ["sample_id", "turn_index"], "full")
    return both.withColumns({"action_correct": F.col("gt_action") == F.col("gen_action"), "response_exact_match": F.trim("gt_content") == F.trim("gen_content")})


def prefixes(turns: DataFrame, line: Column) -> DataFrame:
    """One example for each assistant turn: all lines before it, in order, and its own.

    A dialogue is joined once, and a turn's history is what stands before its line in it: nothing is gathered anew for each turn.
    """
    lines = turns.select("sample_id", "pos", "role", line.alias("target"))
    whole = lines.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x.target), "\n").alias("_whole"))
    before = F.sum(F.coalesce(F.length("target") + 1, F.lit(0))).over(Window.partitionBy("sample_id").orderBy("pos", "target").rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("_before", F.coalesce(before, F.lit(0)).cast("int")).where("role = 'assistant'")
    return rows.join(whole, "sample_id").select("sample_id", "pos", F.substr("_whole", F.lit(1), F.greatest(F.col("_before") - 1, F.lit(0))).alias("history"), "target")


def tagged(turns: DataFrame) -> Column:
    """The line of a turn in training examples: what a user says, what an assistant does, thinks and says as tagged lines, what it hasn't left out; tool output wins over content."""
    part = lambda c, tag, end="\n": F.concat(F.lit(f"{tag}: "), F.col(c), F.lit(end)) if c in turns.columns else F.lit(None).cast("string")
    said = F.concat_ws("", part("action", "Action"), part("thought", "Thought"), F.coalesce(part("tool_output", "Tool_Output", ""), part("content", "Content", "")))
    return F.concat(F.col("role"), F.lit(": "), F.when(F.col("role") == "assistant", F.trim(said)).otherwise(F.coalesce("content", F.lit(""))))


def conversation(turns: DataFrame) -> DataFrame:
    """The dialogue as users see it: non-blank user turns and shown assistant turns, in order."""
    shown = (F.col("role") == "user") | ((F.col("role") == "assistant") & F.col("action").isin(*SHOWN))
    kept = turns.where(shown & (F.coalesce(F.trim("content"), F.lit("")) != ""))
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat("role", F.lit(": "), "content").alias("line"))))
    return kept.groupBy("sample_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("text"), F.count("*").alias("turns"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(*order)).alias("_r"))
    return last.select(*keys, "_r.*")


def common_ids(rows: DataFrame, group: str, id_: str) -> DataFrame:
    """The ids that every loaded group holds; all ids when there are fewer than two groups."""
    groups = rows.select(group).distinct().agg(F.count("*").alias("groups"))
    held = rows.select(group, id_).distinct().groupBy(id_).agg(F.count("*").alias("held"))
    return held.join(F.broadcast(groups)).where("groups < 2 or held = groups").select(id_)


def stratified(ids: DataFrame, stratum: str, id_: str, most: int, seed: int = 42) -> DataFrame:
    """At most so many distinct ids of each stratum, in the order of the md5 of seed and id."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(id_).cast("string"))))
    return ids.select(stratum, id_).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def pending(keys: DataFrame, done: DataFrame, on: list[str], again: Column | None = None) -> DataFrame:
    """Keys that are not done; those whose result satisfies `again` are done over."""
    return keys.join(done if again is None else done.where(~again), on, "left_anti")


def unjudged(keys: DataFrame, judged: DataFrame, on: list[str], answer: str) -> DataFrame:
    """Keys that still have to be judged: those without a judgement, and those whose kept one is an empty answer, which does not count."""
    return pending(keys, judged, on, F.coalesce(F.trim(answer), F.lit("")) == "")


def asked(prompts: DataFrame, call: Callable[[str], str], folder: str, tries: int = 4, wait: float = 2.0, per_second: float | None = None, parts: int = 4, otherwise: str | None = None) -> DataFrame:
    """key, answer of prompts (key, prompt) from `call`, which a judge's client is handed in as; answers that are in the folder are not asked for again.

    A task asks one prompt after the other, all `parts` of them together `per_second` times a second at most. A call that fails is tried again after
    `wait`, twice that, three times that ... seconds; after `tries` of them it is an error, or the answer is `otherwise`, which is not kept. An answer
    is a file of its key as soon as it is there, so what is run again, a task or the job, asks for the rest only. An empty
    answer is none: it is not kept either.
    """
    from pyarrow import fs

    where = folder if "://" in folder else f"file://{folder}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(where)
        system.create_dir(base, recursive=True)
        ready = 0.0

        def ask(prompt: str) -> str | None:
            nonlocal ready
            for nth in range(1, tries + 1):
                time.sleep(max(0.0, ready - time.monotonic()))
                ready = time.monotonic() + (parts / per_second if per_second else 0.0)
                try:
                    return call(prompt)
                except Exception:
                    if nth == tries and otherwise is None:
                        raise
                if nth < tries:
                    time.sleep(wait * nth)
            return None

        for frame in frames:
            rows = []
            for key, prompt in zip(frame["key"], frame["prompt"], strict=True):
                path = f"{base}/{hashlib.sha256(key.encode()).hexdigest()}.json"
                if system.get_file_info(path).type == fs.FileType.File:
                    with system.open_input_stream(path) as held:
                        answer = json.loads(held.read())["answer"]
                else:
                    answer = ask(prompt)
                    if answer and answer.strip():
                        with system.open_output_stream(path + "_") as out:
                            out.write(json.dumps({"key": key, "answer": answer}).encode())
                        system.move(path + "_", path)
                rows.append((key, otherwise if answer is None else answer))
            yield pd.DataFrame(rows, columns=["key", "answer"])

    return prompts.select(F.col("key").cast("string").alias("key"), "prompt").repartition(parts, "key").mapInPandas(run, "key string, answer string")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """key, answer of all that asked() has kept; no rows where there is no folder."""
    shape = "key string, answer string"
    return spark.read.schema(shape).option("pathGlobFilter", "*.json").json(folder) if exists(spark, folder) else spark.createDataFrame([], shape)
