"""Benchmarks, prompts, histories, reports and tool runs as tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: errors of a tool run.
NOT_FOUND, NO_RESULT, RAISED = "File Not Found", "Analysis Error", "Processing Exception"
INVALID_TOOL = "invalid tool, please retry"


def benchmark_items(records: DataFrame, questions: DataFrame) -> DataFrame:
    """id, question, gold_ids, topic, type, stale_ids: the questions (id, questions array) of current records.

    Items of a record that superseded ones point to first are temporal and carry their ids; blank
    questions are dropped and the others numbered by their place.
    """
    stale = records.where("status = 'superseded'").groupBy(F.get("superseded_by", F.lit(0)).alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("stale_ids"))
    asked = questions.select("id", F.posexplode("questions").alias("place", "question")).where(F.trim("question") != "")
    rows = records.where("status = 'current'").select("id", "topic").join(asked, "id").join(stale, "id", "left")
    return rows.select(
        F.concat_ws("__", F.col("id").cast("string"), (F.col("place") + 1).cast("string")).alias("id"), F.trim("question").alias("question"), F.array("id").alias("gold_ids"), "topic",
        F.when(F.col("stale_ids").isNull(), "current").otherwise("temporal").alias("type"), "stale_ids",
    )


def in_order(value: Column, place: str, between: str) -> Column:
    """Aggregate: the values joined in the order of `place`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), value.alias("v")))), lambda x: x.v), between)


def tool_prompts(tools: DataFrame, wanted: list[str]) -> DataFrame:
    """text: the five lines of each wanted tool (name, description, prompt, input_type, return_type), in that order; unknown ones are skipped."""
    order = tools.sparkSession.createDataFrame(list(enumerate(wanted)), "place int, name string")
    lines = F.concat(*(x for tag, c in (("Tool", "name"), ("Description", "description"), ("Usage", "prompt"), ("Input type", "input_type"), ("Return type", "return_type")) for x in (F.lit(f"{tag}: "), F.coalesce(c, F.lit("")), F.lit("\n"))), F.lit("\n"))
    return tools.join(F.broadcast(order), "name").agg(in_order(lines, "place", "\n").alias("text"))  # as few as are wanted


def section_or_name(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """section, text for each wanted `section`: its text, or the name itself where there is none of it."""
    first = sections.groupBy("section").agg(F.min("text").alias("text"))
    return wanted.join(first, "section", "left").select("section", F.coalesce("text", "section").alias("text"))


def filled_in(template: str, **fields: Column) -> Column:
    """A text with `{name}` replaced by each field; a null or blank one is N/A."""
    parts = re.split(r"\{(\w+)\}", template)
    known = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("N/A"))
    return F.concat(*(known(fields[x]) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


#: What a judge is asked: the question and both answers, and a score with a reason for each criterion.
JUDGE = "Compare the answer with the reference.\nQuestion: {question}\nTool output: {tool_output}\nReference: {reference}\nAnswer: {answer}\n{criteria}"


def judge_prompt(criteria: list[str], **fields: Column) -> Column:
    """The prompt of a judge, whose reply text.judgement() reads."""
    asked = "\n".join(f"{c}: [score]\n{c} Explanation: [justification]" for c in criteria)
    return filled_in(JUDGE, criteria=F.lit(asked), **fields)


def context(hits: DataFrame, template: str = "- %s (%s %s, class %s, level %s, %s)") -> DataFrame:
    """query_id, context: the hits' text, society, version, class, LOE and citation, a line each by rank."""
    line = F.format_string(template, *(F.coalesce(F.col(c), F.lit("")) for c in ("text", "society", "version", "class", "LOE", "citation")))
    return hits.groupBy("query_id").agg(in_order(line, "rank", "\n").alias("context"))


def history(turns: DataFrame) -> DataFrame:
    """sample_id, pos, history: what was said before each turn, `role: content` a line, N/A without content."""
    before = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.lit("N/A")))
    return turns.select("sample_id", "pos", F.array_join(F.collect_list(line).over(before), "\n").alias("history"))


def record_path(number: Column, cut: bool = False) -> Column:
    """The place of a recording: thousands as the folder, both padded to five digits.

    Longer numbers stay whole, or with `cut` keep their first five digits, as SQL's lpad leaves them (several records then share a path).
    """
    padded = lambda c: F.lpad(c, 5, "0")
    pad = padded if cut else lambda c: F.when(F.length(c) < 5, padded(c)).otherwise(c)
    return F.concat(pad((F.floor(number / 1000) * 1000).cast("string")), F.lit("/"), pad(number.cast("string")), F.lit("_hr"))


def head_per(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= n)


def seeded_head(rows: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of the md5 of seed and id."""
    return rows.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(id_).cast("string"))), id_).limit(n)


def new_synonyms(known: DataFrame, offered: DataFrame) -> DataFrame:
    """code, cn: the offered (code, cn array) that are not there yet, in their order, once each."""
    have = known.select("code", F.col("cn").alias("_have"))
    fresh = F.array_except("cn", F.coalesce("_have", F.array().cast("array<string>")))
    return offered.join(have, "code", "left").select("code", fresh.alias("cn")).where(F.size("cn") > 0)


def markdown(scores: DataFrame, group: str) -> DataFrame:
    """A table's lines for each group from (group, model, n, errors, score): models with neither count nor errors are left out."""
    shown = scores.where("n > 0 or errors > 0")
    line = F.format_string("| %s | %d | %d | %.2f |", F.col("model"), F.col("n"), F.col("errors"), F.col("score"))
    head = F.concat(F.lit("## "), F.col(group), F.lit("\n| model | n | errors | score |\n| --- | --- | --- | --- |\n"))
    return shown.groupBy(group).agg(in_order(line, "model", "\n").alias("_rows")).select(group, F.concat(head, "_rows").alias("report"))


def extracted(paths: DataFrame, recordings: DataFrame, tool: Callable[[pd.Series], dict | None], columns: str) -> DataFrame:
    """A flat row with `error` for each path: tool(recording) gives the columns, null or an error gives NO_RESULT, an exception RAISED.

    Paths without a recording are NOT_FOUND. The tool runs by recording where the recordings are.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for _, recording in frame.iterrows():
                try:
                    got = tool(recording)
                    failed = not got or "error" in got
                    out = {"error": NO_RESULT} if failed else {n: got.get(n) for n in names} | {"error": None}
                except Exception:  # noqa: BLE001  whatever a tool raises is its row's error
                    out = {"error": RAISED}
                rows.append({"path": recording["path"]} | out)
            yield pd.DataFrame(rows, columns=["path", *names, "error"])

    made = recordings.join(paths.select("path").distinct(), "path", "left_semi").mapInPandas(run, f"path string, {columns}, error string")
    absent = paths.select("path").distinct().join(recordings.select("path"), "path", "left_anti")
    return made.unionByName(absent.withColumn("error", F.lit(NOT_FOUND)), allowMissingColumns=True)


@dataclass
class Tools:
    """Tools by name: what an agent may call, with a description and a function of its arguments."""

    known: dict[str, tuple[str, Callable]] = field(default_factory=dict)

    def register(self, name: str, description: str):
        def keep(f: Callable) -> Callable:
            self.known[name] = description, f
            return f

        return keep

    def call(self, name: str, **arguments):
        """The tool's result; INVALID_TOOL for a name that is not known."""
        return self.known[name][1](**arguments) if name in self.known else INVALID_TOOL
