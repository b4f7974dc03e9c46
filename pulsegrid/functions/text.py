"""Text as Column expressions: tokens, findings, tagged replies, judge replies, intents, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK unified ideographs, the block that tokens are made of one and two characters of.
CJK = "\\u4e00-\\u9fff"
RUNS = re.compile("[a-z0-9]+|[\u4e00-\u9fff]+")


def tokens(text: Column) -> Column:
    """ASCII runs of the lower-cased text, then the single characters and then the bigrams of each CJK run."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ascii_runs = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))

    def grams(run: Column) -> Column:
        single = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substr(run, i, F.lit(1)))
        pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2))))
        return F.concat(single, F.coalesce(pairs, F.array().cast("array<string>")))

    return F.concat(ascii_runs, F.flatten(F.transform(runs, grams)))


def plain_tokens(text: str | None) -> list[str]:
    """tokens() of a string, for where a row's tokens are counted in Python; their order is that of the text."""
    out: list[str] = []
    for run in RUNS.findall((text or "").lower()):
        if run[0] < "\u4e00":
            out.append(run)
        else:
            out += [*run, *map("".join, zip(run, run[1:], strict=False))]
    return out


def findings(value: Column) -> Column:
    """array<struct<code, prob>> of a list of CODE or CODE(prob): quoted items if there are any, else split ones.

    Items that are neither are dropped; a null or empty value gives an empty array.
    """
    text = F.coalesce(value, F.lit(""))
    single = F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))
    double = F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))
    plain = F.split(F.regexp_replace(text, r"^[\s\[\(]+|[\s\]]+$", ""), r"[,\s]+")
    items = F.when(F.size(single) > 0, single).when(F.size(double) > 0, double).otherwise(plain)
    shape = r"^\s*([A-Za-z0-9_/+-]+(?:\([A-Za-z]+\))?)\s*(?:\(\s*([0-9]*\.?[0-9]+)\s*\))?\s*$"
    good = F.filter(items, lambda x: x.rlike(shape))
    return F.transform(good, lambda x: F.struct(F.regexp_extract(x, shape, 1).alias("code"), F.nullif(F.regexp_extract(x, shape, 2), F.lit("")).cast("double").alias("prob")))


#: Tags of a reply, in the order in which they may come.
TAGS = ("Action", "Thought", "Content", "Tool_Output")


def reply_part(text: Column, tag: str) -> Column:
    """What follows `tag:` up to the next tag or the end, trimmed; null without the tag. A bracket before a tag is allowed."""
    others = "|".join(TAGS)
    pattern = rf"(?is)(?:^|\n)\s*\[?{tag}\s*:\s*(.*?)\s*\]?\s*(?=\n\s*\[?(?:{others})\s*:|\z)"
    return F.when(text.rlike(rf"(?is)(?:^|\n)\s*\[?{tag}\s*:"), F.regexp_extract(text, pattern, 1))


def reply(text: Column) -> Column:
    """struct<action, thought, content, tool_output> of a tagged reply."""
    return F.struct(*(reply_part(text, tag).alias(tag.lower()) for tag in TAGS))


def judge_score(text: Column, criterion: str) -> Column:
    """The whole number after `criterion:` at the start of a line, in any case; null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?im)^{re.escape(criterion)}:\s*(\d+)", 1), F.lit("")).cast("int")


def judge_reason(text: Column, criterion: str) -> Column:
    """What follows `criterion Explanation:` on its line, trimmed; a fixed text without one."""
    pattern = rf"(?im)^{re.escape(criterion)} Explanation:[^\S\n]*(.*)"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1))).otherwise("No justification found.")


def judgement(text: Column, criteria: list[str]) -> Column:
    """struct<scores map, reasons map, average>: of the criteria that have a score; null where none has."""
    found = F.filter(F.array(*(F.struct(F.lit(c).alias("c"), judge_score(text, c).alias("score"), judge_reason(text, c).alias("reason")) for c in criteria)), lambda x: x.score.isNotNull())
    of = lambda name: F.map_from_entries(F.transform(found, lambda x: F.struct(x.c, x[name])))
    total = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x.score)
    return F.when(F.size(found) > 0, F.struct(of("score").alias("scores"), of("reason").alias("reasons"), (total / F.size(found)).alias("average")))


def unfenced(text: Column) -> Column:
    """The text without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", ""))


def fenced_json(text: Column, schema: str) -> Column:
    """A JSON value that may stand in a Markdown fence; null where it can't be read."""
    return F.from_json(unfenced(text), schema)


def ui_classes(value: Column) -> Column:
    """array<struct<label, prob>> of a quoted list of LABEL(prob) for display: narrower than findings(), labels hold no brackets and need a number."""
    items = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("'([^']*)'"), F.lit(1))
    shape = r"^\s*([A-Za-z0-9_/+-]+)\s*\(([0-9.]+)\)"
    good = F.filter(items, lambda x: x.rlike(shape))
    return F.transform(good, lambda x: F.struct(F.regexp_extract(x, shape, 1).alias("label"), F.regexp_extract(x, shape, 2).cast("double").alias("prob")))


def turn_text(action: Column, thought: Column, content: Column, tool_output: Column) -> Column:
    """A turn as tagged lines; tool output wins over content."""
    last = F.when(F.coalesce(tool_output, F.lit("")) != "", F.concat(F.lit("Tool_Output: "), tool_output)).otherwise(F.concat(F.lit("Content: "), F.coalesce(content, F.lit(""))))
    return F.concat(F.lit("Action: "), F.coalesce(action, F.lit("")), F.lit("\nThought: "), F.coalesce(thought, F.lit("")), F.lit("\n"), last)


def first_number(text: Column) -> Column:
    """The first run of digits as a long; null without one."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("long")


def normal_file_id(name: Column) -> Column:
    """HR00012.mat as HR12.mat; other names as they are."""
    return F.regexp_replace(name, r"^HR0*(\d+)\.mat$", "HR$1.mat")


def route(text: Column, rules: list[tuple[str, str]], out_of_scope: str | None = None) -> Column:
    """The intent of the first rule (intent, pattern) that matches; null if none does or out_of_scope does first."""
    out = F.when(text.rlike(out_of_scope), F.lit(None).cast("string")) if out_of_scope else None
    for intent, pattern in rules:
        out = F.when(text.rlike(pattern), intent) if out is None else out.when(text.rlike(pattern), intent)
    return F.lit(None).cast("string") if out is None else out


#: What a pattern's parts that engines read in different ways are spelled as: a boundary of ASCII words, and the very end.
RE2 = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "$": r"\z"}


def as_re2(pattern: str) -> str:
    """A pattern (without (?m)) as RE2 reads it: `\\b` by ASCII words, `$` at the very end only, and no line ends but `\\n`.

    Java's `\\b` counts letters outside ASCII up to version 18 and doesn't from 19 on, its `$` also stands before a last line end.
    """
    return "(?d)" + re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\$", lambda m: RE2.get(m[0], m[0]), pattern, flags=re.DOTALL)


def class_list(classes: Column, threshold: float) -> Column:
    """`LABEL (95.00%)` joined by commas for array<struct<label, prob>>, or `None > 80%`."""
    kept = F.filter(classes, lambda c: c.prob > threshold)
    named = F.transform(kept, lambda c: F.format_string("%s (%.2f%%)", c.label, c.prob * 100))
    return F.when(F.size(kept) > 0, F.array_join(named, ", ")).otherwise(F.lit(f"None > {threshold * 100:.0f}%"))


def bedside_classes(classes: Column, threshold: float = 0.05, most: int = 10) -> Column:
    """`['LABEL(0.95)', ...]` for array<struct<label, prob>>: the likeliest above the threshold, ties by label."""
    order = F.transform(F.filter(classes, lambda c: c.prob > threshold), lambda c: F.struct((-c.prob).alias("less"), c.label.alias("label")))
    named = F.transform(F.slice(F.array_sort(order), 1, most), lambda c: F.format_string("'%s(%.2f)'", c.label, -c.less))
    return F.concat(F.lit("["), F.array_join(named, ", "), F.lit("]"))
