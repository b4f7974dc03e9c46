"""What of a reply that comes in pieces may be shown: the text after its content tag, nothing of a tool's reply.

Tags stand at the start of a line, after blanks or a bracket, in any case. The first action tag's own value, if it is
before the content tag, decides: a tool's name mutes the reply. A word elsewhere does neither. The outcome is the
same however the reply is cut.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import remembered

#: Fixed: actions whose replies are a tool's.
TOOLS = ("call_classification_tool", "call_measurement_tool", "call_morphology_tool", "call_signal_quality_tool")


def tag_line(name: str, separators: str = ":") -> str:
    """What begins a tagged line: blanks, a bracket or none, the tag's name and a separator, with blanks between them."""
    return "^" + r"[ \t]*".join(["", r"\[?", name, f"[{separators}]"])


CONTENT, ACTION = tag_line("content"), tag_line("action", r":\-") + r"[ \t]*([a-z_]+)"
#: What str.strip() strips, for Java.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
CONTENT_TAG, ACTION_TAG = (re.compile(p, re.IGNORECASE | re.MULTILINE) for p in (CONTENT, ACTION + "(?![a-z_])"))
WAITING, OPEN, SHOWING, MUTED = range(4)


def shown(text: Column, tools: tuple[str, ...] = TOOLS) -> Column:
    """What of a whole reply is shown; empty for a tool's, without content tag, or for null."""
    tag = rf"(?im){CONTENT}"
    at = F.regexp_instr(text, F.lit(tag))
    action = F.regexp_extract(F.substr(text, F.lit(1), at - 1), rf"(?im){ACTION}", 1)
    body = F.regexp_extract(F.substr(text, at), rf"(?is){CONTENT}{SPACE}*(.*)\z", 1)
    return F.when((F.coalesce(at, F.lit(0)) > 0) & ~action.isin(*tools), body).otherwise("")


def step(phase: int, held: str, piece: str, tools: tuple[str, ...] = TOOLS) -> tuple[int, str, str]:
    """The phase after a piece, what must be held of the text until its tags are known, and what is shown now."""
    if phase == MUTED:
        return MUTED, "", ""
    if phase == WAITING:
        held += piece
        tag = CONTENT_TAG.search(held)
        action = ACTION_TAG.search(held, 0, tag.start() if tag else len(held))
        # a value at the very end may go on in the next piece
        if action and (tag or action.end() < len(held)) and action.group(1) in tools:
            return MUTED, "", ""
        if not tag:
            return WAITING, held, ""
        phase, piece = OPEN, held[tag.end() :]
    if phase == OPEN:
        piece = piece.lstrip()
    return (SHOWING if piece else phase), "", piece


OUT = "reply_id long, nth int, shown string"


def pieces_shown(pieces: DataFrame, tools: tuple[str, ...] = TOOLS, watermark: str | None = None, idle: float = 600.0, ttl: float | None = None) -> DataFrame:
    """reply_id, nth, shown: what of each piece (reply_id, nth, piece) is shown; pieces of nothing are left out.

    In batch what is shown of the joined text, which is its end, is cut by the pieces' lengths. On a stream a reply's phase and the text
    before its tags are state; pieces have to come in the order of nth over micro-batches. With `watermark` the pieces also have the event time
    `ts`, and a reply's state goes `idle` seconds after its latest piece; with `ttl`, so many seconds of the clock after it.
    """
    if not pieces.isStreaming:
        whole = pieces.groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("piece", F.lit("")).alias("piece")))).alias("p"))
        whole = whole.select("reply_id", F.array_join("p.piece", "").alias("text")).select("reply_id", F.length("text").alias("_all"), F.length(shown(F.col("text"), tools)).alias("_shown")).where("_shown > 0")
        end = F.sum(F.coalesce(F.length("piece"), F.lit(0))).over(Window.partitionBy("reply_id").orderBy("nth"))
        cut = pieces.select("reply_id", "nth", "piece", end.alias("_end")).join(whole, "reply_id").withColumn("_own", F.least(F.length("piece"), F.col("_end") - F.col("_all") + F.col("_shown"))).where("_own > 0")
        return cut.select(F.col("reply_id").cast("long").alias("reply_id"), F.col("nth").cast("int").alias("nth"), F.substr("piece", F.length("piece") - F.col("_own").cast("int") + 1).alias("shown"))

    def advance(key: tuple, before: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        phase, held = before or (WAITING, "")
        rows, found = rows.sort_values("nth"), []
        for nth, piece in zip(rows["nth"].tolist(), rows["piece"].tolist(), strict=True):
            phase, held, now = step(phase, held, piece or "", tools)
            if now:
                found.append((key[0], nth, now))
        return (phase, held), pd.DataFrame(found, columns=["reply_id", "nth", "shown"])

    return remembered(pieces, "reply_id", "phase int, held string", advance, OUT, watermark, idle, ttl)
