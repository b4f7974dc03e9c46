"""URL filters: fixed host-and-path rules, and association rules mined from the URLs they label.

URLs that a fixed rule judges are labels. Their tokens (host labels, path
segments, query keys; digits alike) and the verdict make the transactions of Spark's FP-growth. Before it, tokens
that the same rows have become one, and tokens that decide alone are taken out as rules, so that what a site's
URLs share does not multiply; the rules are as good without. Rules that conclude a verdict are pruned by
support, confidence and lift (a rule has to beat the verdict's own share), and by a shorter rule at least as
sure. Unlabelled URLs are judged by the surest rule whose tokens they all have; an inverted index from token
to rules finds it, broadcast or joined by its size with the same outcome. A URL that no rule fits is allowed.

A null URL or one without "://" has an empty host and path, no tokens, and is allowed. Repeated rows
come back each; with no labelled URL there are no mined rules. Columns other than page_id and url are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "verdict="
#: Tokens in rules, and frequent tokens, up to which the index is broadcast (a few tens of MB); the same index is joined beyond.
BROADCAST_TOKENS = 200_000
#: Labelled URLs that a rule must fit at least, however many there are; a parameter of judge().
LEAST_ROWS = 10


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path of every row."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", after.alias("_after")).withColumn("_host", F.regexp_extract("_after", "^[^/?#]*", 0))
    host = F.coalesce(F.translate("_host", UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.expr("substring(_after, length(_host) + 1)"), "^[^?#]*", 0), F.lit(""))
    return split.select("page_id", "url", host.alias("host"), path.alias("path"))


def fixed(rules: tuple[Rule, ...], what: str) -> Column:
    """`text` or `verdict` of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, getattr(r, what)) if out is None else out.when(fits, getattr(r, what))
    return F.lit(None).cast("string") if out is None else out


def tokens() -> Column:
    """The distinct tokens of a URL, from its columns url, host and path."""
    return F.expr(r"""
        array_distinct(concat(
            transform(filter(split(host, '[.]'), x -> x <> ''), x -> concat('host:', regexp_replace(x, '[0-9]+', '0'))),
            transform(filter(split(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/'), x -> x <> ''), x -> concat('path:', regexp_replace(x, '[0-9]+', '0'))),
            transform(filter(split(regexp_extract(coalesce(url, ''), '[?]([^#]*)', 1), '&'), x -> x <> ''), x -> concat('query:', regexp_extract(x, '^[^=]*', 0)))
        ))
    """)


def condensed(items: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions (tokens, verdict) with fewer tokens from which the same rules follow; what stands for what; rules of one token.

    A token that fewer rows than `least` have is in no rule. Tokens that exactly the same rows have are one (the least of them
    stands for all): their combinations fit the same URLs. A token whose rows all have one verdict is a rule by itself,
    and no longer rule that holds it can be surer. The three tables: rows with `tokens`, (token, stands_for), (tokens, then, n, of).
    """
    spread = items.select("row", "verdict", F.explode("tokens").alias("token"))
    mark = F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")
    counts = spread.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.sum(mark).alias("rows"))
    frequent = counts.where(F.col("n") >= least)
    same = Window.partitionBy("n", "blocked", "rows")
    frequent = shared.settled(frequent.withColumn("stands_for", F.min("token").over(same)))
    own = frequent.where("token = stands_for")
    pure = own.where("blocked = 0 or blocked = n")
    single = pure.select(F.array("token").alias("tokens"), F.when(F.col("blocked") > 0, "block").otherwise("allow").alias("then"), F.col("n").alias("n"), F.col("n").alias("of"))
    mixed = own.where("blocked > 0 and blocked < n").select("token")
    rest = spread.join(mixed, "token").groupBy("row", "verdict").agg(F.collect_list("token").alias("tokens"))
    return rest, frequent.select("token", "stands_for"), single


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7, min_lift: float = 1.1, least_rows: int = LEAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Pruned rules (place, tokens, then, confidence, support, size), the surest at place 0, and (token, stands_for) of the tokens that share one.

    labelled: `tokens` (distinct) and `verdict` (allow or block). FP-growth and all pruning are Spark's; nothing is collected.
    """
    items = shared.settled(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"))
    totals = items.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block")).first()
    n = totals["n"]
    least = max(least_rows, math.ceil(min_support * n))  # else each row of a small table is frequent, with all its subsets
    rest, same, single = condensed(items, least)
    found = single
    rest = shared.settled(rest.select(F.array_append("tokens", F.concat(F.lit(VERDICT), "verdict")).alias("items")))
    if rest.take(1):
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / rest.count()), minConfidence=0.0).fit(rest)
        sets = model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(VERDICT))).alias("tokens"), F.get(F.filter("items", lambda x: x.startswith(VERDICT)), F.lit(0)).alias("then"), F.col("freq"))
        of = sets.where("then is null").select("tokens", F.col("freq").alias("of"))
        then = sets.where("then is not null and size(tokens) > 0").select("tokens", F.substring("then", len(VERDICT) + 1, 100).alias("then"), F.col("freq").alias("n"))
        found = found.unionByName(then.join(of, "tokens").select("tokens", "then", "n", "of"))
    share = F.when(F.col("then") == "block", totals["block"]).otherwise(n - totals["block"]) / F.lit(max(n, 1))
    rules = found.select("tokens", "then", (F.col("n") / F.col("of")).alias("confidence"), (F.col("n") / F.lit(max(n, 1))).alias("support"))
    rules = shared.settled(rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * share)))
    # a rule goes if a shorter one on some of its tokens is at least as sure: the shorter one's rarest place is a token of the longer
    short = rules.select("then", F.col("tokens").alias("_tokens"), F.col("confidence").alias("_confidence"), F.element_at("tokens", 1).alias("_first"))
    longer = rules.where("size(tokens) > 1").select("then", "tokens", "confidence", F.explode("tokens").alias("_first"))
    beaten = longer.join(short, ["then", "_first"]).where((F.size("_tokens") < F.size("tokens")) & (F.col("_confidence") >= F.col("confidence")) & (F.size(F.array_except("_tokens", "tokens")) == 0))
    kept = rules.join(beaten.select("then", "tokens").distinct(), ["then", "tokens"], "left_anti")
    return numbered(kept), same


def numbered(rules: DataFrame) -> DataFrame:
    """Rules with their place: the surest first, then by support, more tokens, tokens and verdict; by ranges, so that no task sorts all."""
    order = [F.desc("confidence"), F.desc("support"), F.desc("size"), "tokens", "then"]
    dealt = shared.settled(rules.withColumn("size", F.size("tokens")).repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")))
    inside = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each shuffle partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return inside.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_nth") - 1).alias("place"), "tokens", "then", "confidence", "support", "size")


class RuleIndex:
    """Rules by one inverted index: a rule fires when as many of its tokens were met as it has."""

    def __init__(self, rules: list[tuple[list[str], str]], same: dict[str, str] | None = None):
        self.rules, self.same = rules, same or {}
        self.needs = [len(r[0]) for r in rules]
        self.postings: dict[str, list[int]] = {}
        for n, r in enumerate(rules):
            for t in r[0]:
                self.postings.setdefault(t, []).append(n)

    def first(self, found: list[str]) -> int | None:
        """The surest rule (the first in order) all of whose tokens are among the distinct ones found; a token counts as what stands for it."""
        met: dict[int, int] = {}
        for t in {self.same.get(t, t) for t in found}:
            for n in self.postings.get(t, ()):
                met[n] = met.get(n, 0) + 1
        return min((n for n, k in met.items() if k == self.needs[n]), default=None)


def by_index(asked: DataFrame, rules: DataFrame, same: DataFrame) -> DataFrame:
    """_row, then, mined for rows (_row, tokens) by an index that is broadcast."""
    held = [(r["tokens"], r["then"]) for r in rules.orderBy("place").collect()]
    index = RuleIndex(held, {r["token"]: r["stands_for"] for r in same.where("token <> stands_for").collect()})
    shipped = asked.sparkSession.sparkContext.broadcast(index)

    def run(batches: shared.Batches) -> shared.Batches:
        known = shipped.value
        for batch in batches:
            rows, tokens_ = shared.columns(batch, "_row", "tokens")
            first = [known.first(found or []) for found in tokens_]
            yield shared.batch_of(_row=pa.array(rows, pa.int64()), then=pa.array([None if n is None else known.rules[n][1] for n in first], pa.string()), mined=pa.array([None if n is None else " ".join(known.rules[n][0]) for n in first], pa.string()))

    return shared.map_arrow(asked.select("_row", "tokens"), run, "_row long, then string, mined string")


def by_join(asked: DataFrame, rules: DataFrame, same: DataFrame) -> DataFrame:
    """What by_index() gives, with the inverted index as a table that is joined: for more rules than can be broadcast.

    A rule is posted under its token that the fewest rules have; what fits is then told by all of its tokens.
    """
    spread = rules.select("place", F.explode("tokens").alias("token"))
    often = spread.groupBy("token").agg(F.count("*").alias("n"))
    posted = spread.join(often, "token").groupBy("place").agg(F.min_by("token", F.struct("n", "token")).alias("token")).join(rules, "place").select("token", "place", "then", F.col("tokens").alias("wanted"))
    named = asked.select("_row", F.explode("tokens").alias("token")).join(same, "token", "left").select("_row", F.coalesce("stands_for", "token").alias("token")).distinct()
    whole = named.groupBy("_row").agg(F.collect_list("token").alias("found"))
    met = named.join(posted, "token").join(whole, "_row").where(F.size(F.array_except("wanted", "found")) == 0)
    best = met.groupBy("_row").agg(F.min_by(F.struct("then", F.array_join("wanted", " ").alias("mined")), "place").alias("_best")).select("_row", "_best.*")
    return asked.select("_row").join(best, "_row", "left")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, min_support: float = 0.002, min_confidence: float = 0.7, broadcast_tokens: int = BROADCAST_TOKENS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the tokens of the mined rule that decided, else null) of every URL.

    A mined rule fits `min_support` of the labelled URLs and `least_rows` of them at least, and `min_confidence` of those have its verdict.
    """
    known = shared.settled(parts(pages).withColumns({"rule": fixed(rules, "text"), "fixed": fixed(rules, "verdict"), "tokens": tokens(), "_row": F.monotonically_increasing_id()}))
    mined, same = mine(known.where("fixed is not null").select("tokens", F.col("fixed").alias("verdict")), min_support, min_confidence, least_rows=least_rows)
    mined = shared.settled(mined)
    sizes = mined.agg(F.sum("size")).first()[0] or 0, same.count()
    asked = known.where("fixed is null").select("_row", "tokens")
    told = (by_index if sum(sizes) <= broadcast_tokens else by_join)(asked, mined, same)
    judged = known.join(told, "_row", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", "then", F.lit("allow")).alias("verdict"), "mined")
