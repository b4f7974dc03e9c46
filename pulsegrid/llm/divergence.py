"""How far the sources of a language are apart, by wide vectors of terms.

A term is a run of letters (A-Z, a-z and everything outside ASCII) with A-Z in lower case. Each language keeps the terms
that at least `least` of its documents have. Every kept term is a row that holds an array of its counts by source;
functions over that array emit what the term adds to each pair of sources, and sums by pair are made in the tasks that
emit before anything is shuffled.

Terms are counted in the tasks that read the texts, by numbers in arrays, of which a bounded number is held: a group's count of a
term is a row once for each time that they are handed on, and all rows of a term go to one task, which adds them up and makes the term's row.

p of a term in a source of N occurrences, of V kept terms: 1 + floor(10^9 * (count + 2) / (N + 2 V)). Two sources are
apart by the sum over terms of f(p, q) = floor((p - q)^2 / (p + q)). All of it is integers, so no order of adding counts.

The array holds the sources that have the term. What the others add depends on their sizes alone: with z as p of no
occurrence, f(p, q) of two sources is f(z, z') + (f(p, z') - f(z, z')) + (f(z, q) - f(z, z')) + a rest, which is 0 unless
both have the term. So only pairs of sources that have it are emitted for a term; the other parts are summed once for all
terms of the same count.

Null text, lang and source count as ''. Repeated rows count as often as they are there, whatever their doc_id; texts
without terms (empty ones too) still make a group of their source; no documents give no rows. A language without kept
terms has its pairs, at 0. Ties of the value go by the item in the order of its UTF-8 bytes. Texts are read whole; of other
columns, whatever their names, nothing is read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Fixed: the pattern of a term, once A-Z are in lower case; the number that p counts in, and what is added to counts.
TERM, WHOLE, PRIOR = r"[^\x00-\x60\x7B-\x7F]+", 1_000_000_000, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, RANKS = 10, 10
#: Counts below have a product with WHOLE that is a long.
SHORT = 9_000_000_000
#: Groups (lang, source) up to which their sizes are broadcast: some 10 MB. More are joined, spread by `SPREAD` salts.
BROADCAST, SPREAD = 100_000, 64
#: A-Z to lower case and what is in no term to blanks: split() of such bytes are the terms, as bytes of other than ASCII stay.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms, and distinct ones, beyond which a task hands its counts on after a text; bytes of a text that are split at once; rows of a batch.
HELD, DISTINCT, PIECE, BATCH = 1 << 21, 1 << 19, 1 << 20, 1 << 16


def ascii_lower(text: Column) -> Column:
    """The text with A-Z in lower case; lower() is far cheaper than translate(), and does the same where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time, as a very long text need not be a list of all of them."""
    text, at = text.translate(BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(by: tuple[str, ...]) -> Callable[[shared.Batches], shared.Batches]:
    """A function over batches of `by` and _text (bytes) that yields `by`, term (bytes), n (occurrences) and docs (rows that have it), anew whenever
    HELD terms or DISTINCT different ones are held."""

    def rows(kinds: list[pa.DataType], groups: dict, vocabulary: dict, of: list[int], sizes: list[int], ids: list[np.ndarray]) -> shared.Batches:
        v, terms, group = len(vocabulary), np.concatenate(ids), np.array(of, dtype=np.int64)
        row = np.repeat(np.arange(len(of)), sizes)
        seen = np.unique(row * v + terms, return_counts=True)[0]  # with counts it sorts; without, its hash table takes 30 times as long
        keys, docs = np.unique(group[seen // v] * v + seen % v, return_counts=True)
        n = np.unique(group[row] * v + terms, return_counts=True)[1]
        names, values = pa.array(list(vocabulary), pa.binary()), [pa.array(x, kind) for x, kind in zip(zip(*groups), kinds)]
        for at in range(0, len(keys), BATCH):
            g, t = (pa.array(x) for x in np.divmod(keys[at : at + BATCH], v))
            own = {c: x.take(g) for c, x in zip(by, values)}
            yield shared.batch_of(**own, term=names.take(t), n=n[at : at + BATCH].astype(np.int64), docs=docs[at : at + BATCH].astype(np.int64))

    def count(batches: shared.Batches) -> shared.Batches:
        def anew() -> tuple:
            vocabulary: defaultdict[bytes, int] = defaultdict()
            vocabulary.default_factory = vocabulary.__len__  # a new term gets the next number
            return {}, vocabulary, [], [], []

        kinds, held, state = [], 0, anew()
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            for *key, text in zip(*shared.columns(batch, *by, "_text")):
                groups, vocabulary, of, sizes, ids = state
                found = [np.fromiter(map(vocabulary.__getitem__, w), np.int64, len(w)) for w in split(text)]
                size = sum(map(len, found))
                if size:
                    of.append(groups.setdefault(tuple(key), len(groups)))
                    sizes.append(size)
                    ids.extend(found)
                    held += size
                if held >= HELD or len(vocabulary) >= DISTINCT:
                    yield from rows(kinds, *state)
                    held, state = 0, anew()
        if held:
            yield from rows(kinds, *state)

    return count


def term_counts(docs: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it); or l and i instead of the first two, where `numbers`
    (lang, source, l, i), which is broadcast, numbers languages and their sources: rows are then dealt by l and term."""
    by = ("l", "i") if numbers is not None else ("lang", "source")
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    if numbers is not None:
        rows = rows.join(F.broadcast(numbers), ["lang", "source"])
    kind = "int" if numbers is not None else "string"
    found = shared.map_arrow(rows.select(*by, "_text"), counted(by), f"{by[0]} {kind}, {by[1]} {kind}, term binary, n long, docs long")
    found = found.withColumn("term", F.col("term").cast("string"))
    if numbers is not None:
        found = found.repartition("l", "term")  # counts of a group and rows of a term: one shuffle for both
    return found.groupBy(*by, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(docs: DataFrame) -> DataFrame:
    """lang, source, i: the groups that occur, numbered in each language."""
    found = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    return found.withColumn("i", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a count; in decimals, which cost far more, where the product is no long."""
    over, under = F.lit(WHOLE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)"), total + PRIOR * kept
    short = F.call_function("div", F.lit(WHOLE).cast("long") * (n + PRIOR), under)
    return F.when(kept > 0, F.when(n < SHORT, short).otherwise(F.call_function("div", over, under.cast("decimal(21,0)")).cast("long")) + 1)


def apart(p: Column, q: Column) -> Column:
    """f(p, q): both are 10^9 + 1 at most, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def sized(named: DataFrame, wide: DataFrame) -> DataFrame:
    """A row for each language: names and sizes (N) of its sources by number, z of each, its own size (total) and kept terms (kept)."""
    of_source = wide.select("lang", F.inline("v")).groupBy("lang", "i").agg(F.sum("n").alias("size"))
    of_lang = wide.groupBy("lang").agg(F.sum("total").alias("total"), F.count("*").alias("kept"))
    listed = F.array_sort(F.collect_list(F.struct("i", "source", F.coalesce("size", F.lit(0).cast("long")).alias("size"))))
    rows = named.join(of_source, ["lang", "i"], "left").groupBy("lang").agg(listed.alias("of")).join(of_lang, "lang", "left")
    rows = rows.select("lang", F.col("of.source").alias("names"), F.col("of.size").alias("sizes"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept")))
    return rows.withColumn("zeros", F.transform("sizes", lambda size: share(F.lit(0).cast("long"), size, F.col("kept"))))


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, broadcast: int = BROADCAST) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its language (part `pair`), and the
    `ranks` terms that set it most apart from its language among those that it has more of (part `term`)."""
    named = shared.settled(numbered(docs))
    few = named.count() <= broadcast

    def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """rows with what `groups` has for each language; where it can't be broadcast, rows of a language are spread by a salt."""
        if few:
            return rows.join(F.broadcast(groups), "lang")
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
        return rows.withColumn("_salt", salt).join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["lang", "_salt"]).drop("_salt")

    if few:
        numbers = shared.settled(named.withColumn("l", F.dense_rank().over(Window.orderBy("lang"))))  # of `broadcast` rows at most
        counts = term_counts(docs, numbers)
    else:
        counts = term_counts(docs).join(named, ["lang", "source"])
    key = "l" if few else "lang"
    pivot = counts.groupBy(key, "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("i", "n"))).alias("v")).where(F.col("docs") >= least)
    if few:
        pivot = pivot.join(F.broadcast(numbers.select("l", "lang").distinct()), "l")
    wide = shared.settled(pivot.select("lang", "term", "total", "v"))
    groups = shared.settled(sized(named, wide))
    of = groups.select("lang", "sizes", "zeros", F.col("total").alias("_total"), "kept")
    entry = lambda x: F.struct(x.i.alias("i"), share(x.n, F.get("sizes", x.i), F.col("kept")).alias("p"), F.get("zeros", x.i).alias("z"))
    vectors = with_groups(wide, of).select("lang", "term", share(F.col("total"), F.col("_total"), F.col("kept")).alias("q"), F.transform("v", entry).alias("v"))

    def rest(a: Column, b: Column) -> Column:
        return apart(a.p, b.p) - apart(a.p, b.z) - apart(a.z, b.p) + apart(a.z, b.z)

    # v is never empty; for the outer forms Spark adds no filter on its size, for which it would compute the array once more
    left = vectors.select("lang", "v", F.posexplode_outer("v").alias("k", "a")).where(F.col("k") + 1 < F.size("v"))
    right = F.transform(F.slice("v", F.col("k") + 2, F.size("v")), lambda b: F.struct(b.i.alias("j"), rest(F.col("a"), b).alias("f")))
    both = left.select("lang", F.col("a.i").alias("i"), F.inline_outer(right)).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    alike = vectors.select("lang", F.inline_outer("v")).groupBy("lang", "i", "p", "z").agg(F.count("*").alias("n"))
    added = F.transform("zeros", lambda z, j: F.struct(j.alias("j"), ((apart(F.col("p"), z) - apart(F.col("z"), z)) * F.col("n")).alias("f")))
    single = with_groups(alike, of.select("lang", "zeros")).select("lang", "i", F.inline(added)).where("i <> j").select("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "f")
    none = groups.select("lang", "kept", "zeros", F.posexplode("zeros").alias("i", "z"))
    others = F.transform(F.slice("zeros", F.col("i") + 2, F.size("zeros")), lambda z, k: F.struct((F.col("i") + 1 + k).alias("j"), F.coalesce(F.col("kept") * apart(F.col("z"), z), F.lit(0).cast("long")).alias("f")))
    none = none.select("lang", "i", F.inline(others))
    sums = both.unionByName(single.groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))).unionByName(none).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    ways = sums.select("lang", "value", F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    pairs = with_groups(ways, groups.select("lang", "names")).select("lang", F.get("names", "i").alias("source"), F.lit("pair").alias("part"), F.get("names", "j").alias("item"), "value")
    order = lambda *of: Window.partitionBy(*of).orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order("lang", "source")))
    more = vectors.select("lang", F.col("term").alias("item"), "q", F.inline_outer("v")).where("p > q").select("lang", "i", "item", apart(F.col("p"), F.col("q")).alias("value"))
    top = more.withColumn("rank", F.row_number().over(order("lang", "i"))).where(F.col("rank") <= ranks)
    terms = with_groups(top, groups.select("lang", "names")).select("lang", F.get("names", "i").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
