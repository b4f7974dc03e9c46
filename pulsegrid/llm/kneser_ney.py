"""Quality rules by n-gram perplexity: modified Kneser-Ney character models, one for each language.

The models are of order four over the characters of a text with one blank between words, so they see
spelling and, across the blanks, what follows what: sentence ends, capitals, how words join. Spark counts
the 4-grams of all documents. A symbol is 16 bits, so an n-gram is its own 64-bit hash. Counts,
continuation counts, discounts and back-off masses of every order are Spark tables, keyed by language and
n-gram; no count is dropped.

The corpus is cut into chunks of bounded size, of one language and half each. A chunk holds its documents as word
numbers and its distinct n-grams as a sorted array with counts, and is scored from a sorted array of n-grams with
their log-probabilities: all of them, broadcast, while they are at most BROADCAST_GRAMS, else those that the
chunk holds, joined to it, so that a task needs of a model what its own texts do, however large that is. Both give the
same.

Documents are dealt in halves by a hash of the text, and each is scored by the models of the other
half: a model that had counted a document's own n-grams would find any junk likely. A symbol's probability is
six parts its language's model and four parts the model of all languages, so that clean texts with passages in
another language stay inside. Perplexity is by symbol.

Each language has a band of log-perplexity around its median. Its half-widths above and below are multiples of
the median deviation, for a text of typical length; shorter ones, whose perplexity varies more, have a wider band
(by the root of the ratio of lengths), as do languages with few documents (by `few` / documents of the languages' mean
deviation), for which a median says little. What is above is junk: random characters, words in an order that the language does not have.
What is below repeats the most common words.

The `most_languages` languages with the most documents have a model each; others share one, with null.
Null and empty texts have no words and fail the base rules. Repeated rows are judged each; no documents give
no rows. Texts are read whole, however long. A perplexity on a band's edge is inside. Columns other
than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ORDER, BITS = 4, 16
BLANK, DIGIT = 0x20, ord("0")
#: Where symbols of more than 16 bits go, by their remainder: a range that is for private use.
PRIVATE, PRIVATE_SIZE = 0xE000, 6400
#: Words of all open chunks of a task after which they are closed.
CHUNK_WORDS = 3_000_000
#: Bytes of text that a task makes chunks of, where input partitions are smaller, and such tasks at least.
TASK_BYTES, LEAST_TASKS = 8_000_000, 8
#: N-grams of chunks that are added up by one task, and n-grams of models that one works out.
TOGETHER, TASK_GRAMS = 1_000_000, 100_000
#: Multiples of the scaled median deviation below and above the median.
BELOW, ABOVE = 4.0, 3.5
#: Documents of a language at which its band is widened by as much as the languages' bands are wide on average.
FEW = 20
MOST_LANGUAGES = 255
#: N-grams of all models up to which they are broadcast, as sorted arrays of 24 bytes an n-gram.
BROADCAST_GRAMS = 4_000_000
#: Number of the model of all languages, and its share in a symbol's probability.
ALL, ALL_SHARE = MOST_LANGUAGES + 1, 0.4
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def symbols(words: list[bytes]) -> np.ndarray:
    """The symbols of the words, a blank before, between and after them: digits alike, code points of 16 bits."""
    text = b"".join([b" ", b" ".join(words), b" "]).decode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    points[(points >= 48) & (points <= 57)] = DIGIT
    high = points > 0xFFFF
    points[high] = PRIVATE + points[high] % PRIVATE_SIZE
    return points


class Words:
    """Words by number: symbols, ends, and the 4-grams that lie in a word and the blanks around it."""

    def __init__(self, words: list[bytes]):
        points = symbols(words)
        ends = np.nonzero(points == BLANK)[0][1:]
        starts = np.concatenate([[1], ends[:-1] + 1])
        #: Symbols that are scored: a word's own and the blank after it.
        self.length = ends - starts + 1
        #: The last two symbols before the blank after a word, and its first two: what a border's 4-grams are made of.
        self.tail = points[ends - 2] << np.uint64(BITS) | points[ends - 1]
        self.head = points[starts] << np.uint64(BITS) | points[starts + 1]
        grams = points[: max(0, len(points) - 3)] << np.uint64(48) | points[1:-2] << np.uint64(32) | points[2:-1] << np.uint64(16) | points[3:]
        #: Each word's own 4-grams, word after word: those that end from its third symbol on.
        self.own = np.maximum(self.length - 2, 0)
        first = np.repeat(starts - 1, self.own) + np.arange(int(self.own.sum())) - np.repeat(np.cumsum(self.own) - self.own, self.own)
        self.grams = grams[first] if len(grams) else np.empty(0, dtype=np.uint64)

    def borders(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each word of texts laid end to end: the tail of the word before (blanks at a text's start) and its own head."""
        tails = np.full(len(numbers), BLANK << BITS | BLANK, dtype=np.uint64)
        tails[1:] = self.tail[numbers[:-1]]
        tails[(np.cumsum(lengths) - lengths)[lengths > 0]] = BLANK << BITS | BLANK
        return tails << np.uint64(32) | self.head[numbers]


def border_grams(borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams that end at a word's first and second symbol."""
    one = borders & np.uint64(0xFFFFFFFF00000000) | np.uint64(BLANK << 16) | borders >> np.uint64(16) & np.uint64(0xFFFF)
    two = borders << np.uint64(16) & np.uint64(0xFFFF000000000000) | np.uint64(BLANK << 32) | borders & np.uint64(0xFFFFFFFF)
    return one, two


def repeated(numbers: list[np.ndarray], window: int = WINDOW) -> list[int]:
    """For each text, its words that lie in a window found twice or more in the text."""
    lengths = np.array([len(x) for x in numbers], dtype=np.int64)
    out = np.zeros(len(numbers), dtype=np.int64)
    usable = np.nonzero(lengths >= window)[0]
    if not len(usable):
        return out.tolist()
    text = np.repeat(usable, lengths[usable])
    with np.errstate(over="ignore"):
        x = np.concatenate([numbers[i] for i in usable]).astype(np.uint64)
        key = text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        n = len(x) - window + 1
        for k in range(window):
            key = mix(key[:n] ^ x[k : k + n] * np.uint64(0x9E3779B97F4A7C15))
    inside = text[:n] == text[window - 1 :]
    _, where, times = np.unique(key[inside], return_inverse=True, return_counts=True)
    twice = np.zeros(n, dtype=np.int64)
    twice[np.nonzero(inside)[0]] = times[where] > 1
    edges = np.zeros(len(x) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    np.add.at(out, text, (np.cumsum(edges)[:-1] > 0).astype(np.int64))
    return out.tolist()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen: set[str] = set()
    out = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            out += line in seen
            seen.add(line)
    return out


class Chunk:
    """Documents of one model as word numbers, with the counts of the base rules."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.numbers: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[tuple[int, ...]] = []

    def add(self, doc_id: int | None, text: str, words: list[bytes]) -> None:
        known = self.known
        for w in words:
            if w not in known:
                known[w] = len(known)
        self.numbers.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)))
        self.doc_ids.append(doc_id)
        self.counts.append((len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)), duplicate_lines(text)))

    def row(self, chunk: int, model: int) -> dict:
        counts = np.array([(*c, r) for c, r in zip(self.counts, repeated(self.numbers), strict=True)], dtype=np.int64)
        numbers = np.concatenate(self.numbers)
        out = {"chunk": chunk, "model": model, "doc_ids": self.doc_ids, "counts": shared.pack(counts.ravel()), "numbers": shared.pack(numbers), "size": 0, "words": b"", "grams": shared.pack_sorted(np.empty(0, dtype=np.uint64)), "times": b""}
        if self.known:
            words = Words(list(self.known))
            borders, often = np.unique(words.borders(numbers, counts[:, 0]), return_counts=True)
            grams, where = np.unique(np.concatenate([words.grams, *border_grams(borders)]), return_inverse=True)
            each = np.bincount(numbers, minlength=len(self.known))
            times = np.bincount(where, np.concatenate([np.repeat(each, words.own), often, often]).astype(np.float64)).astype("<i8")
            out |= {"size": len(grams), "words": zstandard.ZstdCompressor(level=1).compress(b"\n".join(self.known)), "grams": shared.pack_sorted(grams), "times": shared.pack(times)}
        return out


CHUNK = pa.schema([("chunk", pa.int64()), ("model", pa.int32()), ("size", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("counts", "numbers", "words", "grams", "times"))])
CHUNK_DDL = "chunk long, model int, size long, doc_ids array<long>, counts binary, numbers binary, words binary, grams binary, times binary"


def chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The documents (doc_id, text, model) in chunks of one model each."""

    def run(batches: shared.Batches) -> shared.Batches:
        open_: dict[int, Chunk] = {}
        made, held = TaskContext.get().partitionId() << 24, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for model, chunk in open_.items():
                yield pa.RecordBatch.from_pylist([chunk.row(made, model)], schema=CHUNK)
                made += 1
            open_.clear()

        for batch in batches:
            for doc_id, text, model in zip(*shared.columns(batch, "doc_id", "text", "model"), strict=True):
                text = text or ""
                words = text.encode("utf-8", "surrogatepass").split()
                open_.setdefault(model, Chunk()).add(doc_id, text, words)
                held += len(words) + 1
                if held > chunk_words:
                    yield from close()
                    held = 0
        yield from close()

    return shared.map_arrow(docs.select("doc_id", "text", "model"), run, CHUNK_DDL)


def spread(made: DataFrame) -> DataFrame:
    """chunk, lang, half, gram, n: a chunk's 4-grams as rows."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            for chunk, model, grams, times in zip(*shared.columns(batch, "chunk", "model", "grams", "times"), strict=True):
                if times:
                    keys = shared.unpack_sorted(grams).view(np.int64)
                    yield shared.batch_of(chunk=np.full(len(keys), chunk), lang=np.full(len(keys), model // 2, dtype=np.int32), half=np.full(len(keys), model % 2, dtype=np.int32), gram=keys, n=shared.unpack(times, "<i8"))

    return shared.map_arrow(made.select("chunk", "model", "grams", "times"), run, "chunk long, lang int, half int, gram long, n long")


def discounts(of: list[int]) -> list[float]:
    """Those of n-grams seen once, twice and more often, from how many are seen one to four times."""
    y = of[0] / (of[0] + 2 * of[1]) if of[0] and of[1] else 0.5
    return [min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.05), k - 0.05) if of[k - 1] and of[k] else 0.5 for k in (1, 2, 3)]


def probabilities(counted: DataFrame) -> DataFrame:
    """lang, gram, p0, p1: modified Kneser-Ney by each half's models, of every 4-gram of either half in `counted` (lang, gram, n0, n1)."""
    spark, halves = counted.sparkSession, (0, 1)
    # tasks by the rows, not by the shuffle's partitions: there are two dozen exchanges, and blocks that are all but empty add up
    tasks = max(1, -(-counted.count() // TASK_GRAMS))
    levels = [counted.coalesce(tasks)]
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: in how many seen n-grams each shorter one ends
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1))
        levels.append(levels[-1].groupBy("lang", shorter.alias("gram")).agg(*(F.count_if(F.col(f"n{h}") > 0).alias(f"n{h}") for h in halves)).coalesce(tasks))
    p = None
    for order, level in enumerate(reversed(levels), 1):
        tally = level.groupBy("lang").agg(F.count("*").alias("all"), *(F.count_if(F.col(f"n{h}") == k).alias(f"h{h}k{k}") for h in halves for k in (1, 2, 3, 4))).collect()
        rows = [(r["lang"], 1 / (r["all"] + 1), *(d for h in halves for d in discounts([r[f"h{h}k{k}"] for k in (1, 2, 3, 4)]))) for r in tally]
        cuts = F.broadcast(spark.createDataFrame(rows, "lang int, uniform double, " + ", ".join(f"h{h}d{k} double" for h in halves for k in (1, 2, 3))))  # a row for each of MOST_LANGUAGES + 2 at most
        cut = lambda h: F.when(F.col(f"n{h}") == 0, 0.0).when(F.col(f"n{h}") == 1, F.col(f"h{h}d1")).when(F.col(f"n{h}") == 2, F.col(f"h{h}d2")).otherwise(F.col(f"h{h}d3")).alias(f"cut{h}")
        seen = level.join(cuts, "lang").select("lang", "gram", F.shiftrightunsigned("gram", BITS).alias("context"), "uniform", "n0", "n1", *map(cut, halves))
        contexts = seen.groupBy("lang", "context").agg(*(F.sum(f"n{h}").alias(f"total{h}") for h in halves), *(F.sum(f"cut{h}").alias(f"left{h}") for h in halves)).coalesce(tasks)
        share = lambda x, h, none: F.when(F.col(f"total{h}") > 0, x / F.col(f"total{h}")).otherwise(F.lit(none))
        own = seen.join(F.broadcast(contexts) if order == 1 else contexts, ["lang", "context"])
        own = own.coalesce(tasks).select("lang", "gram", "uniform", *(share(F.col(f"left{h}"), h, 1.0).alias(f"mass{h}") for h in halves), *(share(F.col(f"n{h}") - F.col(f"cut{h}"), h, 0.0).alias(f"rest{h}") for h in halves))
        if p is None:
            p = own.select("lang", "gram", *((F.col(f"mass{h}") * F.col("uniform") + F.col(f"rest{h}")).alias(f"p{h}") for h in halves))
        else:
            below = p.select("lang", F.col("gram").alias("_end"), F.col("p0").alias("_p0"), F.col("p1").alias("_p1"))
            end = F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
            p = own.withColumn("_end", end).join(below, ["lang", "_end"]).coalesce(tasks).select("lang", "gram", *((F.col(f"mass{h}") * F.col(f"_p{h}") + F.col(f"rest{h}")).alias(f"p{h}") for h in halves))
    return p


def tables(made: DataFrame) -> DataFrame:
    """lang, gram, log_p0, log_p1: what each half's models, mixed with that of all languages, say of the corpus's 4-grams."""
    of = lambda h: F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}")
    # chunks of small files are taken together, so that what they share is added up before it is sent
    size = made.agg(F.sum("size")).first()[0] or 0
    together = made.coalesce(max(1, -(-size // TOGETHER)))
    own = shared.settled(spread(together).groupBy("lang", "gram").agg(of(0), of(1)))
    every = own.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).select(F.lit(ALL).alias("lang"), "gram", "n0", "n1")
    p = shared.settled(probabilities(own.unionByName(every)))
    common = p.where(F.col("lang") == ALL).select("gram", F.col("p0").alias("_p0"), F.col("p1").alias("_p1"))
    return p.where(F.col("lang") != ALL).join(common, "gram").select("lang", "gram", *(F.log((1 - ALL_SHARE) * F.col(f"p{h}") + ALL_SHARE * F.col(f"_p{h}")).alias(f"log_p{h}") for h in (0, 1)))


SCORED = "doc_id long, model int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbols long, log_perplexity double"


def scores(row: dict, grams: np.ndarray, log_p: np.ndarray) -> pa.Table:
    """A chunk's documents as scored() has them, from sorted 4-grams (all of the chunk's, at least) and their log-probabilities."""
    n = len(row["doc_ids"])
    counts, numbers = shared.unpack(row["counts"], "<i8").reshape(n, -1), shared.unpack(row["numbers"], "<u4")
    logs, size = np.full(n, np.nan), np.zeros(n, dtype=np.int64)
    if len(numbers):
        words = Words(zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n"))
        of = lambda keys: log_p[np.searchsorted(grams, keys)]
        inside = np.bincount(np.repeat(np.arange(len(words.own)), words.own), of(words.grams), minlength=len(words.own))
        borders, where = np.unique(words.borders(numbers, counts[:, 0]), return_inverse=True)
        one, two = border_grams(borders)
        text = np.repeat(np.arange(n), counts[:, 0])
        sums = np.bincount(text, inside[numbers] + (of(one) + of(two))[where], minlength=n)
        size = np.bincount(text, words.length[numbers], minlength=n).astype(np.int64)
        logs[size > 0] = -sums[size > 0] / size[size > 0]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "model": pa.array([row["model"]] * n, pa.int32()), **{k: counts[:, i] for i, k in enumerate(names)}, "symbols": size, "log_perplexity": pa.array(logs, mask=np.isnan(logs))})


def scored(made: DataFrame, said: DataFrame, broadcast: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, model, the counts of the base rules, symbols, log_perplexity (null without words) of every document.

    Tables of up to `broadcast` n-grams are sent whole, as sorted arrays; of larger ones each chunk is sent what it holds, with the
    same outcome.
    """
    if said.count() <= broadcast:
        got = said.toArrow()
        langs, grams = got.column("lang").to_numpy(), got.column("gram").to_numpy().view(np.uint64)
        order = np.lexsort((grams, langs))
        edges = np.searchsorted(langs[order], np.arange(MOST_LANGUAGES + 3))
        logs = [got.column(f"log_p{h}").to_numpy()[order] for h in (0, 1)]
        shipped = made.sparkSession.sparkContext.broadcast((grams[order], logs, edges))

        def whole(batches: shared.Batches) -> shared.Batches:
            grams, logs, edges = shipped.value
            for batch in batches:
                for row in batch.to_pylist():
                    a, b = edges[row["model"] // 2], edges[row["model"] // 2 + 1]
                    yield from scores(row, grams[a:b], logs[1 - row["model"] % 2][a:b]).to_batches()

        return shared.map_arrow(made, whole, SCORED)
    asked = spread(made).select("chunk", "lang", "half", "gram")
    answers = asked.join(said, ["lang", "gram"]).select("chunk", "gram", F.when(F.col("half") == 0, F.col("log_p1")).otherwise(F.col("log_p0")).alias("log_p"))

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        grams, log_p = known.column("gram").to_numpy().view(np.uint64), known.column("log_p").to_numpy()
        order = np.argsort(grams)
        return scores(chunk.to_pylist()[0], grams[order], log_p[order])

    return made.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORED)


def measured(docs: DataFrame, most_languages: int = MOST_LANGUAGES, chunk_words: int = CHUNK_WORDS, broadcast: int = BROADCAST_GRAMS) -> DataFrame:
    """What scored() gives, of every row of (doc_id, text, lang)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    large = named.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(most_languages, MOST_LANGUAGES)).collect()
    numbers = F.create_map(*(x for n, r in enumerate(large, 1) for x in (F.lit(r["lang"]), F.lit(n)))) if large else None
    number = F.coalesce(F.try_element_at(numbers, F.col("lang")), F.lit(0)) if large else F.lit(0)
    # small files are read together, as small chunks share most of their n-grams
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    named = named.coalesce(max(LEAST_TASKS, -(-size // TASK_BYTES)))
    made = shared.settled(chunks(named.withColumn("model", (2 * number + F.pmod(F.xxhash64("text"), F.lit(2))).cast("int")), chunk_words))
    return scored(made, shared.settled(tables(made)), broadcast)


def judge(docs: DataFrame, below: float = BELOW, above: float = ABOVE, few: float = FEW, most_languages: int = MOST_LANGUAGES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, the base rules' counts and verdict, perplexity, its band, and kept, of every document."""
    rows = measured(docs, most_languages, chunk_words).withColumn("lang", F.floor(F.col("model") / 2).cast("int"))
    rows = shared.settled(rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    sound = rows.where("not base_failed")
    middles = sound.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"), F.percentile_approx("symbols", 0.5, 10000).alias("typical"), F.count("*").alias("docs"))
    # languages have a row each, MOST_LANGUAGES + 1 at most
    longer = F.greatest(F.lit(1.0), F.sqrt(F.col("typical") / F.col("symbols")))
    spread_ = sound.join(F.broadcast(middles), "lang").groupBy("lang", "middle", "typical", "docs").agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")) / longer, 0.5, 10000).alias("spread"))
    every = Window.partitionBy(F.lit(0))  # a few languages' rows
    spread_ = spread_.withColumn("common", F.sum(F.col("spread") * F.col("docs")).over(every) / F.sum("docs").over(every))
    judged = rows.join(F.broadcast(spread_.withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang"), "left")
    width = 1.4826 * (F.col("spread") + F.col("common") * few / F.col("docs")) * longer
    judged = judged.withColumns({"low": F.col("middle") - below * width, "high": F.col("middle") + above * width})
    kept = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.exp("log_perplexity").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"))
