"""Importance resampling towards a target corpus, by tries of words.

A word is a run of ASCII letters, digits and characters outside ASCII, with A-Z in lower case. The features of a text are its runs
of one to three consecutive words, joined by one space, repeats counted; a feature's bucket is its CRC-32 modulo `BUCKETS`.

Each task builds tries of the words that it meets: a node is a feature, below that of one word fewer, and holds how often it was
met and the state of the CRC so far, so a child's state takes the bytes of its last word only. A trie is built level by level
from arrays, over `BLOCK` words at a time, so its size is bounded; then its counts are added to the task's totals by bucket, which
alone are shuffled. For the scores the same tries hold each node's gain, and a text's weight is the sum along the paths it walks.

The draw orders all documents by range, numbers them in each range, and adds what the ranges before hold: no task has all rows.

Null texts are without words, as empty ones are: no features, weight 0. A text longer than a block is walked in parts that overlap by
two words, so no feature is lost or counted twice. Repeated rows count as often as they are there. Ties of the score go to the
smaller doc_id. A null doc_id is hashed as an empty one and comes last among its ties. Without target texts or
documents the formula stands as it is (T or S is 0). Other columns of `docs` and `target` are not read.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Fixed: buckets, words of the longest feature, words that a document needs for the draw, and how many of a hundred are drawn.
BUCKETS, LONGEST, NEEDED, PERCENT = 10_000, 3, 20, 5
#: Words of a trie: some 200 MB of arrays in a task.
BLOCK = 500_000
#: Fixed: a word, in UTF-8 after lower-casing; bytes from 0x80 on are characters outside ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Trie:
    """Features of a block of words: node of each position and length, the nodes' buckets.

    words: the block's words; room: how many words a feature that starts there may have (0 to 3).
    """

    def __init__(self, words: list[bytes], room: np.ndarray):
        number: dict[bytes, int] = {}
        at = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        crc, spaced = zlib.crc32, np.array([b" " + w for w in number], dtype=object)
        states = [crc(w) for w in number]
        #: For each level: starts of its features, their nodes, and each node's bucket.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.nonzero(room > 0)[0]
        node, parents = at[starts], np.array(states, dtype=np.int64)
        self.levels.append((starts, node, parents % BUCKETS))
        for length in range(2, LONGEST + 1):
            on = room[starts] >= length
            starts, above = starts[on], node[on]
            last = at[starts + length - 1]
            # a child is its parent and its last word
            keys, node = np.unique(above * len(number) + last, return_inverse=True)
            children = [crc(w, s) for w, s in zip(spaced[keys % max(1, len(number))].tolist(), parents[keys // max(1, len(number))].tolist(), strict=True)]
            parents = np.array(children, dtype=np.int64)
            self.levels.append((starts, node, parents % BUCKETS))

    def totals(self) -> np.ndarray:
        """Features by bucket."""
        return sum(np.bincount(bucket, np.bincount(node, minlength=len(bucket)), minlength=BUCKETS).astype(np.int64) for _, node, bucket in self.levels if len(node)) + np.zeros(BUCKETS, dtype=np.int64)

    def sums(self, gains: np.ndarray, size: int) -> np.ndarray:
        """By position: the gains of the features that start there."""
        out = np.zeros(size, dtype=np.int64)
        for starts, node, bucket in self.levels:
            out[starts] += gains[bucket][node]
        return out


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def blocks(texts, size: int = BLOCK):
    """(words, room, texts' numbers by position, number -> words of the text) of at most `size` words and two more, from an iterable of texts.

    A text may go on in the next block: its part's last two words are repeated there, as ends (room 0 here) of features that start before.
    """
    words, room, owner, lengths = [], [], [], {}

    def full() -> tuple:
        return words, np.concatenate(room) if room else np.zeros(0, dtype=np.int64), np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64), lengths

    for number, text in enumerate(texts):
        own = words_of(text)
        lengths[number] = len(own)
        start = 0
        while start < len(own):
            end = min(len(own), start + size - len(words))
            part = own[start : end + LONGEST - 1]
            left = np.minimum(LONGEST, len(own) - np.arange(start, start + len(part)))
            left[end - start :] = 0
            words += part
            room.append(left)
            owner.append(np.full(len(part), number))
            start = end
            if len(words) >= size:
                yield full()
                words, room, owner, lengths = [], [], [], {}
    if lengths or words:
        yield full()


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: features of all texts by bucket."""

    def run(batches: shared.Batches) -> shared.Batches:
        totals = np.zeros(BUCKETS, dtype=np.int64)
        for words, room, _, _ in blocks(t for batch in batches for t in batch.column(0).to_pylist()):
            totals += Trie(words, room).totals()
        met = np.nonzero(totals)[0]
        yield shared.batch_of(bucket=pa.array(met), n=pa.array(totals[met]))

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain: by how much it is commoner in the target, in thousandths of a logarithm."""
    both = [{r["bucket"]: r["n"] for r in bucket_counts(t).collect()} for t in (docs, target)]
    every, wanted = (sum(x.values()) for x in both)
    ratio = lambda b: float((both[1].get(b, 0) + 1) * (every + BUCKETS)) / float((both[0].get(b, 0) + 1) * (wanted + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, words, n_features, weight of each document."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            ids, texts = shared.columns(batch, "doc_id", "text")
            n, weight = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            for words, room, owner, lengths in blocks(texts):
                if len(words):
                    np.add.at(weight, owner, Trie(words, room).sums(shipped.value, len(words)))
                n[list(lengths)] = list(lengths.values())
            features = sum(np.maximum(0, n - i) for i in range(LONGEST))
            yield shared.batch_of(doc_id=pa.array(ids, pa.int64()), words=pa.array(n), n_features=pa.array(features), weight=pa.array(weight))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, needed: int = NEEDED, percent: int = PERCENT, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of each document."""
    # written once: ordering by range reads its rows twice
    found = shared.settled(weights(docs, gains(docs, target)))
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    unit = (F.conv(digest, 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = found.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(unit))).cast("long")).withColumn("able", F.col("words") >= needed)
    ordered = shared.settled(scored.orderBy(F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("able").cast("long")).alias("able")).orderBy("part").collect()
    before, held = [], 0
    for r in sizes:
        before.append((r["part"], held))
        held += r["n"]
    drawn = percent * sum(r["able"] for r in sizes) // 100
    starts = docs.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
