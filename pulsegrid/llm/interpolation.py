"""Deleted interpolation: a word bigram model whose mixture weights depend on the context's count.

P(w | v) = l2(b) c(v w)/c(v) + l1(b) c(w)/N + l0(b) 1/(V+1), b the bucket (power of two) of c(v).
The maximum-likelihood estimates come from all training documents. The weights of each bucket come
from expectation-maximisation on held-out counts: a tenth of the training documents is scored with
the counts of the other nine tenths, and EM runs over a table of how often each combination of the
estimates (to a quarter of an octave) occurred, which is bounded whatever the corpus.

The corpus is counted in chunks: a chunk holds its documents as word ids, asks for the counts of its
distinct words and bigrams, and gets them back in the order asked. Words travel as sorted 64-bit
hashes and bigrams as 56-bit ones, dealt by hash into ranges, so no frequent word makes a large partition.

Null and empty texts are the end token alone. A null doc_id is neither held out nor learned from;
repeated rows count and are scored each. An empty table gives no rows. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Tokens after which a chunk is closed.
CHUNK_TOKENS = 4_000_000
#: Bytes of text whose tokens are a range of the hash, on average.
RANGE_BYTES = 16_000_000
#: Words of a chunk that are numbered by frequency.
FREQUENT = 1 << 15
#: One in so many training documents is held out for the mixture weights.
EM_FOLD = 10
#: The end token and the start context, as hashes of bytes that no word can hold.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\n", b"\t"))
#: Steps in an octave of the table for EM.
STEPS = 4
NEVER = -(1 << 20)


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of word pairs from the words' hashes: the upper 56 of 64 bits, as keys are most of what is shuffled."""
    with np.errstate(over="ignore"):
        x = before * np.uint64(0x9E3779B97F4A7C15) + word
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & ~np.uint64(0xFF)


def before(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The context id of each token, `start` at the start of a document."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = start
    return out


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Chunk:
    """Documents as ids of their words; id 0 is the end token."""

    def __init__(self, em: bool):
        self.em, self.tokens = em, 0
        self.words = _Vocabulary()
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []

    def add(self, doc_id, text, train: bool, held_out: bool) -> None:
        ids = np.array([*map(self.words.__getitem__, shared.ascii_lower_words(text)), 0], dtype=np.uint32)
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), train, held_out))
        self.tokens += len(ids)

    def rows(self, chunk: int, bits: int) -> list[dict]:
        """The documents, and the keys asked for with their counts here, by order and range of the hash."""
        ids = np.concatenate(self.ids)
        lengths = np.array([d[1] for d in self.docs], dtype=np.int64)
        train = np.array([d[2] for d in self.docs], dtype=bool)
        counts = np.bincount(ids, minlength=len(self.words) + 1)
        hashes = np.concatenate([[END], np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))])
        # frequent words get small ids, which pack well; the others follow by hash, as sorted hashes do
        order = np.argsort(-counts, kind="stable")
        order[FREQUENT:] = order[FREQUENT:][np.argsort(hashes[order[FREQUENT:]])]
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        ids = rank[ids]
        hashes = hashes[order]
        learned = np.repeat(train, lengths)
        out = [
            {
                "key": -1 - chunk, "chunk": chunk, "em": self.em, "part": 0, "a": pack_ids(ids), "b": shared.pack(hashes[:FREQUENT]), "c": shared.pack_sorted(hashes[FREQUENT:]), "d": shared.pack(lengths), "n": int(learned.sum()),
                "doc_ids": [d[0] for d in self.docs], "held": [d[3] for d in self.docs],
            }
        ]
        known = np.bincount(ids[learned], minlength=len(hashes))
        at = np.argsort(hashes)
        pairs = bigram_keys(np.concatenate([hashes, [START]])[before(ids, lengths, len(hashes))], hashes[ids])
        keys, where = np.unique(pairs, return_inverse=True)
        for n, (k, c) in enumerate(((hashes[at], known[at]), (keys, np.bincount(where[learned], minlength=len(keys))))):
            for part, a, b in ranges(k, bits):
                out.append({"key": (n << 40) + part, "chunk": chunk, "em": self.em, "part": (n << 40) + part, "a": shared.pack_sorted(k[a:b]), "b": shared.pack(c[a:b].astype("<u8")), "n": 0})
        return out


def pack_ids(ids: np.ndarray) -> bytes:
    return shared.pack(ids.astype("<u4"))


def ranges(keys: np.ndarray, bits: int):
    """(number, start, end) of the ranges of the hash that hold some of the sorted keys."""
    if not len(keys):
        return
    part = keys >> np.uint64(64 - bits)
    starts = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
    for i, s in enumerate(starts.tolist()):
        yield int(part[s]), s, int(starts[i + 1]) if i + 1 < len(starts) else len(keys)


SCHEMA = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("em", pa.bool_()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])
DDL = "key long, chunk long, em boolean, part long, a binary, b binary, c binary, d binary, n long, doc_ids array<long>, held array<boolean>"


def _chunks(docs: DataFrame, mod: int, held: int, bits: int, chunk_tokens: int) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(crc % mod == held, F.lit(False))
    train = F.coalesce(crc % mod != held, F.lit(False))
    em = train & (F.floor(crc / mod) % EM_FOLD == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"), train.alias("train"), em.alias("em"))

    def run(batches: shared.Batches) -> shared.Batches:
        open_, made = {}, 0
        first = TaskContext.get().partitionId() << 24

        def close(chunk: Chunk):
            nonlocal made
            for row in chunk.rows(first + made, bits):
                yield row
            made += 1

        def batches_of(rows_):
            held_rows, size = [], 0
            for row in rows_:
                held_rows.append(row)
                size += len(row["a"]) + len(row["b"])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(held_rows, schema=SCHEMA)
                    held_rows, size = [], 0
            if held_rows:
                yield pa.RecordBatch.from_pylist(held_rows, schema=SCHEMA)

        for batch in batches:
            for doc_id, text, out, learn, em_ in zip(*shared.columns(batch, "doc_id", "text", "held_out", "train", "em"), strict=True):
                chunk = open_.setdefault(em_, Chunk(em_))
                chunk.add(doc_id, text, learn, out)
                if chunk.tokens >= chunk_tokens:
                    yield from batches_of(close(open_.pop(em_)))
        for chunk in open_.values():
            yield from batches_of(close(chunk))

    return shared.map_arrow(rows, run, DDL)


def _counted(table: pa.Table) -> pa.Table:
    """The counts of one range's keys over all chunks (a), and over the held-out ones (b), for each chunk that asked."""
    if table.column("part")[0].as_py() == 0 and table.column("doc_ids")[0].as_py() is not None:
        return table
    rows = table.select(["key", "chunk", "em", "part", "a", "b"]).to_pylist()
    keys = [shared.unpack_sorted(r["a"]) for r in rows]
    counts = [shared.unpack(r["b"], "<u8") for r in rows]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.zeros(len(distinct), dtype=np.uint64)
    held = np.zeros(len(distinct), dtype=np.uint64)
    edges = np.cumsum([0, *map(len, keys)])
    for r, c, s, e in zip(rows, counts, edges, edges[1:], strict=False):
        every[where[s:e]] += c  # a chunk's keys are distinct
        if r["em"]:
            held[where[s:e]] += c
    known = int((every > 0).sum())
    out = []
    for i, (r, s, e) in enumerate(zip(rows, edges, edges[1:], strict=False)):
        at = where[s:e]
        out.append({"key": r["key"], "chunk": r["chunk"], "em": r["em"], "part": r["part"], "a": shared.pack(every[at]), "b": shared.pack(held[at]) if r["em"] else None, "n": known if i == 0 else 0})
    return pa.Table.from_pylist(out, schema=SCHEMA)


def _gathered(table: pa.Table, deleted: bool):
    """A chunk's documents, and for each token: c(w), c(v), c(v w). Deleted: without the held-out documents' own counts."""
    rows = sorted(table.select(["key", "part", "a", "b", "c", "d", "doc_ids", "held"]).to_pylist(), key=lambda r: r["key"])
    docs = next(r for r in rows if r["key"] < 0)
    ids = shared.unpack(docs["a"], "<u4")
    hashes = np.concatenate([shared.unpack(docs["b"], "<u8"), shared.unpack_sorted(docs["c"])])
    lengths = shared.unpack(docs["d"], "<i8")
    got = []
    for n in (0, 1):
        parts = [r for r in rows if r["key"] >= 0 and r["key"] >> 40 == n]
        c = np.concatenate([shared.unpack(r["a"], "<u8") for r in parts]).astype(np.float64)
        got.append(c - np.concatenate([shared.unpack(r["b"], "<u8") for r in parts]).astype(np.float64) if deleted else c)
    uni = np.empty(len(hashes) + 1)
    uni[np.argsort(hashes)] = got[0]
    uni[-1] = uni[int(np.nonzero(hashes == END)[0][0])]  # as many starts as ends
    context = before(ids, lengths, len(hashes))
    _, where = np.unique(bigram_keys(np.concatenate([hashes, [START]])[context], hashes[ids]), return_inverse=True)
    return docs, lengths, uni[ids], uni[context], got[1][where]


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of the count's binary logarithm."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def estimates(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """c(v w)/c(v) and c(w)/N, 0 where the denominator is."""
    return np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), word / max(n, 1)


def em(table: np.ndarray, buckets: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each bucket from rows (bucket, p2/p0, p1/p0, count)."""
    weights = np.full((buckets, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    if len(table):
        b = table[:, 0].astype(np.int64)
        p = np.stack([table[:, 1], table[:, 2], np.ones(len(table))], axis=1)
        for _ in range(rounds):
            share = weights[b] * p
            share *= (table[:, 3] / share.sum(axis=1))[:, None]
            for k in range(3):
                total = np.bincount(b, share[:, k], minlength=buckets)
                seen = np.bincount(b, table[:, 3], minlength=buckets)
                weights[:, k] = np.where(seen > 0, total / np.maximum(seen, 1), weights[:, k])
            # no component dies, as scored texts hold what the held-out ones did not
            weights = np.maximum(weights, 1e-6)
            weights[0, 0] = 0
            weights /= weights.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, mod: int = 7, held: int = 2, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(32, max(4, int(np.ceil(np.log2(max(1, size / RANGE_BYTES))))))
    counted = shared.settled(_chunks(docs, mod, held, bits, chunk_tokens).groupBy("key").applyInArrow(_counted, DDL))
    about = counted.agg(F.sum(F.when((F.col("key") >= 0) & (F.col("key") < 1 << 40), F.col("n"))), F.sum(F.when(F.col("key") < 0, F.col("n"))), F.sum(F.when((F.col("key") < 0) & F.col("em"), F.col("n")))).first()
    v, n, n_em = (int(x or 0) for x in about)

    def seen(table: pa.Table) -> pa.Table:
        _, _, word, context, pair = _gathered(table, True)
        p2, p1 = estimates(word, context, pair, n - n_em)
        with np.errstate(divide="ignore"):
            grid = [np.where(p > 0, np.rint(STEPS * np.log2(p * (v + 1))), NEVER).astype(np.int64) for p in (p2, p1)]
        cells, times = np.unique(np.stack([bucket(context), *grid], axis=1), axis=0, return_counts=True)
        return pa.table({"b": cells[:, 0], "i": cells[:, 1], "j": cells[:, 2], "n": times})

    table = counted.where("em").groupBy("chunk").applyInArrow(seen, "b long, i long, j long, n long").groupBy("b", "i", "j").agg(F.sum("n")).toPandas().to_numpy(dtype=np.float64)
    for k in (1, 2):
        table[:, k] = np.where(table[:, k] == NEVER, 0.0, np.exp2(table[:, k] / STEPS))
    weights = em(table, 66)

    def scored(table: pa.Table) -> pa.Table:
        docs_, lengths, word, context, pair = _gathered(table, False)
        p2, p1 = estimates(word, context, pair, n)
        w = weights[bucket(context)]
        p = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))
        base = np.log10((word + 1) / (n + (v + 1)))
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return pa.table({
            "doc_id": pa.array(docs_["doc_ids"], pa.int64()), "held_out": pa.array(docs_["held"], pa.bool_()), "n_tokens": lengths, "n_known": np.add.reduceat((word > 0).astype(np.int64), at),
            "train_tokens": np.full(len(lengths), n, dtype=np.int64), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(p, at),
        })

    return counted.groupBy("chunk").applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
