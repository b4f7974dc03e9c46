"""Maximum inner product search by score-aware anisotropic quantisation.

Vectors are cut into pieces of two numbers, each coded by one of 16 centroids (four bits). Codes and
centroids minimise a loss that weighs the residual parallel to the vector `eta` times as much as the
rest, because only the parallel part moves the large inner products that matter. A search scans the
codes by tables: a query's inner products with the centroids, two pieces to a table of 256, summed
over a block of vectors at once; the best of a block are scored again exactly, on the original vectors.
The cut is exact: a rough score is off by the residual's length times the query's at most (Cauchy-Schwarz),
so whatever could still reach the block's k-th exact score is scored exactly as well.

Before that, the vectors of a batch are grouped by their nearest coarse centroid: a group lies in a ball around its
mean, so its inner products are bounded by the mean's and the ball's radius times the query's length, and
a group that can't reach what the query has already is not scanned. That is exact as well: recall is 1.

The codebooks and coarse centroids are fitted on a bounded sample (`sample` vectors, by a hash of the id); every
vector is coded. Queries are sent in blocks of bounded bytes, one job each.

Vectors that are null or zero, or hold null or non-finite numbers, take no part. An inner product needs equal lengths, so a query's
candidates are the vectors of its length, and each length is indexed and searched by itself. An id that is repeated with several vectors is a query by the least of them. Ties go to the smaller id, also where identical vectors are very many. A query's own id
is no candidate, however often it is repeated; repeated query ids are searched once. An empty table
gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import shared

PIECE, CENTROIDS = 2, 16
SAMPLE = 10_000
#: Bytes of the queries that are sent at once.
QUERY_BYTES = 64 << 20
#: Vectors scanned at once, and candidates that are scored exactly before a bound is known.
SCAN, RERANK = 16_384, 200
#: Coarse centroids, whose groups of a batch are left out of a query's scan by a bound of their own.
COARSE = 64
FOUND = "query_id long, rank int, vec_id long, score double"
#: Cosine above which inner products matter; sets the weight of the parallel residual.
THRESHOLD = 0.2


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    sound = rows.where(F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"))
    return sound


class Quantiser:
    """Codebooks of pieces x 16 x 2, fitted to the anisotropic loss by coordinate descent."""

    def __init__(self, x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 6):
        n, self.dims = x.shape
        x = self.cut(x)
        self.pieces = x.shape[1]
        self.kappa = max(0.0, (self.dims - 1) * threshold**2 / (1 - threshold**2) - 1) if self.dims > 1 else 0.0
        rng = np.random.default_rng(3)
        whole = x.reshape(n, -1)
        self.coarse = whole[rng.choice(n, min(n, COARSE), replace=False)]
        for _ in range(rounds):
            nearest = self.grouped(whole)
            for c in np.unique(nearest):
                self.coarse[c] = whole[nearest == c].mean(axis=0)
        self.books = np.ascontiguousarray(x[rng.choice(n, CENTROIDS, replace=n < CENTROIDS)].transpose(1, 0, 2))
        for turn in range(rounds):
            # plain k-means first, then the score-aware loss
            codes = self.nearest(x) if turn < 2 else self.code(x)
            residual = x - self.decoded(codes)
            inner = np.einsum("npk,npk->np", x, residual)
            weight = self.kappa / np.maximum(np.einsum("npk,npk->n", x, x), 1e-30) if turn >= 2 else np.zeros(n)
            others = inner.sum(axis=1)
            for p in range(self.pieces):
                rest = others - inner[:, p]
                part = x[:, p]
                outer = np.einsum("n,ni,nj->nij", weight, part, part) + np.eye(PIECE)
                aim = part * (1 + weight * (rest + np.einsum("nk,nk->n", part, part)))[:, None]
                for c in range(CENTROIDS):
                    own = codes[:, p] == c
                    if own.any():
                        self.books[p, c] = np.linalg.solve(outer[own].sum(axis=0), aim[own].sum(axis=0))

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Vectors as pieces, an even number of them, zeros beyond the end."""
        width = -(-x.shape[1] // (2 * PIECE)) * 2 * PIECE
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, PIECE)

    def grouped(self, x: np.ndarray) -> np.ndarray:
        """The nearest coarse centroid of each vector (as wide as the pieces together)."""
        return ((self.coarse**2).sum(axis=1) - 2 * x @ self.coarse.T).argmin(axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((x[:, p, None] - self.books[p]) ** 2).sum(axis=2).argmin(axis=1) for p in range(self.pieces)], axis=1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.pieces), codes]

    def code(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of vectors cut into pieces, each piece chosen with the others' residuals in view."""
        codes = self.nearest(x)
        inner = np.einsum("npk,npk->np", x, x - self.decoded(codes))
        total = inner.sum(axis=1)
        weight = (self.kappa / np.maximum(np.einsum("npk,npk->n", x, x), 1e-30))[:, None]
        for _ in range(rounds):
            for p in range(self.pieces):
                residual = x[:, p, None] - self.books[p]
                along = np.einsum("nk,nck->nc", x[:, p], residual)
                loss = (residual**2).sum(axis=2) + weight * ((total - inner[:, p])[:, None] + along) ** 2
                codes[:, p] = loss.argmin(axis=1)
                chosen = along[np.arange(len(x)), codes[:, p]]
                total += chosen - inner[:, p]
                inner[:, p] = chosen
        return codes

    def packed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Four-bit codes, two to a byte, by how much a rough score can be off for a query of length one, and coarse groups."""
        x = self.cut(x)
        codes = self.code(x).astype(np.uint8)
        decoded = self.decoded(codes)
        length = lambda v: np.sqrt(np.einsum("npk,npk->n", v, v))
        # the residual, and the rounding of tables and sums in single precision
        off = length(x - decoded) + (self.pieces + 4) * 2.0**-23 * (length(x) + length(decoded))
        return codes[:, ::2] | codes[:, 1::2] << 4, off, self.grouped(x.reshape(len(x), -1))

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code, the query's inner product with what the byte stands for."""
        one = np.einsum("pk,pck->pc", self.cut(query[None])[0], self.books)
        return (one[1::2, :, None] + one[::2, None, :]).reshape(self.pieces // 2, 256).astype(np.float32)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    """A quantiser from at most `sample` usable vectors; None where there are none."""
    n = vectors.count()
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(1_100_000.0 * sample / n)).limit(sample) if n > sample else vectors
    rows = drawn.select("vec_id", "embedding").collect() or vectors.limit(sample).collect()
    return Quantiser(np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])])) if rows else None


def index(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """vec_id, embedding, code, off (the bound of a rough score's error), coarse (its group) of every usable vector."""
    shipped = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            if batch.num_rows:
                codes, off, coarse = shipped.value.packed(matrix(batch.column(1)))
                yield shared.batch_of(vec_id=batch.column(0), embedding=batch.column(1), code=pa.array([c.tobytes() for c in codes], pa.binary()), off=pa.array(off), coarse=pa.array(coarse, pa.int32()))

    return shared.map_arrow(vectors.select("vec_id", "embedding"), run, "vec_id long, embedding array<double>, code binary, off double, coarse int")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, ties by position, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    border = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.nonzero(scores > border)[0]
    return np.concatenate([above, np.nonzero(scores == border)[0][: k - len(above)]])


class Search:
    """The k nearest so far of a block of queries, and what of a batch of vectors can change them."""

    def __init__(self, quantiser: Quantiser, names: np.ndarray, asked: np.ndarray, k: int, rerank: int):
        self.quantiser, self.names, self.asked, self.k, self.rerank = quantiser, names, asked, k, max(k, rerank)
        self.far = np.sqrt(np.einsum("nk,nk->n", asked, asked))
        self.near: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(names)

    def scan(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, off: np.ndarray, coarse: np.ndarray) -> None:
        """Take a batch of vectors in. Those of a coarse group lie in a ball, which bounds their inner products at once."""
        order = np.lexsort((ids, coarse))
        ids, vectors, off, coarse = ids[order], vectors[order], off[order], coarse[order]
        codes = [np.ascontiguousarray(c).astype(np.intp) for c in codes[order].T]
        starts = np.nonzero(np.concatenate([[True], coarse[1:] != coarse[:-1]]))[0]
        ends = np.concatenate([starts[1:], [len(ids)]])
        centres = np.add.reduceat(vectors, starts, axis=0) / (ends - starts)[:, None]
        apart = vectors - np.repeat(centres, ends - starts, axis=0)
        radius = np.sqrt(np.maximum.reduceat(np.einsum("nk,nk->n", apart, apart), starts))
        longest = np.sqrt(np.einsum("nk,nk->n", vectors, vectors).max())
        slack = 1e-9 * longest  # for the products' rounding
        for at in range(0, len(self.names), 1024):
            reach = self.asked[at : at + 1024] @ centres.T + self.far[at : at + 1024, None] * (radius + slack)
            for i, could in enumerate(reach):
                self._one(at + i, could, starts, ends, ids, vectors, codes, off, slack)

    def _one(self, i: int, could: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: list[np.ndarray], off: np.ndarray, slack: float) -> None:
        name, query, far = self.names[i], self.asked[i], self.far[i]
        known_ids, known = self.near[i]
        least = known[-1] if len(known) >= self.k else -np.inf
        groups = np.nonzero(could >= least)[0]
        if not len(groups):
            return
        rows = np.arange(len(ids)) if len(groups) == len(starts) else np.concatenate([np.arange(starts[g], ends[g]) for g in groups])
        tables = self.quantiser.tables(query)
        rough = tables[0][codes[0][rows]]
        for t, c in zip(tables[1:], codes[1:], strict=True):
            rough += t[c[rows]]
        rough[ids[rows] == name] = -np.inf
        exactly = lambda at: (vectors[at] * query).sum(axis=1)
        if least == -np.inf:
            # the k-th of some is one that all others have to reach
            first = rows[best(rough, self.rerank)]
            exact = exactly(first[ids[first] != name])
            if len(exact) >= self.k:
                least = np.partition(exact, len(exact) - self.k)[len(exact) - self.k]
        # whatever its bound lets reach the k-th, to within the products' rounding
        at = rows[rough + far * (off[rows] + slack) >= least] if least > -np.inf else rows
        if least > -np.inf:
            at = at[vectors[at] @ query >= least - far * slack]
        at = at[ids[at] != name]
        merged, scores = np.concatenate([known_ids, ids[at]]), np.concatenate([known, exactly(at)])
        order = np.lexsort((merged, -scores))[: self.k]
        self.near[i] = merged[order], scores[order]

    def found(self) -> pa.RecordBatch:
        sizes = [len(s) for _, s in self.near]
        return shared.batch_of(query_id=pa.array(np.repeat(self.names, sizes)), vec_id=pa.array(np.concatenate([x for x, _ in self.near])), score=pa.array(np.concatenate([s for _, s in self.near])))


def search(indexed: DataFrame, quantiser: Quantiser, is_query: Column, k: int = 20, rerank: int = RERANK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among all other vectors.

    A block of queries of bounded bytes is scanned against all vectors in one job; a task answers with its k best of each.
    """
    spark = indexed.sparkSession
    queries = indexed.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-queries.count() * 8 * quantiser.dims // query_bytes))
    asked = shared.settled(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    found = None
    for block in range(blocks):
        rows = sorted(asked.where(F.col("block") == block).select("vec_id", "embedding").collect())
        if not rows:
            continue
        shipped = spark.sparkContext.broadcast((quantiser, np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["embedding"] for r in rows])))

        def run(batches: shared.Batches, shipped=shipped) -> shared.Batches:
            quantiser_, names, vectors = shipped.value
            state = Search(quantiser_, names, vectors, k, rerank)

            def scan(parts: list[pa.RecordBatch]) -> None:
                whole = pa.Table.from_batches(parts).combine_chunks()
                ids = whole.column("vec_id").to_numpy()
                codes = np.frombuffer(b"".join(whole.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                state.scan(ids, matrix(whole.column("embedding").combine_chunks()), codes, whole.column("off").to_numpy(), whole.column("coarse").to_numpy())

            held: list[pa.RecordBatch] = []
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= SCAN:
                    scan(held)
                    held = []
            if held:
                scan(held)
            yield state.found()

        near = shared.map_arrow(indexed.select("vec_id", "embedding", "code", "off", "coarse"), run, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:  # the driver holds one block of queries at a time
            near = shared.settled(near)
            shipped.destroy()
        found = near if found is None else found.unionByName(near)
    return indexed.sparkSession.createDataFrame([], FOUND) if found is None else found


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of `vectors` that `is_query` picks."""
    sound, found = usable(vectors), None
    for n in sorted(r[0] for r in sound.select(F.size("embedding")).distinct().collect()):
        own = sound.where(F.size("embedding") == n)
        quantiser = fit(own, sample)
        part = search(shared.settled(index(own, quantiser)), quantiser, is_query, k)
        found = part if found is None else found.unionByName(part)
    return vectors.sparkSession.createDataFrame([], FOUND) if found is None else found
