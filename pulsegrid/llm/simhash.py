"""SimHash near-duplicates: fingerprints, BK-trees over shards, components of linked fingerprints.

Two fingerprints link if they differ in at most `radius` bits. Cut into radius + 1 bands, linked
fingerprints agree in one band at least (they can't differ in all of them), so a shard holds what
agrees in one band. Each shard is a BK-tree: children are keyed by their integer Hamming distance to
the parent, and a search follows only the edges within the radius. A shard with very many members
is cut again by bands of its remaining bits until it is small, so that no task gets an unbounded
one; every link survives each cut for the same reason as above. The trees grow with the corpus and
so are not broadcast: a shard's tree is built where its members are, and searched there.

Null and empty texts have fingerprint zero and link like any others. Repeated rows come back as
often as they were given. A null doc_id never names a component; a component of null ids only has a
null component_id. No documents give no rows. Texts are read whole, however long. There are no ties to break: links
are a fact of two fingerprints. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SEED = 42
BITS = 64
#: Members above which a shard is cut again.
SHARD_LIMIT = 4096
#: Members of a tree node that are compared outright instead of being given children.
LEAF = 64


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes, repeats included: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        # big-endian: the first unpacked bit is the highest
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if it is set in over half the shingles' hashes."""
    words = shared.ascii_lower_words(text)
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_digest
    return of_hashes(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=">u8"))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            ids, texts = shared.columns(batch, "doc_id", "text")
            known: dict[str | None, int] = {}
            out = np.fromiter((known[t] if t in known else known.setdefault(t, fingerprint(t, size)) for t in texts), dtype=np.uint64, count=len(texts))
            yield shared.batch_of(doc_id=pa.array(ids, pa.int64()), fp=pa.array(out.view(np.int64)))

    return shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit fingerprints, built and searched for many values at once.

    A node has a pivot and, for each distance to it, the child that holds the values at that
    distance; a node of at most LEAF values keeps them in a bucket. The triangle inequality lets a
    search at distance d from the pivot skip every child whose key is not within d +- radius.
    """

    __slots__ = ("bucket", "children", "pivot")

    def __init__(self, at: np.ndarray, fps: np.ndarray, leaf: int = LEAF):
        self.children: dict[int, BKTree] = {}
        self.bucket: np.ndarray | None = None
        self.pivot = int(at[0])
        if len(at) <= leaf:
            self.bucket = at
            return
        rest = at[1:]
        apart = np.bitwise_count(fps[rest] ^ fps[self.pivot])
        for key in np.unique(apart):
            self.children[int(key)] = BKTree(rest[apart == key], fps, leaf)

    def search(self, queries: np.ndarray, fps: np.ndarray, radius: int, found) -> None:
        """Call found(query positions, member positions) for pairs within the radius, a node at a time."""
        if self.bucket is not None:
            for at in range(0, len(queries), 4096):
                part = queries[at : at + 4096]
                q, m = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[self.bucket][None, :]) <= radius)
                found(part[q], self.bucket[m])
            return
        apart = np.bitwise_count(fps[queries] ^ fps[self.pivot]).astype(np.int64)
        near = queries[apart <= radius]
        found(near, np.full(len(near), self.pivot))
        for key, child in self.children.items():
            follow = queries[np.abs(apart - key) <= radius]
            if len(follow):
                child.search(follow, fps, radius, found)


def shard_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: (member, root of its tree)."""
    parent = np.arange(len(fps))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def found(a: np.ndarray, b: np.ndarray) -> None:
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return
        # most pairs of a dense shard are known to be together already
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        fresh = parent[a] != parent[b]
        for x, y in zip(a[fresh].tolist(), b[fresh].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    everything = np.arange(len(fps))
    BKTree(everything, fps).search(everything, fps, radius, found)
    roots = np.array([root(i) for i in range(len(fps))])
    linked = np.nonzero(roots != everything)[0]
    return linked, roots[linked]


def bands(width: int, parts: int) -> list[tuple[int, int]]:
    """Cut `width` bits into near-equal (start, length) bands."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _cut(members: DataFrame, radius: int, width: int) -> DataFrame:
    """Each member once for each band of its `rest` bits: a longer key, and the bits still left."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            fp, rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            rest = rest.view(np.uint64)
            for n, (start, length) in enumerate(bands(width, radius + 1)):
                value = (rest >> np.uint64(start)) & np.uint64((1 << length) - 1)
                low = rest & np.uint64((1 << start) - 1)
                left = ((rest >> np.uint64(start + length)) << np.uint64(start)) | low if start + length < 64 else low
                yield shared.batch_of(key=pa.array([f"{k}{n}:{v:x}," for k, v in zip(keys, value.tolist(), strict=True)], pa.string()), fp=pa.array(fp), rest=pa.array(left.view(np.int64)))

    return shared.map_arrow(members, run, "key string, fp long, rest long")


def links(distinct: DataFrame, radius: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (a, b) among the distinct `fp`: a forest that connects whatever the links connect."""

    def run(batches: shared.Batches) -> shared.Batches:
        held_key, held = None, []

        def flush() -> pa.RecordBatch | None:
            fps = np.concatenate(held).view(np.uint64)
            if len(fps) < 2:
                return None
            a, b = shard_links(fps, radius)
            return shared.batch_of(a=pa.array(fps[a].view(np.int64)), b=pa.array(fps[b].view(np.int64))) if len(a) else None

        out: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
            for i, s in enumerate(starts):
                part = fps[s : starts[i + 1] if i + 1 < len(starts) else len(fps)]
                if keys[s] != held_key:
                    if held and (x := flush()) is not None:
                        out.append(x)
                    held_key, held = keys[s], []
                held.append(part)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out = []
        if held and (x := flush()) is not None:
            yield x

    members = distinct.select(F.lit("").alias("key"), "fp", F.col("fp").alias("rest"))
    width, out = BITS, []
    while True:
        cut = shared.settled(_cut(members, radius, width))
        width -= min(length for _, length in bands(width, radius + 1))
        sizes = cut.groupBy("key").agg(F.count("*").alias("n"))
        # the last cut leaves few enough bits for a shard to be small whatever it holds
        hot = shared.settled(sizes.where(F.col("n") > shard_limit).select("key")) if width > 16 else None
        deeper = hot is not None and bool(hot.take(1))
        ready = cut.join(hot, "key", "left_anti") if deeper else cut
        out.append(shared.map_arrow(ready.join(sizes.where("n > 1").select("key"), "key", "left_semi").select("key", "fp").repartition("key").sortWithinPartitions("key"), run, "a long, b long"))
        if not deeper:
            break
        members = cut.join(hot, "key", "left_semi")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node but the roots of the undirected edges (a, b).

    Alternating large-star and small-star steps, each cut with a checkpoint, until the forest is a
    set of stars; the rounds grow with the logarithm of the longest path.
    """
    both = shared.settled(edges.where("a <> b").select("a", "b"))
    seen = None
    while True:
        pairs = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        both = shared.settled(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        now = both.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            shared.release(edges.sparkSession)
            return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row."""
    prints = shared.settled(fingerprints(docs, size))
    distinct = shared.settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), radius, shard_limit))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of `docs` for each component (those of `found`, else of linked fingerprints), that of its smallest doc_id; rows without an id stay."""
    kept, nth = shared.free(docs, "_kept", "_nth")
    keep = (near_duplicates(docs) if found is None else found).where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    named = docs.where("doc_id is not null").join(keep, F.col("doc_id") == F.col(kept), "left_semi")
    first = named.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return first.unionByName(docs.where("doc_id is null"))
