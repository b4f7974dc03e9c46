"""Near-duplicates by bottom-k sketches, confirmed by the exact Jaccard similarity of word shingles.

One hash function (XXH64) gives each distinct shingle of a text a value. Two sketches are taken of the values of a set of n:

- what is *retained* for the inverted lists: its k = n - ceil(similarity * n) + OVERLAP smallest, where values that are common
  in a sample of the corpus come after all others. Two linked sets of n and m values share ceil(similarity * n) or more, so they
  share OVERLAP of those at least, whatever the order is (different linked sets have 6 values or more): the lists lose no link. The sample only keeps them short.
- what is *compared*: its SKETCH smallest values by the hash alone. The SKETCH smallest of two sketches' union are a random
  sample of the sets' union, so the share of them in both sketches estimates the Jaccard similarity. A pair passes
  unless as few matches are less likely than CHANCE for linked sets. Where both sketches hold their whole sets, that is exact.

Lists of up to SHORT texts emit their pairs of different components and fitting sizes, by ids alone; pairs that come from
OVERLAP lists are compared by their sketches. A longer list has its sketches compared in its own task, and leaves no more links than
connect what passed. A linked pair shares a longer list, or OVERLAP short ones, so it is met in either way. What passes
connects texts to groups, and these are compared by whole sets, all pairs but those already connected.

This is done twice: first over the lists of FIRST values of each text, each compared in its own task, which connects
most copies; then over all lists that hold texts of different components, so lists of texts that are copies of each
other are no more. Large lists and groups are dealt in blocks (shingle_join.by_group).

Texts with fewer words than a shingle are one shingle of all their words. Texts without words (null ones too) have no
shingle and are linked with nothing. Sets are told apart by a 64-bit hash; equal ones (exact copies, repeated rows) are
one until the end. Rows may share a doc_id; a null doc_id never names a component and is never kept. No documents give
no rows. Texts are read whole; other columns are not read. There are no ties to break: links are a fact of two sets.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, shingle_join, simhash

SIZE, SIMILARITY = 3, Fraction(85, 100)
#: Values that are compared, of 4 bytes each; values whose lists are met first; the chance of missing a link at the bound.
SKETCH, FIRST, CHANCE = 64, 3, 1e-15
#: Retained values that linked sets share at least; texts of a list that emits pairs; rows of lists that a task holds at once.
OVERLAP, SHORT, ROWS = 3, 48, 1 << 19
#: Texts up to which those that are read again are told by a broadcast of their hashes (32 MB).
BROADCAST = 2_000_000
LIMIT = shingle_join.LIMIT


def sketches(grams: np.ndarray, known: np.ndarray, often: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, bytes]:
    """Of sorted values: the retained ones in their order, and the sketch (size in eight bytes, then the high halves of its smallest values)."""
    n = len(grams)
    if not n:
        return grams, b""
    rank = np.zeros(n, dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        rank = np.where(known[at] == grams, often[at], 0)
    k = n + int(-similarity * n // 1) + OVERLAP
    retained = grams[np.argsort(rank, kind="stable")[:k]] if rank.any() else grams[:k]
    return retained, n.to_bytes(8, "little") + (grams[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()


@lru_cache(maxsize=1024)
def fewest(k: int, similarity: Fraction) -> int:
    """Matches among k values of the union that linked sets have but for CHANCE (drawing without return is less spread than with it)."""
    p, below = float(similarity), 0.0
    for x in range(k + 1):
        below += math.exp(math.lgamma(k + 1) - math.lgamma(x + 1) - math.lgamma(k - x + 1) + x * math.log(p) + (k - x) * math.log1p(-p))
        if below > CHANCE:
            return x
    return k


def likely(values: list[bytes], labels: list[int], similarity: Fraction) -> tuple[list[int], list[int]]:
    """Links (positions) that connect whatever sketches' unions don't tell apart; those of one label are connected."""
    num, den = similarity.numerator, similarity.denominator
    label, out = np.unique(labels, return_inverse=True)[1], ([], [])
    sizes = np.array([int.from_bytes(v[:8], "little") for v in values])
    parts = [np.frombuffer(v, dtype="<u4", offset=8) for v in values]
    ends = np.cumsum([len(x) for x in parts])
    # who has each value: i meets only those that it shares some with
    which = np.unique(np.concatenate(parts), return_inverse=True)[1]
    owners = np.repeat(np.arange(len(parts)), [len(x) for x in parts])[np.argsort(which, kind="stable")]
    times = np.bincount(which)
    starts = np.cumsum(times) - times
    for i in range(len(values) - 1):
        if (label == label[i]).all():
            break
        own = which[ends[i] - len(parts[i]) : ends[i]]
        n = times[own]
        shared_by = owners[np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)]
        matches = np.bincount(shared_by, minlength=len(values))
        near = np.nonzero((matches > 0) & (label != label[i]) & (np.minimum(sizes, sizes[i]) * den >= np.maximum(sizes, sizes[i]) * num))[0]
        near = near[near > i]
        # the union has the larger set's size at least, and no more matches among its smallest values than in all
        near = near[[matches[j] >= fewest(min(SKETCH, max(sizes[i], sizes[j])), similarity) for j in near]]
        shingle_join.join(i, [j for j in near.tolist() if similar(parts[i], parts[j], sizes[i], sizes[j], similarity)], label, out)
    return out


def similar(a: np.ndarray, b: np.ndarray, n: int, m: int, similarity: Fraction) -> bool:
    """Whether two sketches' union may be that of linked sets of sizes n and m."""
    every, times = np.unique(np.concatenate([a, b]), return_counts=True)
    if n <= SKETCH and m <= SKETCH:  # whole sets, but for equal halves
        return int((times > 1).sum()) * similarity.denominator >= len(every) * similarity.numerator
    k = min(SKETCH, len(every))
    return int((times[:k] > 1).sum()) >= fewest(k, similarity)


def described(docs: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """doc_id, mark (a hash of the text), key (of the set), n (its size), retained, sketch of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(shingle_join.common(docs, size))

    def one(text: str | None) -> tuple[int, int, bytes, bytes]:
        grams = shingle_join.shingles(text, size)
        retained, sketch = sketches(grams, *shipped.value, similarity)
        return shingle_join.key_of(grams), len(grams), retained.tobytes(), sketch

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            ids, marks, texts = shared.columns(batch, "doc_id", "mark", "text")
            rows = [one(t) for t in texts]
            key, n, retained, sketch = zip(*rows, strict=True) if rows else ((),) * 4
            yield shared.batch_of(doc_id=pa.array(ids, pa.int64()), mark=pa.array(marks, pa.int64()), key=pa.array(key, pa.int64()), n=pa.array(n, pa.int64()), retained=pa.array(retained, pa.binary()), sketch=pa.array(sketch, pa.binary()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, key long, n long, retained binary, sketch binary")


def lists(sets: DataFrame, most: int | None = None) -> DataFrame:
    """value, key, n: the retained values of each set, all or the first `most`."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            parts = [np.frombuffer(r, dtype=np.int64)[:most] for r in batch.column(1).to_pylist()]
            if parts:
                times = [len(x) for x in parts]
                yield shared.batch_of(value=pa.array(np.concatenate(parts)), key=pa.array(np.repeat(batch.column(0).to_numpy(), times)), n=pa.array(np.repeat(batch.column(2).to_numpy(), times)))

    return sets.select("key", "retained", "n").mapInArrow(run, "value long, key long, n long")


def labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the label of each key: the root of its component so far (node, root), else the key."""
    if roots is None:
        return rows.withColumn("label", F.col("key"))
    return rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")


def compared(members: DataFrame, met: DataFrame, sets: DataFrame, similarity: Fraction, limit: int) -> DataFrame:
    """Links (a, b) that connect whatever shares one of the lists `met` (value, n), has different labels and passes by the sketches."""
    asked = members.select("value", "key", "label").join(met, "value").join(sets.select("key", "sketch"), "key")
    return shingle_join.by_group(asked.select(F.col("value").alias("group"), "key", F.col("sketch").alias("value"), "label", "n"), lambda values, labels: likely(values, labels, similarity), limit)


def met_in_lists(members: DataFrame, similarity: Fraction, most: int = ROWS) -> DataFrame:
    """a, b: pairs of the short lists, once for each list; and a row (value, null) for each longer one that holds different labels."""
    num, den = similarity.numerator, similarity.denominator

    def pairs(value: np.ndarray, key: np.ndarray, n: np.ndarray, label: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
        """Of whole lists (starts and lengths), lists of one length at a time."""
        out = []
        starts, lengths = whole
        for length in np.unique(lengths[lengths > 1]).tolist():
            own = starts[lengths == length]
            for i in range(length - 1):
                for j in range(i + 1, length):
                    x, y = own + i, own + j
                    fits = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
                    if fits.any():
                        out.append(np.stack([np.minimum(key[x], key[y])[fits], np.maximum(key[x], key[y])[fits]]))
        return out

    def run(batches: shared.Batches) -> shared.Batches:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        # the list that goes on in the next rows, if it is longer already: its value, its first label, and whether it had another
        long: tuple[int, int, bool] | None = None

        def done(last: bool) -> pa.RecordBatch | None:
            nonlocal held, rows, long
            value, key, n, label = (np.concatenate(x) for x in zip(*held, strict=True))
            starts = np.append(0, np.nonzero(value[1:] != value[:-1])[0] + 1)
            lengths = np.diff(np.append(starts, len(value)))
            found: list[np.ndarray] = []
            hot = []
            if long:
                if value[0] == long[0]:
                    several = long[2] or bool((label[: lengths[0]] != long[1]).any())
                    long = (long[0], long[1], several)
                    if len(starts) == 1 and not last:
                        held, rows = [], 0
                        return None
                    starts, lengths = starts[1:], lengths[1:]
                if long[2]:
                    hot.append(long[0])
                long = None
            keep: list[tuple[np.ndarray, ...]] = []
            if not last and len(starts):
                at, length = int(starts[-1]), int(lengths[-1])
                if length > SHORT:
                    long = (int(value[at]), int(label[at]), bool((label[at:] != label[at]).any()))
                else:
                    keep = [(value[at:], key[at:], n[at:], label[at:])]
                starts, lengths = starts[:-1], lengths[:-1]
            for at, length in zip(starts[lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist(), strict=True):
                if (label[at : at + length] != label[at]).any():
                    hot.append(int(value[at]))
            short = lengths <= SHORT
            found = pairs(value, key, n, label, (starts[short], lengths[short]))
            held, rows = keep, sum(len(x[0]) for x in keep)
            if not found and not hot:
                return None
            a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
            return shared.batch_of(a=pa.array(np.concatenate([a, np.array(hot, dtype=np.int64)])), b=pa.concat_arrays([pa.array(b), pa.nulls(len(hot), pa.int64())]))

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy() for i in range(4)))
                rows += batch.num_rows
                if rows >= most and (x := done(False)):
                    yield x
        if held and (x := done(True)):
            yield x
        elif not held and long and long[2]:
            yield shared.batch_of(a=pa.array([long[0]]), b=pa.nulls(1, pa.int64()))

    return members.select("value", "key", "n", "label").repartition("value").sortWithinPartitions("value").mapInArrow(run, "a long, b long")


def passing(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sketches' union may be that of linked sets."""

    def run(batches: shared.Batches) -> shared.Batches:
        read = lambda x: (np.frombuffer(x, dtype="<u4", offset=8), int.from_bytes(x[:8], "little"))
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                (p, n), (q, m) = read(x), read(y)
                kept.append(similar(p, q, n, m, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    of = lambda name: sets.select(F.col("key").alias(name), F.col("sketch").alias(f"of_{name}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def first_round(sets: DataFrame, most: int, similarity: Fraction, limit: int) -> DataFrame:
    """Links (a, b) from the lists of the first `most` values of each set."""
    members = labelled(lists(sets, most), None)
    met = members.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    return compared(members, met, sets, similarity, limit)


def second_round(sets: DataFrame, roots: DataFrame, similarity: Fraction, limit: int) -> DataFrame:
    """Links (a, b) from all lists, among texts of different components."""
    members = labelled(lists(sets), roots)
    met = shared.settled(met_in_lists(members, similarity))
    often = met.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("times")).where(F.col("times") >= OVERLAP).select("a", "b")
    found = passing(often, sets, similarity)
    hot = met.where("b is null").select(F.col("a").alias("value"))
    if not hot.take(1):
        return found
    members = members.join(hot, "value", "left_semi")
    longer = members.groupBy("value").agg(F.count("*").alias("n"))
    return found.unionByName(compared(members, longer, sets, similarity, limit))


def whole_sets(docs: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """key, value: the whole sets of the texts of these marks, one row each."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            grams = [shingle_join.shingles(t, size) for t in batch.column(0).to_pylist()]
            yield shared.batch_of(key=pa.array([shingle_join.key_of(g) for g in grams], pa.int64()), value=pa.array([g.tobytes() for g in grams], pa.binary()))

    wanted = F.broadcast(marks) if marks.count() <= BROADCAST else marks
    texts = docs.select(F.xxhash64("text").alias("mark"), "text").join(wanted, "mark", "left_semi").dropDuplicates(["mark"])
    return texts.select("text").mapInArrow(run, "key long, value binary").dropDuplicates(["key"])


def verified(docs: DataFrame, sets: DataFrame, found: DataFrame, roots: DataFrame | None, size: int, similarity: Fraction, limit: int) -> DataFrame:
    """Of what `found` and the components so far connect: links (a, b) by whole sets that connect whatever is linked and has different labels."""
    told = simhash.components(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    members = labelled(told.select(F.col("root").alias("group"), F.col("node").alias("key")).unionByName(told.select(F.col("root").alias("group"), F.col("root").alias("key")).distinct()), roots)
    several = members.groupBy("group").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("group", "n")
    groups = shared.settled(members.join(several, "group"))
    texts = whole_sets(docs, shared.settled(sets.join(groups.select("key"), "key", "left_semi").select("mark")), size)
    return shingle_join.by_group(groups.join(texts, "key"), lambda values, labels: shingle_join.linked(values, labels, similarity), limit)


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: Fraction = SIMILARITY, first: int = FIRST, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept of each row."""
    whole = shared.settled(described(docs, size, similarity))
    of = whole.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("retained").alias("retained"), F.first("sketch").alias("sketch"))
    sets = shared.settled(of)
    rows = shared.settled(whole.select("doc_id", "key", F.col("n").alias("n_shingles")))
    del whole, of  # copies' sketches are not needed again
    shared.release(docs.sparkSession)
    links = shared.settled(verified(docs, sets, first_round(sets, first, similarity, limit), None, size, similarity, limit))
    roots = simhash.components(links)
    more = verified(docs, sets, shared.settled(second_round(sets, roots, similarity, limit)), roots, size, similarity, limit)
    rooted = labelled(sets.select("key", "least"), simhash.components(links.unionByName(more)))
    named = rooted.join(rooted.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("key", "component_id")
    found = rows.join(named, "key", "left")
    id_ = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", id_.alias("component_id"), F.coalesce(F.col("doc_id") == id_, F.lit(False)).alias("kept"))
