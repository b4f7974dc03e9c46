"""Near-duplicates by SimHash, with an exact check of the Jaccard similarity of word shingles.

Two texts link if their sets of `size`-word shingles have a Jaccard similarity of `similarity` or more.
SimHash's BK-trees over shards propose what differs in few bits of the fingerprints of those shingles. Texts of
similarity 0.8 may differ in a dozen bits, which no radius of 64 bits tells from chance, so a join by prefixes
proposes what the fingerprints leave out, and all that is proposed is checked by the whole sets.

Shingles are put in one order for all texts, those seldom met in a sample first. A set of n shingles
keeps its first n - ceil(similarity * n) + 1 of them: linked sets share one of those at least, whatever
the order is, so the sample affects the time only. Texts that share one are compared by size and by a
parity sketch (of which as many bits differ as shingles do, or fewer), and what is left by the whole sets.
No filter loses a link.

Texts of fewer words have one shingle, of all their words; null and empty texts have none, and link to
each other. Shingles are 64-bit hashes. A null doc_id never names a component. Repeated rows come back as often as they are
there, with the component of their text; no documents give no rows. Texts are read whole, however long. There are
no ties to break. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, simhash

SEED = 42
SIZE, SIMILARITY = 5, Fraction(4, 5)
#: Texts whose shingles are counted for the order, and shingles that are sent as common.
SAMPLE, COMMON = 2000, 200_000
#: Rows of a group that one task compares, before the group is dealt in blocks: some 60 MB of sets. Dealing reads the groups' rows again.
LIMIT = 16_384


def hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    words = shared.ascii_lower_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    return np.array([digest(s, SEED) for s in runs], dtype=np.uint64)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(hashes(text, size))


def key_of(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED))))


def sketch(grams: np.ndarray) -> bytes:
    """The set's size in eight bytes, and parities of its hashes by their low bits, as many as a power of two from the size on."""
    width = max(64, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return len(grams).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def common(docs: DataFrame, size: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that more than one text of a sample has, and in how many."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            found = [shingles(t, size) for t in batch.column(0).to_pylist()]
            if found:
                yield shared.batch_of(gram=pa.array(np.concatenate(found).view(np.int64)))

    share = 1_000_000.0 * sample / max(1, docs.count())
    drawn = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(share)).distinct()
    rows = shared.map_arrow(drawn, run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    grams, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    at = np.argsort(grams)
    return grams[at], n[at]


def described(docs: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """doc_id, mark (a hash of the text), key (of the set of shingles), fp (its SimHash), n, sketch, prefix of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(common(docs, size))

    def one(text: str | None) -> tuple[int, int, int, bytes, bytes]:
        every = hashes(text, size)
        grams = np.unique(every)
        known, often = shipped.value
        rank = np.zeros(len(grams), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            rank = np.where(known[at] == grams, often[at], 0)
        p = len(grams) + int(-similarity * len(grams) // 1) + 1 if len(grams) else 0
        fp = int(np.uint64(simhash.of_hashes(every)).astype(np.int64))
        return key_of(grams), fp, len(grams), sketch(grams) if len(grams) else b"", grams[np.lexsort((grams, rank))[:p]].tobytes()

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            ids, marks, texts = shared.columns(batch, "doc_id", "mark", "text")
            known: dict[str | None, tuple] = {}
            rows = [known[t] if t in known else known.setdefault(t, one(t)) for t in texts]
            key, fp, n, bits, prefix = zip(*rows, strict=True) if rows else ((),) * 5
            yield shared.batch_of(doc_id=pa.array(ids, pa.int64()), mark=pa.array(marks, pa.int64()), key=pa.array(key, pa.int64()), fp=pa.array(fp, pa.int64()), n=pa.array(n, pa.int64()), sketch=pa.array(bits, pa.binary()), prefix=pa.array(prefix, pa.binary()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return shared.map_arrow(rows, run, "doc_id long, mark long, key long, fp long, n long, sketch binary, prefix binary")


def spread(distinct: DataFrame) -> DataFrame:
    """gram, key: the shingles of each prefix."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            keys, prefixes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            grams = np.frombuffer(b"".join(prefixes), dtype=np.int64)
            yield shared.batch_of(gram=pa.array(grams), key=pa.array(np.repeat(keys, [len(p) // 8 for p in prefixes])))

    return shared.map_arrow(distinct.select("key", "prefix"), run, "gram long, key long")


def by_simhash(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of keys, from (key, fp): of one fingerprint, and of fingerprints that differ in `radius` bits or fewer, a key for each."""
    prints = distinct.groupBy("fp").agg(F.min("key").alias("first"))
    same = distinct.join(prints, "fp").select(F.col("key").alias("a"), F.col("first").alias("b")).where("a <> b")
    near = simhash.links(prints.select("fp"), radius)
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"key_{c}"))
    return same.unionByName(near.join(of("a"), "a").join(of("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def by_group(rows: DataFrame, each, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) of keys that connect whatever each(values, labels) links, as positions, in the rows (group, key, value) of any group; n: the group's rows.

    Rows of one `label`, where they have that column, are connected already: all of these links and labels together have to be so.
    A group of more than `limit` rows is dealt in blocks. If those leave it in several components, rows outside of its largest one
    are compared block by block with all others of it, so every pair of different components meets in some task, and pairs
    that are connected already are compared no more.
    """
    mix = F.xxhash64("key", F.lit(7))
    dealt = rows.withColumn("_blocks", F.ceil(F.col("n") / limit).cast("long"))
    group = F.when(F.col("_blocks") > 1, F.xxhash64("group", F.pmod(mix, F.col("_blocks")))).otherwise(F.col("group"))
    known = "label" in rows.columns
    found = shared.settled(links_of(dealt.select(group.alias("group"), "key", "value", F.col("label" if known else "key").alias("label"), (F.col("_blocks") > 1).alias("dealt")), each))
    first = found.where("a is not null")
    if not found.where("a is null").take(1):  # no group was dealt
        return first
    connected = first.unionByName(dealt.where("_blocks > 1 and key <> label").select(F.col("key").alias("a"), F.col("label").alias("b")).distinct()) if known else first
    named = dealt.drop("label").where("_blocks > 1").join(simhash.components(connected).withColumnRenamed("node", "key"), "key", "left").select("group", "key", "value", F.coalesce("root", "key").alias("label"))
    parts = named.groupBy("group", "label").agg(F.count("*").alias("n"))
    several = parts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("of_main"), F.sum("n").alias("of_all"), F.count("*").alias("components")).where("components > 1")
    blocks = several.select("group", "main", F.ceil(F.col("of_main") / limit).cast("long").alias("_m"), F.ceil((F.col("of_all") - F.col("of_main")) / limit).cast("long").alias("_r"))
    whole = F.col("_m") + F.col("_r")
    # task (i, j): block i of the rest with block j of all, those of the largest component first
    own, every = F.pmod(mix, F.col("_r")), F.transform(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1), lambda i: i * whole)
    of_main = F.transform(every, lambda x: x + F.pmod(mix, F.col("_m")))
    of_rest = F.array_union(F.transform(every, lambda x: x + F.col("_m") + own), F.transform(F.sequence(F.lit(0).cast("long"), whole - 1), lambda j: own * whole + j))
    tasks = named.join(blocks, "group").select("group", "key", "value", "label", F.explode(F.when(F.col("label") == F.col("main"), of_main).otherwise(of_rest)).alias("_task"))
    second = links_of(tasks.select(F.xxhash64("group", "_task").alias("group"), "key", "value", "label", F.lit(False).alias("dealt")), each)
    return first.unionByName(second).distinct()


def links_of(rows: DataFrame, each) -> DataFrame:
    """Links (a, b) that each(values, labels) finds, as positions, in the rows (group, key, value, label, dealt) of every group; and a row of nulls if any is dealt."""

    def run(batches: shared.Batches) -> shared.Batches:
        of, keys, values, labels = None, [], [], []
        a, b, dealt = [], [], False

        def flush() -> None:
            if len(keys) > 1:
                for x, y in zip(*each(values, labels), strict=True):
                    a.append(keys[x])
                    b.append(keys[y])

        for batch in batches:
            groups = batch.column(0).to_numpy()
            if not len(groups):
                continue
            batch_keys, batch_values, batch_labels = (batch.column(i).to_pylist() for i in (1, 2, 3))
            dealt = dealt or any(batch.column(4).to_pylist())
            starts = [0, *(np.nonzero(groups[1:] != groups[:-1])[0] + 1).tolist(), len(groups)]
            for start, end in zip(starts, starts[1:], strict=False):
                if groups[start] != of:
                    flush()
                    of, keys, values, labels = groups[start], [], [], []
                keys += batch_keys[start:end]
                values += batch_values[start:end]
                labels += batch_labels[start:end]
            if a:
                yield shared.batch_of(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))
                a, b = [], []
        flush()
        if dealt:
            a.append(None)
            b.append(None)
        if a:
            yield shared.batch_of(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    return shared.map_arrow(rows.select("group", "key", "value", "label", "dealt").repartition("group").sortWithinPartitions("group", "key"), run, "a long, b long").distinct()


def likely(sketches: list[bytes], labels: list[int], similarity: Fraction) -> tuple[list[int], list[int]]:
    """Links (positions) that connect whatever sets the sizes and sketches can't tell apart; those of one label are connected."""
    num, den = similarity.numerator, similarity.denominator
    if len(sketches) == 2:  # most groups
        if labels[0] == labels[1]:
            return [], []
        x, y = sorted(sketches, key=len)
        n, m = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
        if min(n, m) * den < max(n, m) * num:
            return [], []
        p, q, width = int.from_bytes(x[8:], "little"), int.from_bytes(y[8:], "little"), 8 * (len(x) - 8)
        if len(y) > len(x):
            q = q >> width ^ q & (1 << width) - 1
        return ([0], [1]) if (p ^ q).bit_count() * (den + num) <= (n + m) * (den - num) else ([], [])
    sizes = np.array([int.from_bytes(s[:8], "little") for s in sketches])
    label, out, widths = np.unique(labels, return_inverse=True)[1], ([], []), np.array([len(s) - 8 for s in sketches])
    for width in np.unique(widths).tolist():
        own, twice = np.nonzero(widths == width)[0], np.nonzero(widths == 2 * width)[0]
        bits = np.frombuffer(b"".join(sketches[i][8:] for i in own), dtype=np.uint64).reshape(len(own), -1)
        if len(twice):  # sizes of linked sets differ by less than a factor of two
            wide = np.frombuffer(b"".join(sketches[i][8:] for i in twice), dtype=np.uint64).reshape(len(twice), 2, -1)
            bits = np.concatenate([bits, wide[:, 0] ^ wide[:, 1]])
        at = np.concatenate([own, twice])
        n = sizes[at]
        for i in range(min(len(own), len(at) - 1)):
            rest = n[i + 1 :]
            near = np.nonzero((label[at[i + 1 :]] != label[at[i]]) & (np.minimum(rest, n[i]) * den >= np.maximum(rest, n[i]) * num))[0] + i + 1
            apart = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
            join(int(at[i]), at[near[apart * (den + num) <= (n[near] + n[i]) * (den - num)]].tolist(), label, out)
    return out


def join(i: int, others: list[int], label: np.ndarray, out: tuple[list[int], list[int]]) -> None:
    """Note the links from i to others of another label, and give all of those i's."""
    for j in others:
        if label[j] != label[i]:
            label[label == label[j]] = label[i]
            out[0].append(i)
            out[1].append(j)


def linked(values: list[bytes], labels: list[int], similarity: Fraction) -> tuple[list[int], list[int]]:
    """Links (positions) that connect whatever sets are linked by their similarity; those of one label are connected."""
    num, den = similarity.numerator, similarity.denominator
    sets = [np.frombuffer(v, dtype=np.uint64) for v in values]
    label, out = np.unique(labels, return_inverse=True)[1], ([], [])
    sizes = np.array([len(s) for s in sets])
    flat, where = np.unique(np.concatenate(sets), return_inverse=True)
    parts = [where[end - n : end] for end, n in zip(np.cumsum(sizes), sizes, strict=True)]
    has = np.zeros(len(flat), dtype=np.int64)
    for i in range(len(sets) - 1):
        rest = sizes[i + 1 :]
        other = np.nonzero((label[i + 1 :] != label[i]) & (np.minimum(rest, sizes[i]) * den >= np.maximum(rest, sizes[i]) * num))[0] + i + 1
        if not len(other):
            continue
        has[parts[i]] = 1
        both = np.add.reduceat(has[np.concatenate([parts[j] for j in other])], np.cumsum(sizes[other]) - sizes[other])
        has[parts[i]] = 0
        join(i, other[both * (den + num) >= (sizes[other] + sizes[i]) * num].tolist(), label, out)
    return out


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: Fraction = SIMILARITY, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable) of each row."""
    rows = shared.settled(described(docs, size, similarity))
    distinct = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("mark").alias("mark"))
    once = rows.where("n > 0").dropDuplicates(["key"])
    met = spread(once).withColumn("times", F.count("*").over(Window.partitionBy("gram"))).where("times > 1").select(F.col("gram").alias("group"), "key", F.col("times").alias("n"))
    proposed = by_simhash(once.select("key", "fp"), radius)
    told = simhash.components(proposed.unionByName(by_group(met.join(once.select("key", F.col("sketch").alias("value")), "key"), lambda values, labels: likely(values, labels, similarity), limit)))
    sizes = told.groupBy("root").agg((F.count("*") + 1).alias("n"))
    groups = shared.settled(told.select(F.col("root").alias("group"), F.col("node").alias("key")).unionByName(sizes.select(F.col("root").alias("group"), F.col("root").alias("key"))).join(sizes.withColumnRenamed("root", "group"), "group"))
    marks = distinct.join(groups.select("key"), "key", "left_semi").select("mark")

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            grams = [shingles(t, size) for t in batch.column(0).to_pylist()]
            yield shared.batch_of(key=pa.array([key_of(g) for g in grams], pa.int64()), value=pa.array([g.tobytes() for g in grams], pa.binary()))

    texts = docs.select(F.xxhash64("text").alias("mark"), "text").join(marks, "mark", "left_semi").select("text").distinct()
    sets = shared.map_arrow(texts, run, "key long, value binary").dropDuplicates(["key"])
    roots = simhash.components(by_group(groups.join(sets, "key"), lambda values, labels: linked(values, labels, similarity), limit))
    rooted = distinct.join(roots, distinct.key == roots.node, "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "key").join(rooted.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
