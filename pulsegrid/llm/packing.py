"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

A chromosome is a grouping: a list of bins, each a list of documents' pieces. Crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold a piece twice, and puts the
displaced pieces back largest first, each into the bin with the least room that takes it. Mutation
empties the worst bins the same way.

Pieces are dealt by hash into blocks of bounded size. Each block is evolved by several islands in
tasks of their own; after each epoch an island's elite also moves to the next island. The bins that a
block leaves badly filled are pooled with those of other blocks and evolved again, so the loss does not grow
with the number of blocks. Work for a block is bounded, so the whole grows with the input.

Null texts are empty: the end id alone. Repeated rows are packed each. A null doc_id is packed under
null. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import random
import string
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
#: Pieces in a block on average, islands, epochs, chromosomes of an island and generations of an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2048, 2, 2, 5, 5
#: Room, as a share of the capacity, above which a bin's pieces are evolved again with other blocks' ones.
LOOSE = 0.01
#: Words whose ids a worker keeps; bytes of texts that are encoded together.
CACHE, TEXTS = 1_000_000, 20_000_000
OTHER_SPACE = [*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680", *map(chr, range(0x2000, 0x200B)), *"\u2028\u2029\u202f\u205f\u3000", "\n\n", "  ", " \n"]
#: How the vocabulary writes a space, a newline and a no-break space; new words that are encoded at once.
BLANKS, NO_BREAK, TOGETHER = {" ": "\u0120", "\n": "\u010a"}, "\u00c2\u0142", 100
#: The last of the letters that every version of Unicode has as such.
LETTERS = "\u024f"


def mixed(token: str) -> bool:
    """Whether a token of the vocabulary may join a letter to a blank after it or to a newline before it."""
    space, newline = BLANKS.values()
    return (space in token[1:] or newline in token) and bool(token.strip(space + newline)) and NO_BREAK not in token


class Tokens:
    """Ids of texts as little-endian bytes, by a byte-level BPE tokenizer file.

    Its pre-tokenizer starts a new piece of text at every single space or newline between
    non-blanks, so texts without other blanks are encoded word by word, and words are kept. Words that are not known yet
    are encoded together: each one's first token is the only one of it that starts with a blank. Added
    tokens (such as an end mark written out) are found in the whole text first, so a text that holds one is
    encoded at once.

    Letters are a piece of text of their own and so is the punctuation that ends a word, so a word of letters is encoded once
    whatever ends it. No merge goes from a letter to a blank or from a newline to a letter (files that have such merges do
    without this), so the model's merges alone keep words of letters apart, and the pre-tokenizer is left out for them.
    """

    def __init__(self, path: str | None = None, cache: int | None = None):
        self.cache = cache or CACHE
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + OTHER_SPACE
        vocabulary = self.tokenizer.get_vocab()
        #: By blank, whether a token starts with it.
        self.starts = {blank: np.zeros(max(vocabulary.values()) + 1, dtype=bool) for blank in BLANKS}
        for blank, written in BLANKS.items():
            self.starts[blank][[n for token, n in vocabulary.items() if token[0] == written]] = True
        self.merging = self.tokenizer
        if not any(map(mixed, vocabulary.keys() - set(self.whole))):
            self.merging = Tokenizer.from_str(self.tokenizer.to_str())
            self.merging.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Ids of words after a space, and of newlines with the word after them.
        self.known: dict[str, bytes] = {}
        #: What was known before `known` was begun anew, and ids of the punctuation that ends words.
        self.earlier: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def together(self, tokenizer, words: list[str], blank: str) -> None:
        """Learn words after this blank; a newline is a word's first character, a space is not in it."""
        before = "" if blank == "\n" else blank
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(tokenizer.encode_batch_fast([before + before.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = (4 * np.nonzero(self.starts[blank][ids])[0]).tolist()
            if len(starts) == len(some):
                data = ids.tobytes()
                self.known.update(zip(some, map(data.__getitem__, map(slice, starts, [*starts[1:], len(data)])), strict=True))
            else:
                self.known.update((w, self.encode(before + w)) for w in some)

    def learn(self, words: list[str]) -> None:
        known, earlier, tails = self.known, self.earlier, self.tails
        for blank in BLANKS:
            stems: dict[str, None] = {}
            ended, others = [], []
            for word in [w for w in words if w[0] == "\n"] if blank == "\n" else [w for w in words if w[0] != "\n"]:
                stem = word.rstrip(string.punctuation)
                letters = stem if blank == " " else stem[1:]
                if not letters.isalpha() or not letters.isascii() and max(letters) > LETTERS:
                    others.append(word)
                    continue
                stems[stem] = None
                if len(stem) < len(word):
                    ended.append((word, stem))
            missing = [w for w in stems if w not in known]
            known.update((w, earlier[w]) for w in missing if w in earlier)
            self.together(self.merging, [w for w in missing if w not in earlier], blank)
            self.together(self.tokenizer, others, blank)
            for word, stem in ended:
                tail = word[len(stem) :]
                if tail not in tails:
                    tails[tail] = self.encode(tail)
                known[word] = known[stem] + tails[tail]

    def of(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if len(self.known) > self.cache // 2:
            self.known, self.earlier, self.tails = {}, self.known, {}
        known, earlier = self.known, self.earlier
        ids = list(map(known.get, words))
        new = [n for n, got in enumerate(ids) if got is None]
        known.update((words[n], earlier[words[n]]) for n in new if words[n] in earlier)
        self.learn([words[n] for n in new if words[n] not in known])
        for n in new:
            ids[n] = known[words[n]]
        return ids

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null is empty."""
        out: list[bytes] = []
        worded = []
        for text in texts.to_pylist():
            whole = text and (text[0] in " \n" or text[-1] == " " or any(x in text for x in self.whole))
            worded.append(bool(text) and not whole)
            out.append(self.encode(text) if whole else b"")
        # each text begins with a newline of its own, whose id is left out again
        lines = pc.replace_substring(texts.filter(pa.array(worded, pa.bool_())).cast(pa.large_string()), "\n", " \n")
        newline = pa.scalar("\n", pa.large_string())
        lists = pc.split_pattern(pc.binary_join_element_wise(newline, lines, pa.scalar("", pa.large_string())), " ")
        if len(lists):
            words = lists.flatten().dictionary_encode()
            numbers = words.indices.to_numpy()
            ids = self.of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            starts, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), dtype="<u4")
            stops = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
            for n, a, b in zip(np.nonzero(worded)[0].tolist(), [0, *stops[:-1]], stops, strict=True):
                own = numbers[a:b]
                lengths = sizes[own]
                ends = np.cumsum(lengths)
                out[n] = every[np.arange(ends[-1]) + np.repeat(starts[own] - (ends - lengths), lengths)][1:].tobytes()
        return out


@lru_cache(maxsize=2)
def tokens(path: str | None = None, cache: int | None = None) -> Tokens:
    return Tokens(path, cache)


def gathered(batches: shared.Batches, size: int) -> shared.Batches:
    """The same rows, small batches joined up to this many bytes: a word that is in many texts is looked up once for them all."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cache: int = CACHE, size: int = TEXTS) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32 of every piece; the first takes what is over."""

    def run(batches: shared.Batches) -> shared.Batches:
        encode, end = tokens(path, cache), np.array([END_ID], dtype="<u4").tobytes()
        for batch in gathered(batches, size):
            rows = []
            (names,) = shared.columns(batch, "doc_id")
            for doc_id, ids in zip(names, encode(batch.column(batch.schema.get_field_index("text"))), strict=True):
                ids += end
                n = len(ids) // 4
                at = 0
                for piece, stop in enumerate(range(n % capacity or capacity, n + 1, capacity) if n > capacity else (n,)):
                    rows.append((doc_id, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at = stop
            a, b, c, d, e = zip(*rows, strict=True) if rows else ((),) * 5
            yield shared.batch_of(doc_id=pa.array(a, pa.int64()), piece=pa.array(b, pa.int32()), start=pa.array(c, pa.int64()), length=pa.array(d, pa.int64()), ids_crc32=pa.array(e, pa.int64()))

    made = shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


class Rooms:
    """Bins by the room that they have, to find the least room that takes a piece."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def add(self, members: list[int], room: int) -> None:
        self.by_room[room].append(members)
        self.mask |= 1 << room

    def fit(self, item: int, size: int) -> None:
        least = self.mask >> size
        if least:
            room = size + (least & -least).bit_length() - 1
            members = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
        else:
            room, members = self.capacity, []
        members.append(item)
        self.add(members, room - size)

    def bins(self) -> list[tuple[list[int], int]]:
        return [(members, room) for room, some in enumerate(self.by_room) for members in some]


Grouping = list[tuple[list[int], int]]


def refit(kept: Grouping, displaced: list[int], sizes: list[int], capacity: int) -> Grouping:
    """The kept bins with the displaced pieces fitted in, largest first, best fit."""
    rooms = Rooms(capacity)
    for members, room in kept:
        rooms.add(list(members), room)
    for item in sorted(displaced, key=sizes.__getitem__, reverse=True):
        rooms.fit(item, sizes[item])
    return rooms.bins()


def exchanged(kept: Grouping, displaced: list[int], sizes: list[int]) -> tuple[Grouping, list[int]]:
    """Kept bins that are fuller, and displaced pieces that are smaller: in each bin the piece goes for a displaced one that fills it best."""
    out = sorted(displaced, key=sizes.__getitem__)
    known = [sizes[i] for i in out]
    bins = []
    for members, room in kept:
        best = 0, 0, 0
        if room:
            for place, item in enumerate(members):
                size = sizes[item]
                at = bisect_right(known, size + room) - 1
                if at >= 0 and known[at] - size > best[0]:
                    best = known[at] - size, place, at
        gain, place, at = best
        if gain:
            item = members[place]
            members = [*members[:place], out[at], *members[place + 1 :]]
            del out[at], known[at]
            at = bisect_right(known, sizes[item])
            out.insert(at, item)
            known.insert(at, sizes[item])
        bins.append((members, room - gain))
    return bins, out


def fitness(grouping: Grouping, capacity: int) -> tuple[int, int]:
    """Fewer bins first; then fuller ones, as the squares of what they hold (negative: less is better)."""
    return len(grouping), -sum((capacity - room) ** 2 for _, room in grouping)


def crossover(a: Grouping, b: Grouping, sizes: list[int], capacity: int, rng: random.Random) -> Grouping:
    """The child of two: half of b's fullest bins whole, a's bins that hold none of their pieces, and the rest fitted in again."""
    fullest = sorted(b, key=lambda g: g[1])[: max(2, len(b) // 2)]
    injected = rng.sample(fullest, max(1, len(fullest) // 2))
    inside = {i for members, _ in injected for i in members}
    kept, displaced = list(injected), []
    for members, room in a:
        if inside.isdisjoint(members):
            kept.append((members, room))
        else:
            displaced += [i for i in members if i not in inside]
    return refit(*exchanged(kept, displaced, sizes), sizes, capacity)


def mutated(a: Grouping, sizes: list[int], capacity: int, rng: random.Random) -> Grouping:
    """The worst bins, and some others, emptied and their pieces fitted in again."""
    order = sorted(range(len(a)), key=lambda i: a[i][1] + rng.random() * capacity / 50, reverse=True)
    emptied = set(order[: max(2, len(a) // 20)])
    return refit(*exchanged([g for i, g in enumerate(a) if i not in emptied], [m for i in emptied for m in a[i][0]], sizes), sizes, capacity)


def evolve(sizes: list[int], elites: list[Grouping], seed: int, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> Grouping:
    """The best grouping that one island finds in an epoch, from elites and best-fit groupings in disturbed orders."""
    rng = random.Random(seed)
    best_possible = -(-sum(sizes) // capacity)
    herd = list(elites)
    if not herd:
        herd.append(refit([], list(range(len(sizes))), sizes, capacity))
    if min(map(len, herd)) <= best_possible:
        return min(herd, key=lambda g: fitness(g, capacity))
    while len(herd) < population:
        rooms = Rooms(capacity)
        for item in sorted(range(len(sizes)), key=lambda i: sizes[i] * (1 + rng.random() / 4), reverse=True):
            rooms.fit(item, sizes[item])
        herd.append(rooms.bins())
    ranked = sorted(((fitness(g, capacity), n, g) for n, g in enumerate(herd)), key=lambda x: x[:2])
    born = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] <= best_possible:
            break
        for _ in range(population // 2):
            (_, _, a), (_, _, b) = rng.sample(ranked[: max(2, population - 1)], 2)
            child = mutated(crossover(a, b, sizes, capacity, rng), sizes, capacity, rng)
            ranked.append((fitness(child, capacity), born, child))
            born += 1
        ranked = sorted(ranked, key=lambda x: x[:2])[:population]
    return ranked[0][2]


def _numbers(grouping: Grouping, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for number, (members, _) in enumerate(grouping):
        out[members] = number
    return out


def _grouping(numbers: np.ndarray, sizes: list[int], capacity: int) -> Grouping:
    bins: list[list[int]] = [[] for _ in range(int(numbers.max()) + 1)]
    for item, number in enumerate(numbers.tolist()):
        bins[number].append(item)
    return [(members, capacity - sum(map(sizes.__getitem__, members))) for members in bins]


ELITE = "block long, island int, rows array<long>, sizes array<int>, bins array<int>, n int"


def evolve_blocks(items: DataFrame, blocks: int, seed: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """row, length, sequence (block, bin), room, offset of items (row, length) after all epochs of all islands."""

    def elite(block: int, island: int, rows: np.ndarray, sizes: list[int], elites: list[Grouping], epoch: int) -> pa.Table:
        best = evolve(sizes, elites, hash((seed, block, island, epoch)), capacity)
        return pa.table({"block": [block], "island": pa.array([island], pa.int32()), "rows": [rows.tolist()], "sizes": pa.array([sizes], pa.list_(pa.int32())), "bins": pa.array([_numbers(best, len(sizes)).tolist()], pa.list_(pa.int32())), "n": pa.array([len(best)], pa.int32())})

    def begin(table: pa.Table) -> pa.Table:
        rows = table.column("row").to_numpy()
        order = np.argsort(rows)  # islands of a block, and repeated runs, number its pieces alike
        return elite(table.column("block")[0].as_py(), table.column("island")[0].as_py(), rows[order], table.column("length").to_numpy()[order].tolist(), [], 0)

    def go_on(epoch: int):
        def run(table: pa.Table) -> pa.Table:
            came = sorted(table.to_pylist(), key=lambda r: r["island"])
            sizes = came[0]["sizes"]
            elites = [_grouping(np.array(r["bins"]), sizes, capacity) for r in came]
            return elite(came[0]["block"], came[0]["to"], np.array(came[0]["rows"]), sizes, elites, epoch)

        return run

    dealt = items.select(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "row", "length")
    state = dealt.groupBy("block", "island").applyInArrow(begin, ELITE)
    for epoch in range(1, epochs):
        moved = state.withColumn("to", F.explode(F.array(F.col("island"), ((F.col("island") + 1) % islands).cast("int"))))
        state = moved.groupBy("block", "to").applyInArrow(go_on(epoch), ELITE)
    best = state.groupBy("block").agg(F.min_by(F.struct("rows", "sizes", "bins"), F.struct("n", "island")).alias("best"))

    def placed(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            for block, got in zip(*shared.columns(batch, "block", "best"), strict=True):
                rows, sizes, bins = (np.array(got[k], dtype=np.int64) for k in ("rows", "sizes", "bins"))
                order = np.lexsort((rows, bins))
                rows, sizes, bins = rows[order], sizes[order], bins[order]
                before = np.cumsum(sizes) - sizes
                starts = np.nonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))[0]
                spans = np.diff(np.concatenate([starts, [len(bins)]]))
                filled = np.repeat(np.add.reduceat(sizes, starts), spans)
                yield shared.batch_of(row=rows, length=sizes, block=np.full(len(rows), block, dtype=np.int64), bin=bins, room=capacity - filled, offset=before - np.repeat(before[starts], spans))

    return shared.map_arrow(best, placed, "row long, length long, block long, bin long, room long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, cache: int = CACHE, size: int = TEXTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document; less `cache` and `size` take less memory and more time."""
    made = shared.settled(pieces(docs, path, capacity, cache, size))
    loose = made.where(F.col("length") < capacity).select("row", "length")
    blocks = max(1, -(-loose.count() // block))
    first = shared.settled(evolve_blocks(loose, blocks, 1, capacity, islands, epochs))
    again = first.where(F.col("room") > F.lit(LOOSE) * capacity)
    n = again.count()
    second = evolve_blocks(again.select("row", "length"), max(1, -(-n // block)), 2, capacity, islands, epochs)
    # sequences: 3 x for whole pieces, then those of the first and the second dealing
    number = (F.col("block") * (1 << 24) + F.col("bin")) * 3
    placed = first.where(F.col("room") <= F.lit(LOOSE) * capacity).select("row", (number + 1).alias("sequence_id"), "offset")
    placed = placed.unionByName(second.select("row", (number + 2).alias("sequence_id"), "offset"))
    whole = made.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row") * 3, "offset": F.lit(0).cast("long")})
    return whole.drop("row").unionByName(made.where(F.col("length") < capacity).join(placed, "row").drop("row"))
