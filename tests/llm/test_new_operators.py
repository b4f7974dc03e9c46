"""Divergence, bottom-k sketches and importance resampling against brute force, on awkward and on skewed rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pulsegrid.llm import bottom_k, divergence, importance, shared, shingle_join
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the of and", "en", None, 10), (3, "the of and", "en", None, 10), (None, "le la des", "fr", "b", 9), (5, "\t\n  ", "fr", "a", 5), (6, "x" * 200_000 + " y", "en", "a", 200_002), (7, "12 34 !!", None, "b", 8), (8, "THE\r\nof  and to", "en", "a", 15), (9, "one two", "en", "a", 7), (10, "One  TWO", "en", "a", 8)]


@pytest.fixture(scope="module")
def awkward(spark):
    names = ("n", "i", "key", "label", "value", "term", "total", "weight", "score", "at", "rank", "v", "k")
    return spark.createDataFrame(AWKWARD, DOC).withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- divergence --------------------------------------------------------------------------------


def brute_divergence(rows, least=10, ranks=10):
    held = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in held}:
        own = [(s, w) for g, s, w in held if g == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        counts = {s: Counter() for s, _ in own}
        for s, w in own:
            counts[s].update(t for t in w if df[t] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda x, y: (x - y) * (x - y) // (x + y)
        shares, of_lang = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in shares:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in shares if o != s]
            terms = [(f(shares[s][t], of_lang[t]), t) for t in kept if counts[s][t] and shares[s][t] > of_lang[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, n) for n, (value, item) in enumerate(ordered[:most], 1)}
    return out


def divergence_rows(df):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]


def test_divergence_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = ["A", "b", "Zeta", "naïve", "É", "é", "日本", "x1y", "don't", "\U00020000x"] + [f"w{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{rng.integers(0, 9)}"
        rows.append((" ".join(rng.choice(words, int(rng.integers(0, 30)))), ["en", "fr", None][i % 3 if i % 7 else 0], source))
    rows += [("onlyrare", "de", "s1"), ("", "de", "s2"), (None, "de", None), ("w", "xx", "alone")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    want = brute_divergence(rows)
    for broadcast in (divergence.BROADCAST, 0):
        got = divergence_rows(divergence.audit(docs, broadcast=broadcast))
        assert len(got) == len(set(got)) and set(got) == want
    assert {x[2] for x in want} == {"pair", "term"} and any(x[0] == "de" and x[4] == 0 for x in want)


def test_divergence_of_awkward_rows(spark, awkward, empty):
    rows = [(r[1], r[2], r[3]) for r in AWKWARD]
    for least in (1, 2):
        assert set(divergence_rows(divergence.audit(awkward, least))) == brute_divergence(rows, least)
    assert divergence.audit(empty).count() == 0


def test_divergence_of_counts_beyond_a_long(spark):
    n = 10**12
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(10**6)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert got.p == 1 + 10**9 * (n + 2) // (3 * n + 2 * 10**6) and got.none is None


# --- bottom-k ----------------------------------------------------------------------------------


def brute_components(rows, size=3, num=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (a == b or 100 * len(a & b) >= num * len(a | b)):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in least[root(i)] if x is not None]
        first = doc_id if not sets[i] else min(ids) if ids else None
        out.append((doc_id, len(sets[i]), first, doc_id is not None and doc_id == first))
    return sorted(out, key=repr)


def links_rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def test_bottom_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(3000)]
    texts = []
    for length in (4, 8, 9, 30, 64, 70, 130, 300, 900):
        for _ in range(4):
            base = rng.choice(names, length).tolist()
            for changed in (0, 0.005, 0.01, 0.02, 0.025, 0.03, 0.05):
                texts.append(" ".join(str(rng.choice(names)) if rng.random() < changed else w for w in base))
            texts += [" ".join(base[: int(length * 0.87)]), " ".join(base[: int(length * 0.84)]), " ".join(base).upper()]
    base = rng.choice(names, 200).tolist()  # a chain of near copies whose ends are far apart
    for i in range(60):
        base[(i * 3) % 200] = f"n{i}"
        texts.append(" ".join(base))
    passage = " ".join(rng.choice(names, 40).tolist())  # met in many texts that are no copies
    texts += [passage + " " + " ".join(rng.choice(names, int(n)).tolist()) for n in rng.integers(3, 60, 120)]
    texts += [None, "", " \n", "one two", "One  two", "one"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_components(rows)
    assert links_rows(bottom_k.near_duplicates(docs)) == want
    # groups that are dealt in blocks
    assert links_rows(bottom_k.near_duplicates(docs, limit=7)) == want


def test_lists_across_blocks_of_rows(spark, monkeypatch):
    """Pairs of short lists and values of longer ones, whatever rows a task holds at once."""
    rng = np.random.default_rng(6)
    lists = {int(v): rng.permutation(400)[: int(n)] for v, n in zip(rng.permutation(10**6)[:60], rng.choice([1, 2, 3, 20, 48, 49, 50, 120], 60), strict=True)}
    rows = [(v, int(k), 50 + int(k) % 30, int(k) % 5 if v % 2 else 0) for v, keys in lists.items() for k in keys]
    members = spark.createDataFrame(rows, "value long, key long, n long, label long")
    num, den = bottom_k.SIMILARITY.numerator, bottom_k.SIMILARITY.denominator
    want, hot = Counter(), set()
    for v, keys in lists.items():
        own = [r for r in rows if r[0] == v]
        if len(own) > bottom_k.SHORT:
            hot |= {v} if len({r[3] for r in own}) > 1 else set()
            continue
        for i, x in enumerate(own):
            for y in own[:i]:
                if x[3] != y[3] and min(x[2], y[2]) * den >= max(x[2], y[2]) * num:
                    want[(min(x[1], y[1]), max(x[1], y[1]))] += 1
    for records in (1, 7, 10_000):  # rows of a batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
        for held in (1, 30, 1 << 19):
            got = bottom_k.met_in_lists(members, bottom_k.SIMILARITY, held).collect()
            assert Counter((r.a, r.b) for r in got if r.b is not None) == want and sorted(r.a for r in got if r.b is None) == sorted(hot)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bottom_k_estimate_keeps_links():
    rng = np.random.default_rng(7)
    none = np.empty(0, dtype=np.uint64)
    for n in (3, 20, 64, 65, 500, 5000):
        for _ in range(60):
            union = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
            away = int(len(union) * 3 / 20)
            out = rng.permutation(len(union))[:away]
            split = rng.integers(0, away + 1)
            a, b = np.delete(union, out[:split]), np.delete(union, out[split:])
            parts = [bottom_k.sketches(x, none, none, bottom_k.SIMILARITY) for x in (a, b)]
            read = [np.frombuffer(p[1], dtype="<u4", offset=8) for p in parts]
            assert bottom_k.similar(read[0], read[1], len(a), len(b), bottom_k.SIMILARITY)
            if n > 12:
                assert len(np.intersect1d(parts[0][0], parts[1][0])) >= bottom_k.OVERLAP
    apart = [np.frombuffer(bottom_k.sketches(np.unique(rng.integers(0, 2**64 - 1, 900, dtype=np.uint64)), none, none, bottom_k.SIMILARITY)[1], dtype="<u4", offset=8) for _ in range(2)]
    assert not bottom_k.similar(*apart, 900, 900, bottom_k.SIMILARITY)


def test_bottom_k_of_awkward_rows(spark, awkward, empty):
    assert links_rows(bottom_k.near_duplicates(awkward)) == brute_components([(r[0], r[1]) for r in AWKWARD])
    assert bottom_k.near_duplicates(empty).count() == 0


def test_bottom_k_of_large_groups_of_copies(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = [" ".join(base)] * 300 + [" ".join([*base[:i], f"c{n}", *base[i + 1 :]]) for n, i in enumerate(rng.integers(0, 120, 300).tolist())] + [" ".join(f"u{n}_{i}" for i in range(30)) for n in range(300)]
    rows = list(enumerate(texts))
    got = links_rows(bottom_k.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), limit=100))
    assert {r[2] for r in got} == {0} | set(range(600, 900)) and sum(r[3] for r in got) == 301


# --- importance --------------------------------------------------------------------------------


def brute_importance(docs, target, needed=20, percent=5):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    features = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in features(words(x))) for texts in ([d[1] for d in docs], target))
    every, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every + 10000) / ((s[b] + 1) * (wanted + 10000))))
    out = []
    for doc_id, text in docs:
        w = words(text)
        f = features(w)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= needed])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=repr)


def importance_rows(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=repr)


def test_importance_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["the", "OF", "naïve", "x9", "日本", "a-b", "\U00020000"] + [f"t{i}" for i in range(200)]
    docs = [(int(i), " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 80, 900))]
    target = [" ".join(rng.choice(words[:20], 30)) for _ in range(15)] + [None, ""]
    rows, wanted = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance_rows(importance.resample(rows, wanted))
    assert got == brute_importance(docs, target) and sum(r[4] is not None for r in got) == 5 * sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) >= 20 for _, t in docs) // 100


def test_texts_that_are_cut_into_tries(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "c"], int(n))) for n in (0, 1, 2, 3, 50, 1, 7, 0, 23)]
    whole, gain = None, rng.integers(-50, 50, importance.BUCKETS)
    for size in (1, 2, 3, 5, 1000):
        totals, weight, n = np.zeros(importance.BUCKETS, dtype=np.int64), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for words, room, owner, lengths in importance.blocks(texts, size):
            if words:
                trie = importance.Trie(words, room)
                totals += trie.totals()
                np.add.at(weight, owner, trie.sums(gain, len(words)))
            for number, length in lengths.items():
                n[number] = length
        assert n.tolist() == [len(t.split()) for t in texts]
        whole = whole or (totals.tolist(), weight.tolist())
        assert (totals.tolist(), weight.tolist()) == whole
    assert sum(whole[0]) == sum(max(0, k - i) for k in n.tolist() for i in range(3))


def test_importance_of_awkward_rows(spark, awkward, empty):
    target = spark.createDataFrame([(1, "the of and to")], "item_id long, text string")
    docs = [(r[0], r[1]) for r in AWKWARD]
    assert importance_rows(importance.resample(awkward, target, needed=2, percent=50)) == brute_importance(docs, ["the of and to"], 2, 50)
    assert importance.resample(empty, target).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert importance_rows(importance.resample(awkward, nothing)) == brute_importance(docs, [])
    same = spark.createDataFrame([(7, "w " * 30)] * 50, "doc_id long, text string")  # repeated rows and ties
    assert sorted(r["rank"] for r in importance.resample(same, target).collect() if r["rank"]) == [1, 2]
