"""Perplexity against brute-force Kneser-Ney, and what its bands reject."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import kneser_ney
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def plain_symbols(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join("0" if c in "0123456789" else c for c in "  " + "".join(" " + w for w in words) + " ") if words else ""


def plain_grams(text):
    s = plain_symbols(text)
    return [s[i : i + 4] for i in range(len(s) - 3)]


class PlainModel:
    """Modified Kneser-Ney by dictionaries: `asked` are texts whose symbols are in the vocabulary beside those learned from."""

    def __init__(self, texts, asked):
        counts = Counter(g for t in texts for g in plain_grams(t))
        self.levels, self.vocabulary = [], {g[-1] for t in [*texts, *asked] for g in plain_grams(t)}
        for n in (4, 3, 2, 1):
            of = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
            d = [0.0, *kneser_ney.discounts(of)]
            total, left = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3)]
            self.levels.append((counts, d, total, left))
            counts = Counter(g[1:] for g in counts) if n > 1 else counts

    def p(self, gram):
        out = 1 / (len(self.vocabulary) + 1)
        for n in (1, 2, 3, 4):
            counts, d, total, left = self.levels[4 - n]
            g = gram[4 - n :]
            if total[g[:-1]]:
                out = left[g[:-1]] / total[g[:-1]] * out + (counts[g] - d[min(counts[g], 3)]) / total[g[:-1]]
        return out


TEXTS = ["banana band. The ban a nab", "a b aé 42 \U00020000x the\nThe band", "The the the", "", None, "nab a  ban. A banana 7", "x"] + ["on the %s of a band." % w for w in ("nab", "ban", "banana", "é")]


def test_probabilities_against_dictionaries(spark):
    texts = [(i, t, "en") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    half = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()}
    halves = [[(t or "").replace("\U00020000", chr(kneser_ney.PRIVATE + 0x20000 % kneser_ney.PRIVATE_SIZE)) for i, t, _ in texts if half[i] == h] for h in (0, 1)]
    models = [PlainModel(halves[h], halves[1 - h]) for h in (0, 1)]
    for chunk_words, broadcast in ((3, 10**6), (10**6, 0), (3, 0)):
        got = {r["doc_id"]: r for r in kneser_ney.measured(docs, chunk_words=chunk_words, broadcast=broadcast).collect()}
        assert len(got) == len(TEXTS)
        for i, t, _ in texts:
            grams = plain_grams((t or "").replace("\U00020000", chr(kneser_ney.PRIVATE + 0x20000 % kneser_ney.PRIVATE_SIZE)))
            assert got[i]["symbols"] == len(grams)
            if grams:  # one language: its model is that of all
                assert abs(got[i]["log_perplexity"] + sum(math.log(models[1 - half[i]].p(g)) for g in grams) / len(grams)) < 1e-9
            else:
                assert got[i]["log_perplexity"] is None


def test_probabilities_sum_to_one(spark):
    model = PlainModel([t or "" for t in TEXTS], [])
    contexts = {g[:3] for t in TEXTS for g in plain_grams(t or "")} | {"zzz"}
    for context in contexts:
        assert abs(sum(model.p(context + s) for s in [*model.vocabulary, "~"]) - 1) < 1e-9


def test_grams_of_words_and_borders_are_those_of_the_text():
    words = [b"on", b"a", b"the", "\u00e9t\u00e9".encode(), b"x9"]
    numbers, lengths = np.array([0, 1, 1, 2, 3, 4, 0]), np.array([4, 0, 3])
    w = kneser_ney.Words(words)
    key = lambda g: sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g))
    want = Counter(key(g) for part in (numbers[:4], numbers[4:]) for g in plain_grams(" ".join(words[i].decode() for i in part)))
    starts = np.cumsum(w.own) - w.own
    have = Counter(int(g) for i in numbers for g in w.grams[starts[i] : starts[i] + w.own[i]])
    for more in kneser_ney.border_grams(w.borders(numbers, lengths)):
        have.update(int(g) for g in more)
    assert have == want


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    labels = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    rng = random.Random(3)
    planted = defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        words = r["text"].split()
        if r["doc_id"] in labels and r["doc_id"] % 5 == 1 and 300 < len(words) < 3000:
            rng.shuffle(words)
            planted["salad"].append((" ".join(words), r["lang"]))
    planted["loop"] = [(" ".join(rng.choice(("of", "the", "and", "to", "in")) for _ in range(200)), "en") for _ in range(5)]
    planted["junk"] = [(" ".join("".join(chr(rng.randrange(33, 120)) for _ in range(9)) for _ in range(60)), "en") for _ in range(5)]
    planted["rare"] = [(" ".join(rng.choice(("kwa", "mtu", "hii", "sana", "watoto", "nyumba")) for _ in range(60)) + ".", "sw")]
    rows, names = [], {}
    for kind, some in planted.items():
        for text, lang in some:
            names[10**6 + len(rows)] = kind
            rows.append((10**6 + len(rows), text, lang))
    got = {r["doc_id"]: r for r in kneser_ney.judge(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    return got, names, labels


def test_bands_reject_shuffled_words_loops_and_junk(judged):
    got, names, labels = judged
    kept = defaultdict(list)
    for doc_id, kind in names.items():
        kept[kind].append(got[doc_id]["kept"])
    assert not any(kept["loop"]) and not any(kept["junk"])
    assert len(kept["salad"]) >= 10 and sum(kept["salad"]) <= 0.4 * len(kept["salad"])
    assert all(kept["rare"])  # a language of one document has a wide band


def test_bands_keep_clean_documents(judged):
    got, _, labels = judged
    sound = [got[i] for i in labels if not got[i]["base_failed"]]
    assert sum(r["kept"] for r in sound) > 0.95 * len(sound)
