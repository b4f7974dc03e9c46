"""Language identification by a linear-chain conditional random field over the words of a text.

Every word has a label, a learned language. Emissions are sums of weights of affixes, character
n-grams and lexicon entries; transitions between the labels of neighbouring words are learned with
them. Marginals come from forward-backward over the whole text, so a word that two languages share
takes its label from its neighbours, and code-switched texts get a label a word. A document's language
is the one with the most marginal probability over its words, and its score is that share.

The model is fitted on a bounded sample of labelled documents (`per_language` of each of the
`most_languages` largest languages, by a hash of the id): one half makes the lexicon, the other is cut into runs of words that are spliced with
runs of other languages, which is what transitions are learned from. Everything else covers all rows.

A word of over 40 letters is several links of the chain, so texts of scripts without blanks are read
whole and in step with others.

Texts that are null or hold no letter are `und` with score 0, as all are when nothing can be learned.
Repeated rows are judged each; a null doc_id is neither held out nor learned from. Columns other than
doc_id, text and lang are not read, and lang only of the rows that are learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Documents of a language to learn from, and words of a training sequence and of its shortest run.
PER_LANGUAGE, SEQUENCE, RUN = 300, 64, 8
#: Languages that are learned (those with the most rows), so that what the driver gathers and the model are bounded.
MOST_LANGUAGES = 256
#: Characters of a language's sample, which the driver holds.
CHARACTERS = 8_000_000
#: Words whose emissions a worker keeps, and steps of a segment in forward-backward.
CACHE, SEGMENT = 500_000, 256
#: Words whose features are looked up at once.
BLOCK = 50_000
#: Letters of a link of the chain, letters that it shares with the next one of the same word, and the sign of a cut.
LONGEST, SHARED, CUT = 40, 2, "\n"
#: Characters of texts that are worked through at once.
AT_ONCE = 2_000_000


def links(text: str) -> list[str]:
    """The words of a text; one of over LONGEST letters (as of a script without blanks) as successive links of the chain.

    Links of a word overlap by SHARED letters, so that none of its n-grams is lost; CUT, which no word holds, stands where one goes on.
    """
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for word in words:
        letters = NOT_LETTERS.sub("", word).lower() if len(word) > LONGEST else ""
        if len(letters) <= LONGEST:
            out.append(word)
            continue
        for at in range(0, len(letters) - SHARED, LONGEST):
            part = letters[at : at + LONGEST + SHARED]
            out.append((CUT if at else "") + part + (CUT if at + len(part) < len(letters) else ""))
    return out


def core(word: str) -> str:
    """A word's letters, lower-cased; a link of a longer word as it is."""
    return word if CUT in word else NOT_LETTERS.sub("", word).lower()


def features(letters: str, lexicon: dict[str, str]) -> list[str]:
    """Affixes to three letters, n-grams to three letters and the word's lexicon entry."""
    if not letters:
        return []
    n = len(letters)
    out = [f"^{letters[:k]}" for k in range(1, min(3, n) + 1)] + [f"{letters[-k:]}$" for k in range(1, min(3, n) + 1)]
    out += {letters[i : i + k] for k in (1, 2, 3) for i in range(n - k + 1)}
    if (entry := lexicon.get(letters)) is not None:
        out.append(entry)
    return out


class Grams:
    """What features() finds in a model's index, for many words at once.

    Up to three letters are an integer of 21 bits a letter, looked up in sorted arrays: one of
    prefixes, one of suffixes, one of n-grams.
    """

    def __init__(self, index: dict[str, int], lexicon: dict[str, str]):
        self.size = max(1, len(index))
        self.entries = {c: index[e] for c, e in lexicon.items() if e in index}
        kinds: list[dict[int, int]] = [{}, {}, {}]
        for name, row in index.items():
            if name[0] != "=":
                key = 0
                for letter in name.strip("^$"):
                    key = key << 21 | ord(letter)
                kinds[0 if name[0] == "^" else 1 if name[-1] == "$" else 2][key] = row
        self.tables = []
        for held in kinds:
            keys = np.array(sorted(held), dtype=np.uint64)
            self.tables.append((keys, np.array([held[k] for k in keys.tolist()], dtype=np.int64)))

    def _pairs(self, kind: int, keys: np.ndarray, words: np.ndarray) -> np.ndarray:
        known, rows = self.tables[kind]
        if not len(known) or not len(keys):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return words[hit] * self.size + rows[at[hit]]

    def found(self, letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the index for each word's letters, word after word, and how many a word has."""
        n = np.fromiter(map(len, letters), dtype=np.int64, count=len(letters))
        points = np.frombuffer("".join(letters).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        number = np.arange(len(letters))
        word, ends = np.repeat(number, n), np.cumsum(n)
        entries = map(self.entries.get, letters)
        out = [np.array([w * self.size + e for w, e in enumerate(entries) if e is not None], dtype=np.int64)]
        keys = np.zeros(len(points), dtype=np.uint64)
        for k in (1, 2, 3):
            if len(points) < k:
                break
            keys = keys[: len(points) - k + 1] << np.uint64(21) | points[k - 1 :]
            long = n >= k
            out.append(self._pairs(0, keys[(ends - n)[long]], number[long]))
            out.append(self._pairs(1, keys[ends[long] - k], number[long]))
            inside = word[: len(keys)] == word[k - 1 :]
            out.append(self._pairs(2, keys[inside], word[: len(keys)][inside]))
        # an n-gram that a word repeats counts once
        pairs = np.sort(np.concatenate(out))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        return pairs % self.size, np.bincount(pairs // self.size, minlength=len(letters))


def normalise(x: np.ndarray) -> np.ndarray:
    return x / x.reshape(len(x), -1).sum(axis=1).reshape((-1,) + (1,) * (x.ndim - 1))


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Forward-backward: P(label | text) of each word, for many texts laid end to end.

    emissions: positive potentials (words x labels); moves: positive potentials from label to label.
    Texts are cut into segments, all of which are worked through at once: first the product of each
    segment's steps as a matrix, then the messages at the segments' borders, then the words inside.
    The result is exact, whatever the length of a segment.
    """
    n, size = emissions.shape
    lengths = lengths[lengths > 0]
    if not n:
        return emissions
    # segments of all texts, the longest first, so that the active ones are always a prefix
    per_text = -(-lengths // segment)
    text_of = np.repeat(np.arange(len(lengths)), per_text)
    nth = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = (np.cumsum(lengths) - lengths)[text_of] + nth * segment
    span = np.minimum(segment, lengths[text_of] - nth * segment)
    order = np.argsort(-span, kind="stable")
    start_, span_ = start[order], span[order]
    active = np.searchsorted(-span_, -np.arange(1, span_[0] + 1), side="right")
    products = np.repeat(np.eye(size)[None], len(order), axis=0)
    for t in range(span_[0]):
        k = active[t]
        products[:k] = normalise((products[:k].reshape(-1, size) @ moves).reshape(k, size, size) * emissions[start_[:k] + t][:, None, :])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    products = products[place]
    # what comes in from the left of each segment, and from the right
    left, right = np.empty((len(order), size)), np.empty((len(order), size))
    first = np.cumsum(per_text) - per_text
    by_count = np.argsort(-per_text, kind="stable")
    most = np.searchsorted(-per_text[by_count], -np.arange(1, per_text.max() + 1), side="right")
    message = np.full((len(lengths), size), 1.0 / size)
    for s in range(int(per_text.max())):
        at = first[by_count[: most[s]]] + s
        left[at] = message[by_count[: most[s]]]
        message[by_count[: most[s]]] = normalise(np.einsum("ni,nij->nj", left[at], products[at]))
    message[:] = 1.0 / size
    for s in range(int(per_text.max()) - 1, -1, -1):
        at = first[by_count[: most[s]]] + s
        right[at] = message[by_count[: most[s]]]
        message[by_count[: most[s]]] = normalise(np.einsum("nij,nj->ni", products[at], right[at]))
    alpha = np.empty_like(emissions)
    message = left[order]
    for t in range(span_[0]):
        k = active[t]
        message[:k] = normalise((message[:k] @ moves) * emissions[start_[:k] + t])
        alpha[start_[:k] + t] = message[:k]
    out = np.empty_like(emissions)
    message = right[order]
    for t in range(span_[0] - 1, -1, -1):
        k = active[t]
        at = start_[:k] + t
        out[at] = normalise(alpha[at] * message[:k])
        message[:k] = normalise((message[:k] * emissions[at]) @ moves.T)
    return out


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, str]
    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    #: Words seen (twice the number of their letters, and 1 with a letter), and emissions by number; kept by a worker, never shipped.
    seen: dict[str, int] = field(default_factory=dict)
    cores: dict[str, int] = field(default_factory=dict)
    kept: np.ndarray | None = None
    grams: Grams | None = None

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "cores": {}, "kept": None, "grams": None}

    def emissions_of(self, cores: list[str]) -> np.ndarray:
        """Potentials of words by their letters; 1 for one without."""
        if self.grams is None:
            self.grams = Grams(self.index, self.lexicon)
        parts = (self.grams.found(cores[i : i + BLOCK]) for i in range(0, len(cores), BLOCK))
        sums = np.concatenate([summed_flat(self.weights, flat, n) for flat, n in parts])
        return np.exp(sums - sums.max(axis=1, keepdims=True))

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of the words, and whether each has a letter."""
        if self.kept is None or len(self.seen) > CACHE:
            self.seen, self.cores, self.kept = {}, {}, np.empty((0, len(self.languages)))
        known, cores, before = self.seen, self.cores, len(self.cores)
        for w in dict.fromkeys(words):
            if w not in known:
                known[w] = 2 * cores.setdefault(core(w), len(cores)) + any(map(str.isalpha, w))
        if len(cores) > before:
            self.kept = np.concatenate([self.kept, self.emissions_of(list(islice(cores, before, None)))])
        numbers = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        return self.kept[numbers >> 1], numbers & 1

    def label(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """(word, language, probability) of the words of each text: its code switches. A very long word comes link by link."""
        words = [links(t) for t in texts]
        got = marginals(self.emissions([w for t in words for w in t])[0], np.array([len(t) for t in words], dtype=np.int64), self.moves)
        out, at = [], 0
        for t in words:
            out.append([(w.strip(CUT), self.languages[int(p.argmax())], float(p.max())) for w, p in zip(t, got[at : at + len(t)], strict=True)])
            at += len(t)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (its share of the marginals) and certainty (the mean of each word's best marginal) of each text."""
        names, scores, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        start = 0
        while start < len(texts) and self.languages:
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= AT_ONCE):
                size += len(texts[stop] or "")
                stop += 1
            self._predict(texts, range(start, stop), names, scores, sure)
            start = stop
        return names, scores, sure

    def _predict(self, texts: list[str | None], at_once: range, names: list[str], scores: list[float], sure: list[float]) -> None:
        words = [links(texts[i] or "") for i in at_once]
        flat = [w for t in words for w in t]
        lengths = np.array([len(t) for t in words], dtype=np.int64)
        if not flat:
            return
        potentials, letters = self.emissions(flat)
        got = marginals(potentials, lengths, self.moves) * letters[:, None]
        some = np.nonzero(lengths)[0]
        at = (np.cumsum(lengths) - lengths)[some]
        sums, count, best = np.add.reduceat(got, at, axis=0), np.add.reduceat(letters, at), np.add.reduceat(got.max(axis=1), at)
        for i, s, c, b in zip(some.tolist(), sums, count.tolist(), best.tolist(), strict=True):
            if c:
                k = int(s.argmax())
                names[at_once[i]], scores[at_once[i]], sure[at_once[i]] = self.languages[k], min(1.0, float(s[k] / c)), min(1.0, b / c)


def splice(runs_by_language: list[list[str]], rng: np.random.Generator, length: int = SEQUENCE) -> tuple[list[str], np.ndarray]:
    """Sequences of `length` words, cut from the languages' words and switching between them at random."""
    at = [0] * len(runs_by_language)
    words: list[str] = []
    labels: list[int] = []
    left = [i for i, r in enumerate(runs_by_language) if r]
    while left:
        i = left[int(rng.integers(len(left)))]
        n = RUN + int(rng.geometric(1 / (3 * RUN)))
        part = runs_by_language[i][at[i] : at[i] + n]
        words += part
        labels += [i] * len(part)
        at[i] += n
        if at[i] >= len(runs_by_language[i]):
            left.remove(i)
    whole = len(words) // length * length
    return words[:whole], np.array(labels[:whole]).reshape(-1, length)


def fit(texts_by_language: dict[str, list[str]], rounds: int = 40, rate: float = 0.15, most_words: int = 60_000, ridge: float = 1e-6) -> Model:
    """A model from texts of each language, by full-batch gradient ascent (Adam) on the conditional likelihood.

    most_words bounds the words of a language that transitions and emissions are learned from.
    """
    languages = sorted(texts_by_language)
    size = len(languages)
    rng = np.random.default_rng(7)
    counts = Counter()
    runs: list[list[str]] = []
    for i, lang in enumerate(languages):
        texts = texts_by_language[lang]
        for t in texts[::2]:
            counts.update((i, c) for c in map(core, links(t)) if c)
        runs.append([c for t in texts[1::2] or texts for c in map(core, links(t)) if c][:most_words])
    # an entry says which language a word is typical of, and how surely
    by_word: dict[str, np.ndarray] = {}
    for (i, c), n in counts.items():
        by_word.setdefault(c, np.zeros(size))[i] += n
    lexicon = {}
    for c, n in by_word.items():
        if n.sum() >= 3:
            share = (n + 0.1) / (n + 0.1).sum()
            lexicon[c] = f"={languages[int(share.argmax())]}:{int(4 * share.max())}:{min(4, int(np.log2(n.sum())) // 2)}"
    words, labels = splice(runs, rng)
    if not len(labels):
        return Model(languages, lexicon, {}, np.zeros((0, size)), np.full((size, size), 1.0 / max(1, size)))
    distinct, where = np.unique(np.array(words, dtype=object), return_inverse=True)
    named = [features(w, lexicon) for w in distinct]
    often = Counter(f for fs in named for f in fs)
    index = {f: n for n, f in enumerate(sorted(f for f, k in often.items() if k >= 2))}
    found = [[index[f] for f in fs if f in index] for fs in named]
    per_word = np.array([len(f) for f in found])
    flat = np.fromiter((i for f in found for i in f), dtype=np.int64, count=int(per_word.sum()))
    where = where.reshape(labels.shape)
    theta = np.zeros((len(index) + size, size))
    theta[len(index) :] = 2 * np.eye(size)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    truth = np.zeros((len(distinct), size))
    np.add.at(truth, (where.ravel(), labels.ravel()), 1.0)
    steps = np.zeros((size, size))
    np.add.at(steps, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1.0)
    for turn in range(1, rounds + 1):
        potential = summed_flat(theta[: len(index)], flat, per_word)
        potential = np.exp(potential - potential.max(axis=1, keepdims=True))
        moves = np.exp(theta[len(index) :] - theta[len(index) :].max())
        e = potential[where]
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[:, 0] = normalise(e[:, 0])
        beta[:, -1] = 1.0
        for t in range(1, e.shape[1]):
            alpha[:, t] = normalise((alpha[:, t - 1] @ moves) * e[:, t])
        for t in range(e.shape[1] - 2, -1, -1):
            beta[:, t] = normalise((beta[:, t + 1] * e[:, t + 1]) @ moves.T)
        posterior = alpha * beta
        posterior /= posterior.sum(axis=2, keepdims=True)
        ahead = beta[:, 1:] * e[:, 1:]
        scale = 1 / np.einsum("nti,ij,ntj->nt", alpha[:, :-1], moves, ahead)
        expected_steps = np.einsum("nti,nt,ntj->ij", alpha[:, :-1], scale, ahead) * moves
        expected = np.stack([np.bincount(where.ravel(), posterior[:, :, k].ravel(), minlength=len(distinct)) for k in range(size)], axis=1)
        by_feature = np.repeat(truth - expected, per_word, axis=0)
        gradient = np.concatenate([np.stack([np.bincount(flat, by_feature[:, k], minlength=len(index)) for k in range(size)], axis=1), steps - expected_steps])
        gradient = gradient / labels.size - ridge * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta += rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-9)
    return Model(languages, lexicon, index, theta[: len(index)], np.exp(theta[len(index) :] - theta[len(index) :].max()))


def summed_flat(weights: np.ndarray, flat: np.ndarray, per_word: np.ndarray) -> np.ndarray:
    """Sums of the rows of `weights` that `flat` lists for each word."""
    out = np.zeros((len(per_word), weights.shape[1]))
    if len(flat):
        out[per_word > 0] = np.add.reduceat(weights[flat], (np.cumsum(per_word) - per_word)[per_word > 0], axis=0)
    return out


def learn(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, characters: int = CHARACTERS) -> Model:
    """A model from the rows that `may_learn` admits and whose lang is not null: a sample of the languages with the most rows.

    Of a language's sample, texts count until they have `characters` together; the first counts whatever its length.
    """
    rows = docs.where(may_learn).where("lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    if not sizes:
        return Model([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(per_language / n))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000) * share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")  # a few hundred rows each
    some = drawn.limit(2 * per_language * len(sizes)).withColumns({"_nth": F.row_number().over(order), "_so_far": F.sum(F.coalesce(F.length("text"), F.lit(0))).over(order)})
    got = sorted(some.where((F.col("_nth") == 1) | (F.col("_so_far") <= characters)).collect(), key=lambda r: (r["lang"], r["doc_id"]))
    texts: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in got:
        texts[r["lang"]].append(r["text"] or "")
    return fit({lang: t for lang, t in texts.items() if any(LETTER.search(x) for x in t)})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            ids, texts = shared.columns(batch, "doc_id", "text")
            names, scores, _ = shipped.value.predict(texts)
            yield shared.batch_of(doc_id=pa.array(ids, pa.int64()), lang_pred=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()))

    return shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose words have a language each with at least that certainty on average; all columns are kept.

    A text in several languages is as certain as its words are; one without letters has none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def certainty(texts):
        import pandas as pd

        return pd.Series(shipped.value.predict([t if isinstance(t, str) else None for t in texts])[2])

    return docs.where(certainty("text") >= least)
