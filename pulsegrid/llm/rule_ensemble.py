"""Sparse rule ensemble: conjunctive rules from boosted trees, weighted by lasso logistic regression.

Statistics of a text (lengths, shares of character classes, repetition) feed small boosted trees. The
path to each node is a rule, a conjunction of thresholds. L1-penalised logistic regression (FISTA)
over the rules keeps few; the penalty is the one with the least loss on a fifth of the sample. The kept
rules are compiled into one Spark column expression over the statistics.

The ensemble is fitted on a bounded sample of labelled rows (`sample`, by a hash of the id). With
labels of one kind only, or none, every text scores the share of 1s (0.5 with none).

Null texts are empty, and are scored. Repeated rows are scored each; rows with a null label are not
learned from, nor are those with a null doc_id. No documents give no rows. Texts are read whole, however long.
Equal texts score alike, and thresholds take ties to one side. Columns other than doc_id, text and quality are not
read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 32, 0.2, 20
STATISTICS = ("chars", "words", "mean_word", "distinct_share", "stutter_share", "upper_share", "digit_share", "symbol_share", "mark_share", "bar_share", "line_words", "duplicate_lines", "longest_word", "top_word_share", "non_ascii_share")
UPPER, DIGITS, SYMBOLS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~{}[]\\", b"!?;:"


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of a whole text, in the order of STATISTICS."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda chars: (size - len(data.translate(None, chars))) / max(1, size)
    tally = Counter(words)
    most = max(tally.values(), default=0) / max(1, n)
    return (
        float(len(text or "")), float(n), (size - n + 1) / max(1, n), len(tally) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n), share(UPPER), share(DIGITS), share(SYMBOLS), share(MARKS), share(b"|"),
        n / max(1, len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0.0, float(max(map(len, tally), default=0)), float(most), (size - len(text or "")) / max(1, size),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""

    def run(batches: shared.Batches) -> shared.Batches:
        for batch in batches:
            ids, texts = shared.columns(batch, "doc_id", "text")
            values = np.array([statistics(t) for t in texts]).reshape(len(ids), len(STATISTICS))
            yield shared.batch_of(doc_id=pa.array(ids, pa.int64()), **{k: pa.array(values[:, i]) for i, k in enumerate(STATISTICS)})

    return shared.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS))


#: A rule: (statistic, above?, threshold) for each of its conditions, in order.
Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, ((x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in rule))


def paths(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The rules of the nodes of gradient-boosted trees (logistic loss, histogram splits)."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)

        def grow(at: np.ndarray, rule: Rule, g=g, h=h) -> None:
            best = None
            if len(rule) < depth and len(at) >= 2 * LEAST:
                total_g, total_h = g[at].sum(), h[at].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[at, f]
                    sums = [np.cumsum(np.bincount(b, v, minlength=len(c) + 1))[:-1] for v in (g[at], h[at], np.ones(len(at)))]
                    gain = sums[0] ** 2 / (sums[1] + 1) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + 1) - total_g**2 / (total_h + 1)
                    gain[(sums[2] < LEAST) | (len(at) - sums[2] < LEAST)] = -1
                    i = int(gain.argmax())
                    if gain[i] > 1e-3 and (best is None or gain[i] > best[0]):
                        best = float(gain[i]), f, i
            if best is None:
                margin[at] += RATE * g[at].sum() / (h[at].sum() + 1)
                return
            _, f, i = best
            for above, part in ((False, at[binned[at, f] <= i]), (True, at[binned[at, f] > i])):
                longer = (*rule, (f, above, float(cuts[f][i])))
                rules[tuple(sorted(longer))] = None
                grow(part, longer)

        grow(np.arange(len(y)), ())
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float] | None = None, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of L1-penalised logistic regression, by FISTA."""
    n, k = z.shape
    w, b = start or (np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    step = 4 / (float(np.linalg.norm(z.T @ z / n, 2)) + 1)
    at, at_b, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(z @ at + at_b))) - y
        new = at - step * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = at_b - step * float(error.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            conditions = [F.col(STATISTICS[f]) > t if above else F.col(STATISTICS[f]) <= t for f, above, t in rule]
            total = total + F.when(reduce(lambda a, b: a & b, conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x))))))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Ensemble([], [], float(np.log(share / (1 - share))))
    checked = np.arange(len(y)) % 5 == 4
    rules = paths(x[~checked], y[~checked])
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), dtype=np.float32)
    best, start = None, None
    for penalty in (0.02, 0.01, 0.005, 0.002, 0.001):
        start = lasso(z[~checked], y[~checked], penalty, start)
        p = np.clip(1 / (1 + np.exp(-(z[checked] @ start[0] + start[1]))), 1e-6, 1 - 1e-6)
        loss = -float((y[checked] * np.log(p) + (1 - y[checked]) * np.log(1 - p)).mean()) if checked.any() else 0.0
        if best is None or loss < best[0] - 1e-4:
            best = loss, start
    w, b = best[1]
    kept = [i for i in np.argsort(-np.abs(w)).tolist() if abs(w[i]) > 1e-4]
    return Ensemble([rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Ensemble:
    """An ensemble from labelled rows (labels: doc_id, quality) whose doc_id `may_learn` admits."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(may_learn).where("quality is not null")
    n = named.count()
    drawn = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000.0 * sample / max(n, 1))).limit(2 * sample)
    # at most 2 * sample rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi")
    got = with_statistics(rows).join(drawn, "doc_id").toArrow().to_pandas()
    got = got.sort_values(["doc_id", *STATISTICS, "quality"]).head(2 * sample)
    order = np.random.default_rng(5).permutation(len(got))
    return fit(got[list(STATISTICS)].to_numpy(dtype=np.float64)[order], got["quality"].to_numpy(dtype=np.float64)[order])


def score(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id, score of every document."""
    return with_statistics(docs).select("doc_id", ensemble.column().alias("score"))
