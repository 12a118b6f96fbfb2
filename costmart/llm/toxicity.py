"""Toxicity by weak supervision.

Voters are small rules that fire or stay silent on a text: entries of a public
list of insults, word stems that a labelled sample finds far more often in
toxic texts, and surface patterns.  A generative label model with a hidden
class estimates how often each voter that fires is right (its accuracy) and
how strongly voters fire together beyond the class (their correlation); voters
that repeat each other share one vote.  Its posterior labels, not the given ones,
train a linear classifier on words and word stems, which scores every text.

The fit uses a bounded sample (``per_class`` labelled training rows of each
label, in hash order); everything else sees all rows and whole texts.  Given
labels only choose the learned stems.

Defined cases: a null or empty text gets the classifier's score without
evidence (low); without a toxic training row the public list alone votes; with
no labels at all every score rests on the public list; repeated texts get
equal scores and count once in the sample; several labels of one id count as
toxic if any is; an empty table gives an empty result; ``score`` ignores other
columns and ``keep_civil`` carries all of them through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costmart.llm.common import first_by_hash, held_out, pairs, pieces

#: Insults in wide use in English, German, French and Spanish (fixed values).
INSULTS = """arschloch bastard blödmann cabrón clown connard crétin débile disgusting dumm dumb
estúpido filthy freak garbage gilipollas hurensohn idiot idiota idiote imbécil imbécile
imbecile loser miststück moron pathetic pendejo salaud scum shithead stupid stupide trash
trottel ugly vermin widerlich worthless""".split()
#: Surface patterns that may vote.
PATTERNS = {
    "marks in a row": re.compile(r"[!?]{3,}"),
    "shouted run": re.compile(r"(?:\b[A-Z]{3,}\b\W+){3,}"),
    "insulting address": re.compile(r"\b(?:you are|you're|du bist|tu es|eres) (?:an? |ein |une? )?"
                                    rf"(?:{'|'.join(INSULTS)})", re.I),
    "masked word": re.compile(r"\b\w+[*#@$]{2,}\w+\b"),
}
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word stems that may vote and be features.
STEMS = range(3, 7)
CACHE_WORDS = 200_000


def word_features(word: str) -> list[str]:
    """The stems of a lower-cased word, and the word itself (with an end mark)."""
    return [word[:k] for k in STEMS if k <= len(word)] + [f"{word}$"]


class FeatureIds:
    """Numbers the features of a sample, so that a text is a short array of them."""

    def __init__(self):
        self.names: list[str] = []
        self._ids: dict[str, int] = {}
        self._words: dict[str, list[int]] = {}

    def _number(self, feature: str) -> int:
        if feature not in self._ids:
            self._ids[feature] = len(self.names)
            self.names.append(feature)
        return self._ids[feature]

    def of(self, features: list[str]) -> np.ndarray:
        return np.array([self._number(f) for f in features], np.int32)

    def text(self, text: str) -> np.ndarray:
        """Sorted distinct features of a text."""
        found: list[int] = []
        for w in set(_WORD.findall(text.lower())):
            if w not in self._words:
                if len(self._words) > CACHE_WORDS:
                    self._words.clear()
                self._words[w] = [self._number(f) for f in word_features(w)]
            found += self._words[w]
        return np.unique(np.array(found, np.int32))


def frequencies(texts: list[np.ndarray], size: int) -> np.ndarray:
    """In how many texts each feature is."""
    total = np.zeros(size)
    for t in texts:
        total[t] += 1
    return total


# ---- voters and the label model -----------------------------------------

def learned_stems(texts: list[np.ndarray], labels: list[int], names: list[str],
                  odds: float = 100.0, least: int = 4, depth: int = 3,
                  most: int = 400) -> list[str]:
    """Words and stems at least ``odds`` times as frequent in toxic texts, by greedy cover.

    The next one is that which fires in most toxic texts with fewer than
    ``depth`` voters so far; the end is where it adds fewer than ``least``.
    A sample with under 25 * ``odds`` clean texts cannot show such odds; it
    asks for a 25th of its clean texts instead, but at least 20.
    """
    bad = [t for t, y in zip(texts, labels) if y]
    n1, n0 = len(bad), len(texts) - len(bad)
    if not n1 or not n0:
        return []
    toxic = frequencies(bad, len(names))
    clean = frequencies([t for t, y in zip(texts, labels) if not y], len(names))
    good = (toxic >= least) & ((toxic / n1) / ((clean + 0.5) / n0) >= min(odds, max(20, n0 / 25)))
    open_ = [t[good[t]] for t in bad]
    where: dict[int, list[int]] = {}
    for i, fs in enumerate(open_):
        for f in fs.tolist():
            where.setdefault(f, []).append(i)
    gain, covered, chosen = {f: len(w) for f, w in where.items()}, [0] * n1, []
    while gain and len(chosen) < most:
        best = max(gain.values())
        if best < least:
            break
        # Of those that fire about as often, the one with fewest clean texts, then the longest.
        f = min((f for f, g in gain.items() if g >= 0.97 * best),
                key=lambda f: (clean[f], -len(names[f]), names[f]))
        chosen.append(names[f])
        del gain[f]
        for i in where[f]:
            covered[i] += 1
            if covered[i] == depth:
                for g in open_[i].tolist():
                    if g in gain:
                        gain[g] -= 1
    return chosen


def vote(text: str, features: np.ndarray, voters: np.ndarray) -> list[int]:
    """1 where a voter fires: the words and stems, the patterns, and silence of the words."""
    fired = np.isin(voters, features).astype(int).tolist()
    return [*fired, *(int(bool(p.search(text))) for p in PATTERNS.values()), int(not any(fired))]


@dataclass
class LabelModel:
    """Prior of the toxic class, voters' accuracies, correlations and shares of a vote.

    A silent voter abstains; a voter that fires is right with its accuracy.
    The last voter fires where no word or stem does and votes for clean.
    """

    prior: float
    accuracies: np.ndarray     # P(toxic | the voter alone fires), at an even prior
    correlations: np.ndarray   # voters x voters, given the class
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.accuracies / (1 - self.accuracies)) * self.weights
        gap = votes @ odds + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -50, 50)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50,
                    passes: int = 3) -> LabelModel:
    """Expectation maximisation of the accuracies, from a first guess ``start`` of each.

    After each pass the correlations of the voters given the class are taken
    from the residuals; a voter's weight is one over its sum of squared
    correlations, so a voter that n others repeat counts 1/(n + 1).  The last
    voter, silence, is the anchor: it keeps its accuracy and its whole vote.
    """
    n, m = votes.shape
    fired = votes.sum(axis=0)
    model = LabelModel(prior, start.copy(), np.eye(m), np.ones(m))
    for _ in range(passes):
        post = model.posterior(votes)
        for _ in range(rounds):
            # Two imagined firings at the first guess keep rare voters near it.
            share = (votes.T @ post + 2 * start) / (fired + 2)
            model.accuracies = np.append(np.clip(share, 0.02, 0.98)[:-1], start[-1])
            new = model.posterior(votes)
            done = np.abs(new - post).max(initial=0) < 1e-4
            post = new
            if done:
                break
        mass = np.array([1 - post, post])
        rates = (mass @ votes + 0.01) / (mass.sum(axis=1, keepdims=True) + 1)
        residual = votes - mass.T @ rates
        cov = residual.T @ residual / max(1, n)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        cor = np.clip(cov / np.outer(sd, sd), -1, 1)
        np.fill_diagonal(cor, 1)
        model.correlations = cor
        model.weights = 1 / (np.where(cor > 0.2, cor, 0) ** 2).sum(axis=0)
        model.weights[-1] = 1
    return model


# ---- the classifier ------------------------------------------------------

def fit_linear(rows: list[list[int]], size: int, target: np.ndarray, penalty: float = 1e-4,
               rounds: int = 200, rate: float = 1.5) -> np.ndarray:
    """Logistic regression on sets of features with soft labels; the last weight is the bias."""
    lengths = np.array([len(r) for r in rows])
    columns = np.array([c for r in rows for c in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    weight, speed = np.zeros(size + 1), np.full(size + 1, 1e-8)
    # Both classes weigh the same, so that rare toxic texts are not drowned.
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3) if len(target) else 0.5
    emphasis = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    for _ in range(rounds):
        raw = np.bincount(owner, weight[columns], minlength=len(rows)) + weight[size]
        error = (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - target) * emphasis / len(rows)
        step = np.append(np.bincount(columns, error[owner], minlength=size), error.sum())
        step[:size] += penalty * weight[:size]
        speed += step ** 2
        weight -= rate * step / np.sqrt(speed)
    return weight


@dataclass
class ToxicityModel:
    """Weights of words (with an end mark) and stems, and the bias."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        """text -> score, with the weighted features of recent words remembered."""
        known: dict[str, tuple] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            words = set(_WORD.findall((text or "").lower()))
            if len(known) > CACHE_WORDS:
                known.clear()
            found: set[str] = set()
            for w in words:
                hits = known.get(w)
                if hits is None:
                    hits = known[w] = tuple(f for f in word_features(w) if f in weights)
                if hits:
                    found.update(hits)
            raw = bias + math.fsum(weights[f] for f in found)
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, raw))))
        return score


def fit_sample(texts: list[str], labels: list[int], size: int = 400,
               prior: float = 0.5) -> ToxicityModel:
    """The model of a labelled sample; equal texts count once (toxic if any copy is)."""
    once: dict[str, int] = {}
    for t, y in zip(texts, labels):
        once[t] = max(once.get(t, 0), y)
    listed = [f"{w}$" for w in INSULTS]
    if not once:
        return ToxicityModel(dict.fromkeys(listed, 4.0), -4.0)
    texts, labels = list(once), list(once.values())
    ids = FeatureIds()
    features = [ids.text(t) for t in texts]
    voters = list(dict.fromkeys([*listed, *learned_stems(features, labels, ids.names)]))
    numbers = ids.of(voters)
    votes = np.array([vote(t, f, numbers) for t, f in zip(texts, features)], float)
    start = np.array([0.95] * len(voters) + [0.5] * len(PATTERNS) + [0.02])
    post = fit_label_model(votes, start, prior).posterior(votes)
    # Features: those that differ most between the posterior classes, and all voters.
    high = post > 0.5
    mass = frequencies([f for f, h in zip(features, high) if h], len(ids.names))
    plain = frequencies([f for f, h in zip(features, high) if not h], len(ids.names))
    gain = np.abs(mass / max(1, high.sum()) - plain / max(1, (~high).sum()))
    gain[mass + plain < 5] = 0
    gain = {i: g for i, g in enumerate(gain.tolist()) if g}
    best = sorted(gain, key=lambda i: (-gain[i], ids.names[i]))[:min(size, len(texts) // 10)]
    chosen = list(dict.fromkeys([*numbers.tolist(), *best]))
    column = np.full(len(ids.names), -1)
    column[chosen] = np.arange(len(chosen))
    rows = [column[f][column[f] >= 0].tolist() for f in features]
    weight = fit_linear(rows, len(chosen), post)
    learned = {ids.names[i]: float(w) for i, w in zip(chosen, weight) if w}
    # A listed insult that the sample does not show keeps a vote.
    for w, i in zip(listed, numbers.tolist()):
        if not mass[i] and not plain[i]:
            learned[w] = 4.0
    return ToxicityModel(learned, float(weight[-1]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most ``per_class`` training rows (not held out) of each label."""
    marked = (labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                            F.col(f"`{label_col}`").cast("int").alias("y"))
              .where("doc_id IS NOT NULL AND y IS NOT NULL")
              .where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("y").alias("y")))
    marked = marked.withColumn("y", (F.col("y") > 0).cast("int"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    parts = [first_by_hash(marked.where(F.col("y") == y), F.col("doc_id"), per_class,
                           F.lit(counts.get(y, 0)))
             .orderBy("hash", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "y")
    rows = docs.select(*pairs(id_col, text_col)).join(F.broadcast(chosen), "doc_id")
    # Hash order again: the join's order is Spark's, the sums below should not be.
    found = sorted(((r["doc_id"], r["text"] or "", r["y"]) for r in rows.collect()))
    return fit_sample([t for _, t, _ in found], [y for _, _, y in found])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in pieces(batches, "text"):
            scores = [scorer(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "score", "predicted"])

    return (docs.select(*pairs(id_col, text_col))
            .mapInArrow(run, "doc_id long, score double, predicted int")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


def keep_civil(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3,
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in pieces(batches, at):
            yield b.filter(pa.array([scorer(t) < threshold for t in b.column(at).to_pylist()],
                                    pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
