"""Language identification in two levels.

A first set of linear support vector machines tells language families apart,
a second set the languages within a family; both levels vote one against one.
Features are hashed byte trigrams of the lower-cased text with square-root
counts at unit length, so a text of any length is one vector.

The fit uses a bounded sample (``per_language`` training rows of each language,
in hash order, ``max_rows`` in all, of ``max_languages`` languages at most);
every text is scored whole.

Defined cases: a null text or one without letters is ``und`` with score 0;
without training rows every text is; with one language that language is
predicted with score 1; a language outside the family table is a family of
its own; ties go to the first language by name; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costmart.llm.common import first_by_hash, held_out, pairs, pieces

#: Families by ISO 639-1 code (fixed values).
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk".split(),
    "baltic": "lt lv".split(),
    "uralic": "et fi hu".split(),
    "celtic": "br cy ga gd".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "semitic": "ar he mt".split(),
    "indo-iranian": "bn fa gu hi mr ne pa ps ur".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = re.compile(r"[^\W\d_]")
#: Bins of the trigram hash (a power of two).
BINS = 4096
#: Training rows and languages of a fit in all.
MAX_ROWS, MAX_LANGUAGES = 10_000, 100
#: Trigrams that are counted in one step, so a very long text needs little memory.
STEP = 1 << 18


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter (a digit-like sign such as a superscript is none)."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def vector(text: str) -> np.ndarray:
    """Square-root counts of the text's hashed byte trigrams, at unit length."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BINS)
    for at in range(0, max(1, len(data) - 2), STEP):
        b = data[at:at + STEP + 2].astype(np.uint32)
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
        counts += np.bincount(code >> np.uint32(20), minlength=BINS)
    root = np.sqrt(counts)
    return (root / max(1e-12, np.sqrt(counts.sum()))).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Linear support vector machine (squared hinge, y of +-1); the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = y.astype(x.dtype)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()),
                     0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    weight = look = np.zeros(x.shape[1], x.dtype)
    step, speed = 1 / (2 * float(np.einsum("ij,ij,i->", x, x, share)) + penalty), 1.0
    for _ in range(rounds):  # Nesterov's accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - np.float32(step) * (np.float32(penalty) * look - 2 * (share * y * slack) @ x)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        look = new + np.float32((speed - 1) / faster) * (new - weight)
        weight, speed = new, faster
    return weight


class OneVersusOne:
    """A support vector machine for each pair of classes, and their vote."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        given = np.array(labels)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows = []
        for i, j in self.pairs:
            a, b = given == self.classes[i], given == self.classes[j]
            rows.append(fit_svm(x[a | b], np.where(a[a | b], 1.0, -1.0)))
        self.weights = np.array(rows).reshape(-1, x.shape[1] + 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Each class's share of the votes (rows sum to 1), by the logistic of the margins."""
        out = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            return out + 1
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-np.clip(4 * margins[:, k], -50, 50)))
            out[:, i] += p
            out[:, j] += 1 - p
        return out / len(self.pairs)


@dataclass
class LanguageModel:
    """The family level and, for each family, its languages."""

    families: OneVersusOne
    languages: dict[str, OneVersusOne]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        real = [i for i, t in enumerate(texts) if has_letter(t)]
        if not real:
            return out
        x = np.array([vector(texts[i]) for i in real])
        family_scores = self.families.scores(x)
        best = family_scores.argmax(axis=1)
        for f in np.unique(best).tolist():
            rows = np.flatnonzero(best == f)
            level = self.languages[self.families.classes[f]]
            scores = level.scores(x[rows])
            tops = scores.argmax(axis=1)
            shares = family_scores[rows, f] * scores[np.arange(len(rows)), tops]
            for r, k, share in zip(rows.tolist(), tops.tolist(), shares.tolist()):
                out[real[r]] = (level.classes[k], min(1.0, max(0.0, share)))
        return out


def fit_sample(texts: list[str], langs: list[str],
               family_of: dict[str, str] = FAMILY_OF) -> LanguageModel | None:
    """The model of labelled texts; None without any text that has a letter."""
    rows = [(vector(t), lang) for t, lang in zip(texts, langs) if has_letter(t)]
    return fit_vectors([x for x, _ in rows], [lang for _, lang in rows], family_of)


def fit_vectors(vectors: list[np.ndarray], langs: list[str],
                family_of: dict[str, str] = FAMILY_OF) -> LanguageModel | None:
    """The model of the vectors of labelled texts; None without any."""
    if not vectors:
        return None
    x = np.array(vectors)
    families = [family_of.get(lang, lang) for lang in langs]
    levels = {}
    for f in sorted(set(families)):
        own = [i for i, g in enumerate(families) if g == f]
        levels[f] = OneVersusOne(x[own], [langs[i] for i in own])
    return LanguageModel(OneVersusOne(x, families), levels)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lang, h and the vector of each text that has a letter."""
    for b in pieces(batches, "text"):
        texts = b.column("text").to_pylist()
        kept = b.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
        made = [vector(t).tobytes() for t in kept.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [kept.column("doc_id"), kept.column("lang"), kept.column("h"),
             pa.array(made, pa.binary())], ["doc_id", "lang", "h", "vector"])


def fit(docs: DataFrame, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", family_of: dict[str, str] = FAMILY_OF,
        max_rows: int = MAX_ROWS, max_languages: int = MAX_LANGUAGES) -> LanguageModel | None:
    """Fit on at most ``per_language`` training rows (not held out) of each language.

    With many languages each gives fewer, ``max_rows`` in all; of more than
    ``max_languages`` the most frequent ones are learned (ties by name). The
    sampled texts become vectors where they lie, so the driver holds
    ``max_rows`` vectors of ``BINS`` numbers however long the texts are.
    """
    rows = docs.select(*pairs(id_col, text_col), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = rows.select("doc_id", "lang", F.xxhash64("text").alias("h"))
    learned = (usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), "lang").limit(max_languages).collect())
    if not learned:
        return None
    quota = min(per_language, max(1, max_rows // len(learned)))
    counts = docs.sparkSession.createDataFrame([tuple(r) for r in learned], "lang string, n long")
    few = first_by_hash(usable.join(F.broadcast(counts), "lang"), F.col("doc_id"), quota, F.col("n"))
    first = Window.partitionBy("lang").orderBy("hash", "doc_id", "h")
    chosen = (few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= quota)
              .select("doc_id", "lang", "h").distinct())
    # At most quota * max_languages narrow rows; a null id is its own key.
    found = rows.withColumn("h", F.xxhash64("text")).alias("r").join(
        F.broadcast(chosen.alias("c")),
        F.expr("r.doc_id <=> c.doc_id AND r.lang = c.lang AND r.h = c.h"), "left_semi")
    made = found.mapInArrow(_vectors, "doc_id long, lang string, h long, vector binary")
    sample = sorted({(r["doc_id"] or 0, r["lang"], r["h"], bytes(r["vector"]))
                     for r in made.dropDuplicates(["doc_id", "lang", "h"]).collect()})
    return fit_vectors([np.frombuffer(v, np.float32) for *_, v in sample],
                       [lang for _, lang, _, _ in sample], family_of)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = b.column("text").to_pylist()
            out = model.predict(texts) if model else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([p for p, _ in out], pa.string()),
                 pa.array([s for _, s in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return (docs.select(*pairs(id_col, text_col))
            .mapInArrow(run, "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
