import random
import zlib

import numpy as np

from helpers import EDGES, edges, frame
from costmart.llm import toxicity

CLEAN = "sun rain field river stone bread house garden table window letter music".split()


def sample(seed, n=600, stem="zorbl"):
    """Texts in which words on one unlisted stem, and listed insults, mark the toxic ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ly"]) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                word = rng.choice([stem + rng.choice("abcdefgh"), "idiot", "worthless"])
                words[rng.randrange(40)] = word
        rows.append((i, " ".join(words), "en", "s", 1, int(toxic)))
    return rows


def test_held_out_accuracy_and_unseen_forms(spark):
    rows = sample(1)
    docs = frame(spark, [r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    out = [(got[r[0]]["predicted"], r[5]) for r in rows if got[r[0]]["held_out"]]
    assert len(out) > 100
    assert all((r["doc_id"] % 1 == 0) and
               r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
               for r in got.values())
    assert np.mean([p == y for p, y in out]) > 0.95
    model = toxicity.fit(docs, labels)
    assert model.scorer()("house zorblxyz garden " * 3) > model.scorer()("house garden " * 3)


def test_held_out_labels_do_not_matter(spark):
    rows = sample(2, 300)
    docs = frame(spark, [r[:5] for r in rows])
    for flip in (0, 1):
        labels = spark.createDataFrame(
            [(r[0], r[5] ^ flip if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[5])
             for r in rows], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        if not flip:
            first = model
    assert model == first


def test_label_model_finds_accuracies_and_repeats():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    fire = lambda hit, false: rng.random(4000) < np.where(y, hit, false)
    good, same, noise = fire(0.6, 0.01), None, fire(0.2, 0.2)
    same = good.copy()
    other = fire(0.6, 0.02)
    votes = np.array([good, same, other, noise]).T.astype(float)
    votes = np.hstack([votes, (votes[:, :3].sum(axis=1, keepdims=True) == 0)])
    model = toxicity.fit_label_model(votes, np.array([0.9, 0.9, 0.9, 0.5, 0.05]), 0.5)
    assert model.correlations[0, 1] > 0.9 and model.weights[0] < 0.6 < model.weights[2]
    assert model.accuracies[2] > 0.8 > model.accuracies[3]


def test_edges_without_labels(spark):
    docs = edges(spark, (50, "you worthless idiot, what a moron", "en", "s", 1))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[50]["predicted"] == 1 and got[1]["predicted"] == 0
    assert got[1]["score"] == got[2]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.keep_civil(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(EDGES)
    assert toxicity.score(frame(spark, []), model).collect() == []


def test_nulls_and_repeats_in_labels(spark):
    docs = frame(spark, [r[:5] for r in sample(3, 80)])
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (4, 1), (5, 0)],
                                   "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 80
