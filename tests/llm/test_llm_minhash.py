import random

import numpy as np
import pytest

from helpers import EDGES, brute_components, edges, frame
from costmart.llm import minhash


def corpus(seed, groups=25, hot=60):
    """Texts with near copies; one group is large and spread around the threshold."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    rows, n = [], 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 120]))]
        for _ in range(hot if g == 0 else rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            rows.append((n, text.upper() if rng.random() < 0.2 else text, "en", "s", len(text)))
            n += 1
    return rows


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_against_brute_force(spark, width, percent):
    rows = corpus(width)
    got = result(minhash.components(frame(spark, rows), width, percent))
    assert got == brute_components([r[:2] for r in rows], width, percent)


def test_round_two_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 7)
    rows = corpus(11, groups=3, hot=90)
    got = result(minhash.components(frame(spark, rows), 3, 85))
    assert got == brute_components([r[:2] for r in rows], 3, 85)


def test_real_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 85)
    assert result(minhash.components(docs, 3, 85)) == want


def test_edges_and_empty(spark):
    rows = minhash.components(edges(spark), 3, 85).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == len(EDGES)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[5] == (1, 5) and got[6] == (1, 5) and got[9] == (1, 9)
    assert got[7][1] == 7 and got[8][1] == 8          # only A-Z are lower-cased
    assert minhash.components(frame(spark, [])).collect() == []
    docs = edges(spark)
    assert minhash.drop_near_duplicates(docs, 3, 85).schema == docs.schema


def test_signature_estimates_similarity_and_permutes():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
    assert abs(same - exact) < 0.08
    some = np.arange(200_000, dtype=np.uint32)
    assert len(np.unique(minhash.second_permutation(some.copy()))) == len(some)
    wide = np.arange(200_000, dtype=np.uint64)
    assert len(np.unique(minhash.first_permutation(wide))) == len(wide)


def test_connect_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501)], "a long, b long")
    got = {r["id"]: r["comp"] for r in minhash.connect(links).collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and got[501] == 500
