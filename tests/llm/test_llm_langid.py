import random
import zlib

from helpers import EDGES, edges, frame
from costmart.llm import langid

WORDS = {
    "en": "the and of with that this from have which there would about people water".split(),
    "de": "und der die das nicht werden ist mit sich über können zwischen straße wasser".split(),
    "fr": "les des est dans pour que une avec être mais cette tout eau après".split(),
    "es": "los las está para que una con pero como más agua después también niño".split(),
}


def sample(seed, n=400):
    rng = random.Random(seed)
    langs = sorted(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 4]]) for _ in range(25)), langs[i % 4], "s", 1)
            for i in range(n)]


def test_held_out_accuracy(spark):
    docs = frame(spark, sample(1))
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    want = {r[0]: r[2] for r in sample(1)}
    out = [i for i in got if got[i]["held_out"]]
    assert out and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i]["lang_pred"] == want[i] for i in out) > 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_real_table_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs, per_language=100)).where("held_out")
    both = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in both) > 0.95 * len(both)


def test_levels():
    rows = sample(2, 200)
    model = langid.fit_sample([r[1] for r in rows], [r[2] for r in rows])
    assert model.families.classes == ["germanic", "romance"]
    assert model.languages["romance"].classes == ["es", "fr"]
    got = model.predict([None, "", "123 !", "x²", "²½ ⅷ", "und der die das nicht"])
    assert [g[0] == "und" for g in got] == [True, True, True, False, True, False]
    assert got[5][0] == "de"


def test_edges(spark):
    docs = edges(spark, *[(100 + i, *r[1:]) for i, r in enumerate(sample(3, 60))])
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und"
    assert got[1]["score"] == 0 and got[4]["lang_pred"] in WORDS
    empty = frame(spark, [])
    assert langid.identify(empty, langid.fit(empty)).collect() == []
    unlabelled = frame(spark, [(1, "words here", None, "s", 1)])
    assert langid.identify(unlabelled, langid.fit(unlabelled)).first()["lang_pred"] == "und"
    one = frame(spark, [(i, "nur ein Text", "de", "s", 1) for i in range(8)])
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(one, langid.fit(one)).collect()} \
        == {("de", 1.0)}
    assert len(EDGES) == 11


def test_sample_is_bounded_with_many_languages(spark, monkeypatch):
    docs = frame(spark, [*sample(4, 80), *((1000 + i, f"wort{i} rare text {i}", f"x{i:03}", "s", 1)
                                           for i in range(200))])
    sizes = []
    real = langid.fit_vectors
    monkeypatch.setattr(langid, "fit_vectors",
                        lambda x, langs, f: sizes.append(langs) or real(x, langs, f))
    model = langid.fit(docs, max_rows=60, max_languages=12)
    assert len(sizes[0]) <= 60 and len(set(sizes[0])) == 12
    assert set(WORDS) <= set(sizes[0])               # the most frequent ones are learned
    got = {r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got <= set(sizes[0])


def test_fit_equals_votes_recomputed_from_the_sample(spark):
    rows = [*sample(5, 60), *sample(5, 4), (None, "und der die das nicht", "de", "s", 1)]
    docs = frame(spark, rows)
    train = sorted({(i or 0, lang, t) for i, t, lang, *_ in rows
                    if i is None or zlib.crc32(str(i).encode()) % 4 != 2})
    model = langid.fit_sample([t for *_, t in train], [lang for _, lang, _ in train])
    texts = [r[1] for r in rows]
    for (lang, score), r in zip(model.predict(texts), langid.identify(docs, langid.fit(docs))
                                .select("lang_pred", "score", "doc_id").collect()):
        want = vote(model, r["doc_id"], rows)
        assert (lang, r["lang_pred"]) == (want[0], want[0])
        assert abs(score - want[1]) < 1e-5 and abs(r["score"] - want[1]) < 1e-3


def vote(model, doc_id, rows):
    """Family, then language, by plain sums over the pairs of machines."""
    import math
    x = [float(v) for v in langid.vector(next(r[1] for r in rows if r[0] == doc_id))]

    def tops(level):
        if len(level.classes) == 1:
            return level.classes[0], 1.0
        got = dict.fromkeys(level.classes, 0.0)
        for (i, j), w in zip(level.pairs, level.weights.tolist()):
            margin = sum(a * b for a, b in zip(x, w)) + w[-1]
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, 4 * margin))))
            got[level.classes[i]] += p
            got[level.classes[j]] += 1 - p
        top = max(sorted(got), key=got.get)
        return top, got[top] / len(level.pairs)

    family, a = tops(model.families)
    lang, b = tops(model.languages[family])
    return lang, a * b
