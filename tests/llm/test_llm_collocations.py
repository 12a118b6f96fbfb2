import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helpers import EDGES, LOWER, edges, frame
from costmart.llm import collocations

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, lang string, text string"


def brute(rows, least=30, longest=4, percent=80, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(zip(*(words[i:] for i in range(k))))
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inner = defaultdict(int)
        for p, a in phrases.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i:i + k]] = max(inner[p[i:i + k]], a)
        rows = []
        for p, a in phrases.items():
            if 100 * inner[p] >= percent * a:
                continue
            score, _, left, right = min(
                (2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), left, right))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n[lang], s)
                for i, (s, a, p, x, y) in enumerate(rows[:most])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n",
                                       "score").collect()))


@pytest.mark.parametrize("least, filter_bits, range_rows", [(30, 26, 1_000_000), (6, 8, 3000)])
def test_documents_against_brute_force(spark, least, filter_bits, range_rows):
    """The small filter lets nearly all through, the small ranges cut words' phrases apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = found(collocations.top(*collocations.score(
        docs.repartition(7), least, filter_bits=filter_bits, range_rows=range_rows), 300))
    want = brute(rows, least, most=300)
    assert got == want and len(got) >= 50


def test_edges_ties_and_odd_words(spark):
    texts = ["a b c. a b c, A B\tc\x0bb c", "x\x00y é ÀB é\xa0b", "one two three four five " * 3,
             "one two\nthree four", "a a a a a", ".,;:!?", " \t ", None, "", "q " * 50 + "end",
             "ſ K İ ſ K İ", "a b"]
    rows = [(i, (None, "en", "und", "")[i % 4], t) for i, t in enumerate(texts * 5)]
    rows += [(i, lang, t) for i, t, lang, *_ in EDGES if i != 4] + [(None, None, "a b a b a b")] * 4
    docs = frame(spark, rows, SCHEMA).repartition(4)
    for least, longest in ((1, 4), (5, 2), (2, 6)):
        got = found(collocations.top(*collocations.score(
            docs, least=least, longest=longest, range_rows=90), 500))
        assert got == brute([r[1:] for r in rows], least, longest, most=500)


def test_scores_do_not_overflow(spark):
    big = 9 * 10**14
    counts = frame(spark, [("en", ["a"], big + 7), ("en", ["b"], big + 2), ("en", ["a", "b"], big),
                           ("en", ["a", "b", "c"], big * 8 // 10 - 1), ("en", ["b", "c"], big),
                           ("en", ["c"], big)], "lang string, words array<string>, n long")
    rows = {tuple(r["words"]): r for r in collocations.stream(counts, 2).collect()}
    assert rows[("a", "b")]["parts"] == [big + 7]
    assert rows[("a",)]["extension"] == big
    assert rows[("a", "b")]["extension"] == big * 8 // 10 - 1


def test_blocks_end_at_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 10)
    for data in (b"", b"abc", b"a b.c d.e f g h i j k l m", b"no ends at all in here",
                 b"a.b.c.d.e.f.g.h.i.j", b"........................"):
        blocks = list(collocations._blocks(data))
        assert b"".join(blocks) == data
        assert all(b[-1:] in b".,;:!?\n\v\f\r" for b in blocks[:-1])


def test_empty_table_and_clashing_columns(spark):
    assert collocations.top(*collocations.score(edges(spark).limit(0))).count() == 0
    got = found(collocations.top(*collocations.score(edges(spark), least=2), 100))
    want = brute([(lang, t) for _, t, lang, *_ in EDGES], least=2, most=100)
    assert got == want


def all_pass():
    return collocations.Filter(np.full(4, ~np.uint64(0)), 8)


def test_rows_of_the_exact_count_do_not_grow_with_the_splits(spark):
    rows = [(i, "en", "the red fox, the red hen. a fox") for i in range(240)]
    made = {}
    for splits in (4, 12, 60):
        docs = frame(spark, rows, SCHEMA).repartition(splits).select("lang", "text")
        filters = [spark.sparkContext.broadcast(all_pass())]
        parts = collocations.partial_counts(docs, filters, 4, tasks=4)
        made[splits] = parts.count()
        sums = {r["phrase"]: r["n"] for r in parts.groupBy("phrase").sum("n")
                .withColumnRenamed("sum(n)", "n").collect()}
        assert sums["the red"] == 480 and sums["a fox"] == 240 and sums[""] == 8 * 240
    assert made[4] == made[12] == made[60] == 4 * 12
    cores = spark.sparkContext.defaultParallelism
    docs = frame(spark, rows, SCHEMA).repartition(2 * cores + 7).select("lang", "text")
    plain = collocations.partial_counts(docs, [spark.sparkContext.broadcast(all_pass())], 4)
    assert plain.count() == 2 * cores * 12


def test_a_full_table_goes_on_counting_common_phrases(monkeypatch):
    """The rarer half leaves a full table; sums stay exact, common phrases make one row."""
    monkeypatch.setattr(collocations, "PHRASES", 150)
    want, batches = Counter(), []
    for i in range(50):
        text = "on and on, on and on. " + "; ".join(f"w{i} v{i}x{j}" for j in range(10))
        for lang in ("en", "fr"):
            batches.append(pa.RecordBatch.from_pydict({"lang": [lang], "text": [text]}))
            want.update({(lang, ""): 26, (lang, "on"): 4, (lang, "and"): 2, (lang, "on and"): 2,
                         (lang, "and on"): 2, (lang, "on and on"): 2, (lang, f"w{i}"): 10})
            for j in range(10):
                want.update({(lang, f"v{i}x{j}"): 1, (lang, f"w{i} v{i}x{j}"): 1})
    got, rows, most = Counter(), Counter(), 0
    for b in collocations._exact(iter(batches), [all_pass()], 3):
        most = max(most, b.num_rows)
        for lang, phrase, n in zip(*(b.column(c).to_pylist() for c in ("lang", "phrase", "n"))):
            got[lang, phrase] += n
            rows[lang, phrase] += 1
    assert got == want and most < 200
    assert rows["en", "on and"] == rows["fr", "on and on"] == rows["en", ""] == 1
