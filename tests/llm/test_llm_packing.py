import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import EDGES, edges, frame
from costmart.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fill(plan, counts, capacity):
    """Every piece once, no sequence over capacity, no gaps; returns the sequence count."""
    seen, places = Counter(), defaultdict(list)
    for length, rank, count, sequence, offset in plan.tolist():
        for k in range(count):
            seen[length, rank + k] += 1
            places[sequence + k].append((offset, length))
    assert seen == Counter((n, r) for n, c in counts.items() for r in range(c))
    for slots in places.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30),
       st.integers(1, 12), st.integers(0, 64))
def test_plan_is_valid(counts, groups, small):
    sequences = fill(packing.make_plan(counts, 64, groups, small), counts, 64)
    assert sequences <= sum(counts.values())


def test_plan_is_nearly_full():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.3, 0.9, 20_000).astype(int), 1, 2048)
    counts = dict(Counter(lengths.tolist()))
    sequences = fill(packing.make_plan(counts, 2048), counts, 2048)
    assert sequences <= 1.005 * max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))


def test_ids_of_odd_texts():
    library = Tokenizer.from_file(PATH)
    words = packing.WordIds(PATH)
    odd = ["", "a\x1cb c", "İstanbul ΣΑΣ ß", "<|endoftext|> x <|startoftext|>y", "é café",
           "日本語 テスト 12³", "x y 　z", "it's WE'LL", "\x85a\x85", "\x00\x01 a", "²½ 1²3",
           "a" * 3000, "１２ Ⅷ 五", "ẞ ǅ ŉ", "ﬁ ＡＢ", "a​b", " x"]
    for text in odd:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == \
            library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB 's1\n.É")), max_size=40))
def test_ids_of_any_text(text):
    assert np.frombuffer(_WORDS.ids(text), "<u4").tolist() == \
        _LIBRARY.encode(text, add_special_tokens=False).ids


_WORDS, _LIBRARY = packing.WordIds(PATH), Tokenizer.from_file(PATH)


def check(rows, docs, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text in docs:
        ids = np.array(_LIBRARY.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at:at + capacity]
            want[i].append((p, at, len(cut), zlib.crc32(cut.tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given_ = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for capacity in (2048, 100):
        check(packing.pack(docs, PATH, capacity).collect(), given_, capacity)


def test_edges_buckets_and_empty(spark):
    docs = edges(spark)
    found = packing.keep_table(packing.tokenise(docs, PATH, 64, outputs=True), "t")
    rows = packing.place(found, 64, bucket_rows=5).collect()
    check(rows, [r[:2] for r in EDGES], 64)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(frame(spark, []), PATH).collect() == []
