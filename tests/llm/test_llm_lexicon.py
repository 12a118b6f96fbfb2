import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import EDGES, edges, frame
from costmart.llm import lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  \n ", "a\x1cb c", "İstanbul ΣΑΣ ß", "<|endoftext|> x <|startoftext|>y",
       "foo  <|endoftext|>  bar", "é café", "日本語 テスト 12³", "x y 　z",
       "it's we'll I'VE can't", "\x85a\x85 b", "\x00\x01 a", "²½ 1²3", "a" * 3000, " lead",
       "trail  \n\n ", "１２ Ⅷ 五", "a\n b\t\tc  d\r\n", "🙂🙂 ok", "_a__b_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merger():
    return lexicon.Merger(PATH)


def encoder(merger, words):
    return lexicon.Encoder(merger, lexicon.Automaton(
        lexicon.compile_words({w: merger.word(w) for w in words})))


def same(enc, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = enc.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert enc.decode(got) == library.decode(ids, skip_special_tokens=False) == text


def test_odd_texts(merger, library):
    for words in ([], [" the", "a", " café", "\n"]):
        enc = encoder(merger, words)
        for text in ODD:
            same(enc, library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab 's1\n\t.é")), max_size=40))
def test_any_text(text):
    m = _MERGER
    same(encoder(m, [" a", "b"]), _LIBRARY, text)


_MERGER, _LIBRARY = lexicon.Merger(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abcé ", min_size=1, max_size=6), max_size=30), st.text("abcé ", max_size=6))
def test_automaton_is_a_minimal_dictionary(words, other):
    ids = {w: list(range(i, i + 1 + len(w))) for i, w in enumerate(sorted(words))}
    block = lexicon.compile_words(ids)
    a = lexicon.Automaton(block)
    listed = sorted(words, key=str.encode)
    assert a.find(listed).tolist() == list(range(len(listed)))
    assert (a.find([other])[0] >= 0) == (other in words)
    for w, place in zip(listed, a.find(listed).tolist()):
        assert np.frombuffer(a.output(place), "<u4").tolist() == ids[w]
    # No two states accept the same set of endings.
    arcs = {}
    for key, target in zip(a.keys.tolist(), a.targets.tolist()):
        arcs.setdefault(key >> 8, []).append((key & 255, target))

    def endings(state):
        out = {b""} if a.final[state] else set()
        for byte, target in arcs.get(state, []):
            out |= {bytes([byte]) + e for e in endings(target)}
        return frozenset(out)
    shapes = [endings(s) for s in range(len(a.final))]
    assert len(set(shapes)) == len(shapes)


def test_table_against_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in lexicon.encode(docs, PATH, max_words=500).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], bytes(g["ids"]), g["decoded"]) == \
            (len(ids), hashlib.sha256(raw).hexdigest(), raw, r["text"] or "")


def test_edges_and_frequent_words(spark):
    got = {r["doc_id"]: r for r in lexicon.encode(edges(spark), PATH).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["decoded"] == "" and got[4]["decoded"] == EDGES[3][1]
    assert lexicon.encode(frame(spark, []), PATH).collect() == []
    docs = frame(spark, [(i, "a b b b c c", None, None, None) for i in range(4)])
    assert lexicon.frequent_words(docs, 1) == [" b"]
    assert lexicon.frequent_words(docs, 2) == [" b", " c"]


def test_texts_with_unsure_characters_use_the_lexicon(spark, merger, library):
    text = "“the price” — 日本語 ქართული ქართული the price"
    words = lexicon.frequent_words(frame(spark, [(i, text, "x", "s", 1) for i in range(5)]))
    assert {" ქართული", " price", " the", "the", " 日本語"} <= set(words)
    enc = encoder(merger, words)
    same(enc, library, text)
    assert not enc._merged
    for odd in ODD:
        same(encoder(merger, merger.words(odd) if "<|" not in odd else words), library, odd)


def test_long_unbroken_words(merger, library):
    rng = random.Random(3)
    enc = encoder(merger, [" a"])
    for size in (lexicon.LONG, lexicon.LONG + 1, 700):
        for letters in ("ab", "theanor", "é日 a"):
            same(enc, library, "".join(rng.choice(letters) for _ in range(size)))
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789") for _ in range(1 << 20))
    start = time.monotonic()
    letters = "".join(c for c in text if c.isalpha())
    got = enc.encode([letters])[0]
    assert time.monotonic() - start < 40
    assert np.frombuffer(got, "<u4").tolist() == library.encode(
        letters, add_special_tokens=False).ids


def test_equally_frequent_words_fill_the_lexicon(spark):
    docs = frame(spark, [(i, "v w x y z", "en", "s", 9) for i in range(4)])
    words = lexicon.frequent_words(docs, 3)
    assert 1 <= len(words) <= 3 and set(words) <= {"v", " w", " x", " y", " z"}
    assert lexicon.frequent_words(docs, 5) == [" w", " x", " y", " z", "v"]
    assert lexicon.frequent_words(docs, 0) == []


def test_forgetting_the_older_half(merger, library, monkeypatch):
    monkeypatch.setattr(lexicon, "REMEMBERED", 4)
    enc = encoder(merger, [" a"])
    for i in range(30):
        same(enc, library, f"one two{i} three four{i % 3} five six")
        assert len(enc._merged) <= 4 + 6
