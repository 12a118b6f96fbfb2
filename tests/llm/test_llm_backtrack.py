import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from helpers import EDGES, edges, frame
from costmart.llm import backtrack

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a  b", "   a   b   ", "\n", "a\nb", "日本語 テスト", "🙂🙂 ok", "▁a▁▁b",
       "<s> </s> <unk> <0x0A>", "\x00a\x00", " " * 100, "a" + " " * 1000 + "b", "\t\t", "ab" * 900,
       " " * 37 + "語", "語" + " " * 5 + "語", "� ﻿", "don't, won't; (x).", "a1b2 3.14"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return backtrack.encoder(PATH)


def same(coder, library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    got = coder.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == ids, text[:80]
    assert coder.decode(got) == library.decode(ids), text[:80]


def test_odd_texts_and_random_pieces(coder, library):
    rng = random.Random(5)
    listed = list(coder.pieces.born)
    for text in ODD:
        same(coder, library, text)
    for _ in range(3000):
        same(coder, library, "".join(rng.choice(listed) for _ in range(rng.randint(1, 12))))


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"),
                              st.sampled_from("abe  thing.\n\té▁")), max_size=60))
def test_any_text(coder, library, text):
    same(coder, library, text)


def test_compatible_is_what_merging_gives(coder):
    rng, pieces = random.Random(6), coder.pieces
    common = [p for p in pieces.born if pieces.rank[p] < 3000] + list("abe ▁.")
    for choice in (common, list(pieces.born)):
        for _ in range(5000):
            a, b = rng.choice(choice), rng.choice(choice)
            assert pieces.compatible(a, b) == (pieces.merge(a + b)[0] == [a, b]), (a, b)


def test_failed_positions_and_windows(coder, library, monkeypatch):
    """Texts without blanks: many wrong longest matches, and returns behind a window."""
    monkeypatch.setattr(backtrack, "WINDOW", 16)
    rng = random.Random(7)
    for letters in ("thanonerti", "ab", "aeinorst"):
        for _ in range(100):
            same(coder, library, "".join(rng.choice(letters) for _ in range(300)))


def test_long_unbroken_words_take_linear_time(coder, library):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/")
                   for _ in range(400_000))
    for long in (text, "x" * 400_000, " " * 400_000):
        start = time.monotonic()
        got = coder.encode([long])[0]
        assert time.monotonic() - start < 30
        assert np.frombuffer(got, "<u4").tolist() == library.encode(long, add_bos=True,
                                                                    add_eos=True)


def test_decoding_any_ids(coder, library):
    rng = random.Random(9)
    for _ in range(2000):
        ids = [rng.choice([1, 2, rng.randint(3, 258), rng.randint(259, 31999), 29871, 263])
               for _ in range(rng.randint(0, 10))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_forgetting_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(backtrack, "REMEMBERED", 5)
    for text in ("the thing on the other thing " * 20, "a b c d e f g h i j k l m n o p"):
        same(coder, library, text)


def test_documents_and_edges(spark, library):
    docs = edges(spark, *((100 + i, t, "en", "s", len(t)) for i, t in enumerate(ODD)))
    texts = {**{i: t or "" for i, t, *_ in EDGES}, **{100 + i: t for i, t in enumerate(ODD)}}
    rows = backtrack.encode(docs, PATH).collect()
    assert len(rows) == len(EDGES) + len(ODD)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], bytes(r["ids"])) == (len(ids), raw)
        assert r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["decoded"] == library.decode(ids)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert backtrack.encode(frame(spark, []), PATH).count() == 0
