import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from helpers import EDGES, edges, frame
from costmart.llm import alignment
from costmart.llm.lexicon import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a b", " lead", "trail ", "a  b   c", "\n\n x\t\ty \n", "日本語 テスト 🙂🙂",
       "a▁b", "<|endoftext|> <s> </s> <0x41>", "don't we'll", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20,
       "🙂" * 40, "x" + " " * 70 + "y", "\x00 \x1c \x85 \xa0 b", "naïve café — “quoted”"]


@pytest.fixture(scope="module")
def spelled():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: x for x, c in enumerate(byte_letters())}

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                  else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return left, right
    return tokens


def brute(texts, tokens):
    """The contract by whole texts: sets of ends, all pairs of each group."""
    per, held = [], defaultdict(int)
    for text in texts:
        left, right = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in left) != whole or b"".join(
                x for _, x in right) != whole:
            per.append((0, 0, [], Counter()))
            continue
        ends = []
        for side in (left, right):
            at, out = 0, []
            for _, x in side:
                at += len(x)
                out.append(at)
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        cut = [([], []) for _ in common]
        for k, (side, es) in enumerate(zip((left, right), ends)):
            for (i, _), e in zip(side, es):
                cut[bisect_left(common, e)][k].append(i)
        pairs = Counter((i, j) for x, y in cut for i in x for j in y)
        for p in pairs:
            held[p] += 1
        per.append((len(left), len(right), cut, pairs))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    rows = []
    for n_a, n_b, cut, pairs in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cut)
        rows.append((n_a, n_b, len(cut), sum(pairs.values()),
                     sum(n for p, n in pairs.items() if held[p] == best[p[0]]),
                     sum(n * held[p] for p, n in pairs.items()),
                     hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return rows


def found(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best",
                                              "count_sum", "groups_sha256"))
            for r in df.collect()}


@pytest.mark.parametrize("max_pairs", [1 << 20, 40, 0])
def test_links_against_brute_force(spark, spelled, max_pairs):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    texts = [*ODD, *(t for _, t, *_ in EDGES), *(r["text"] for r in some), *ODD[3:9]]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = found(alignment.links(docs, A, B, max_pairs=max_pairs))
    assert got == dict(enumerate(brute(texts, spelled)))


def test_edges(spark):
    rows = alignment.links(edges(spark), A, B).collect()
    assert len(rows) == len(EDGES)
    same = [tuple(r)[1:] for r in rows if r["doc_id"] == 9]
    assert len(same) == 2 and same[0] == same[1]
    empty = {r["doc_id"]: r for r in rows}
    assert tuple(empty[1])[1:] == tuple(empty[2])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.links(edges(spark).limit(0), A, B).count() == 0
    aligned = alignment.align(edges(spark), A, B)
    assert aligned.where("n_groups > 0 and length(pairs) = 0").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_common_ends(a, b):
    left, right = sorted(a), sorted(b)
    assert [(left[i], right[j]) for i, j in alignment.common_ends(left, right)] == \
        [(x, x) for x in sorted(a & b)]


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab  's1\n\té▁")),
                    max_size=40))
def test_parts_equal_the_whole(spelled, text):
    tool = alignment.aligner(A, B)
    got = next(tool.align([text]))
    want = brute([text], spelled)[0]
    assert (got.text if got else "") == want[-1]
