"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide link counts.

Both vocabularies spell a blank and the text.  A group ends at every byte
offset where a token of each ends; all tokens of one group are linked.  The
offsets are intersected by galloping: the shorter list of ends drives an
exponential and then a binary search into the longer one; the indices found
slice both token lists into groups, and their differences are the overlap
ranges.

Both vocabularies begin a new token at a single blank between two other
characters, so texts are cut there and the alignment of a part is remembered;
a text without such blanks is aligned whole.

The first pass writes one row per document: its numbers and its distinct id
pairs with their numbers of links.  From that table Spark counts, per pair,
the documents that hold it, and the second pass looks the counts up.  Pairs
that one document alone holds need no entry.  Of the others the most frequent,
at most ``max_pairs``, are broadcast; links of rarer ones, if there are any,
are joined with their counts by a shuffle, in which no pair can be hot.

Defined cases: null and empty texts, and texts whose tokens spell something
else than a blank and the text, have no tokens: all numbers are zero and the
hash is empty; repeated rows are documents of their own; very long texts are
aligned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costmart.llm.common import keep_table, pairs, pieces
from costmart.llm.lexicon import byte_letters

#: Pairs whose counts are broadcast (16 bytes each), parts of texts that a worker remembers,
#: and distinct pairs that a task counts before it hands them on.
MAX_PAIRS, REMEMBERED, COUNTED = 3_000_000, 500_000, 2_000_000
LONGEST_REMEMBERED = 64
#: Groups up to this number of links list every link; larger ones count equal id pairs.
LISTED = 64

#: A blank that begins a token in both vocabularies.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def common_ends(left: Sequence[int], right: Sequence[int]) -> list[tuple[int, int]]:
    """Index pairs of the equal numbers of two ascending lists, by galloping."""
    if len(left) > len(right):
        return [(i, j) for j, i in common_ends(right, left)]
    if left == right:
        return [(i, i) for i in range(len(left))]
    found, at, size = [], 0, len(right)
    for i, x in enumerate(left):
        step, top = 1, at
        while top < size and right[top] < x:
            at, top, step = top + 1, top + step, 2 * step
        at = bisect_left(right, x, at, min(top, size))
        if at == size:
            break
        if right[at] == x:
            found.append((i, at))
            at += 1
    return found


def groups(left: Sequence[int], right: Sequence[int]) -> list[tuple[slice, slice]]:
    """The token ranges of both sides that common ends cut off, in order."""
    out, i0, j0 = [], 0, 0
    for i, j in common_ends(left, right):
        out.append((slice(i0, i + 1), slice(j0, j + 1)))
        i0, j0 = i + 1, j + 1
    return out


class Aligned(NamedTuple):
    """A part's numbers (A and B tokens, groups, links), its groups as text, and its links."""

    numbers: bytes
    text: str
    links: bytes     # pair codes; a code is there once per link, or once with its times
    times: bytes     # empty: once per link


class Aligner:
    """Tokens of both vocabularies, aligned; short parts of texts are remembered."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self._a = Tokenizer.from_file(byte_path)
        self._a.encode_special_tokens = True
        self._a.no_truncation()
        self._a.no_padding()
        self._b = SentencePieceProcessor(model_file=piece_path)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self._blank = byte_letters()[ord(" ")]
        size = max(self._a.get_vocab(with_added_tokens=True).values()) + 1
        self._spell_a = [b""] * size
        for token, i in self._a.get_vocab(with_added_tokens=False).items():
            self._spell_a[i] = bytes([byte_of[c] for c in token])
        b = self._b
        self._spell_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
            else b"" if b.is_control(i) or b.is_unknown(i)
            else b.id_to_piece(i).replace("▁", " ").encode() for i in range(len(b))]
        self._len_a = [len(s) for s in self._spell_a]
        self._len_b = [len(s) for s in self._spell_b]
        self.a_size, self.b_size = size, len(b)
        #: Type of a pair's code, A id * number of B ids + B id.
        self.code = "I" if size * len(b) < 1 << 32 else "Q"
        self._known: dict[str, Aligned | None] = {}
        self._weighted: set[str] = set()

    def _align(self, part: str, a: list[int], b: list[int]) -> Aligned | None:
        if not part.isascii():               # both vocabularies spell every ASCII text
            spelled = b"".join([self._spell_b[i] for i in b])
            if (spelled != b" " + part.encode()
                    or spelled != b"".join([self._spell_a[i] for i in a])):
                return None
        ends_a = list(accumulate([self._len_a[i] for i in a]))
        ends_b = list(accumulate([self._len_b[i] for i in b]))
        texts, links, size, n_links = [], [], self.b_size, 0
        cut = groups(ends_a, ends_b)
        heavy: Counter | None = None
        for of_a, of_b in cut:
            left, right = a[of_a], b[of_b]
            if len(left) == len(right) == 1:
                texts.append(f"{left[0]}|{right[0]}")
                links.append(left[0] * size + right[0])
                n_links += 1
                continue
            texts.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            n = len(left) * len(right)
            n_links += n
            if n <= LISTED:
                links += [i * size + j for i in left for j in right]
            else:
                heavy = Counter() if heavy is None else heavy
                counted = Counter(right).items()
                for i, x in Counter(left).items():
                    for j, y in counted:
                        heavy[i * size + j] += x * y
        times = b""
        if heavy is not None:
            heavy.update(links)
            links, times = list(heavy), array("Q", heavy.values()).tobytes()
        return Aligned(array("q", (len(a), len(b), len(cut), n_links)).tobytes(),
                       ";".join(texts), array(self.code, links).tobytes(), times)

    def _learn(self, parts: list[str]) -> None:
        # A run of ASCII letters is one word of the split rule: the merges alone encode it.
        tokenize = self._a.model.tokenize
        words = [p.isascii() and p.isalpha() for p in parts]
        rest = iter(self._a.encode_batch_fast(
            [" " + p for p, word in zip(parts, words) if not word], add_special_tokens=False))
        for p, word, b in zip(parts, words, self._b.encode(parts, num_threads=1)):
            a = [t.id for t in tokenize(self._blank + p)] if word else next(rest).ids
            found = self._known[p] = self._align(p, a, b)
            if found is not None and found.times:
                self._weighted.add(p)

    def align(self, texts: Iterable[str | None]) -> Iterator[Aligned | None]:
        """Of each text: numbers, hash, distinct pairs and their times; None without tokens."""
        known = self._known
        cut = [_CUT.split(t) if t else [] for t in texts]
        new = set().union(*cut).difference(known)
        self._learn(list(new))
        for parts in cut:
            found = [known[p] for p in parts]
            if not found or None in found:
                yield None
                continue
            numbers, text, links, _ = zip(*found)
            codes = np.frombuffer(b"".join(links), self.code)
            if self._weighted.isdisjoint(parts):
                codes, times = np.unique(codes, return_counts=True)
            else:
                each = np.concatenate([
                    np.frombuffer(f.times, "Q") if f.times
                    else np.ones(len(f.links) // codes.itemsize, "Q") for f in found])
                codes, at = np.unique(codes, return_inverse=True)
                times = np.zeros(len(codes), "Q")
                np.add.at(times, at, each)
            yield Aligned(np.frombuffer(b"".join(numbers), "q").reshape(-1, 4).sum(0).tobytes(),
                          hashlib.sha256(";".join(text).encode()).hexdigest(), codes.tobytes(),
                          times.astype(np.min_scalar_type(int(times.max()))).tobytes())
        for p in new:
            if len(p) > LONGEST_REMEMBERED:
                del known[p]
                self._weighted.discard(p)
        if len(known) > REMEMBERED:
            for p in list(known)[:len(known) - REMEMBERED // 2]:
                del known[p]
                self._weighted.discard(p)


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """This worker's aligner of two vocabulary files."""
    return Aligner(byte_path, piece_path)


def _times(codes: np.ndarray, raw: bytes) -> np.ndarray:
    """The numbers of links that go with pair codes, whatever width they were written in."""
    width = len(raw) // max(1, len(codes))
    return np.frombuffer(raw, f"u{width}") if width else np.zeros(0, "u1")


#: One row per document: its own number, its figures, pair codes and numbers of links.
_ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
            "groups_sha256 string, pairs binary, times binary")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The alignment of every row, with its distinct id pairs (codes) and their links."""
    names = [f.split()[0] for f in _ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_path, piece_path)
        row = TaskContext.get().partitionId() << 40
        for b in pieces(batches, "text"):
            found = list(tool.align(b.column("text").to_pylist()))
            numbers = np.array([np.frombuffer(f.numbers, "q") if f else np.zeros(4, "q")
                                for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(found))), b.column("doc_id"),
                 *(pa.array(c) for c in numbers.T),
                 pa.array([f.text if f else "" for f in found], pa.string()),
                 pa.array([f.links if f else b"" for f in found], pa.binary()),
                 pa.array([f.times if f else b"" for f in found], pa.binary())], names)
            row += len(found)

    return docs.select(*pairs(id_col, text_col)).mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame, code: str, b_size: int) -> DataFrame:
    """pair, n (documents that hold it) and whether n is its A id's highest, for all n > 1."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.zeros(0, code), np.zeros(0, "q")
        waiting: list[np.ndarray] = []

        def settle() -> None:
            nonlocal codes, times
            found, n = np.unique(np.concatenate([*waiting, codes[:0]]), return_counts=True)
            waiting.clear()
            both = np.concatenate([codes, found])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([times, n])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) \
                if len(both) else np.zeros(0, "q")
            codes, times = both[first], np.add.reduceat(n, first) if len(first) else n

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(codes.astype("q")), pa.array(times)], ["pair", "n"])

        size = 0
        for b in batches:
            for raw in b.column("pairs"):
                waiting.append(np.frombuffer(raw.as_buffer(), code))
                size += len(waiting[-1])
            if size > COUNTED:
                settle()
                size = 0
                if len(codes) > COUNTED:
                    yield flush()
                    codes, times = codes[:0], times[:0]
        settle()
        if len(codes):
            yield flush()

    return (aligned.select("pairs").mapInArrow(count, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
            # At most as many pairs of one A id as there are B ids.
            .withColumn("best", F.col("n") == F.max("n").over(
                Window.partitionBy(F.floor(F.col("pair") / b_size)))))


class Counts(NamedTuple):
    """Broadcast counts: ascending pair codes, their documents, whether they are the A id's best."""

    pair: np.ndarray
    n: np.ndarray
    best: np.ndarray
    several: np.ndarray  # per A id: whether several documents hold a pair of it


def _least(counts: DataFrame, max_pairs: int) -> int | None:
    """The lowest class of counts of which all and all above are at most ``max_pairs`` pairs."""
    least, total = None, 0
    for r in counts.groupBy(_size_class()).count().orderBy(F.desc("class")).collect():
        total += r["count"]
        if total > max_pairs:
            break
        least = r["class"]
    return least


def _size_class():
    return F.floor(F.log2("n") * 16).cast("int").alias("class")


def links(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id",
          text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per row: the alignment's figures, links with the best count, and the sum of counts."""
    spark = docs.sparkSession
    tool = aligner(byte_path, piece_path)
    code, b_size = tool.code, tool.b_size
    aligned = keep_table(align(docs, byte_path, piece_path, id_col, text_col), "aligned")
    counts = keep_table(pair_counts(aligned, code, b_size), "pair-counts")
    least = _least(counts, max_pairs)
    sent = counts.where(_size_class() >= least) if least is not None else counts.where("false")
    listed = sent.toArrow().sort_by("pair")
    ids = counts.select(F.floor(F.col("pair") / b_size).cast("int").alias("a")).distinct()
    shared = spark.sparkContext.broadcast(Counts(
        listed["pair"].to_numpy().astype(code), listed["n"].to_numpy(),
        listed["best"].to_numpy(), np.isin(np.arange(tool.a_size), ids.toArrow()["a"].to_numpy())))
    rarer = counts.where(_size_class() < least) if least is not None else counts
    complete = rarer.isEmpty()
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, " \
             "groups_sha256 string, n_best long, count_sum long" \
             + ("" if complete else ", open array<long>, open_times array<long>")
    names = [f.split()[0] for f in schema.split(", ")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in pieces(batches, "pairs", 4 << 20):
            raw = [r.as_buffer() for r in b.column("pairs")]
            each = [np.frombuffer(r, code) for r in raw]
            codes = np.concatenate(each)
            times = np.concatenate([_times(c, t.as_py()).astype("q")
                                    for c, t in zip(each, b.column("times"))])
            ends = np.cumsum([0, *map(len, each)])
            at = np.searchsorted(table.pair, codes)
            if len(table.pair):
                at = np.minimum(at, len(table.pair) - 1)
                hit = table.pair[at] == codes
                n = np.where(hit, table.n[at], 0)
                best = hit & table.best[at]
            else:
                hit = best = np.zeros(len(codes), bool)
                n = np.zeros(len(codes), "q")
            if complete:                     # all others are of one document alone
                n = np.where(hit, n, 1)
                best = best | (~hit & ~table.several[(codes // b_size).astype("q")])
            total, bests = (np.diff(np.concatenate([[0], np.cumsum(x * times)])[ends])
                            for x in (n, best))
            unknown = [c[~h].astype("q") for c, h in zip(each, np.split(hit, ends[1:-1]))] \
                if not complete else None
            unknown_times = [t[~h] for t, h in zip(np.split(times, ends[1:-1]),
                                                   np.split(hit, ends[1:-1]))] \
                if not complete else None
            columns = [b.column(c) for c in names[:7]] + [
                pa.array(bests.astype("q")), pa.array(total.astype("q"))]
            if not complete:
                columns += [pa.array(unknown, pa.list_(pa.int64())),
                            pa.array(unknown_times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    found = aligned.mapInArrow(look_up, schema)
    if not complete:
        found = keep_table(found, "links")
        single = (found.select("row", F.explode(F.arrays_zip("open", "open_times")).alias("x"))
                  .select("row", F.col("x.open").alias("pair"),
                          F.col("x.open_times").alias("times"),
                          F.floor(F.col("x.open") / b_size).cast("int").alias("a")))
        several = F.col("held").isNotNull()
        more = (single.join(rarer, "pair", "left")
                .join(F.broadcast(ids.withColumn("held", F.lit(True))), "a", "left")
                .groupBy("row").agg(
                    F.sum(F.when(F.coalesce("best", ~several), F.col("times"))).alias("more_best"),
                    F.sum(F.col("times") * F.coalesce("n", F.lit(1))).alias("more_sum")))
        found = (found.drop("open", "open_times").join(more, "row", "left")
                 .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
                 .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        "groups_sha256")
