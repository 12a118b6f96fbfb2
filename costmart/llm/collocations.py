"""Phrase collocations from count streams in prefix and suffix order.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and
the pieces into words.  A phrase of two to ``longest`` words is scored by its
lowest-scoring cut: how often the phrase stands, against how often its two
halves do.

1. Counts.  Every phrase inside a frequent one is frequent itself.  One pass a
   length first counts words, pairs, ... by the first 32 bits of their hashes,
   partly summed in the tasks, each only where the shorter ones pass; those that
   reach ``least`` set bits of a filter of fixed size.  A bit set by mistake, as
   by two rare ones with equal bits, costs a row, nothing else.  The last pass
   counts words and phrases exactly, by their spelling, where all in them pass
   the filters; what does not reach ``least`` is dropped.  Nearly every task of
   that pass meets nearly every common phrase and puts out a row of it, so its
   tasks are as many as the cores ask for, not as the input has splits; a full
   table puts out its rarer half and goes on counting the other.
2. Streams.  The counts are kept in prefix order (range-partitioned and sorted
   by language and words) and in suffix order (by the words reversed).  A phrase
   then follows its beginnings, and precedes its extensions, so one pass in
   lockstep over a stream knows the counts of all beginnings, and the highest
   count of an extension, without any lookup.  A range starts with the rows of
   the beginnings that lie before it, so no word's phrases need to be one task's.
3. The prefix stream gives the counts of first parts and right extensions, the
   suffix stream those of last parts and left extensions; a merge join of the
   two scores the phrases and drops those that a longer one explains.  (A phrase
   that a much longer one explains is explained by the one between them, as
   counts only fall with length.)

Defined cases: a null text is empty; a null language is ``und``; words that a
null id or a repeated row holds count like any other; very long texts are read
in blocks cut at piece ends; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costmart.llm.common import keep_table, pieces

#: Bytes of text that are split at a time; hashes and phrases that a task sums up.
BLOCK, SUMMED, PHRASES = 2 << 20, 3 << 20, 1_000_000
#: Bits of each filter: 2^26 bits are 8 MB, however large the corpus.
FILTER_BITS = 26
#: Filters are made for phrases of up to this many words.
FILTERS = 4
#: Counts in a range of a stream, on average.
RANGE_ROWS = 1_000_000

_PIECE_ENDS, _BLANKS = b".,;:!?\n\v\f\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)                  # 0: part of a word
_KIND[list(_BLANKS)] = 1
_KIND[list(_PIECE_ENDS)] = 2


# ---- words of a block ------------------------------------------------------

class Words:
    """The words of a block: distinct words, and per occurrence its word and piece."""

    def __init__(self, data: bytes):
        raw = _LOWER[np.frombuffer(data, np.uint8)]
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        listed = pa.Array.from_buffers(pa.binary(), len(starts), [
            None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        self.distinct = listed.dictionary
        self.word = listed.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of every distinct word."""
        if not len(self.distinct):
            return np.zeros(0, np.uint64)
        spelled = np.array(self.distinct.to_pylist() + [None], object)[:-1]
        return _mix(pd.util.hash_array(spelled, categorize=False) ^ np.uint64(seed))

    def follows(self) -> np.ndarray:
        """For every word but the last: whether the next one is in the same piece."""
        return self.piece[1:] == self.piece[:-1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a word pair from the hashes of its words."""
    return _mix(left * np.uint64(0xD6E8FEB86659FD93) + (right ^ (right >> np.uint64(32))))


def _blocks(data: bytes) -> Iterator[bytes]:
    """The bytes in blocks that end where a piece does."""
    kind, start = None, 0
    while len(data) - start > BLOCK:
        if kind is None:
            kind = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8)] == 2)
        at = np.searchsorted(kind, start + BLOCK)    # the last end within a block, or the next one
        if at and kind[at - 1] > start:
            at -= 1
        elif at == len(kind):
            break
        yield data[start:kind[at] + 1]
        start = int(kind[at]) + 1
    yield data[start:]


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for b in pieces(batches, "text", BLOCK):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(),
                              b.column("text").cast(pa.binary()).to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, found in texts.items():
            for block in _blocks(b"\n".join(found)):
                yield lang, Words(block)


def _seed(lang: str) -> int:
    return int(pd.util.hash_array(np.array([lang], object), categorize=False)[0])


# ---- counts ----------------------------------------------------------------

class _Sums:
    """Counts per hash (its first 32 bits), summed up as far as a bounded table allows."""

    def __init__(self) -> None:
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, hashes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._waiting.append(((hashes >> np.uint64(32)).astype(np.uint32), n))
        self._size += len(hashes)
        if self._size > SUMMED + SUMMED // 2:
            self._settle()
            if self._size > SUMMED:
                yield from self.flush()

    def _settle(self) -> None:
        hashes, n = (np.concatenate(c) for c in zip(*self._waiting))
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        self._waiting = [(hashes[first], np.add.reduceat(n, first))]
        self._size = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self._size:
            self._settle()
            hashes, n = self._waiting[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int32)), pa.array(n.astype(np.int64))], ["hash", "n"])
        self._waiting, self._size = [], 0


class Filter:
    """A set of hashes as one bit each; it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray, log2: int):
        self._bits, self._shift = bits, np.uint64(64 - log2)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self._shift
        return (self._bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))
                & np.uint64(1)).astype(bool)


def _filter(counted: DataFrame, least: int, log2: int) -> Filter:
    """The filter of all hashes that reach ``least``: at most 2^(log2 - 6) rows come to the driver.

    ``counted`` has the first 32 bits of hashes, so ``log2`` is 32 at most.
    """
    at = F.shiftrightunsigned(F.col("hash"), 32 - log2)
    rows = (counted.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            .groupBy(F.shiftright(at, 6).alias("word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, shiftrightunsigned(hash, {32 - log2}) & 63))")
                 .alias("bits")).toArrow())
    bits = np.zeros(1 << log2 - 6, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(bits, log2)


class _Phrases(NamedTuple):
    """The phrases of one length in a block: distinct ones, and per occurrence its start."""

    codes: np.ndarray    # number of the phrase without its last word, and that word
    hashes: np.ndarray   # of the distinct ones, 0 where no filter asks for them
    back: np.ndarray     # per occurrence: its distinct phrase
    at: np.ndarray       # per occurrence: the place of its first word


def _phrases(found: Words, hashes: np.ndarray, filters: list[Filter],
             longest: int) -> Iterator[_Phrases]:
    """Phrases of 2 to ``longest`` words whose shorter phrases all pass the filters.

    ``filters`` are those of phrases of 1, 2, ... words; the phrases are
    numbered exactly, one word longer each round, and hashed for the filters.
    """
    passing = filters[0].passes(hashes)[found.word]
    back, hashed = found.word, hashes
    at = np.flatnonzero(passing)
    back = back[at]
    hot, checked = np.append(passing, np.zeros(longest, bool)), 1
    same = np.append(found.follows(), np.zeros(longest, bool))
    for length in range(2, longest + 1):
        grow = hot[at + length - checked] & same[at + length - 2]
        at, back = at[grow], back[grow]
        codes, back = np.unique(back << 32 | found.word[at + length - 1], return_inverse=True)
        if length <= len(filters) + 1:
            hashed = pair_hash(hashed[codes >> 32], hashes[codes & 0xFFFFFFFF])
        yield _Phrases(codes, hashed, back, at)
        if length <= len(filters):
            good = filters[length - 1].passes(hashed)[back]
            at, back = at[good], back[good]
            hot[:], checked = False, length
            hot[at] = True


def _hashed(batches: Iterator[pa.RecordBatch], filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    """Counts, by hash, of phrases one word longer than the last filter's (first: of words)."""
    sums = _Sums()
    for lang, found in _by_language(batches):
        hashes = found.hashes(_seed(lang))
        if not filters:
            yield from sums.add(hashes, np.bincount(found.word, minlength=len(hashes)))
        elif len(hashes):
            *_, last = _phrases(found, hashes, filters, len(filters) + 1)
            yield from sums.add(last.hashes, np.bincount(last.back, minlength=len(last.codes)))
    yield from sums.flush()


def _exact(batches: Iterator[pa.RecordBatch], filters: list[Filter],
           longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of words and phrases that the filters allow, and of all words (the empty phrase)."""
    counts: dict[str, Counter] = {}
    size = 0

    def put_out(all_: bool) -> Iterator[pa.RecordBatch]:
        """Rows of all phrases, or of the half counted least often so far; they leave the table."""
        each = [np.fromiter(into.values(), np.int64, len(into)) for into in counts.values()]
        most = None if all_ or not each else int(np.median(np.concatenate(each)))
        for (lang, into), n in zip(counts.items(), each):
            rare = n >= 0 if most is None else n <= most
            gone = list(compress(into, rare))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gone), pa.string()),
                 pa.array(gone, pa.binary()).cast(pa.string()), pa.array(n[rare])],
                ["lang", "phrase", "n"])
            for phrase in gone:
                del into[phrase]

    for lang, found in _by_language(batches):
        hashes = found.hashes(_seed(lang))
        if not len(hashes):
            continue
        into = counts.setdefault(lang, Counter())
        size -= len(into)
        into[b""] += len(found.word)
        once = np.bincount(found.word, minlength=len(hashes))
        spelled = np.array(found.distinct.to_pylist() + [None], object)[:-1]
        for i in np.flatnonzero(filters[0].passes(hashes)):
            into[spelled[i]] += int(once[i])
        texts = spelled
        for length, p in enumerate(_phrases(found, hashes, filters, longest), 2):
            texts = texts[p.codes >> 32] + b" " + spelled[p.codes & 0xFFFFFFFF]
            n = np.bincount(p.back, minlength=len(p.codes))
            if length <= len(filters):
                n[~filters[length - 1].passes(p.hashes)] = 0
            for i in np.flatnonzero(n):
                into[texts[i]] += int(n[i])
        size += len(into)
        if size > PHRASES:
            yield from put_out(False)
            size = sum(map(len, counts.values()))
    yield from put_out(True)


def _broadcast_filter(texts: DataFrame, filters: list, least: int, log2: int):
    """The broadcast filter of phrases one word longer than those of the last filter."""
    counted = texts.mapInArrow(lambda batches: _hashed(batches, [f.value for f in filters]),
                               "hash int, n long")
    return texts.sparkSession.sparkContext.broadcast(_filter(counted, least, log2))


def partial_counts(texts: DataFrame, filters: list, longest: int,
                   tasks: int | None = None) -> DataFrame:
    """lang, phrase and n of ``_exact``: at most one row for each phrase and task, unless tables fill.

    Splits are read together in ``tasks`` tasks at most (None: two for each core
    of the session, ``spark.default.parallelism`` if that is set).
    """
    tasks = tasks or 2 * texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(tasks).mapInArrow(
        lambda batches: _exact(batches, [f.value for f in filters], longest),
        "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, least: int, longest: int, text_col: str = "text",
                  lang_col: str = "lang", filter_bits: int = FILTER_BITS,
                  tasks: int | None = None) -> DataFrame:
    """lang, words and n: all phrases of up to ``longest`` words that stand ``least`` times.

    The row without words holds the number of all words of its language.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    filters: list = []
    for _ in range(min(longest, FILTERS)):
        filters.append(_broadcast_filter(texts, list(filters), least, filter_bits))
    return (partial_counts(texts, filters, longest, tasks)
            .groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= least) | (F.col("phrase") == ""))
            .select("lang", F.when(F.col("phrase") == "", F.array().cast("array<string>"))
                    .otherwise(F.split("phrase", " ")).alias("words"), "n"))


# ---- streams ---------------------------------------------------------------

def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted ranges: counts of all beginnings, highest count of an extension.

    The path holds the open beginnings of the current row; a row closes all that
    it does not begin with.  Rows with ``context`` stand before the range and
    give a count only; what they learn of extensions is handed on.
    """
    names = ["lang", "words", "n", "parts", "extension"]
    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    rows: list[tuple] = []
    path: list[list] = []        # [words, n, context, highest extension]
    here = None

    def close(depth: int) -> None:
        while len(path) > depth:
            words, n, context, highest = path.pop()
            if not context:
                rows.append((here[1], words, n, [p[1] for p in path], highest))
            elif highest:
                rows.append((here[1], words, None, None, highest))

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        rows.clear()
        return done

    for b in batches:
        for part, lang, words, n, context in zip(*(b.column(c).to_pylist() for c in (
                "part", "lang", "words", "n", "context"))):
            if here != (part, lang):
                close(0)
                here = (part, lang)
            while path and path[-1][0] != words[:len(path[-1][0])]:
                close(len(path) - 1)
            if path and len(words) == len(path[-1][0]) + 1:
                path[-1][3] = max(path[-1][3], n)
            path.append([words, n, context, 0])
        if len(rows) > 10_000:
            yield batch()
    close(0)
    if rows:
        yield batch()


def stream(counts: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per phrase of a count table: ``parts``, the counts of its 1, 2, ... first words, and
    ``extension``, the highest count of a phrase with one more word behind."""
    spark = counts.sparkSession
    ranges = max(1, -(-counts.count() // range_rows))
    order = ["lang", "words"]
    sorted_ = keep_table(counts.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id()), "stream")
    # Where each range starts, and the beginnings that lie before it (a few rows a range).
    first = F.min(F.struct(*order)).alias("first")
    begin = (sorted_.groupBy("part").agg(first)
             .select("part", F.col("first.lang").alias("lang"), F.col("first.words").alias("begin")))
    before = (begin.select("part", "lang", F.explode(F.sequence(
                  F.lit(1), F.greatest(F.size("begin") - 1, F.lit(1)))).alias("k"), "begin")
              .where(F.col("k") < F.size("begin"))
              .select("part", "lang", F.slice("begin", 1, F.col("k")).alias("words"))
              .join(counts.select("lang", "words", "n"), ["lang", "words"]))
    whole = sorted_.withColumn("context", F.lit(False)).unionByName(
        before.withColumn("context", F.lit(True)))
    found = (whole.repartition(ranges, "part").sortWithinPartitions("part", *order)
             .select("part", "lang", "words", "n", "context")
             .mapInArrow(_lockstep, "lang string, words array<string>, n long, "
                                    "parts array<long>, extension long"))
    # A phrase whose extensions lie in several ranges has a row of each.
    return found.groupBy("lang", "words").agg(F.max("n").alias("n"), F.max("parts").alias("parts"),
                                              F.max("extension").alias("extension"))


def _decimal(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def score(docs: DataFrame, least: int = 30, longest: int = 4, keep_percent: int = 80,
          text_col: str = "text", lang_col: str = "lang", filter_bits: int = FILTER_BITS,
          range_rows: int = RANGE_ROWS, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, a, l, r and score of all phrases that no longer one explains; and lang, n.

    The score is floor(2000000 * a / (l + r)) at the lowest-scoring cut, the
    shortest first part at ties; products are decimals of 38 digits.  ``tasks``
    bounds the tasks of the exact count (None: two for each core).
    """
    counts = keep_table(phrase_counts(docs, least, longest, text_col, lang_col, filter_bits, tasks),
                        "phrase-counts")
    phrases = counts.where(F.size("words") > 0)
    totals = counts.where(F.size("words") == 0).select("lang", "n")
    forward = stream(phrases, range_rows)
    backward = stream(phrases.withColumn("words", F.reverse("words")), range_rows).select(
        "lang", F.reverse("words").alias("words"), F.col("parts").alias("last_parts"),
        F.col("extension").alias("left_extension"))
    size = F.size("words")
    cut = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), F.element_at("parts", k).alias("l"),
        F.element_at("last_parts", size - k).alias("r")))
    scores = F.transform(cut, lambda c: F.struct(
        F.call_function("div", _decimal(F.lit(2000000)) * F.col("n").cast("decimal(19,0)"),
                        _decimal(c["l"]) + _decimal(c["r"])).alias("score"),
        c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    explained = _decimal(F.lit(100)) * F.greatest("extension", "left_extension").cast(
        "decimal(19,0)") >= _decimal(F.lit(keep_percent)) * F.col("n").cast("decimal(19,0)")
    scored = (forward.hint("merge").join(backward, ["lang", "words"])
              .where((size > 1) & ~explained).withColumn("best", F.array_min(scores))
              .select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"),
                      F.col("best.l").alias("l"), F.col("best.r").alias("r"),
                      F.col("best.score").alias("score")))
    return scored, totals


def top(scored: DataFrame, totals: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language, by score, count and spelling.

    Each task keeps ``most`` phrases of a language before the shuffle.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
            .join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                    "n", "score"))
