"""Best-fit packing of documents into token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the number of pieces per
length is a table of at most ``capacity`` rows, however large the corpus.  The
plan is made on that table alone:

1. Linear grouping: the large pieces, longest first, are dealt into groups of
   equal cardinality, and each piece is rounded up to the longest of its group.
2. Few-size configurations: sets of rounded sizes that fill a sequence are
   found by an exact subset-sum table and used as often as their sizes last.
3. Substitution: actual pieces take the places of their group, longest first,
   which leaves a known gap in each sequence.
4. The small pieces go best-fit into the gaps, longest first, then into new
   sequences.

A plan is a list of slot runs (length, first rank, count, first sequence,
offset); its size depends on the capacity and the number of groups, not on the
number of pieces.  Spark tokenises the texts, counts lengths, ranks the pieces
within their length (salted into buckets, so no length is one task's work) and
looks each rank up in the plan.

Defined cases: a null or empty text has one piece, the end id alone; only
documents longer than the capacity are cut; a null id is a document like any
other; repeated rows are packed each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costmart.llm.common import keep_table, pairs, pieces
from costmart.llm.lexicon import byte_letters

#: Words and word parts whose ids a worker remembers.
CACHE_WORDS = 250_000
#: Pieces that share a ranking bucket, on average.
BUCKET_ROWS = 1 << 16

# ---- tokens --------------------------------------------------------------

#: Separators that Python's split() knows and the vocabulary's white space does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Characters that need the library's own normaliser and split rule.
_UNSURE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbè-\U0010ffff]")
#: The vocabulary's split rule on the remaining characters (fixed alternatives).
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordIds:
    """Token ids of texts; ids of recent words are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        self._letters = {b: c for b, c in enumerate(byte_letters())}
        self._words: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids,
                        "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            spelled = part if part.isascii() and part.isprintable() else \
                part.encode().decode("latin-1").translate(self._letters)
            ids = self._parts[part] = np.array(
                [t.id for t in self._model.tokenize(spelled)], "<u4").tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        # White space never joins tokens, so a word's ids do not depend on its neighbours.
        if "<|" in word or _UNSURE.search(word):
            return self._whole(word)
        low = word.lower()
        if low.isascii() and low.isalpha():
            return self._part(low)
        return b"".join([self._part(p) for p in _SPLIT.findall(low)])

    def ids(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit."""
        if _NOT_SPACE.search(text):
            return self._whole(text)
        words, known = text.split(), self._words
        for w in set(words).difference(known):
            known[w] = self._word(w)
        out = b"".join([known[w] for w in words])
        if len(known) > CACHE_WORDS:
            known.clear()
        if len(self._parts) > CACHE_WORDS:
            self._parts.clear()
        return out


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenise(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0,
             id_col: str = "doc_id", text_col: str = "text", outputs: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if outputs:
        schema += ", ids binary"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = _word_ids(vocabulary)
        for b in pieces(batches, "text"):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = word_ids.ids(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut), cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)][:len(names)], names)

    return docs.select(*pairs(id_col, text_col)).mapInArrow(run, schema)


# ---- the plan ------------------------------------------------------------

class _Plan:
    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.taken: dict[int, int] = defaultdict(int)        # length -> pieces placed
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (sequence, count)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        """The next ``count`` pieces of a length, one in each sequence from ``sequence`` on."""
        self.slots.append((length, self.taken[length], count, sequence, offset))
        self.taken[length] += count

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best, with the largest remaining size in it."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    # reached: bit r is set if sizes seen so far can fill r; the last size that first reached r.
    reached, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i in range(first, len(sizes)):
        size = sizes[i]
        for _ in range(min(left[i] - (i == first), room // size) if size <= room else 0):
            wider = (reached | reached << size) & mask
            if wider == reached:
                break
            steps.append((i, size, reached))
            reached = wider
        if reached >> room & 1:
            break
    use = [0] * len(sizes)
    use[first] = 1
    fill = reached.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> fill & 1:
            use[i] += 1
            fill -= size
    return use


def _place_large(plan: _Plan, lengths: list[tuple[int, int]], groups: int) -> None:
    """Steps 1 to 3 for (length, count), longest first."""
    total = sum(n for _, n in lengths)
    if not total:
        return
    ends = np.cumsum([n for _, n in lengths])                # places of the sorted pieces
    cut = [total * g // groups for g in range(groups + 1)]
    cut = [a for a, b in zip(cut, [*cut[1:], -1]) if a != b]  # without empty groups
    at, left = cut[:-1] or [0], []
    left = [b - a for a, b in zip(at, [*at[1:], total])]
    sizes = [lengths[int(np.searchsorted(ends, a, side="right"))][0] for a in at]
    at = list(at)
    while any(left):
        use = _configuration(sizes, left, plan.capacity)
        times = min(left[i] // u for i, u in enumerate(use) if u)
        sequence = plan.new(times)
        # Each use of a group takes a run of its places; cut the runs where a length ends.
        starts = []
        for i, u in enumerate(use):
            for _ in range(u):
                starts.append(at[i])
                at[i] += times
            left[i] -= u * times
        breaks = {0, times}
        for s in starts:
            a, b = np.searchsorted(ends, [s, s + times], side="right")
            breaks.update(int(e) - s for e in ends[a:b] if 0 < e - s < times)
        edges = sorted(breaks)
        for a, b in zip(edges, edges[1:]):
            offset = 0
            for s in starts:
                k = int(np.searchsorted(ends, s + a, side="right"))
                length, before = lengths[k][0], int(ends[k]) - lengths[k][1]
                plan.slots.append((length, s + a - before, b - a, sequence + a, offset))
                plan.taken[length] += b - a
                offset += length
            if offset < plan.capacity:
                plan.gaps[plan.capacity - offset].append((sequence + a, b - a))


def _place_small(plan: _Plan, lengths: list[tuple[int, int]]) -> None:
    """Step 4 for (length, count), longest first: the tightest gap that holds a piece."""
    for length, count in lengths:
        while count:
            gap = min((g for g in plan.gaps if g >= length), default=None)
            if gap is None:
                each = plan.capacity // length
                plan.gaps[plan.capacity].append((plan.new(-(-count // each)), -(-count // each)))
                gap = plan.capacity
            sequence, width = plan.gaps[gap].pop()
            if not plan.gaps[gap]:
                del plan.gaps[gap]
            each = min(gap // length, count)      # a gap stays the tightest until it is full
            used = min(width, count // each)
            if used < width:
                plan.gaps[gap].append((sequence + used, width - used))
            for k in range(each):
                plan.put(length, used, sequence, plan.capacity - gap + k * length)
            count -= each * used
            if gap - each * length:
                plan.gaps[gap - each * length].append((sequence, used))


def make_plan(counts: dict[int, int], capacity: int, groups: int = 1024,
              small: int | None = None) -> np.ndarray:
    """Slot runs (length, first rank, count, first sequence, offset), sorted, from a count per length.

    ``small`` is the longest small piece (default: a third of the capacity).
    """
    small = capacity // 3 if small is None else small
    plan = _Plan(capacity)
    ordered = sorted(((n, c) for n, c in counts.items() if c), reverse=True)
    for length, count in ordered:
        if length == capacity:
            plan.put(length, count, plan.new(count), 0)
    _place_large(plan, [x for x in ordered if small < x[0] < capacity], groups)
    _place_small(plan, [x for x in ordered if x[0] <= min(small, capacity - 1)])
    return np.array(sorted(plan.slots), np.int64).reshape(-1, 5)


# ---- on Spark ------------------------------------------------------------

def ranked(found: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """``found`` with the rank of each piece among those of its length, and the count per length.

    ``found`` must be a written table.  Pieces of a length are spread over
    hashed buckets; a bucket's ranks start after those of the buckets before.
    """
    counts = {r["length"]: r["n"] for r in
              found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    spread = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                               F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    starts = sizes.select("length", "bucket", before.alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (spread.withColumn("inside", F.row_number().over(inside) - 1)
            .join(starts, ["length", "bucket"])
            .withColumn("rank", F.col("before") + F.col("inside"))
            .drop("bucket", "inside", "before")), counts


def place(found: DataFrame, capacity: int, groups: int = 1024,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``found`` (a written table with length) with sequence_id and offset."""
    rows, counts = ranked(found, bucket_rows)
    plan = make_plan(counts, capacity, groups)
    columns = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = plan[:, 0] << 44 | plan[:, 1]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            slot = plan[np.searchsorted(first, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns),
                 pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])],
                [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return rows.select(*columns, "rank").mapInArrow(
        run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, groups: int = 1024,
         end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         outputs: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    found = keep_table(tokenise(docs, vocabulary, capacity, end_id, id_col, text_col, outputs),
                       "token-pieces")
    return place(found, capacity, groups)
