"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

Spark counts the words of the whole corpus; the most frequent ones are
compiled with their token ids into a shared-suffix automaton: a minimal
acyclic transducer whose transitions carry numbers that add up to the place of
a word's ids.  The automaton is one flat block of bytes, bounded by
``max_words``; it is broadcast, and each worker memory-maps it from an
unlinked temporary file.  A batch's distinct words walk through it together,
one byte a step.  Words outside it are merged exactly by the ranks of the
vocabulary, so the ids are those of the vocabulary's own library whatever the
automaton holds.

A word is an optional blank and a run of non-blank characters, or a run of
white space.  Texts with characters whose class is not certain (white space
outside ASCII, or anything from U+0500 on) are split by the library's own
splitting rule instead, into words that are counted and looked up alike; special tokens in a text keep their id.

Defined cases: a null text is the empty text: no ids, the empty decoding; a
word of any length is merged whole, a long one with a heap; repeated rows get equal results; an empty
table gives an empty lexicon and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costmart.llm.common import keep_table, pairs, pieces

#: Words compiled into the automaton, and merged words that a worker remembers.
MAX_WORDS = 200_000
REMEMBERED = 400_000
#: Parts above this many bytes are merged with a heap; words above it are not remembered.
LONG = 128

#: An optional blank and a run of other characters, or white space as the split rule cuts it.
_CHUNK = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Characters whose class here and in the library's rule may differ.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeԀ-\U0010ffff]")
#: The library's split rule on the remaining characters (fixed alternatives).
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others take the code points from
    256 on, in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class Merger:
    """Exact merges of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._byte_of = byte_of = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.first = [vocab[c] for c in letters]
        # (left id, right id) -> rank and merged id in one number: the least is merged next.
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") \
            if self.special else None
        self._path, self._library, self._merging = path, None, None
        self._blank = letters[ord(" ")]

    def merge(self, part: bytes) -> list[int]:
        """Ids of one part of the split rule."""
        if len(part) > LONG:
            return self._merge_long(part)
        ids = [self.first[b] for b in part]
        get, none = self.merges.get, 1 << 60
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            new = ids[at] = best & 0xFFFFF
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(new << 20 | ids[at + 1], none)
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, none)
        return ids

    def _merge_long(self, part: bytes) -> list[int]:
        """The same with a heap over a linked list: time n log n, whatever the length."""
        ids: list[int | None] = [self.first[b] for b in part]
        size, get = len(ids), self.merges.get
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        # (rank and merged id, place, left id, right id): the last two show outdated entries.
        heap = [(best, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:]))
                if (best := get(a << 20 | b)) is not None]
        heapify(heap)
        while heap:
            best, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= size or ids[j] != b:
                continue
            new = ids[i] = best & 0xFFFFF
            ids[j], k = None, after[j]
            after[i] = k
            if k < size:
                before[k] = i
                if (best := get(new << 20 | ids[k])) is not None:
                    heappush(heap, (best, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (best := get(ids[h] << 20 | new)) is not None:
                heappush(heap, (best, h, ids[h], new))
        return [i for i in ids if i is not None]

    def _tokenizer(self):
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self._path)
            self._merging = self._library.model
        return self._library

    def _model(self):
        return self._merging or self._tokenizer().model

    def split(self, text: str) -> list[str]:
        """Parts of a text by the library's own split rule, as letters that stand for bytes."""
        return [x for x, _ in self._tokenizer().pre_tokenizer.pre_tokenize_str(text)]

    def word(self, word: str) -> list[int]:
        """Ids of a word of ``words``."""
        bare = word[1:] if word[0] == " " else word
        if bare.isalpha() and bare.isascii():    # one part: the library merges it faster
            return [t.id for t in self._model().tokenize(
                self._blank + bare if bare is not word else word)]
        if _UNSURE.search(word):
            return self.merge(word.encode())
        out: list[int] = []
        for part in _SPLIT.findall(word):
            out += self.merge(part.encode())
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens; with unsure characters, the library's parts."""
        if not _UNSURE.search(text):
            return _CHUNK.findall(text)
        byte_of = self._byte_of
        return [bytes([byte_of[c] for c in part]).decode() for part in self.split(text)]

    def parts(self, text: str) -> list[str]:
        """The text cut at its special tokens; special tokens are parts of their own."""
        return [text] if not self._special_split else self._special_split.split(text)


# ---- the automaton -------------------------------------------------------

def compile_words(words: dict[str, list[int]]) -> bytes:
    """The minimal acyclic transducer from UTF-8 words to their ids, as one block of bytes.

    Words are added in byte order; the states that a new word leaves behind are
    final in shape and merged with an equal state (same finality and same
    transitions), which shares all suffixes.  A state knows how many words it
    leads to, so the numbers on a path add up to the word's place in order.
    """
    entries = sorted((w.encode(), ids) for w, ids in words.items())
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []   # (final, ((byte, state), ...))
    reach: list[int] = []                   # words below a state

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
            reach.append(final + sum(reach[s] for _, s in arcs))
        return registry[key]

    path: list[list] = [[False, []]]        # open states of the last word: [final, arcs]
    last = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for at in range(len(last), common, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[at - 1], settle(final, arcs)))
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    for at in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append((last[at - 1], settle(final, arcs)))
    root = settle(*path[0])

    keys, targets, adds = [], [], []
    for state, (final, arcs) in enumerate(states):
        before = int(final)
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            adds.append(before)
            before += reach[target]
    ids = [np.array(i, "<u4") for _, i in entries]
    fields = [np.array([root], "<i8"), np.array(keys, "<i8"), np.array(targets, "<i4"),
              np.array(adds, "<i4"), np.array([f for f, _ in states], "<i1"),
              np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype("<i4"),
              np.concatenate([*ids, np.zeros(0, "<u4")])]
    head = np.array([len(f) for f in fields], "<i8")
    return b"".join([head.tobytes(), *(f.tobytes() + bytes(-f.nbytes % 8) for f in fields)])


class Automaton:
    """Looks words up in a memory-mapped block of ``compile_words``."""

    TYPES = ["<i8", "<i8", "<i4", "<i4", "<i1", "<i4", "<u4"]

    def __init__(self, block: bytes):
        # The file is unlinked at once: the mapping stays, no file does.
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        lengths = np.frombuffer(self._map, "<i8", len(self.TYPES))
        at, fields = lengths.nbytes, []
        for kind, n in zip(self.TYPES, lengths.tolist()):
            fields.append(np.frombuffer(self._map, kind, n, at))
            at += fields[-1].nbytes + -fields[-1].nbytes % 8
        root, self.keys, self.targets, self.adds, self.final, self.starts, self.ids = fields
        self.root = int(root[0])

    def find(self, words: list[str]) -> np.ndarray:
        """Place of each word, -1 where the automaton does not have it."""
        coded = [w.encode() for w in words]
        lengths = np.array([len(w) for w in coded], np.int64)
        place = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return place
        letters = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        live = np.arange(len(words))
        start = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.root, np.int64)
        total = np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            ended = lengths[live] == step
            done = live[ended]
            place[done] = np.where(self.final[state[ended]] == 1, total[ended], -1)
            live, state, total = live[~ended], state[~ended], total[~ended]
            key = state << 8 | letters[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state, total = self.targets[at].astype(np.int64), total[hit] + self.adds[at]
            step += 1
        return place

    def output(self, place: int) -> bytes:
        """The ids at a place, little-endian unsigned 32-bit."""
        return self.ids[self.starts[place]:self.starts[place + 1]].tobytes()


class Encoder:
    """Encodes texts with an automaton and exact merges for all other words."""

    def __init__(self, merger: Merger, automaton: Automaton):
        self.merger, self.automaton = merger, automaton
        self._known: dict[str, bytes] = {}       # ids of words met before
        self._merged: set[str] = set()           # those of them that the automaton lacks

    def _outputs(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all ``words``; what the automaton and the merges gave before is remembered."""
        known = self._known
        if len(known) > REMEMBERED:              # the older half goes
            for word in list(known)[:len(known) - REMEMBERED // 2]:
                del known[word]
                self._merged.discard(word)
        new, long = list(words.difference(known)), {}
        for word, place in zip(new, self.automaton.find(new).tolist()):
            if place >= 0:
                ids = self.automaton.output(place)
            else:
                ids = np.array(self.merger.word(word), "<u4").tobytes()
                if len(word) <= LONG:
                    self._merged.add(word)
            (known if len(word) <= LONG else long)[word] = ids
        return known | long if long else known

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        plans, words = [], set()
        for text in texts:
            plan: list = []
            for i, part in enumerate(self.merger.parts(text)):
                if i % 2:
                    plan.append(np.array([self.merger.special[part]], "<u4").tobytes())
                elif part:
                    plan.append(self.merger.words(part))
                    words.update(plan[-1])
            plans.append(plan)
        known = self._outputs(words)
        return [b"".join(p if isinstance(p, bytes) else b"".join([known[w] for w in p])
                         for p in plan) for plan in plans]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        spelled = self.merger.token_bytes
        return b"".join([spelled[i] for i in np.frombuffer(ids, "<u4").tolist()]) \
            .decode("utf-8", "replace")


# ---- on Spark ------------------------------------------------------------

@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    return Merger(path)


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Word counts, summed within the task as far as a bounded table allows."""
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["word", "n"])
    counts: Counter = Counter()
    merger = _merger(vocabulary)
    for b in pieces(batches, "text"):
        for text in b.column("text").to_pylist():
            for part in merger.parts(text or "")[::2]:
                counts.update(merger.words(part))
        if len(counts) > REMEMBERED:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def frequent_words(docs: DataFrame, max_words: int = MAX_WORDS, text_col: str = "text",
                   vocabulary: str | None = None) -> list[str]:
    """The most frequent words of all texts up to ``LONG`` characters: at most ``max_words``.

    Counts are split into 16 classes per doubling, and a class into 1024 parts
    by hash.  Whole classes are taken from the top on, then whole parts of the
    class that does not fit, so neither the driver nor a task sorts or holds
    more than ``max_words``, and equally frequent words do not leave the lexicon
    empty.  Words that occur once, and those of over ``LONG`` characters, are in
    no class, which bounds the lexicon's bytes too.
    """
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    counts = keep_table(
        docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
        .mapInArrow(lambda batches: _counted(batches, vocabulary), "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n"))
        .where((F.col("n") > 1) & (F.length("word") <= LONG))
        .withColumn("class", F.floor(F.log2("n") * 16).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("word"), F.lit(1024)).cast("int")), "word-counts")

    def fitting(sizes: DataFrame, room: int) -> tuple[list, object, int]:
        """The leading groups that fit, the first that does not, and the room left."""
        taken = []
        for group, n in sizes.collect():
            if n > room:
                return taken, group, room
            taken.append(group)
            room -= n
        return taken, None, room

    _, border, room = fitting(
        counts.groupBy("class").count().orderBy(F.desc("class")), max_words)
    wanted = F.col("class") > (F.lit(-1) if border is None else F.lit(border))
    if border is not None:
        parts, _, _ = fitting(counts.where(F.col("class") == border).groupBy("part").count()
                              .orderBy("part"), room)
        wanted |= (F.col("class") == border) & F.col("part").isin(parts)
    return sorted(r["word"] for r in counts.where(wanted).select("word").collect())


def build_lexicon(docs: DataFrame, vocabulary: str, max_words: int = MAX_WORDS,
                  text_col: str = "text") -> bytes:
    """The automaton of the corpus's frequent words."""
    merger = _merger(vocabulary)
    words = frequent_words(docs, max_words, text_col, vocabulary)
    return compile_words({w: merger.word(w) for w in words})


_ENCODERS: dict[int, Encoder] = {}


def _encoder(block, vocabulary: str) -> Encoder:
    """This worker's encoder for a broadcast automaton (one at a time is kept)."""
    digest = hashlib.md5(block.value).digest()
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = Encoder(_merger(vocabulary), Automaton(block.value))
    return _ENCODERS[digest]


def encode(docs: DataFrame, vocabulary: str, max_words: int = MAX_WORDS,
           id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens and digests of every row; with ``outputs`` the ids and the decoded text."""
    spark = docs.sparkSession
    block = spark.sparkContext.broadcast(build_lexicon(docs, vocabulary, max_words, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(block, vocabulary)
        for b in pieces(batches, "text"):
            ids = encoder.encode(t or "" for t in b.column("text").to_pylist())
            decoded = [encoder.decode(i) for i in ids]
            columns = [
                b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
            if outputs:
                columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if outputs:
        schema += ", ids binary, decoded string"
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.select(*pairs(id_col, text_col)).mapInArrow(run, schema)
