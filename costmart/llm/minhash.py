"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash needs two permutations of the 2^32 hash positions: the first
scatters a text's shingles, the second ranks them after a circular shift; the
k-th signature coordinate is the least rank under a shift by k steps.  Bands of
coordinates are hashed to buckets; texts that share a bucket are candidates,
and a candidate pair is linked only if the exact Jaccard similarity of the
full shingle sets reaches the threshold.

Work follows the number of texts, not of pairs:

* Texts with equal word sequences become one representative first.
* Round 1 verifies each bucket member against the bucket's smallest id.
* Linked texts get a component.  A bucket whose members lie in one component
  is settled, and so is one with two members.
* Round 2 takes the other buckets in blocks of bounded size; a task compares
  two blocks inside memory, and returns only links that join components (at
  most one less than the texts it read), never all pairs.

Every pair that shares a bucket is thus compared exactly or already connected,
so the components are those of all links among candidates.  A pair at the
threshold misses all buckets with probability (1 - t^rows)^bands, under
one in a million at the defaults.

Defined cases: a null text or one without words has an empty set and is linked
with nothing, not even with another empty text; a text with fewer words than a
shingle has one shingle, its whole sequence; ties do not arise, as the
smallest id names a component; rows that repeat an id and a text are one
document; a null id is a document of its own class of ids (the smallest); an
empty table gives an empty result; ``components`` ignores other columns,
``drop_near_duplicates`` carries all of them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costmart.llm.common import WORD, keep_table, lower_az, pairs, pieces

#: Bands and rows per band: a pair of similarity 0.85 is missed with probability 7e-7.
BANDS, ROWS = 30, 6
#: The same for 0.8: probability 2e-7.
BANDS_80, ROWS_80 = 40, 5
#: Most texts and shingles of a block in round 2; a task holds two blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 1 << 20
#: Fixed odd multipliers of the hash steps (the golden ratio in 64 and 32 bits, and its powers).
MIX64 = np.uint64(0x9E3779B97F4A7C15)
MIX32 = np.uint32(0x9E3779B1)
CACHE_WORDS = 300_000


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self._hashes: dict[str, int] = {}

    def word_hashes(self, words: list[str]) -> np.ndarray:
        known = self._hashes
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out = np.array([known[w] for w in words], np.uint64)
        if len(known) > CACHE_WORDS:
            known.clear()
        return out

    def shingles(self, words: list[str]) -> np.ndarray:
        """Sorted distinct hashes of the ``width``-word shingles."""
        if not words:
            return np.zeros(0, np.uint64)
        h = self.word_hashes(words)
        n = max(1, len(h) - self.width + 1)
        total = np.full(n, np.uint64(min(len(h), self.width)))
        for k in range(min(len(h), self.width)):
            total = _scramble(total * MIX64 + h[k:k + n])
        return np.unique(total)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * MIX64
    return x ^ (x >> np.uint64(29))


def first_permutation(x: np.ndarray) -> np.ndarray:
    """Position of a hash on the circle of 2^32, by a bijection of 32-bit numbers."""
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


def second_permutation(x: np.ndarray) -> np.ndarray:
    """Rank of a position, by another bijection of 32-bit numbers (works in place)."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: the least rank of the shingles under each circular shift."""
    shifts = (np.arange(size, dtype=np.uint32) * MIX32)[:, None]
    at = first_permutation(shingles)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 4096):       # bounded memory for very long texts
        out = np.minimum(out, second_permutation(at[None, i:i + 4096] + shifts).min(axis=1))
    return out


def band_hashes(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit bucket key per band."""
    total = np.arange(bands, dtype=np.uint64)
    for column in coordinates.reshape(bands, rows).T.astype(np.uint64):
        total = _scramble(total * MIX64 + column)
    return total.view(np.int64)


def _lowered(texts: pa.Array) -> list[list[str]]:
    return [WORD.findall(t) if t else [] for t in lower_az(texts).to_pylist()]


def _signed(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in pieces(batches, "text"):
            digests, sizes, keys = [], [], []
            for words in _lowered(b.column("text")):
                found = shingler.shingles(words)
                digests.append(hashlib.md5(" ".join(words).encode()).digest() if words else None)
                sizes.append(len(found))
                keys.append(band_hashes(signature(found, bands * rows), bands, rows)
                            if words else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "bands"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in pieces(batches, "text"):
            sets = [shingler.shingles(w).tobytes() for w in _lowered(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())],
                                             ["id", "shingles"])
    return run


def _linked(percent: int):
    """Pairs of sets (a, b) that reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _block_links(percent: int):
    """Links inside or between two blocks of a bucket that join different components."""
    def run(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("id").to_pylist(), np.int64)
        comp = np.unique(group.column("comp").to_pylist(), return_inverse=True)[1]
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[token] > 1               # a shingle of one text meets no other
        owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        width = 2048
        for first in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            a, b = np.searchsorted(token, [first, first + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], token[a:b] - first] = 1
            common += part @ part.T
        union = sizes[:, None] + sizes[None, :] - common
        near = 100 * common >= percent * union
        # Join components greedily: only links that connect something new are returned.
        root = list(range(int(comp.max()) + 1))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out_a, out_b = [], []
        for i in range(len(sets)):
            partners = np.flatnonzero(near[i, :i])
            seen: set[int] = set()
            for j in partners.tolist():
                if comp[j] in seen:
                    continue
                seen.add(comp[j])
                p, q = find(comp[i]), find(comp[j])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out_a.append(int(min(ids[i], ids[j])))
                    out_b.append(int(max(ids[i], ids[j])))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
    return run


def connect(links: DataFrame, name: str = "components") -> DataFrame:
    """id, comp: the smallest id reachable, for every id in ``links`` (a, b).

    Each step points every node to the smallest label among itself and its
    neighbours, and the label's own label (pointer jumping), so the number of
    steps grows with the logarithm of the longest chain.  Labels are
    aggregated before they are joined; a node with very many links is summed
    up in the map tasks.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))
    both = keep_table(both.distinct(), f"{name}-links")
    labels = keep_table(both.groupBy(F.col("a").alias("id"))
                        .agg(F.least(F.min("b"), F.col("a")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        reach = (both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id"))
                 .agg(F.min("comp").alias("near")))
        near = labels.join(reach, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        # A lower label also lowers the label it replaces (hooking), then labels jump.
        hook = near.where("low < comp").groupBy(F.col("comp").alias("id")).agg(F.min("low").alias("hook"))
        lowered = near.join(hook, "id", "left").select(
            "id", F.col("comp").alias("old"), F.least("low", F.coalesce("hook", "low")).alias("new"))
        lowered = keep_table(lowered, f"{name}-{step}-low")
        jump = lowered.select(F.col("id").alias("new"), F.col("new").alias("jump"))
        labels = keep_table(
            lowered.join(jump, "new", "left")
            .select("id", "old", F.least("new", F.coalesce("jump", "new")).alias("comp")),
            f"{name}-{step}")
        if labels.where("comp < old").isEmpty():
            return labels.select("id", "comp")
        labels = labels.select("id", "comp")


def _buckets(reps: DataFrame) -> DataFrame:
    """band, key, id of representatives in buckets with at least two, with size and least id."""
    rows = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    big = (rows.groupBy("band", "key")
           .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("texts"),
                F.sum("n_shingles").alias("shingles")).where("texts > 1"))
    return rows.join(big, ["band", "key"])


def components(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = BANDS,
               rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Texts are linked whose shingle sets have 100 * common >= ``percent`` * all.
    """
    texts = docs.select(*pairs(id_col, text_col))
    signed = keep_table(texts.mapInArrow(
        _signed(width, bands, rows),
        "doc_id long, digest binary, n_shingles long, bands array<long>"), "signatures")
    # One representative per word sequence; copies are summed up before the shuffle.
    least = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"))
    least = keep_table(least, "representatives")
    reps = (signed.join(least, (signed.digest == least.digest) & (signed.doc_id == least.id))
            .select("id", "n_shingles", "bands").dropDuplicates(["id"]))
    members = keep_table(_buckets(reps), "buckets")
    wanted = members.select("id").distinct()
    sets = keep_table(
        texts.join(wanted, texts.doc_id == wanted.id).select("id", "text")
        .mapInArrow(_sets(width), "id long, shingles binary").dropDuplicates(["id"]),
        "shingle-sets")
    # Round 1: members against the least id of their bucket.
    stars = members.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")) \
        .distinct()
    checked = (stars.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
               .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
               .select("a", "b", "x", "y"))
    links = keep_table(checked.mapInArrow(_linked(percent), "a long, b long"), "links-1")
    labels = connect(links, "round-1")
    # Round 2: buckets of three or more whose members are not all in one component.
    known = (members.where("texts > 2").join(labels, "id", "left")
             .withColumn("comp", F.coalesce("comp", "id")))
    mixed = (known.groupBy("band", "key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
             .where("c1 < c2").select("band", "key"))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS),
                        F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_ = (known.join(mixed, ["band", "key"])
             .withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
             # A block meets itself and every other one: pairs of blocks, not of texts.
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("id", "comp", "band", "key", F.least("block", "other").alias("p"),
                     F.greatest("block", "other").alias("q")))
    more = (open_.join(sets, "id").groupBy("band", "key", "p", "q")
            .applyInArrow(_block_links(percent), "a long, b long"))
    more = keep_table(more.distinct(), "links-2")
    if not more.isEmpty():
        labels = connect(links.unionByName(more), "round-2")
    named = (least.join(labels, "id", "left")
             .select("digest", F.coalesce("comp", "id").alias("component_id")))
    out = signed.select("doc_id", "digest", "n_shingles").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles",
                      F.when(F.col("digest").isNull(), F.col("doc_id"))
                      .otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80,
                         bands: int = BANDS_80, rows: int = ROWS_80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one per component: its smallest id."""
    kept = keep_table(components(docs, width, percent, bands, rows, id_col, text_col)
                      .where("kept").select(F.col("doc_id").alias("kept_id")).distinct(),
                      "near-kept")
    columns = docs.columns
    joined = docs.join(kept, docs[f"`{id_col}`"].cast("long").eqNullSafe(kept["kept_id"]),
                       "left_semi")
    return joined.select(*[F.col(f"`{c}`") for c in columns])
