"""A random forest of regression trees, grown and applied in blocks of rows.

The trees are those of ``pyspark.ml``'s regressor: a bootstrap of the rows for
each tree (a Poisson count per row), all features at every node, bins of the
feature values, the split of the largest variance gain, level by level. Spark
keeps an object for each row and adds it to its node's sums one row, tree and
feature at a time; here the rows are written once as blocks of binned columns,
and a task adds up a block's columns for one tree after the other. A row takes
one byte per feature and its label; bootstrap counts and node ids are made
anew in each pass, from the block's number and the nodes found so far.

A pass makes one table of sums for each tree, node and task. Its size follows
the nodes, the bins and the tasks (two for each core), not the rows.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costmart.session import shared_dir

#: Rows of a block, and blocks of a file (Spark's reader holds a file's blocks at once).
BLOCK_ROWS, FILE_BLOCKS = 1 << 16, 32
#: Bytes of sums that a task holds in a pass, and nodes whose sums travel together.
PASS_BYTES, NODE_GROUP = 64 << 20, 64
#: Levels walked with one comparison of a column per node; below them each row looks its node up.
WIDE_LEVELS = 5
#: Gains and variances below this share of a node's own are rounding.
ROUNDING = 1e-12

BLOCKS = "part long, seq long, n long, bins binary, label binary"
SUMS = "tree int, chunk int, part long, sums binary"
FOUND = "tree int, slot int, count double, total double, square double, feature int, cut int, gain double"


class Forest:
    """The trees on the driver: ``nodes[tree][level]`` is a record array of 2^level nodes."""

    NODE = np.dtype([("alive", "?"), ("count", "f8"), ("total", "f8"), ("square", "f8"),
                     ("feature", "i4"), ("cut", "i4"), ("gain", "f8")])

    def __init__(self, num_trees: int, max_depth: int, cuts: list[np.ndarray], centre: float):
        self.max_depth, self.cuts, self.centre = max_depth, cuts, centre
        self.nodes = [[np.zeros(1 << level, self.NODE) for level in range(max_depth + 1)]
                      for _ in range(num_trees)]
        for tree in self.nodes:
            tree[0]["alive"] = True
            for level in tree:
                level["feature"] = -1

    def splits(self, tree: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(feature, last bin that goes left) of the nodes of each level above ``depth``."""
        return [(np.maximum(x["feature"], 0).astype(np.uint16),
                 np.where(x["feature"] < 0, 0xFFFF, x["cut"]).astype(np.uint16))
                for x in self.nodes[tree][:depth]]

    def values(self, tree: int) -> np.ndarray:
        """The prediction at each place of the last level (a leaf above it holds all below it)."""
        found = np.zeros(1)
        for level in self.nodes[tree]:
            if len(level) > 1:
                found = np.repeat(found, 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.where(level["count"] > 0, level["total"] / level["count"], found)
        return found + self.centre

    def predictor(self):
        """A function from the features' columns to the mean of the trees' predictions."""
        cuts, trees = self.cuts, [(self.splits(t, self.max_depth), self.values(t))
                                  for t in range(len(self.nodes))]

        def mean(columns: Sequence[np.ndarray]) -> np.ndarray:
            bins, total = binned(columns, cuts), np.zeros(len(columns[0]))
            for splits, values in trees:
                total += values.take(places(bins, splits))
            return total / len(trees)

        return mean

    def rows(self, tree: int) -> Iterator[tuple]:
        """The tree's nodes, parents before children and left before right: id, prediction,
        impurity, (count, sum, sum of squares), gain, left and right id, feature, threshold."""
        levels, number = self.nodes[tree], iter(range(1 << (self.max_depth + 1)))

        def below(level: int, at: int) -> list[tuple]:
            x, me = levels[level][at], next(number)
            n, mean = float(x["count"]), float(x["total"] / x["count"]) if x["count"] else 0.0
            spread = max(float(x["square"] / n) - mean * mean, 0.0) if n else 0.0
            value, f = mean + self.centre, int(x["feature"])
            stats = [n, value * n, (spread + value * value) * n]
            if f < 0:
                return [(me, value, spread, stats, int(n), -1.0, -1, -1, -1, [], -1)]
            left, right = below(level + 1, 2 * at), below(level + 1, 2 * at + 1)
            return [(me, value, spread, stats, int(n), float(x["gain"]), left[0][0], right[0][0],
                     f, [float(self.cuts[f][x["cut"]])], -1), *left, *right]

        yield from below(0, 0)


def bin_type(cuts: Sequence[np.ndarray]) -> type:
    return np.uint8 if max(map(len, cuts)) < 256 else np.uint16


def binned(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """One row of bin numbers for each feature; bin i holds values up to ``cuts[i]``, the last
    one (NaN too) those above all."""
    return np.stack([np.searchsorted(c, x) for x, c in zip(columns, cuts)]).astype(bin_type(cuts))


def places(bins: np.ndarray, splits: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each row's place, 0 .. 2^len(splits) - 1, on the level below ``splits``."""
    n = bins.shape[1]
    at = np.zeros(n, np.uint8)
    for feature, cut in splits[:WIDE_LEVELS]:
        right = np.zeros(n, bool)
        for node, (f, c) in enumerate(zip(feature.tolist(), cut.tolist())):
            if c < 0xFFFF:
                right |= (at == node) & (bins[f] > bins.dtype.type(c))
        at = 2 * at + right
    at = at.astype(np.intp)
    flat, row = bins.reshape(-1), np.arange(n)
    for feature, cut in splits[WIDE_LEVELS:]:
        cell = (feature.astype(np.intp) * n).take(at)
        cell += row
        right = flat.take(cell) > cut.take(at)
        at += at
        at += right
    return at


_EDGES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)]) * 65536
_COUNTS = np.searchsorted(_EDGES, np.arange(65536), side="right").astype(np.uint8)
_MIXED = np.zeros(65536, bool)
_MIXED[_EDGES[_EDGES < 65536].astype(int)] = True


def bootstrap(n: int, *seed: int) -> np.ndarray:
    """Poisson(1) counts. 16 random bits settle all but the few cells that an edge of the
    distribution runs through; those get a finer number."""
    random = np.random.Generator(np.random.SFC64(np.random.SeedSequence(seed)))
    cells = random.integers(0, 65536, n, np.uint16)
    counts = _COUNTS.take(cells)
    finer = np.flatnonzero(_MIXED.take(cells))
    counts[finer] = np.searchsorted(_EDGES, cells[finer] + random.random(len(finer)), side="right")
    return counts


def find_cuts(rows: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Per feature the values between its bins: halfway between neighbours where at most
    ``max_bins`` values occur, else quantiles of all rows."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").alias("x"))
                                            for i, c in enumerate(features)])).alias("p"))
    first = F.row_number().over(Window.partitionBy("f").orderBy("x"))
    values: dict[int, list[float]] = {i: [] for i in range(len(features))}
    for r in (pairs.select("p.*").where("x IS NOT NULL").distinct()
              .withColumn("k", first).where(F.col("k") <= max_bins + 1).collect()):
        values[r.f].append(r.x)
    many = [i for i, v in values.items() if len(v) > max_bins]
    shares = [k / max_bins for k in range(1, max_bins)]
    found = rows.agg(F.lit(0), *[F.percentile_approx(F.col(f"`{features[i]}`"), shares, 10_000)
                                 for i in many]).first()[1:]
    cuts = {i: np.unique(np.array(q, float)) for i, q in zip(many, found)}
    for i, v in values.items():
        if i not in cuts:
            v = np.sort(np.array(v, float))
            cuts[i] = v[:-1] + (v[1:] - v[:-1]) / 2
    return [cuts[i] for i in range(len(features))]


def write_blocks(rows: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray],
                 centre: float) -> DataFrame:
    """The rows as blocks: bin numbers feature by feature, and the labels less ``centre``."""
    def block(part: int, seq: int, batches: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(batches)
        columns = [table.column(i).to_numpy() for i in range(len(features) + 1)]
        if table.column(len(features)).null_count or np.isnan(columns[-1]).any():
            raise ValueError("Labels MUST NOT be Null or NaN")
        if any(table.column(i).null_count for i in range(len(features))) or not all(
                np.isfinite(c).all() for c in columns[:-1]):
            raise ValueError("Vector values MUST NOT be NaN or Infinity")
        return {"part": part, "seq": seq, "n": table.num_rows,
                "bins": binned(columns[:-1], cuts).tobytes(),
                "label": (columns[-1] - centre).tobytes()}

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()),
                            ("bins", pa.binary()), ("label", pa.binary())])
        part, seq, kept, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                piece = batch.slice(start, BLOCK_ROWS - size)
                kept.append(piece)
                size, start = size + piece.num_rows, start + piece.num_rows
                if size == BLOCK_ROWS:
                    yield pa.RecordBatch.from_pylist([block(part, seq, kept)], schema)
                    seq, kept, size = seq + 1, [], 0
        if size:
            yield pa.RecordBatch.from_pylist([block(part, seq, kept)], schema)

    path = shared_dir(rows.sparkSession, "forest-blocks")
    plain = rows.select(*[F.col(f"`{c}`").cast("double") for c in [*features, "label"]])
    (plain.mapInArrow(blocks, BLOCKS).write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path))
    return rows.sparkSession.read.schema(BLOCKS).parquet(path)


def node_sums(blocks: DataFrame, forest: Forest, level: int, trees: Sequence[int],
              seed: int) -> DataFrame:
    """(tree, chunk, part, sums) of the nodes of ``level``: count, sum and sum of squares of the
    labels of a node, then, above the last level, count and sum in every bin of every feature."""
    sizes = [len(c) + 1 for c in forest.cuts] if level < forest.max_depth else []
    kind, starts = bin_type(forest.cuts), np.cumsum([0, *sizes]).tolist()
    width, n_features = 3 + 2 * starts[-1], len(forest.cuts)
    above = {t: forest.splits(t, level) for t in trees}
    slots = {t: np.where(x := forest.nodes[t][level]["alive"], np.cumsum(x) - 1, -1) for t in trees}

    def add(sums: np.ndarray, tree: int, bins: np.ndarray, label: np.ndarray, seeds: tuple) -> None:
        counts = bootstrap(len(label), *seeds)
        drawn = np.flatnonzero(counts)
        bins = bins.take(drawn, axis=1)
        slot = places(bins, above[tree])
        if len(sums) < 1 << level:             # some nodes end above: their rows are not needed
            slot = slots[tree].take(slot)
            kept = np.flatnonzero(slot >= 0)
            slot, bins, drawn = slot.take(kept), bins.take(kept, axis=1), drawn.take(kept)
        count, y = counts.take(drawn).astype(float), label.take(drawn)
        total, nodes = count * y, len(sums)
        for k, weight in enumerate((count, total, total * y)):
            sums[:, k] += np.bincount(slot, weight, nodes)
        for f, (size, start) in enumerate(zip(sizes, starts)):
            cell = slot * size
            cell += bins[f]
            for k, weight in enumerate((count, total)):
                at = 3 + k * starts[-1] + start
                sums[:, at:at + size] += np.bincount(cell, weight, nodes * size).reshape(nodes, size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: np.zeros((int((slots[t] >= 0).sum()), width)) for t in trees}
        for batch in batches:
            for part, seq, n, bins, label in zip(*(batch.column(i) for i in range(5))):
                cells = np.frombuffer(bins.as_buffer(), kind).reshape(n_features, n.as_py())
                labels = np.frombuffer(label.as_buffer(), float)
                for t in trees:
                    add(held[t], t, cells, labels, (seed, t, part.as_py(), seq.as_py()))
        me = TaskContext.get().partitionId()
        for t in trees:
            for chunk, start in enumerate(range(0, len(held[t]), NODE_GROUP)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([chunk], pa.int32()),
                     pa.array([me], pa.int64()),
                     pa.array([held[t][start:start + NODE_GROUP].tobytes()], pa.binary())],
                    names=["tree", "chunk", "part", "sums"])
            held[t] = None

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.coalesce(2 * cores).mapInArrow(run, SUMS)


def best_splits(sums: np.ndarray, sizes: Sequence[int]) -> dict[str, np.ndarray]:
    """Per node the feature and bin that lower the variance most; feature -1 where none does."""
    count, total, square = sums[:, 0], sums[:, 1], sums[:, 2]
    best = {"feature": np.full(len(sums), -1, np.int32), "cut": np.zeros(len(sums), np.int32),
            "gain": np.zeros(len(sums))}
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_square = square / count
        variance = mean_square - (total / count) ** 2
        start, every = 3, sum(sizes)
        for f, size in enumerate(sizes):
            n = np.cumsum(sums[:, start:start + size], axis=1)[:, :-1]
            s = np.cumsum(sums[:, every + start:every + start + size], axis=1)[:, :-1]
            start += size
            if size < 2:
                continue
            m, r = count[:, None] - n, total[:, None] - s
            gain = (s * s / n + r * r / m - (total * total / count)[:, None]) / count[:, None]
            gain = np.where((n > 0) & (m > 0), gain, -1.0)
            cut = gain.argmax(axis=1)
            gain = gain[np.arange(len(gain)), cut]
            better = gain > best["gain"]
            for name, x in (("feature", f), ("cut", cut), ("gain", gain)):
                best[name] = np.where(better, x, best[name]).astype(best[name].dtype)
        best["feature"][~((best["gain"] > ROUNDING * variance)
                          & (variance > ROUNDING * mean_square))] = -1
    return best


def found_splits(sums: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The tasks' sums of each node added up (in the order of the tasks), and its best split."""
    width = 3 + 2 * sum(sizes)

    def best(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        parts, added = table.column("sums").combine_chunks(), 0.0
        for i in order.tolist():
            added = added + np.frombuffer(parts[i].as_buffer(), float).reshape(-1, width)
        found, n = best_splits(added, sizes), len(added)
        tree, chunk = (table.column(c)[0].as_py() for c in ("tree", "chunk"))
        return pa.table({"tree": np.full(n, tree, np.int32),
                         "slot": np.arange(n, dtype=np.int32) + np.int32(chunk * NODE_GROUP),
                         "count": added[:, 0].copy(), "total": added[:, 1].copy(),
                         "square": added[:, 2].copy(), **found})

    return sums.groupBy("tree", "chunk").applyInArrow(best, FOUND)


def grow(rows: DataFrame, features: Sequence[str], num_trees: int, max_depth: int, max_bins: int,
         seed: int, most_trees: int) -> Forest:
    """The forest of ``rows`` (columns ``features`` and ``label``), at most ``most_trees`` a pass."""
    centre = rows.agg(F.avg("label")).first()[0]
    if centre is None:
        raise ValueError("a forest needs rows with labels")
    cuts = find_cuts(rows, features, max_bins)
    blocks = write_blocks(rows, features, cuts, centre)
    forest = Forest(num_trees, max_depth, cuts, centre)
    for level in range(max_depth + 1):
        sizes = [len(c) + 1 for c in cuts] if level < max_depth else []
        open_trees = [t for t in range(num_trees) if forest.nodes[t][level]["alive"].any()]
        a_tree = 8 * (3 + 2 * sum(sizes)) << level
        group = max(1, min(most_trees, PASS_BYTES // a_tree))
        for start in range(0, len(open_trees), group):
            trees = open_trees[start:start + group]
            found = found_splits(node_sums(blocks, forest, level, trees, seed), sizes).toArrow()
            take_level(forest, level, found)
    return forest


def take_level(forest: Forest, level: int, found: pa.Table) -> None:
    """Put what a pass found into the forest; a node that is split opens two on the next level."""
    column = {c: found.column(c).to_numpy() for c in found.column_names}
    for t in np.unique(column["tree"]).tolist():
        mine = np.flatnonzero(column["tree"] == t)
        nodes = forest.nodes[t][level]
        at = np.flatnonzero(nodes["alive"])[column["slot"][mine]]
        for name in ("count", "total", "square", "feature", "cut", "gain"):
            nodes[name][at] = column[name][mine]
        if level < forest.max_depth:
            split = at[nodes["feature"][at] >= 0]
            forest.nodes[t][level + 1]["alive"][np.concatenate([2 * split, 2 * split + 1])] = True


def spark_model(spark: SparkSession, forest: Forest, estimator: RandomForestRegressor,
                ) -> RandomForestRegressionModel:
    """The forest as Spark's own model, with the estimator's parameters: written to the shared
    folder in the format of a saved model, and loaded."""
    path, n_trees = shared_dir(spark, "forest-model"), len(forest.nodes)
    given = {p.name: v for p, v in estimator._paramMap.items()}
    usual = {p.name: v for p, v in estimator._defaultParamMap.items()}

    def metadata(kind: str, uid: str, leave: Sequence[str] = (), **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}",
                           "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": uid, "paramMap": {k: v for k, v in given.items() if k not in leave},
                           "defaultParamMap": {k: v for k, v in usual.items() if k not in leave},
                           **more})

    of_forest = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")
    whole = metadata("RandomForestRegressionModel", estimator.uid, numFeatures=len(forest.cuts),
                     numTrees=n_trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    (spark.createDataFrame([(t, metadata("DecisionTreeRegressionModel", f"{estimator.uid}_{t}",
                                         of_forest), 1.0) for t in range(n_trees)],
                           "_1 int, _2 string, _3 double")
     .write.parquet(f"{path}/treesMetadata"))
    nodes = [(t, *row) for t in range(n_trees) for row in forest.rows(t)]
    names = ["treeID", "id", "prediction", "impurity", "impurityStats", "rawCount", "gain",
             "leftChild", "rightChild", "featureIndex", "leftCategoriesOrThreshold", "numCategories"]
    number, long, real = pa.int32(), pa.int64(), pa.float64()
    kinds = [number, number, real, real, pa.list_(real), long, real, number, number, number,
             pa.list_(real), number]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*nodes), kinds)], names)
    (spark.createDataFrame(table)
     .select("treeID", F.struct(*names[1:9], F.struct(*names[9:]).alias("split")).alias("nodeData"))
     .write.parquet(f"{path}/data"))
    return RandomForestRegressionModel.load(path)
