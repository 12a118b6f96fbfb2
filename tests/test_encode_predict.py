"""C7 ordinal codes and M1–M8."""
import pytest
from pyspark.sql import functions as F

from costmart.operators import encode, predict


def test_codes_dense_sorted_with_null(spark):
    vals = ["b", "a", None, "c", "a", "nan", "Z"]
    df = spark.createDataFrame([(v,) for v in vals], "d string")
    codes = {r.value: r.code for r in encode.fit_codes(df, "d").collect()}
    assert codes == {"Z": 0, "a": 1, "b": 2, "c": 3, "nan": 4}
    out = encode.apply_codes(df, encode.fit_codes(df, "d"), "d").collect()
    assert sorted((r.d, r.d_encoded) for r in out if r.d) == sorted(
        (v, codes[v]) for v in vals if v)
    assert [r.d_encoded for r in out if r.d is None] == [4]


def test_codes_many_partitions_match_brute_force(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 1237).cast("string").alias("v"))
    df = df.repartition(13)
    got = {r.value: r.code for r in encode.fit_codes(df, "v").collect()}
    want = {v: i for i, v in enumerate(sorted({str(i * 7919 % 1237) for i in range(5000)}))}
    assert got == want


def test_require_rows(spark):
    with pytest.raises(ValueError):
        predict.require_rows(spark.range(99))
    predict.require_rows(spark.range(100))


def test_split_disjoint_complete_stable(billing_small):
    from costmart.sources.fixture import row_key
    b = billing_small.withColumn("row_key", row_key())
    s1 = predict.hash_split(b, "row_key")
    s2 = predict.hash_split(b.repartition(5), "row_key")
    n = b.count()
    tr = s1.where("is_train").count()
    assert 0.7 * n < tr < 0.9 * n
    a = sorted((r.row_key, r.is_train) for r in s1.select("row_key", "is_train").collect())
    c = sorted((r.row_key, r.is_train) for r in s2.select("row_key", "is_train").collect())
    assert a == c and len({k for k, _ in a}) == n


def test_quality_band(spark):
    df = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (0.1,)], "r2 double")
    got = [r[0] for r in df.select(predict.quality_band("r2")).collect()]
    assert got == ["good", "fair", "moderate", "low"]


def test_metrics_perfect_and_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "actual double, prediction double")
    m = predict.metrics(df).first()
    assert (m.mae, m.rmse, m.r2, m.quality) == (0.0, 0.0, 1.0, "good")
    const = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "actual double, prediction double")
    c = predict.metrics(const).first()
    assert c.r2 == 0.0 and c.mae == 1.0


def test_forest_end_to_end(billing_small):
    from costmart.schema import ENCODED
    from costmart.sources.fixture import row_key
    b = encode.encode(billing_small.withColumn("row_key", row_key()), ENCODED)
    t = predict.feature_table(predict.hash_split(b, "row_key"), keep=["row_key", "is_train"])
    model = predict.fit_forest(t.where("is_train"), num_trees=5, max_depth=3)
    p = predict.predict(model, t.where("not is_train"), keep=["row_key"])
    m = predict.metrics(p).first()
    assert m.n == t.where("not is_train").count() and m.mae > 0
    s = predict.sample_pairs(p, "row_key", 50)
    assert s.count() == 50
    line = predict.ideal_line(s).first()
    assert line.lo <= line.hi


def test_r2_does_not_cancel(spark):
    kind = "actual double, prediction double"
    same = predict.metrics(spark.createDataFrame([(0.1, 0.2)] * 7, kind)).first()
    assert (same.r2, same.quality) == (0.0, "low")
    exact = predict.metrics(spark.createDataFrame([(0.1, 0.1)] * 7, kind)).first()
    assert (exact.r2, exact.quality) == (1.0, "good")
    big = [(1e9 + i, 1e9 + i + 0.1) for i in range(3)]
    assert predict.metrics(spark.createDataFrame(big, kind)).first().r2 == 0.985


def test_metrics_text_and_counts(spark):
    df = spark.createDataFrame([(1000.0, 3000.0), (5000.0, 4000.0)], "actual double, prediction double")
    t = predict.metrics_display(predict.metrics(df)).first()
    assert (t.n, t.mae_text, t.rmse_text, t.r2_text) == (2, "Rp 1,500", "Rp 1,581", "0.3750")
    split = spark.createDataFrame([(True,), (True,), (False,)], "is_train boolean")
    assert tuple(predict.data_counts(split).first()) == (3, 2, 1, 6)


def test_codes_join_back(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i % 5}") for i in range(100)], "id int, d string")
    codes = encode.fit_codes(df, "d")
    few = encode.apply_codes(df, codes, "d")
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(encode, "BROADCAST_CODES", 2)
    many = encode.apply_codes(df, codes, "d")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.select(few.columns).collect()))


def test_main_payer_of_every_key(spark):
    from costmart.operators.aggregates import mode_or_default
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", None), ("x", None), ("x", None),
                                ("y", None), (None, "a")], "k string, v string")
    assert sorted(map(tuple, mode_or_default(df, ["k"], "v", "m", "none").collect())) == \
        [("x", "a"), ("y", "none")]


def test_forest_report_tells_a_forest_from_a_constant(spark):
    from pyspark.sql import functions as F
    from costmart.operators import predict as P

    class Constant:
        def transform(self, rows):
            return rows.withColumn("prediction", F.lit(50.0))

    rows = [(f"k{i}", i % 5 != 0, float(i % 12), float(i % 7), i % 4, float(40 + i * 37 % 23))
            for i in range(400)]
    table = spark.createDataFrame(
        rows, "row_key string, is_train boolean, bulan double, hari double, poli_encoded int,"
              " label double")
    model = P.fit_forest(table.where("is_train"), ["bulan", "hari"], num_trees=10, max_depth=6)
    got = P.forest_report(model, table, "poli_encoded").collect()
    assert len(got) == 1 and got[0]["n"] == 80
    assert got[0]["learns"] and got[0]["band_fits"]
    flat = P.forest_report(Constant(), table, "poli_encoded").first()
    assert not flat["learns"] and flat["band_fits"]
    none = P.forest_report(model, table.limit(0), "poli_encoded").first()
    assert (none["n"], none["learns"], none["near_baseline"]) == (0, False, False)


def test_forest_grows_in_groups_of_trees(spark):
    """A kept row holds one count for each tree of a group, not of the whole forest."""
    from costmart.operators import predict as P
    rows = [(float(i % 12), float(i % 7), float(i * 37 % 23)) for i in range(300)]
    table = spark.createDataFrame(rows, "a double, b double, label double")
    model = P.fit_forest(table, ["a", "b"], num_trees=25, max_depth=9)
    forests = [s for s in model.stages if hasattr(s, "trees")]
    sizes = [f.getNumTrees for f in forests]
    assert sum(sizes) == 25 and max(sizes) <= P.TREE_GROUP and min(sizes) > 1
    assert not any(f.getCacheNodeIds() for f in forests)
    assert len({t.toDebugString for f in forests for t in f.trees}) > 20
    found = model.transform(table).limit(5).collect()
    assert set(found[0].asDict()) == {"a", "b", "label", "features", "prediction"}
    for r in found:
        trees = [t.predict(r["features"]) for f in forests for t in f.trees]
        assert r["prediction"] == pytest.approx(sum(trees) / 25)


def _forest_rows(spark, n, parts=3):
    rows = [(float(i * 7 % 12), float(i * i % 31), float(i * 37 % 23 + i * 7 % 12)) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, label double").repartition(parts)


def test_forest_reads_the_rows_once_a_level_for_all_trees(spark, monkeypatch):
    """Passes follow the depth, not the number of trees, and a kept row holds nothing per tree."""
    from costmart.operators import forest as R
    from costmart.operators import predict as P
    passes, sums = [], R.node_sums

    def watched(blocks, grown, level, trees, seed):
        passes.append((level, len(trees)))
        kept = blocks.selectExpr("sum(n)", "sum(length(bins) + length(label))").first()
        assert tuple(kept) == (400, 400 * (2 + 8))
        return sums(blocks, grown, level, trees, seed)

    monkeypatch.setattr(R, "node_sums", watched)
    model = P.fit_forest(_forest_rows(spark, 400), ["a", "b"], num_trees=30, max_depth=4)
    assert passes == [(level, 30) for level in range(5)]
    assert [s.getNumTrees for s in model.stages if hasattr(s, "trees")] == [30]


def test_forest_passes_are_cut_by_memory_only(spark, monkeypatch):
    from costmart.operators import forest as R
    rows = _forest_rows(spark, 400)
    whole = R.grow(rows, ["a", "b"], 6, 5, 16, 7, 100)
    monkeypatch.setattr(R, "PASS_BYTES", 3000)
    cut = R.grow(rows, ["a", "b"], 6, 5, 16, 7, 4)
    same = [(x == y).all() for s, t in zip(whole.nodes, cut.nodes) for x, y in zip(s, t)]
    assert all(same) and len(same) == 36


def test_forest_trees_match_brute_force(spark):
    """Each tree against a plain recursion over the same bootstrap, and Spark's own scoring."""
    import numpy as np
    from costmart.operators import forest as R
    from costmart.operators import predict as P
    rows, depth, seed = _forest_rows(spark, 300).cache(), 8, 11
    rows.count()
    model = P.fit_forest(rows, ["a", "b"], num_trees=3, max_depth=depth, max_bins=16, seed=seed)
    cuts = R.find_cuts(rows, ["a", "b"], 16)
    assert len(cuts[0]) == 11 and 10 <= len(cuts[1]) <= 15      # twelve values; quantiles of 16
    blocks = R.write_blocks(rows, ["a", "b"], cuts, 0.0).orderBy("part").collect()

    def value(x, y, w, at, left):
        mean = (w * y).sum() / w.sum()
        best = (1e-9, None)
        for f in range(2) if left else ():
            for c in cuts[f]:
                go = x[f] <= c
                if w[go].sum() and w[~go].sum():
                    gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (go, ~go)) \
                        - (w * y).sum() ** 2 / w.sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, c, go))
        if best[1] is None:
            return mean
        f, c, go = best[1]
        side = go if at[f] <= c else ~go
        return value(x[:, side], y[side], w[side], at, left - 1)

    given = rows.collect()
    for t, tree in enumerate(model.stages[-1].trees):
        w = np.concatenate([R.bootstrap(b.n, seed, t, b.part, b.seq) for b in blocks]).astype(float)
        bins = np.concatenate([np.frombuffer(b.bins, np.uint8).reshape(2, -1) for b in blocks], 1)
        y = np.concatenate([np.frombuffer(b.label) for b in blocks])
        x = np.stack([np.append(c, 1e9)[k] for c, k in zip(cuts, bins)])   # a value of each bin
        for r in given[:25]:
            from pyspark.ml.linalg import Vectors
            assert tree.predict(Vectors.dense(r.a, r.b)) == pytest.approx(
                value(x, y, w, (r.a, r.b), depth))
    ours = model.transform(rows).select("a", "b", "prediction").collect()
    spark_own = model.stages[-1].transform(model.stages[0].transform(rows))
    theirs = spark_own.select("a", "b", "prediction").collect()
    assert sorted(map(tuple, ours)) == [pytest.approx(tuple(r)) for r in sorted(map(tuple, theirs))]


def test_forest_bootstrap_is_poisson():
    import numpy as np
    from costmart.operators import forest as R
    counts = R.bootstrap(400_000, 5, 1, 2, 3)
    assert (counts == R.bootstrap(400_000, 5, 1, 2, 3)).all()
    assert (counts != R.bootstrap(400_000, 5, 2, 2, 3)).any()
    share = np.bincount(counts, minlength=6)[:6] / len(counts)
    assert share == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613, 0.0153, 0.0031], abs=0.003)
    assert counts.mean() == pytest.approx(1, abs=0.01) and counts.max() > 6


def test_forest_of_odd_rows(spark):
    """One label, one row, values not seen or missing when scored; nulls in training are refused."""
    from costmart.operators import predict as P
    kind = "a double, b double, label double"
    for rows in ([(1.0, 2.0, 5.0)], [(float(i), 0.0, 0.1) for i in range(50)]):
        model = P.fit_forest(spark.createDataFrame(rows, kind), ["a", "b"], 5, 3)
        odd = spark.createDataFrame([(None, 2.0, 0.0), (float("nan"), -1e9, 0.0), (1e9, 1.0, 0.0)], kind)
        got = [r.prediction for r in model.transform(odd).collect()]
        assert got == [pytest.approx(rows[0][2])] * 3
    model = P.fit_forest(spark.createDataFrame([(float(i), 0.0, float(i > 20)) for i in range(50)], kind),
                         ["a", "b"], 5, 3)
    odd = spark.createDataFrame([(None, 2.0, 0.0), (-1.0, None, 0.0)], kind)
    got = [r.prediction for r in model.transform(odd).collect()]
    own = model.stages[-1].transform(model.stages[0].transform(odd))
    assert got == [pytest.approx(r.prediction) for r in own.collect()] and got[0] > 0.9 > 0.1 > got[1]
    for bad in ([(1.0, 2.0, None)], [(None, 2.0, 1.0)], [(float("nan"), 2.0, 1.0)]):
        with pytest.raises(Exception, match="MUST NOT be"):
            P.fit_forest(spark.createDataFrame(bad + [(0.0, 0.0, 0.0)], kind), ["a", "b"], 3, 2)
