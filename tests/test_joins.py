"""Exact methods agree with the plain product on awkward vectors; approximate ones reach their recall."""

from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from dotforge.operators import evaluate, joins, linalg, sparse
from dotforge.plans import buckets
from dotforge.plans.shared import numbered
from dotforge.sources import matrices

SAMPLE = f"file://{Path(__file__).resolve().parent}/data"


def frames(spark, q, p):
    return matrices.from_memory(spark, q), matrices.from_memory(spark, p)


def data(kind):
    r = np.random.default_rng(3)
    if kind == "signed":
        return r.normal(size=(20, 6)), r.normal(size=(60, 6)) * np.exp(r.normal(size=(60, 1)))
    if kind == "sparse":
        return np.abs(r.normal(size=(20, 8))) * (r.random((20, 8)) < 0.4), np.abs(r.normal(size=(50, 8))) * (r.random((50, 8)) < 0.4)
    if kind == "zeros":
        return np.vstack([np.zeros((1, 3)), r.normal(size=(5, 3))]), np.vstack([np.zeros((2, 3)), r.normal(size=(9, 3))])
    if kind == "copies":
        return np.ones((3, 2)), np.repeat(np.arange(5.0)[:, None], 2, axis=1).repeat(4, axis=0)
    return r.random((4, 1)), r.random((7, 1))


@pytest.mark.parametrize("kind", ["signed", "sparse", "zeros", "copies", "single"])
@pytest.mark.parametrize("theta", [1.0, -0.5])
def test_above_theta(spark, kind, theta):
    q, p = data(kind)
    want = {(i, j) for i, j in np.argwhere(q @ p.T >= theta).tolist() if abs(q[i] @ p[j] - theta) > 1e-9}
    a, b = frames(spark, q.tolist(), p.tolist())
    for method in joins.EXACT:
        got = {(r.query_id, r.probe_id) for r in joins.above_theta(a, b, theta, method).collect()}
        assert {(i, j) for i, j in got if abs(q[i] @ p[j] - theta) > 1e-9} == want, method


@pytest.mark.parametrize("kind", ["signed", "zeros", "copies"])
def test_top_k(spark, kind):
    q, p = data(kind)
    a, b = frames(spark, q.tolist(), p.tolist())
    for k in (3, 100):
        want = None
        for method in joins.EXACT:
            if method.startswith("tanra"):
                continue
            got = sorted((r.query_id, r.rank, r.probe_id) for r in joins.row_top_k(a, b, k, method).collect())
            want = want or got
            assert got == want and len(got) == len(q) * min(k, len(p)), method


def test_sample_matrices(spark):
    q = matrices.read_mma(spark, f"{SAMPLE}/queries.mma").cache()
    p = matrices.read_mma(spark, f"{SAMPLE}/probes.mma", left=False).cache()
    # worked out with numpy from the two files
    assert joins.above_theta(q, p, 0.001, "dense").count() == 323
    assert joins.above_theta(q, p, 0.005, "length").count() == 47
    assert joins.above_theta(q, p, 0.01, "li").count() == 21
    assert joins.above_theta(q, p, 0.035, "tree").count() == 1
    top = joins.row_top_k(q, p, 10, "dense").toPandas()
    assert len(top) == 1500 and abs(top.score.sum() - 1.3478470163062273) < 1e-9
    for how, starts in (({}, [0, 30, 60, 90, 120]), ({"first": 10}, [0, 10, 40, 70, 100, 130]), ({"least": 5}, [0, 5, 10, 15, 20, 26, 31, 36, 42, 47, 52, 57, 62, 67, 72, 79, 86, 91, 98, 105, 111, 116, 124, 129, 134, 139, 144, 149])):
        sizes = [r["count"] for r in buckets.bucketize(p, **how).groupBy("bucket").count().orderBy("bucket").collect()]
        assert sizes == np.diff([*starts, 150]).tolist()
        norms = sorted((r[1] for r in joins.prepare(p, "p").select("pid", "pn").collect()), reverse=True)
        assert buckets.bucket_offsets(norms, **how) == starts


@pytest.mark.parametrize("how", [{}, {"most": 40}, {"first": 7, "least": 3}])
def test_buckets_follow_the_sequential_rule(spark, how):
    m = np.exp(np.random.default_rng(6).normal(size=(500, 4)))
    got = buckets.bucketize(matrices.from_memory(spark, m.tolist()), **how).orderBy("bucket", "norm").collect()
    starts = buckets.bucket_offsets(sorted((r.norm for r in got), reverse=True), **how)
    assert np.bincount([r.bucket for r in got]).tolist() == np.diff([*starts, 500]).tolist()
    assert buckets.bucketize(matrices.from_memory(spark, m.tolist()).where("id < 0")).count() == 0


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.createDataFrame([(int(x), i) for i, x in enumerate(np.random.default_rng(7).integers(0, 300, 1000))], "x long, i long")
    got = numbered(rows, "x", "i", parts=7).collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.x, r.i))] == list(range(1000))
    assert numbered(rows.limit(0), "x").count() == 0
    sizes = [r["count"] for r in buckets.blocks(rows.select(F.col("i").alias("id")), 7).groupBy("block").count().orderBy("block").collect()]
    assert sizes == [143] * 6 + [142]


def test_unit_vectors_are_cut_into_blocks(spark, monkeypatch):
    """All in one norm bucket: still no task meets more than a block of either side."""
    monkeypatch.setattr(joins, "BLOCK", 30)
    m = np.random.default_rng(8).normal(size=(400, 8))
    m /= np.linalg.norm(m, axis=1)[:, None]
    q, p = frames(spark, m[:100].tolist(), m[100:].tolist())
    want = {(i, j) for i, j in np.argwhere(m[:100] @ m[100:].T >= 0.6).tolist()}
    for method in ("length", "coord", "incr", "li", "ap", "naive", "tree"):
        assert {(r.query_id, r.probe_id) for r in joins.above_theta(q, p, 0.6, method).collect()} == want, method
    left, right = joins.prepare(q, "q").withColumn("bound", F.lit(0.6)), joins.prepare(p, "p")
    right, stats = joins.with_buckets(right)
    assert stats.count() <= 2
    met = joins.in_blocks(joins.pair_buckets(left, stats).drop("probes"), right, stats, 100)
    assert "chunk" not in met.columns and met.count() == 100 * 300


@pytest.mark.parametrize("kind", ["normal", "unit"])
def test_approximate_methods_reach_their_recall(spark, kind):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 24))
    m = base[rng.integers(0, 30, 800)] + 0.5 * rng.normal(size=(800, 24))
    if kind == "unit":
        m /= np.linalg.norm(m, axis=1)[:, None]
    q, p = frames(spark, m[:80].tolist(), m[80:].tolist())
    s = m[:80] @ m[80:].T
    theta = float(np.quantile(s, 0.98))
    above, best = set(map(tuple, np.argwhere(s >= theta).tolist())), {(i, j) for i, row in enumerate(s) for j in np.argsort(-row, kind="stable")[:10].tolist()}
    for method in ("lsh", "blsh"):
        got = {(r.query_id, r.probe_id) for r in joins.above_theta(q, p, theta, method).collect()}
        print("above", kind, method, len(got) / len(above))
        assert got <= above and len(got) >= 0.9 * len(above)
    for method, how in (("lsh", {}), ("blsh", {}), ("simple_lsh", {}), ("pca_tree", {}), ("lsh", {"approx": "hyb", "epsilon": 0.05})):
        rows = joins.row_top_k(q, p, 10, method, **how).collect()
        hits = len({(r.query_id, r.probe_id) for r in rows} & best)
        print("top", kind, method, how, hits / len(best))
        assert len(rows) == 800 and hits >= 0.9 * len(best)


def test_small_parts(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 3.0), (0, 1, -2.0), (0, 2, 1.0), (0, 3, 2.5), (2, 1, 5.0), (2, 4, -1.0)], "row long, col int, val double")
    # 3 + 2.5 + 1 - 2 = 4.5: the third entry is the first that half of it does not reach
    kept = {(r.row, r.col) for r in sparse.low_filter(m, "row", 1, 0.6).collect()}
    assert kept == {(0, 0), (2, 1)}
    assert sparse.volume(m) == 8.5 and sparse.volume(m.limit(0)) == 0
    assert {(r.row, r.val) for r in sparse.reorder_rows(m).where("col = 1").collect()} == {(1, -2.0), (0, 5.0)}
    matrices.write_smat(m, path := f"file://{tmp_path}/a.smat")
    assert sorted(map(tuple, matrices.read_smat(spark, path).collect())) == sorted(map(tuple, m.collect()))
    assert spark.read.text(path).where("value like '3\t5%'").count() == 1
    (tmp_path / "b.graph").write_text("% c\n4 3 011 2\n9 9 2 0.5 3 1.5\n9 9 1 0.5\n\n9 9\n")
    got = sorted(map(tuple, matrices.read_metis(spark, f"file://{tmp_path}/b.graph").collect()))
    assert got == [(0, 1, 0.5), (0, 2, 1.5), (1, 0, 0.5)]
    (tmp_path / "c.graph").write_text("2 1\n2\n1\n")
    assert sorted(map(tuple, matrices.read_metis(spark, f"file://{tmp_path}/c.graph").collect())) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert sparse.sort_indices(m).select("col").where("row = 2").collect()[0].col == 1
    turned = linalg.orthogonalize(np.random.default_rng(1).normal(size=(4, 4)))
    assert np.allclose(turned @ turned.T, np.eye(4)) and abs(np.linalg.norm(linalg.random_unit(9)) - 1) < 1e-12
    made = linalg.random_vectors(spark, 20, 3, seed=5)
    assert made.count() == 20 and made.exceptAll(linalg.random_vectors(spark, 20, 3, seed=5).repartition(3)).count() == 0
    assert all(0 <= x < 1 for r in made.collect() for x in r.vec)
    assert linalg.remove_rows(made, spark.range(5)).count() == 15
    found = spark.createDataFrame([(1, 1, 4.0, 1), (1, 2, 1.0, 2), (2, 3, 1.0, 1)], "query_id long, probe_id long, score double, rank long")
    error = evaluate.hybrid_error_estimate(found, 2, F.lit(2.0), 0.9).first().error
    assert abs(error - ((0.1 + 0.5) / 2 + 0.5 / 2) / 2) < 1e-12


def test_mismatched_vectors_raise(spark):
    a, b = frames(spark, [[1.0, 2.0]], [[1.0]])
    with pytest.raises(ValueError):
        joins.above_theta(a, b, 1.0, check=True)
    with pytest.raises(ValueError):
        joins.row_top_k(a, a, 1, "tanra_rr")


def test_empty_sides(spark):
    a, _ = frames(spark, [[1.0, 2.0]], [[1.0]])
    none = a.where("id < 0")
    for method in ("dense", "li", "naive", "tree", "ta_rr"):
        assert joins.above_theta(none, a, 1.0, method).count() == 0
        assert joins.above_theta(a, none, 1.0, method).count() == 0


@pytest.mark.parametrize("method", ["simple_lsh", "pca_tree"])
def test_transformed_top_k_reaches_recall(spark, method):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((700, 16)) * rng.uniform(0.5, 2, (700, 1))
    q, p = (spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(part)], "id long, vec array<double>") for part in (m[:60], m[60:]))
    got = joins.row_top_k(q, p, 10, method).collect()
    want = {(i, j) for i, row in enumerate(m[:60] @ m[60:].T) for j in np.argsort(-row)[:10]}
    assert len(got) == 600 and len({(r.query_id, r.probe_id) for r in got} & want) >= 0.9 * len(want)
