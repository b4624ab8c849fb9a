"""What the kernels look up inside a group, and what leaves it."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotforge.operators import covers, evaluate, joins, kernels, lists, lsh
from dotforge.sources import matrices


def frames(spark, *sides):
    return [matrices.from_memory(spark, np.asarray(s).tolist()) for s in sides]


@pytest.mark.parametrize("most", [False, True])
@pytest.mark.parametrize("full", [False, True])
def test_threshold_loses_no_pair_and_reads_little_of_peaked_lists(most, full):
    rng = np.random.default_rng(31)
    p = rng.normal(size=(900, 12)) * (rng.random((900, 12)) < 0.2)
    q = rng.normal(size=(40, 12)) * (rng.random((40, 12)) < 0.2)
    q[0] = 0
    s = q @ p.T
    held = kernels.Lists(p)
    for bound in (np.full(40, np.quantile(s, 0.999)), np.full(40, -1.0), np.full(40, -np.inf), np.quantile(s, 0.99, axis=1)):
        found = kernels.threshold(q, held, bound, most, full)
        assert not ((s >= bound[:, None]) & ~found).any()
    tight = kernels.threshold(q, held, np.full(40, np.quantile(s, 0.999)), most, full)[1:]
    assert tight.mean() < 0.5
    if not full:
        assert tight.sum() <= kernels.threshold(q, held, np.full(40, np.quantile(s, 0.999)), most, True)[1:].sum()


def test_only_the_best_leave_a_group(spark, monkeypatch):
    rng = np.random.default_rng(32)
    m = rng.normal(size=(400, 6))
    m[100:200] = m[100]  # ties
    monkeypatch.setattr(kernels, "PAIRS", 1000)  # several steps a group
    q, p, _ = joins.prepare_both(*frames(spark, m[:30], m))
    q = q.withColumn("bound", F.lit(float("-inf")))
    groups = p.select(joins.log_bucket(F.col("pn"))).distinct().count()
    rows = kernels.block_join(q, p, "dense", k=3).collect()
    assert len(rows) <= 30 * groups * 3
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((-r.score, r.probe_id))
    for i, row in enumerate(m[:30] @ m.T):
        assert [j for _, j in sorted(got[i])[:3]] == sorted(range(400), key=lambda j: (-row[j].round(9), j))[:3]


@pytest.mark.parametrize("method", joins.APPROXIMATE)
def test_a_complete_approximate_join_misses_no_pair(spark, method):
    m = np.random.default_rng(33).normal(size=(900, 16))
    q, p = frames(spark, m[:200], m[200:])
    s = m[:200] @ m[200:].T
    theta = float(np.quantile(s, 0.99))
    want = set(map(tuple, np.argwhere(s >= theta).tolist()))
    got = {(r.query_id, r.probe_id) for r in joins.above_theta(q, p, theta, method, recall=0.5, complete=True).collect()}
    assert got == want > {(r.query_id, r.probe_id) for r in joins.above_theta(q, p, theta, method, recall=0.5).collect()}


@pytest.mark.parametrize("method", joins.COUNTED)
def test_run_figures_of_counted_methods(spark, method):
    m = np.random.default_rng(34).normal(size=(300, 5))
    a, b = frames(spark, m[:40], m[40:])
    s = m[:40] @ m[40:].T
    log = evaluate.run_log(a, b, 2.0, method, lambda d: d.write.format("noop").mode("overwrite").save()).first()
    assert log.comparisons <= 40 * 260 and log.results <= log.comparisons
    if method not in joins.APPROXIMATE:
        assert log.results == (s >= 2.0).sum()
    if method == "naive":
        assert log.comparisons == 40 * 260


def test_lists_in_the_kernel_count_what_the_ranges_hold(spark):
    m = np.random.default_rng(35).normal(size=(500, 8))
    q, p, width = joins.prepare_both(*frames(spark, m[:50], m[50:]))
    q = q.withColumn("bound", F.lit(6.0))
    s = m[:50] @ m[50:].T
    coord, incr = (lists.comparisons(q, p, n, width).first().comparisons for n in ("coord", "incr"))
    assert (s >= 6.0).sum() <= incr <= coord < joins.candidates(q, p, "length").count()


def test_long_csr_lines_are_split_once(spark, tmp_path):
    """Reading time a line grows with its length, not with its square: 20,000 entries took minutes when every entry split its line."""
    m = spark.range(60_000).select((F.col("id") % 3).alias("row"), F.floor(F.col("id") / 3).cast("int").alias("col"), (F.col("id") / 7).alias("val"))
    want = m.agg(F.sum(F.xxhash64("row", "col", "val").cast("decimal(38,0)"))).first()[0]
    for header in (False, True):
        matrices.write_csr(m, path := f"file://{tmp_path}/{header}.csr", 4, header=header)
        began = time.perf_counter()
        got = matrices.read_csr(spark, path).agg(F.sum(F.xxhash64("row", "col", "val").cast("decimal(38,0)"))).first()[0]
        assert got == want and time.perf_counter() - began < 20


def test_near_pairs_send_a_vector_once_a_block(spark, monkeypatch):
    rng = np.random.default_rng(36)
    m = np.vstack([rng.normal(size=(150, 5)), np.zeros((80, 5))])  # more copies than a block holds
    monkeypatch.setattr(covers, "NEAR", 60)
    monkeypatch.setattr(covers, "PAIRS", 500)
    apart = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    got = [(r.id, r.other) for r in covers.near_pairs(frames(spark, m)[0], 1.2, leaf=16, fanout=4).collect()]
    assert sorted(got) == [(i, j) for i, j in np.argwhere(apart <= 1.2).tolist() if i < j]


def test_a_task_has_few_groups_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 10)
    m = np.random.default_rng(37).normal(size=(330, 4))
    q, p, _ = joins.prepare_both(*frames(spark, m[:30], m[30:]))
    groups = sum(-(-r["count"] // 10) for r in p.groupBy(joins.log_bucket(F.col("pn"))).count().collect()) * 3
    out = kernels.block_join(q.withColumn("bound", F.lit(1.0)), p, "length")
    assert out.rdd.getNumPartitions() == -(-groups // kernels.GROUPS) > 4  # the session's partitions
    assert out.count() == (m[:30] @ m[30:].T >= 1.0).sum()


def test_bounds_are_scores_and_worked_out_once(spark, monkeypatch):
    rng = np.random.default_rng(38)
    m = rng.normal(size=(60, 7)) * 10.0 ** rng.integers(-3, 3, (60, 1))
    m[30:34] = m[30]  # ties
    monkeypatch.setattr(kernels, "PAIRS", 50)  # few queries at a time
    q, p, _ = joins.prepare_both(*frames(spark, m[:20], m[20:]))
    out = joins.top_k_bounds(q, p, 3, seeds=2)
    best = joins.products(q.crossJoin(p.orderBy(F.desc("pn"), "pid").limit(6))).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False)[2].alias("s"))
    assert {r.qid: r.bound for r in out.collect()} == {r.query_id: r.s for r in best.collect()}
    assert not any(n in out._jdf.queryExecution().executedPlan().toString() for n in ("Join", "Window", "MapInArrow"))
    for few in (joins.top_k_bounds(q, p, 41), joins.top_k_bounds(q, p.where("pid < 0"), 1)):
        assert {r.bound for r in few.collect()} == {float("-inf")}


def test_nodes_are_split_to_leaves_inside_a_group():
    rng = np.random.default_rng(43)
    m = np.vstack([rng.normal(size=(900, 4)), np.ones((60, 4))])
    node = np.where(np.arange(960) < 900, 17, 18)
    got = covers.split(m, node, leaf=40, fanout=4)
    leaves, sizes = np.unique(got, return_counts=True)
    assert set(leaves[sizes > 40]) == {18}  # of one vector
    up = got.copy()
    while (up > 18).any():
        up = np.where(up > 18, up >> 4, up)
    assert (up == node).all() and len(leaves) > 900 // 40


def test_shared_codes_as_by_comparing():
    rng = np.random.default_rng(41)
    (q, _), (p, _) = lsh.signs(rng.normal(size=(1100, 6))), lsh.signs(rng.normal(size=(37, 6)))
    needed = rng.integers(1, lsh.TABLES + 2, 1100)
    got = np.unpackbits(lsh.shared_codes(q, p, needed), axis=1, count=37).astype(bool)
    for i in range(0, 1100, 13):
        want = (q[i, : needed[i]] == p[:, : needed[i]]).any(1) if needed[i] <= lsh.TABLES else np.zeros(37, bool)
        assert (got[i] == want).all()


def test_bounds_come_from_a_block_of_probes(spark):
    m = np.random.default_rng(39).normal(size=(620, 5))
    q, p, _ = joins.prepare_both(*frames(spark, m[:20], m[20:]))
    got = {r.qid: r.bound for r in joins.top_k_bounds(q, p, 3).collect()}
    want = np.sort(m[:20] @ m[20:].T, axis=1)[:, -3]
    assert np.allclose([got[i] for i in sorted(got)], want)


def test_only_queries_that_ask_for_a_bucket_make_blocks(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 10)
    m = np.random.default_rng(40).normal(size=(420, 4))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[:280] *= 0.1  # these reach the bound nowhere
    q, p, _ = joins.prepare_both(*frames(spark, m[:300], m[300:]))
    out = kernels.block_join(q.withColumn("bound", F.lit(0.5)), p, "length")
    assert out.rdd.getNumPartitions() <= -(-2 * (12 + 2) // kernels.GROUPS)
    assert out.count() == (m[:300] @ m[300:].T >= 0.5).sum()


def test_a_query_that_will_be_scanned_is_not_followed_further(monkeypatch):
    rng = np.random.default_rng(42)
    q, p = rng.normal(size=(50, 20)), rng.normal(size=(400, 20))
    held, seen, edges = kernels.Lists(p), [], kernels.Lists.edges
    monkeypatch.setattr(kernels.Lists, "edges", lambda s, q, depth: seen.append(len(q)) or edges(s, q, depth))
    assert kernels.threshold(q, held, np.full(50, -5.0), True, True).all()
    assert sum(seen) <= 4 * 50  # both ends, and a step or two of ten


def test_tasks_hold_one_group_and_pick_from_few_rows(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 10)
    monkeypatch.setattr(kernels, "KEPT", 400, raising=False)
    rng = np.random.default_rng(44)
    m = rng.normal(size=(430, 4))
    m /= np.linalg.norm(m, axis=1)[:, None]
    q, p, _ = joins.prepare_both(*frames(spark, m[:30], m[30:]))
    q = q.withColumn("bound", F.lit(-1.0))
    groups = sum(-(-r["count"] // 10) for r in p.groupBy(joins.log_bucket(F.col("pn"))).count().collect())
    assert kernels.block_join(q, p, "dense").rdd.getNumPartitions() >= groups * 3
    out = kernels.block_join(q, p, "dense", k=2)
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == -(-2 * 30 * groups // 400) > 4 and max(sizes) < 2 * 400
    got = [(r.query_id, r.probe_id) for r in joins.best(out, 2).orderBy("query_id", "rank").collect()]
    assert got == [(i, j) for i, row in enumerate(np.argsort(-(m[:30] @ m[30:].T), axis=1, kind="stable")[:, :2].tolist()) for j in row]
