"""Lists, covers, postings, staged pruning, leaves, running results, binary files, bounds and run figures against brute force."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dotforge.functions import vectors as V
from dotforge.operators import covers, evaluate, joins, kernels, linalg, lists, lsh
from dotforge.sources import binary, matrices
from dotforge.streaming import probing

ALL = (*joins.EXACT, *joins.APPROXIMATE)


def frames(spark, *sides):
    return [matrices.from_memory(spark, np.asarray(s).tolist()) for s in sides]


def peaked(rng, n, width):
    """Sparse vectors with a few large coordinates, the kind that lists are for."""
    m = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.3)
    m[np.arange(n), rng.integers(0, width, n)] += 3
    return m


# vectors that are missing or odd ------------------------------------------
ODD = [(0, [1.0, 1.0]), (1, None), (2, [2.0, None]), (3, [math.nan, 1.0]), (4, [0.0, 0.0]), (5, [0.5, -1.0])]


def test_null_vectors_and_coordinates_are_left_out_by_every_method(spark):
    df = spark.createDataFrame(ODD, "id long, vec array<double>")
    whole = df.where("id IN (0, 4, 5)")
    want = None
    for method in ALL:
        got = sorted(map(tuple, joins.above_theta(df, df, -1.0, method).collect()))
        want = want or sorted(map(tuple, joins.above_theta(whole, whole, -1.0, "dense").collect()))
        assert got == want and len(got) == 9, method
    for method in ("dense", "li", "tree", "simple_lsh", "pca_tree", "pca_hamming"):
        got = joins.row_top_k(df, df, 2, method, depth=1).collect()
        assert sorted(r.query_id for r in got) == [0, 0, 4, 4, 5, 5], method


def test_vectors_of_unlike_length_raise_in_every_method(spark):
    a = spark.createDataFrame([(0, [1.0, 1.0])], "id long, vec array<double>")
    b = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (1, [1.732])], "id long, vec array<double>")
    for method in ALL:
        for q, p in ((a, b), (b, a)):
            with pytest.raises(Exception, match="different lengths"):
                joins.above_theta(q, p, -1.0, method).collect()
    with pytest.raises(ValueError):
        joins.above_theta(a, b, -1.0, "dense", check=True)


# inverted lists -----------------------------------------------------------
def test_lists_read_only_entries_in_range(spark, monkeypatch):
    rng = np.random.default_rng(11)
    q, p = peaked(rng, 60, 12), peaked(rng, 500, 12)
    q /= np.linalg.norm(q, axis=1)[:, None]
    p /= np.linalg.norm(p, axis=1)[:, None]
    a, b = frames(spark, q, p)
    qq, pp, width = joins.prepare_both(a, b)
    qq = qq.withColumn("bound", F.lit(0.8))
    by_length = joins.candidates(qq, pp, "length").count()
    count = {m: lists.comparisons(qq, pp, m, width).first().comparisons for m in lists.METHODS}
    assert by_length == 60 * 500 and count["incr"] <= count["coord"] < by_length / 5 and count["li"] <= count["lc"] < by_length / 2
    want = {(i, j) for i, j in np.argwhere(q @ p.T >= 0.8).tolist()}
    for chunk in (joins.BLOCK, 20):
        monkeypatch.setattr(joins, "BLOCK", chunk)
        for m in ("coord", "li"):
            assert {(r.query_id, r.probe_id) for r in joins.above_theta(a, b, 0.8, m).collect()} == want, (m, chunk)


def test_running_counts_are_those_of_the_lists(spark):
    p = peaked(np.random.default_rng(12), 90, 5)
    pp, _ = joins.with_buckets(joins.prepare(frames(spark, p)[0], "p"))
    held = {(r.pid): (r.bucket, np.array(r.pu)) for r in pp.collect()}
    for r in lists.running_counts(pp).collect():
        x = np.sort([u[r.coord] for b, u in held.values() if b == r.bucket])
        at = np.clip(np.floor((x + 1) * lists.BINS / 2), 0, lists.BINS - 1)
        assert r.ends == [int((at < i).sum()) for i in range(lists.BINS + 1)]


# covers -------------------------------------------------------------------
def test_covers_are_nested_and_hold_their_members(spark):
    rng = np.random.default_rng(13)
    m = np.vstack([rng.normal(size=(400, 4)), np.zeros((300, 4))])  # many copies of one vector do not split for ever
    p = joins.prepare(frames(spark, m)[0], "p")
    members, levels = covers.build(p, leaf=20, fanout=4)
    leaf = {r.pid: r.node for r in members.collect()}
    assert sorted(leaf) == list(range(700)) and len(levels) > 2
    nodes = {r.node: r for lv in levels for r in lv.collect()}
    assert all(r.parent == 1 or nodes[r.parent].level == r.level - 1 for r in nodes.values())
    for i, node in leaf.items():
        while node != 1:  # every ball on the way up holds the vector
            assert np.linalg.norm(m[i] - np.array(nodes[node].centre)) <= nodes[node].radius + 1e-9
            node = nodes[node].parent
    for node, r in nodes.items():
        own = [i for i, x in leaf.items() if node in _up(x)]
        assert r.probes == len(own)
    sizes = np.unique(list(leaf.values()), return_counts=True)[1]
    assert (sizes > 20).sum() <= 2  # what holds the copies


def _up(node):
    out = {node}
    while node > 1:
        node //= 16
        out.add(node)
    return out


def test_tree_prunes_and_near_pairs_are_whole(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(12, 6)) * 5
    m = centres[rng.integers(0, 12, 500)] + 0.2 * rng.normal(size=(500, 6))
    a, b = frames(spark, m[:40], m)
    q = joins.prepare(a, "q").withColumn("bound", F.lit(60.0))
    seen = covers.visits(q, joins.prepare(b, "p"), leaf=16, fanout=6).collect()
    assert [r.level for r in seen] == list(range(1, len(seen) + 1)) and sum(r.visits for r in seen) < 40 * sum(r.nodes for r in seen) / 2
    apart = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    got = covers.near_pairs(b, 0.7, leaf=16, fanout=6).collect()
    assert {(r.id, r.other) for r in got} == {(i, j) for i, j in np.argwhere(apart <= 0.7).tolist() if i < j} and len(got) == len({(r.id, r.other) for r in got})


def test_small_nodes_are_split_in_one_task_as_level_by_level(spark, monkeypatch):
    rng = np.random.default_rng(21)
    m = np.vstack([rng.integers(-2, 3, (300, 3)) * 0.3, rng.normal(size=(300, 3)), np.zeros((80, 3)), np.full((5, 3), -0.0)])
    p = joins.prepare(frames(spark, m)[0], "p")
    want = None
    for whole in (0, 60, 1000):  # level by level, both, in one task
        monkeypatch.setattr(covers, "WHOLE", whole, raising=False)
        members, levels = covers.build(p, leaf=12, fanout=4)
        nodes = [sorted((r.level, r.node, r.parent, tuple(x + 0.0 for x in r.centre), r.radius, r.probes) for r in lv.collect()) for lv in levels]
        got = sorted(map(tuple, members.collect())), nodes
        want = want or got
        assert got == want and len(levels) > 3 and all(r[0] == n for n, lv in enumerate(nodes, 1) for r in lv)
    assert sorted(map(tuple, covers.build(p, leaf=12, fanout=4, balls=False)[0].collect())) == want[0]
    none, levels = covers.build(p.where("pid < 0"))
    assert none.count() == 0 and not levels
    written = []
    kept = covers.materialize
    monkeypatch.setattr(covers, "materialize", lambda df: written.append(df.columns) or kept(df))
    covers.build(p, leaf=12, fanout=4)
    assert len(written) < 6  # it was three a level


def test_visits_are_counted_in_blocks_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 12)
    monkeypatch.setattr(covers, "PAIRS", 50)
    rng = np.random.default_rng(20)
    m = np.vstack([rng.integers(-3, 4, (400, 3)).astype(float), np.zeros((60, 3))])
    a, b = frames(spark, m[:50], m)
    q, p = joins.prepare(a, "q").withColumn("bound", F.col("qid") % 4 * 4.0 - 3.0), joins.prepare(b, "p")
    nodes = [r for lv in covers.build(p, leaf=10, fanout=4)[1] for r in lv.collect()]
    held, want = {1: range(50)}, {}
    for r in sorted(nodes, key=lambda r: r.level):
        reach = [float(m[i] @ np.array(r.centre)) + math.sqrt(m[i] @ m[i]) * r.radius for i in range(50)]
        held[r.node] = [i for i in held[r.parent] if reach[i] + 1e-9 * (1 + abs(reach[i])) >= i % 4 * 4.0 - 3.0]
        n, seen = want.get(r.level, (0, 0))
        want[r.level] = n + 1, seen + len(held[r.node])
    out = covers.visits(q, p, leaf=10, fanout=4)
    assert [(r.level, r.nodes, r.visits) for r in out.collect()] == [(n, *want[n]) for n in sorted(want)] and len(nodes) > 4 * 12
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") < 6 < 3 * len(want)  # not one or more a level
    assert covers.visits(q.where("qid < 0"), p, leaf=10, fanout=4).agg(F.sum("visits")).first()[0] == 0
    assert covers.visits(q, p.where("pid < 5"), leaf=10).count() == 0


# postings and staged bounds -----------------------------------------------
@pytest.mark.parametrize("seed", range(6))
def test_prefix_kernel_loses_no_pair(seed):
    rng = np.random.default_rng(seed)
    q, p = peaked(rng, 30, 30), peaked(rng, 200, 30)
    s = q @ p.T
    for bound in (np.full(30, np.quantile(s, 0.99)), np.full(30, -1.0), np.quantile(s, 0.95, axis=1), np.where(np.arange(30) % 2, -np.inf, 5.0)):
        i, j = kernels.prefix(q, p, bound)
        got = set(zip(i.tolist(), j.tolist()))
        assert {(a, b) for a, b in np.argwhere(s >= bound[:, None]).tolist()} <= got and len(got) == len(i)
    i, _ = kernels.prefix(q, p, np.full(30, np.quantile(s, 0.999)))
    assert len(i) < s.size / 20


# staged pruning by sketches -------------------------------------------------
def test_least_matches_are_those_of_the_integral():
    x = np.linspace(0.5, 1, 400_001)[:-1]
    for bits in range(lsh.GROUP, lsh.SKETCH + 1, 2 * lsh.GROUP):
        for threshold in (0.55, 0.7, 0.9):
            for recall in (0.9, 0.97):
                def chance(m):
                    w = np.exp(m * np.log(x) + (bits - m) * np.log1p(-x) - m * math.log(max(0.5, m / bits)) - (bits - m) * math.log(max(1e-9, 1 - max(0.5, m / bits - 1e-9))))
                    return w[x >= threshold].sum() / w.sum()

                m = lsh.least_matches(threshold, recall, bits)
                assert chance(m) > 1 - recall - 1e-4 and (m == 0 or chance(m - 1) <= 1 - recall + 1e-4)
    table = np.array(lsh.match_table(0.97))
    assert table.shape == (lsh.SKETCH // lsh.GROUP, lsh.GRID + 1) and (np.diff(table, axis=1) >= 0).all()


def test_stages_drop_pairs_group_by_group(spark):
    rng = np.random.default_rng(15)
    bits = rng.random((200, 256)) < rng.uniform(0, 0.5, 200)[:, None]  # where the second sketch differs
    first = rng.random((200, 256)) < 0.5
    words = lambda m: np.packbits(m, axis=1).view(">i4").astype(np.int32).tolist()
    rows = [(i, 0.75, a, b) for i, (a, b) in enumerate(zip(words(first), words(first ^ bits)))]
    df = spark.createDataFrame(rows, "id long, local double, qsketch array<int>, psketch array<int>")
    table = np.array(lsh.match_table(0.97))[:, int(0.75 * lsh.GRID)]
    equal = np.cumsum(32 - bits.reshape(200, 8, 32).sum(2), axis=1)
    want = np.flatnonzero((equal >= table).all(1)).tolist()
    assert sorted(r.id for r in lsh.staged(df, 0.97).collect()) == want and 0 < len(want) < 200


# leaves of the PCA tree -----------------------------------------------------
def test_hamming_leaves_and_their_recall(spark):
    leaves = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 7), (4, 7)], "id long, leaf long")
    got = sorted((r.id, r.near, r.members) for r in lsh.leaf_neighbours(leaves, 3).collect())
    assert got == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1), (1, 3, 1), (2, 1, 1), (2, 3, 1), (2, 7, 2), (3, 3, 1), (3, 7, 2), (4, 3, 1), (4, 7, 2)]
    rng = np.random.default_rng(16)
    base = rng.normal(size=(30, 24))
    m = base[rng.integers(0, 30, 900)] + 0.4 * rng.normal(size=(900, 24))
    a, b = frames(spark, m[:100], m[100:])
    exact, found = joins.row_top_k(a, b, 10, "dense"), joins.row_top_k(a, b, 10, "pca_hamming", depth=3)
    recall = evaluate.recall_at_k(exact, found, 10).first().recall
    print(f"pca_hamming: recall {recall:.3f}")
    assert recall >= 0.9 and found.count() == 1000


def test_only_the_best_of_the_leaves_leave_their_blocks(spark):
    rng = np.random.default_rng(18)
    m = rng.normal(size=(640, 6))
    m[300:320] = m[300]  # ties
    q, p, _ = joins.prepare_both(*frames(spark, m[:40], m[40:]))
    q = joins.top_k_bounds(q, p, 4)
    found = lsh.pca_hamming(q, p, 4, 3).collect()
    assert len(found) == len({(r.query_id, r.probe_id) for r in found}) <= 40 * 5 * 4  # of four leaves and the smallest ids
    qx, px, _ = lsh._lifted(q, p, 3)
    leaves, splits = lsh.median_leaves(px, "x", 3)
    at = qx.withColumn("leaf", F.lit(0).cast("long"))
    for level in range(3):
        at = lsh.descend(at, "x", splits.where(F.col("level") == level), level)
    leaf = {r.pid: r.leaf for r in leaves.collect()}
    for r in at.collect():
        near = [j for j in range(600) if (leaf[j] ^ r.leaf).bit_count() < 2 or j < 4]
        want = sorted((-round(float(m[r.qid] @ m[40 + j]), 9), j) for j in near)[:4]
        assert sorted((-round(x.score, 9), x.probe_id) for x in found if x.query_id == r.qid)[:4] == want


# streams against static probes ----------------------------------------------
def test_streamed_queries_meet_blocks_of_probes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(joins, "BLOCK", 30)
    monkeypatch.setattr(kernels, "PAIRS", 100)
    rng = np.random.default_rng(19)
    q, p = rng.integers(-3, 4, (90, 4)).astype(float), rng.integers(-3, 4, (200, 4)).astype(float)
    a, b = frames(spark, q, p)
    odd = spark.createDataFrame([(500, None), (501, [1.0, None, 1.0, 1.0]), (502, [math.nan, 1.0, 1.0, 1.0])], "id long, vec array<double>")
    a.union(odd).repartition(3).write.parquet(f"{tmp_path}/in")
    for theta in (14.0, -2.0):
        stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run = probing.stream_above_theta(stream, b.union(odd), theta).writeStream.format("parquet").option("path", f"{tmp_path}/{theta}")
        run.option("checkpointLocation", f"{tmp_path}/state{theta}").trigger(availableNow=True).start().awaitTermination()
        got = [(r.query_id, r.probe_id, r.score) for r in spark.read.parquet(f"{tmp_path}/{theta}").collect()]
        s = q @ p.T
        assert sorted(got) == [(i, j, s[i, j]) for i, j in np.argwhere(s >= theta).tolist()]
    # no row a pair: both sides' vectors stand in no expression together
    plan = probing.stream_above_theta(a, b, 14.0)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("qv#" in line and "pv#" in line for line in plan.splitlines())
    assert probing.stream_above_theta(a, b.where("id < 0"), 1.0).count() == 0
    with pytest.raises(PySparkException, match="different lengths"):
        probing.stream_above_theta(frames(spark, q[:, :3])[0], b, 1.0).collect()


# running results ------------------------------------------------------------
def test_running_top_k_grows_and_survives_a_restart(spark, tmp_path):
    rng = np.random.default_rng(17)
    q, p = rng.integers(-3, 4, (9, 4)).astype(float), rng.integers(-3, 4, (120, 4)).astype(float)  # many ties
    a, b = frames(spark, q, p)
    for hi in (40, 120):  # the second run starts from the state of the first
        b.where(f"id < {hi} AND id >= {0 if hi == 40 else 40}").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run = probing.running_top_k(stream, a, 5).writeStream.outputMode("update").foreachBatch(probing.latest_sink(f"{tmp_path}/out"))
        run.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = probing.latest(spark.read.parquet(f"{tmp_path}/out")).select("query_id", "probe_id", "score", "rank").collect()
        want = joins.row_top_k(a, b.where(f"id < {hi}"), 5).select("query_id", "probe_id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


# binary files -----------------------------------------------------------------
@pytest.mark.parametrize("kind", binary.KINDS)
def test_binary_round_trip(spark, tmp_path, kind, monkeypatch):
    rng = np.random.default_rng(18)
    cells = {(int(r), int(c)): float(np.float32(v)) for r, c, v in zip(rng.integers(0, 50, 400), rng.integers(0, 30, 400), rng.normal(size=400)) if r != 7}
    m = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col int, val double")
    monkeypatch.setattr(binary, "SPLIT", 60)
    monkeypatch.setattr(binary, "BATCH", 16)
    for part in (1 << 20, 70):
        path = f"file://{tmp_path}/{kind}-{part}"
        binary.write_binary(m, path, kind, 50, 30, part=part)
        got = binary.read_binary(spark, path, kind)
        assert {(r.row, r.col): r.val for r in got.collect()} == cells and got.rdd.getNumPartitions() > 4
    binary.write_binary(m, path := f"file://{tmp_path}/{kind}-ones", kind, 50, 30, values=False)
    assert {(r.row, r.col): r.val for r in binary.read_binary(spark, path, kind).collect()} == dict.fromkeys(cells, 1.0)
    binary.write_binary(m.limit(0), path := f"file://{tmp_path}/{kind}-none", kind, 50, 30)
    assert binary.read_binary(spark, path, kind).count() == 0


def test_binary_layout(spark, tmp_path):
    """A file made by hand: 2 x 3, entries (0, 1) = 2 and (1, 0) = 3, (1, 2) = 4."""
    ints, floats = lambda *x: np.array(x, "<i4").tobytes(), np.array([2, 3, 4], "<f4").tobytes()
    made = {
        "binrow": ints(2, 3, 0, 1, 3, 1, 0, 2) + floats, "bincol": ints(2, 3, 0, 1, 2, 3, 1, 0, 1) + np.array([3, 2, 4], "<f4").tobytes(),
        "bijv": ints(2, 3, 3, 0, 1) + b"".join(ints(r, c) + np.array([v], "<f4").tobytes() for r, c, v in ((0, 1, 2), (1, 0, 3), (1, 2, 4))),
    }
    for kind, data in made.items():
        (tmp_path / f"m.{kind}").write_bytes(data)
        got = binary.read_binary(spark, f"{tmp_path}/m.{kind}", kind).collect()
        assert sorted(map(tuple, got)) == [(0, 1, 2.0), (1, 0, 3.0), (1, 2, 4.0)], kind
        (tmp_path / f"short.{kind}").write_bytes(data[:-8])
        with pytest.raises(PySparkException):
            binary.read_binary(spark, f"{tmp_path}/short.{kind}", kind).collect() if kind == "bijv" else binary.read_binary(spark, f"{tmp_path}/gone.{kind}", kind).collect()


# bounds -------------------------------------------------------------------------
def test_bounds_hold_for_points_inside(spark):
    rng = np.random.default_rng(19)
    rows = []
    for i in range(60):
        lo1, lo2 = rng.uniform(-2, 2, (2, 3))
        rows.append((i, lo1.tolist(), (lo1 + rng.uniform(0, 2.5, 3)).tolist(), lo2.tolist(), (lo2 + rng.uniform(0, 1, 3)).tolist(), rng.uniform(-3, 3, 3).tolist(), [1.5, 0.0, 2.2], float(rng.uniform(0, 2)), float(rng.uniform(0, 2))))
    df = spark.createDataFrame(rows, "id long, al array<double>, ah array<double>, bl array<double>, bh array<double>, x array<double>, period array<double>, r1 double, r2 double")
    box, p = ("al", "ah", "bl", "bh"), F.col("period")
    got = df.select(
        "*", V.boxes_min_distance(*box).alias("near"), V.boxes_max_distance(*box).alias("far"), V.periodic_boxes_min_distance(*box, p).alias("pnear"), V.periodic_boxes_max_distance(*box, p).alias("pfar"),
        V.periodic_min_distance("al", "ah", "x", p).alias("xnear"), V.periodic_max_distance("al", "ah", "x", p).alias("xfar"), V.periodic_distance("al", "x", p).alias("point"),
        V.ball_union("al", F.col("r1"), "bl", F.col("r2")).alias("ball"), V.box_union(*box).alias("whole"),
    ).collect()
    axis = lambda d, length: np.minimum(d % length, length - d % length) if length else np.abs(d)
    for r in got:
        grid = [[np.linspace(r[lo][c], r[hi][c], 301) for c in range(3)] for lo, hi in (("al", "ah"), ("bl", "bh"))]
        flat = [np.abs(grid[0][c][:, None] - grid[1][c][None]) for c in range(3)]
        wrap = [axis(grid[0][c][:, None] - grid[1][c][None], r.period[c]) for c in range(3)]
        from_x = [axis(grid[0][c] - r.x[c], r.period[c]) for c in range(3)]
        root = lambda ds, f: math.sqrt(sum(f(d) ** 2 for d in ds))
        for name, want in (("near", root(flat, np.min)), ("far", root(flat, np.max)), ("pnear", root(wrap, np.min)), ("pfar", root(wrap, np.max)), ("xnear", root(from_x, np.min)), ("xfar", root(from_x, np.max))):
            assert abs(r[name] - want) < 0.02, (name, r)
        assert abs(r.point - root([axis(np.array([r.al[c] - r.x[c]]), r.period[c]) for c in range(3)], np.max)) < 1e-9
        for c, radius in ((r.al, r.r1), (r.bl, r.r2)):
            assert math.dist(r.ball["centre"], c) + radius <= r.ball["radius"] + 1e-9
        assert r.ball["radius"] <= max(r.r1, r.r2, (math.dist(r.al, r.bl) + r.r1 + r.r2) / 2) + 1e-9
        assert r.whole["lo"] == np.minimum(r.al, r.bl).tolist() and r.whole["hi"] == np.maximum(r.ah, r.bh).tolist()


# figures of runs ------------------------------------------------------------------
def test_run_figures_equal_separate_counts(spark, tmp_path):
    rng = np.random.default_rng(20)
    a, b = frames(spark, rng.normal(size=(20, 5)), rng.normal(size=(90, 5)))
    out = f"{tmp_path}/out"
    log = evaluate.run_log(a, b, 1.0, "length", lambda d: d.write.parquet(out)).first()
    q, p, _ = joins.prepare_both(a, b)
    assert log.comparisons == evaluate.comparisons(joins.candidates(q.withColumn("bound", F.lit(1.0)), p, "length")).first().comparisons
    assert log.results == spark.read.parquet(out).count() == joins.above_theta(a, b, 1.0).count() and (log.probes, log.queries, log.width) == (90, 20, 5)
    top = evaluate.run_log(a, b, 4, "dense", lambda d: d.write.format("noop").mode("overwrite").save())
    assert top.first().results == 80 and top.first().comparisons is None
    for _ in range(2):
        evaluate.write_log(top, f"{tmp_path}/log")
    assert spark.read.csv(f"{tmp_path}/log", sep="\t").count() == 2


def test_error_estimates_by_hand(spark):
    found = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.8), (2, 1, 2.0), (2, 2, 1.95)], "query_id long, probe_id long, score double")
    # margins 0.88 and 2.145: 0.8 misses a part of the first, both scores of the second query of theirs
    want = ((1 - 0.8 / 0.88) / 2 + (2 - 2.0 / 2.145 - 1.95 / 2.145) / 2) / 2
    assert abs(evaluate.relative_error_estimate(found, 2, 0.1).first().error - want) < 1e-12
    want = ((0.03 + 1 - 0.8 / 0.9) / 2 + (0.03 + 0.03) / 2) / 2
    assert abs(evaluate.hybrid_error_estimate(found, 2, F.lit(0.9), 0.97).first().error - want) < 1e-12


def test_group_bounds(spark):
    m = np.random.default_rng(21).normal(size=(60, 4))
    df = frames(spark, m)[0].withColumn("g", F.col("id") % 3)
    for r in linalg.group_bounds(df, "g").collect():
        own = m[r.g :: 3]
        assert np.allclose(r.centre, own.mean(0)) and np.allclose(r.lo, own.min(0)) and abs(r.radius - np.linalg.norm(own - own.mean(0), axis=1).max()) < 1e-9
