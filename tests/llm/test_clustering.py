"""Centroid clustering against whole-number loops, and exactness at the ends of the range."""

import hashlib
import math

import numpy as np
import pytest

from dotforge.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string, digest string, q string, copies long"


def plain(rows, width=64, k=16, rounds=3):
    kept = [(i, [math.floor(x * 64) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cent = [list(q) for _, q in start]

    def near(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in cent]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[0], []).append(q)
        for c, qs in own.items():
            cent[c] = [sum(col) // len(qs) for col in zip(*qs)]
    out = [(i, *near(q)) for i, q in kept]
    per = {c: sum(d for _, x, d in out if x == c) for _, c, _ in out}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, c, fits(d), fits(per[c]), fits(sum(per.values())), sha[c]) for i, c, d in out]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "d", "q", 3) for i, v in rows], SCHEMA).repartition(5)


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(0, 0.3, (120, 64)).tolist()
    rows = list(enumerate(vecs)) + [(200 + i, vecs[0]) for i in range(150)] + [(None, vecs[1]), (None, vecs[2]), (5, vecs[7])]
    odd = [None, [], [0.5] * 63, [None] * 64, [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63]
    rows += [(500 + n, v) for n, v in enumerate(odd)] + [(600, [0.0] * 64), (601, [-0.0] * 64)]
    same(clustering.cluster(frame(spark, rows))[0].collect(), plain(rows))


@pytest.mark.parametrize("big", [2.0**12, 2.0**24, 2.0**30])
def test_whole_numbers_of_any_size_stay_exact(spark, big):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 64) * big + rng.random(64)).tolist()) for i in range(40)]
    same(clustering.cluster(frame(spark, rows))[0].collect(), plain(rows))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    out, centroids = clustering.cluster(frame(spark, rows).where(f"vec_id < {n}"))
    same(out.collect(), plain(rows[:n]))
    assert len(centroids) == n


def test_ties_go_to_the_smaller_cluster():
    cluster, distance = clustering.nearest(np.array([[0, 0], [2, 0]]), np.array([[1, 0], [-1, 0], [3, 0]]))
    assert cluster.tolist() == [0, 0] and distance.tolist() == [1, 1]
