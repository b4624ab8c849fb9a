"""Importance resampling against a plain loop, and its hashes against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dotforge.llm import resampling

SCHEMA = "doc_id long, text string, score string, rank long, digest string, copies long, nth long, bucket string"


def features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(docs, target):
    s, t = Counter(), Counter()
    for side, rows in ((s, docs), (t, target)):
        for _, text in rows:
            side.update(features(text)[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for n, r in enumerate(able[: 25 * len(able) // 100]):
        r[5] = n + 1
    return out


def test_crc_of_runs_is_zlibs():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 900, 300) * (rng.random(300) < 0.2) + rng.integers(0, 60, 300)
    got = resampling.crc_runs(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    on = resampling.crc_runs(data, starts[::-1], ends[::-1], got)
    assert on.tolist() == [zlib.crc32(data[a:b].tobytes(), int(g)) for a, b, g in zip(starts[::-1], ends[::-1], got)]


def test_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "bdfgk" for b in ("Ran", "tis", "éod", "mek", "9", "日本")]
    texts = [" ".join(rng.choice(words, rng.integers(15, 60))) for _ in range(60)]
    texts += [texts[0]] * 200 + [None, "", " \t.", "Wort_wort-wort'9", "x" * 200_000, "é " * 30_000, "a.b" * 7000]
    docs = list(enumerate(texts)) + [(None, texts[1]), (None, texts[1]), (None, None), (3, texts[3]), (3, texts[3])]
    target = [(0, "bRan tis bRan dtis"), (1, None), (2, " ".join(words)), (2, " ".join(words))]
    side = lambda rows: spark.createDataFrame([(*r, "s", 1, "d", 2, 3, "b") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in resampling.importance(side(docs), side(target)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(map(tuple, plain(docs, target)), key=key)
    drawn = resampling.draw(side(docs), side(target)).collect()
    assert [r.rank for r in drawn] == list(range(1, len(drawn) + 1))


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    docs = spark.createDataFrame([(1, "a " * 30, "s", 1, "d", 2, 3, "b")], SCHEMA)
    out = resampling.importance(docs.limit(n), docs.limit(0)).collect()
    assert len(out) == n and all(r.n_words == 30 and r.n_features == 59 and r.rank is None for r in out)
    assert len(resampling.importance(docs.limit(n), docs).collect()) == n


def test_copies_share_one_weight_and_draw_on_their_own(spark):
    docs = spark.createDataFrame([(i, "the same words " * 10) for i in range(400)], "doc_id long, text string")
    out = resampling.importance(docs, docs.limit(1)).collect()
    assert len({r.weight for r in out}) == 1 and len({r.score for r in out}) > 300
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 101))
