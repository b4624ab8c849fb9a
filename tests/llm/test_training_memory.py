"""What training and its neighbours hold, and where."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from dotforge.llm import components, learn, toxicity
from dotforge.llm import textcore as tc


def test_words_of_a_sample_need_little_beside_themselves():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 12))) for _ in range(60)) for _ in range(3000)]
    data, offsets = tc.utf8(pa.array(texts))
    tracemalloc.start()
    words = toxicity.Words.of(data, offsets)
    whole = toxicity.Words(data, offsets)
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    again = toxicity.Words.of(data, offsets)
    size, peak = (x - held for x in tracemalloc.get_traced_memory())
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words.first))
    y = (np.arange(len(texts)) % 3 == 0).astype(np.float32)
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    toxicity.all_odds(words, owner, y, np.ones(len(y), np.float32))
    counted = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    for name in ("word", "count", "piece", "head", "at", "first"):
        assert (getattr(words, name) == getattr(whole, name)).all() and (getattr(again, name) == getattr(whole, name)).all()
    print(size / 1e6, peak / 1e6, counted / 1e6)
    assert peak < 2.1 * size and counted < 1.2 * size


def test_near_copies_hold_a_few_megabytes_at_a_time():
    from dotforge.llm import near_dedup

    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 70_000).astype(np.uint64)
    whole = near_dedup.sketch(x, len(x))
    tracemalloc.start()
    got = near_dedup.sketch(x)
    sketched = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == whole).all() and sketched < 16 << 20
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(400)])], ["text"])
    out = list(near_dedup._counts(iter([batch])))
    assert len(out) > 1 and sum(o.column(1).to_numpy().sum() for o in out) == sum(len(x) for some in near_dedup._marks(batch) for _, x in some)


def test_the_network_learns_outside_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} {'bad' if i % 3 == 0 else 'good'} text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    want = toxicity.train(*learn.labelled_sample(docs, labels, "toxic", 4, 2, 40))
    got = toxicity.fit(docs, labels, 40)
    assert "out" in got and got.keys() == want.keys() and all((np.asarray(got[k]) == want[k]).all() for k in want)
    assert toxicity.fit(docs, labels.where("toxic > 1")) == {"prior": 0.0}
    monkeypatch.setattr(toxicity, "train", lambda *_: {"prior": float(os.getpid())})
    assert toxicity.fit(docs, labels, 40)["prior"] != os.getpid()


def test_components_stop_as_soon_as_all_are_stars(spark, monkeypatch):
    rnd, rounds, star = random.Random(4), [], components._star
    monkeypatch.setattr(components, "_star", lambda *how: rounds.append(how[1]) or star(*how))
    found = lambda edges: {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found([(1, 5), (6, 1), (2, 2), (9, 7)]) == {1: 1, 5: 1, 6: 1, 7: 7, 9: 7} and not rounds
    assert found([(1, 2), (3, 2)]) == {1: 1, 2: 1, 3: 1} and len(rounds) == 2
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert found(edges) == root
