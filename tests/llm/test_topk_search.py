"""Exact search against brute force, with copies, ties and odd vectors."""

import math
import random

from ratecard.llm import topk_search


def expected(rows, k, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(good):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(good) if j != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search(spark, monkeypatch):
    rng = random.Random(8)
    f = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f(rng.uniform(-1, 1)) for _ in range(6)], "a") for i in range(400)]
    hot = rows[40][1]
    rows += [(400 + i, hot, "a") for i in range(150)]
    rows += [(600 + i, [f(rng.choice([-0.5, 0.0, 0.5])) for _ in range(6)], "a") for i in range(120)]
    rows += [(800, None, None), (820, [None] * 6, "x"), (840, [float("nan")] * 6, "x"), (860, [float("inf")] * 6, "x"),
             (880, [0.0] * 6, "x"), (900, [], "x"), (920, [1.0, 0.5], "x"), (None, hot, "x"), (40, hot, "x"), (60, hot, "x"),
             (-20, hot, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    for k, block, chunk in ((20, 4096, 8192), (3, 7, 50), (900, 100, 64)):
        monkeypatch.setattr(topk_search, "BLOCK", block)
        monkeypatch.setattr(topk_search, "CHUNK", chunk)
        if chunk != 8192:
            frame = frame.repartition(2)
        got = topk_search.search(frame, k=k).collect()
        assert sorted(map(tuple, got)) == expected(rows, k)
    few = spark.createDataFrame(rows[:1] + rows[20:21], frame.schema)
    assert sorted(map(tuple, topk_search.search(few).collect())) == expected(rows[:1] + rows[20:21], 20)
    assert topk_search.search(frame.limit(0)).count() == 0
    assert topk_search.search(spark.createDataFrame([(7, hot, "x")], frame.schema)).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e5, 1e5) for _ in range(8)], None) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, topk_search.search(frame, k=5).collect())) == expected(rows, 5)


def test_rows_that_share_an_id_all_take_part(spark):
    rows = [(20, [1.0, 0.0], None), (20, [0.5, 0.5], None), (20, [0.5, 0.5], None), (1, [1.0, 1.0], None),
            (1, [1.0, 1.0], None), (2, [0.0, 1.0], None), (40, [0.5, 0.5], None)]
    rows += [(60, [0.25, 0.25], None)] * 30
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string").repartition(3)
    for k in (2, 5, 20):
        got = sorted(map(tuple, topk_search.search(frame, k=k).collect()))
        assert got == expected(rows, k)
    assert len({(r[0], r[1]) for r in got}) < len(got) == 20 * (3 + 1 + 30)


def test_many_chunks_in_a_task(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], None) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int")
    monkeypatch.setattr(topk_search, "CHUNK", 10)
    assert sorted(map(tuple, topk_search.search(frame, k=3).collect())) == expected(rows, 3)
