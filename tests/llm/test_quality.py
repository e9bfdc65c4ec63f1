"""Quality: statistics, normal equations and calibration against plain versions, accuracy, odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ratecard.llm import quality
from ratecard.llm.common import buffers

SYLLABLES = ["la", "me", "ni", "po", "ru", "sé", "tor", "kan"]


def plain(text):
    raw, words = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
    count = lambda chars: sum(raw.count(c) for c in chars.encode())
    symbols, n = "#$%&*|<>{}[]=_~^@\\/+", max(len(words), 1)
    caps, chars = sum("A" <= c <= "Z" for c in text), max(len(text), 1)
    lines = [w for w in (re.findall(r"[^\x20\x09-\x0D]+", x) for x in text.split("\n")) if w]
    bodies = {tuple(sorted(w.lower() if w.isascii() else w for w in x)) for x in lines}
    wide = sum(ord(c) > 127 for c in text)
    share = [c / len(raw) for c in Counter(raw).values()]
    lower = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words}
    return [math.log1p(len(text)), math.log1p(len(words)), math.log1p(text.count("\n")),
            sum(len(w.encode()) for w in words) / n, caps / chars,
            (sum(c.isascii() and c.isalpha() for c in text) + wide) / chars, count("0123456789") / chars,
            count(" \t\n\x0b\x0c\r") / chars, count(",;:.") / n, count("!?") / n, count(symbols) / n, count("|") / n,
            wide / chars, -sum(p * math.log2(p) for p in share),
            sum("A" <= w[0] <= "Z" for w in words) / n, sum(w[-1] in symbols for w in words) / n,
            sum(len(w.encode()) <= 2 for w in words) / n, len(lower) / n, len(bodies) / max(len(lines), 1),
            math.log1p(len(words) / max(len(lines), 1)), math.log1p(len(words) / (count(".!?") + 1))]


def test_statistics_of_whole_texts():
    rng = random.Random(2)
    texts = ["", " ", "\n\n", "A", "é", None, "a b\x1cc, d!\n\nA B\nb a\n", "# | x# y|"]
    texts += ["".join(rng.choice("aB é#|.!\n 7\t") for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += ["word " * 300_000 + "\nend", " \t"]
    got = quality.statistics_of(*buffers(pa.array([x or "" for x in texts], pa.large_string())))
    want = np.array([plain(x or "") for x in texts])
    assert got.shape == want.shape == (len(texts), len(quality.STATISTICS))
    assert np.allclose(got, want, atol=1e-5)
    assert quality.statistics_of(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape == (0, len(quality.STATISTICS))


def test_normal_equations_and_penalty(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(quality.STATISTICS))).astype(np.float32)
    good, fold = (x[:, 0] > 0).astype(int), rng.integers(1, 5, 300)
    basis = quality.Basis(x.mean(axis=0).astype(float), x.std(axis=0).astype(float))
    frame = spark.createDataFrame([(v.tolist(), int(g), int(f)) for v, g, f in zip(x, good, fold)],
                                  "x array<float>, good int, fold int").repartition(3)
    sums = quality.fold_sums(frame, basis)
    z = basis.features(x.astype(float))
    for f, got in sums.items():
        a = np.column_stack([z, good])[fold == f]
        assert np.allclose(got, a.T @ a)
    whole = sum(sums.values())
    w = quality.ridge(whole, 1e-2)
    assert np.isclose(quality.squared_error(whole, w), ((z @ w - good) ** 2).sum())
    damp = np.diag([math.sqrt(3.0)] * quality.FEATURES + [0.0])
    best = np.linalg.lstsq(np.vstack([z, damp]), np.append(good, np.zeros(len(damp))), rcond=None)[0]
    assert np.allclose(z @ w, z @ best, atol=1e-6)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, len(quality.STATISTICS)))
    z = quality.Basis(np.zeros(x.shape[1]), np.ones(x.shape[1])).features(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    kernel = np.exp(-apart / (2 * quality.WIDTH ** 2 * x.shape[1]))
    assert np.abs(z @ z.T - kernel).max() < 0.3 and np.abs(z @ z.T - kernel).mean() < 0.06


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_against_the_min_max_formula(seed):
    rng = np.random.default_rng(seed)
    x, n = np.sort(rng.choice(500, 30, replace=False)) / 100, rng.integers(1, 9, 30).astype(float)
    good = np.array([rng.integers(0, k + 1) for k in n], float)
    places, shares = quality.isotonic(x, good, n)
    mean = lambda a, b: good[a:b].sum() / n[a:b].sum()
    want = [max(min(mean(a, b) for b in range(i + 1, 31)) for a in range(i + 1)) for i in range(30)]
    assert np.all(np.diff(places) > 0) and np.all(np.diff(shares) > 0)
    assert np.allclose(np.unique(np.round(want, 12)), shares)


def corpus(n, seed=4):
    rng = random.Random(seed)
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(10, 120))]
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else (
                [w + rng.choice(["***", "###", "$$$"]) for w in words] if kind == 1 else words[:2] * (len(words) // 2))
        yield i, " ".join(words) + ".", int(good)


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    rows = list(corpus(1500))
    odd = [(9001, None), (9002, ""), (None, "po ru."), (7, rows[7][1]), (9004, "PO!! " * 5000)]
    docs = spark.createDataFrame([(i, t, 0, 5) for i, t, _ in rows] + [(i, t, None, None) for i, t in odd],
                                 "doc_id long, text string, quality int, x int")
    labels = spark.createDataFrame([(i, g, 1) for i, _, g in rows] + [(None, 1, 1), (5, None, 0), (6, rows[6][2], 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows) + len(odd)
    truth = {i: g for i, _, g in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9001]["score"] == by_id[9002]["score"] and by_id[9004]["predicted"] == 0
    assert not by_id[None]["held_out"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    again = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    assert all(math.isclose(again[i], r["score"], abs_tol=1e-6) for i, r in by_id.items())


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score(docs, labels).collect()} == {1.0}
