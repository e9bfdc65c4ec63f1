"""Toxicity: held-out accuracy, the counts against brute force, and odd inputs."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratecard.llm import toxicity

WORDS = [a + b for a in ("an", "be", "co", "du", "er", "fo", "gi") for b in ("la", "me", "ni", "po", "ru", "sé")]
BAD = ["grob", "fies", "schuft"]


def corpus(n, seed=4):
    rng = random.Random(seed)
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(1 + len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        yield i, " ".join(words).capitalize() + ".", int(toxic)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = list(corpus(1500))
    odd = [(9001, None), (9002, ""), (None, "an fies"), (9003, "?! 12"), (7, rows[7][1]), (9004, "fies " * 3000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(i, t, None) for i, t in odd],
                                 "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, t, 1) for i, _, t in rows] + [(None, 1, 1), (5, None, 0)],
                                   "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: t for i, _, t in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and len(held) > 200
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9001]["score"] == by_id[9002]["score"] == by_id[9003]["score"] < 0.5 < by_id[9004]["score"]
    assert not by_id[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.keep_ordinary(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_continuation_counts(spark):
    rows = [(1, "a b a b", 1, 2), (2, "a b c", 0, 1), (3, "b c b", 0, 3), (4, "", 1, 1)]
    frame = spark.createDataFrame([(t, y, f) for _, t, y, f in rows], "words string, toxic int, fold long")
    got = toxicity.continuation_counts(frame).toPandas().set_index("slot")
    slot = dict(zip("abc", toxicity.slots_of(pa.array(["a b c"]))[1].tolist()))
    pairs = {(y, p, w, f != 1) for _, t, y, f in rows for p, w in zip([""] + t.split(), t.split())}
    for w, s in slot.items():
        for y, name in ((1, "toxic"), (0, "ordinary")):
            assert got.loc[s, name] == len({p for c, p, x, _ in pairs if (c, x) == (y, w)})
            assert got.loc[s, name + "_rest"] == len({p for c, p, x, r in pairs if (c, x) == (y, w) and r})


def test_words_with_equal_leading_bits_are_apart(spark):
    words = pa.array([" ".join(a + b + c for a in WORDS for b in WORDS for c in WORDS[:6])])
    text = words[0].as_py().split()
    lead = {}
    for w, h in zip(text, toxicity.slots_of(words)[0].tolist()):
        if (other := lead.setdefault(h >> 43, w)) != w:  # the first 21 bits
            break
    else:
        raise AssertionError("no such pair")
    rows = [(f"{other} x", 0, 2)] * 2 + [(f"{w} x", 1, 2)]
    frame = spark.createDataFrame(rows, "words string, toxic int, fold long")
    got = toxicity.continuation_counts(frame).toPandas().set_index("slot")
    mine, theirs = toxicity.slots_of(pa.array([f"{w} {other}"]))[1].tolist()
    assert got.loc[mine, ["toxic", "ordinary"]].tolist() == [1, 0]
    assert got.loc[theirs, ["toxic", "ordinary"]].tolist() == [0, 1]


def plain_counts(docs, labels, leave_out):
    """word -> [toxic, ordinary] continuation counts, from the rows of the other folds."""
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known[i] = max(y, known.get(i, 0))
    seen = set()
    for i, text in docs:
        if i in known and zlib.crc32(str(i).encode()) % 5 not in leave_out:
            words = words_of(text)
            seen |= {(known[i], p, w) for p, w in zip(["", *words], words)}
    out = {}
    for y, _, w in seen:
        out.setdefault(w, [0, 0])[1 - y] += 1
    return out


def words_of(text):
    return re.sub(r"[^\w]|[\d_]", " ", (text or "").lower()).split()


def plain_model(counts, d):
    """word -> the two probabilities, and the backoff masses."""
    total = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    taken = [sum(min(c[k], d) for c in counts.values()) / total[k] for k in (0, 1)]
    return {w: [max(c[k] - d, 0) / total[k] + taken[k] * sum(c) / sum(total) for k in (0, 1)]
            for w, c in counts.items()}, taken


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, t, y) for i, t, y in corpus(1200, seed=11)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


@pytest.mark.parametrize("d", [1.0, 1.5, 5.0])
def test_probabilities_of_a_class_sum_to_one(spark, d):
    counts = spark.createDataFrame([(w, t, o, t, o) for w, (t, o) in enumerate([(1, 0), (0, 1), (7, 2), (3, 3), (0, 9)])],
                                   "slot long, toxic int, ordinary int, toxic_rest int, ordinary_rest int")
    m = toxicity.masses(counts, "", (d,))[0]
    for cls in ("toxic", "ordinary"):
        total = counts.agg(F.sum(m.probability(cls, F.col("toxic"), F.col("ordinary")))).first()[0]
        assert total == pytest.approx(1.0, abs=1e-12)
    plain, taken = plain_model({0: [1, 0], 1: [0, 1], 2: [7, 2], 3: [3, 3], 4: [0, 9]}, d)
    assert m.rest() == pytest.approx(taken[0] / taken[1])
    got = [r[0] for r in counts.orderBy("slot").select(m.ratio(F.col("toxic"), F.col("ordinary"))).collect()]
    assert got == pytest.approx([plain[w][0] / plain[w][1] for w in range(5)])


def test_scores_equal_a_plain_model(spark, fitted):
    rows, docs, labels, model = fitted
    counts = plain_counts([r[:2] for r in rows], [(i, y) for i, _, y in rows], {0})
    plain, taken = plain_model(counts, model.discount)
    rare = math.log1p(model.share * (taken[0] / taken[1] - 1))
    says = {w: math.log1p(model.share * (p[0] / p[1] - 1)) - rare for w, p in plain.items()}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows:
        words = words_of(text)
        x = sum(says.get(w, 0.0) for w in words) / max(len(words), 1)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.offset))), abs=2e-4)


def test_joined_weights_score_alike(spark, fitted, monkeypatch):
    rows, docs, labels, model = fitted
    docs = docs.unionByName(spark.createDataFrame([(None, None), (5000, ""), (1, rows[1][1]), (6000, "grob")], docs.schema))
    docs = docs.withColumn("key", F.lit("k")).withColumn("score", F.lit(7))
    key = lambda r: (str(r["doc_id"]), r["score"])
    held = sorted(toxicity.score(docs, model).collect(), key=key)
    kept = sorted(map(tuple, toxicity.keep_ordinary(docs, model).collect()), key=str)
    monkeypatch.setattr(toxicity, "TABLE_ROWS", 0)
    again = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert not again.held()
    assert (again.discount, again.share, again.words) == (model.discount, model.share, model.words)
    assert (again.slope, again.offset) == pytest.approx((model.slope, model.offset), rel=1e-3)
    joined = sorted(toxicity.score(docs, model).collect(), key=key)
    assert [(r["doc_id"], r["predicted"]) for r in joined] == [(r["doc_id"], r["predicted"]) for r in held]
    assert [r["score"] for r in joined] == pytest.approx([r["score"] for r in held], abs=1e-6)
    out = toxicity.keep_ordinary(docs, model)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == kept
    assert toxicity.score(docs.limit(0), model).count() == 0
