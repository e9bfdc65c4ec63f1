"""Near-dedup against brute force over all pairs."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecard.llm import near_dedup as nd
from ratecard.llm.common import buffers
from ratecard.llm.graph import components
from ratecard.llm.shingles import shingle_hashes

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def shingles(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = SPLIT.findall(low)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows, percent):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(a), find(i) if i is not None else None, i is None or find(i) == i) for i, a in sets), key=str)


def corpus(seed, n_base, copies):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows, i = [], 0
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, rng.choice(["\t", " ", "\n "]).join(t).replace("w1", "W1"), None))
            i += 1
    rng.shuffle(rows)
    return rows


def test_shingles():
    import pyarrow as pa
    texts = ["", None, " \t", "a", "A b", "a b c d e", "a  b\x0bc d e f", "é a\x85b   c", "x " * 9, "q\x00r s"]
    h, n = shingle_hashes(*buffers(pa.array(texts)))
    assert n.tolist() == [len(shingles(t)) for t in texts]
    assert len(set(h.tolist())) == len(set().union(*map(shingles, texts)))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "x long, y long")).collect()))
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in pairs:
        a, b = sorted((find(x), find(y)))
        parent[b] = a
    linked = {x for x, y in pairs if x != y} | {y for x, y in pairs if x != y}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([(4, 4)], "x long, y long")).count() == 0


def test_classes(spark):
    rows = corpus(5, 60, 8)
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, " \n", "x"), (None, rows[0][1], "x"), (5003, "ab", "x"),
             (5004, "AB", "x"), (5005, "one two", "x"), (5005, "one two", "x"), (5006, "long word " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    for percent in (85, 80):
        got = nd.near_classes(docs, percent)
        assert sorted(map(tuple, got.collect()), key=str) == expected(rows, percent)
    assert nd.near_classes(docs.limit(0)).count() == 0
    kept = nd.near_dedup(docs, 80)
    assert kept.columns == docs.columns
    want = [i for i, _, _, k in expected(rows, 80) if k]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_one_large_group_of_loose_copies(spark):
    rng = random.Random(7)
    base = ["b%d" % i for i in range(100)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(100)] = "e%d" % rng.randrange(10**6)
        rows.append((i, " ".join(t), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    assert sorted(map(tuple, nd.near_classes(docs, 85).collect()), key=str) == expected(rows, 85)


def test_banding():
    for percent in (70, 80, 85, 95, 100):
        k, a = nd.banding(percent)
        s = percent / 100
        assert 1 - (1 - (1 - s ** k) ** a) ** 2 <= nd.MISS + 1e-12
    assert np.isfinite(nd.banding(85)).all()


def test_pairs_inside_a_component_are_never_formed(spark):
    """One component of many near copies beside a few strays: pairs grow with the copies, not their square."""
    made = {}
    for copies in (500, 2000):
        live = (spark.range(copies).select(F.explode(F.array(*[F.lit(h) for h in range(3)])).alias("hash"),
                                           F.col("id").alias("node"), F.lit(0).alias("comp"))
                .unionByName(spark.range(3).selectExpr("explode(array(0, 1, 2)) AS hash", "id + 10000 AS node",
                                                       "CAST(id + 10000 AS INT) AS comp"))
                .withColumn("comp", F.col("comp").cast("long")).withColumn("n", F.lit(100).cast("long"))
                .withColumn("at", F.lit(0).cast("long")))
        pairs = nd.cross_pairs(live, 85)
        made[copies] = pairs.count()
        assert pairs.distinct().count() == 3 * copies + 3
    assert made == {c: 3 * (3 * c + 3) for c in made}
    same = spark.createDataFrame([(1, i, 7, 50, 0) for i in range(40)], "hash long, node long, comp long, n long, at long")
    assert nd.cross_pairs(same, 85).count() == 0


def test_loose_copies_beside_a_stray(spark):
    """Near copies of one text, each other than the next, and a text that shares a passage with them."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(250):
        t = list(base)
        t[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t), None))
    rows.append((900, " ".join(base[:60] + [f"s{i}" for i in range(40)]), None))
    got = nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, 85)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="testdata missing")
def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, nd.near_classes(docs, 85).collect()), key=str) == expected(rows, 85)
