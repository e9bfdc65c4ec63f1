"""Exact dedup against brute force, with groups that part late and odd rows."""

import hashlib

from ratecard.llm import exact_dedup as e

LONG = "Ab" * 40_000
ROWS = [(1, None, "p"), (2, "", "p"), (3, "A b", "q"), (4, "a B", "q"), (5, "É", "q"), (6, "é", "q"), (7, LONG, "r"),
        (8, LONG.lower(), "r"), (9, LONG[:-1] + "c", "r"), (10, LONG[:100] + "x" + LONG[101:], "r"), (10, "same", None),
        (10, "same", None), (11, "a" * 32, "s"), (12, "A" * 32, "s"), (13, "a" * 33, "s"), (None, "a b", "t"),
        (None, None, "t"), (14, "x\x00y", "u"), (15, "X\x00y", "u"), (16, "x\x00z", "u"), *[(100 + i, "hot", "h") for i in range(300)]]
SCHEMA = "doc_id long, text string, chunk string"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def expected(rows):
    out = []
    for i, t, _ in rows:
        same = [j for j, x, _ in rows if j is not None and low(x) == low(t)]
        named = i is not None
        out.append((i, max(same) if named else None, len(same) if named else 1, not named or i == max(same),
                    hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_classes(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, e.exact_classes(docs).collect()), key=str) == expected(ROWS)
    monkeypatch.setattr(e, "WIDEST", 20_000)
    assert sorted(map(tuple, e.exact_classes(docs).collect()), key=str) == expected(ROWS)
    assert e.exact_classes(docs.limit(0)).count() == 0


def test_dedup(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = e.exact_dedup(docs)
    assert got.columns == docs.columns
    want = {(i, low(t)) for (i, t, _), x in zip(ROWS, [r for r in ROWS]) if i is None or i == max(
        j for j, y, _ in ROWS if j is not None and low(y) == low(t))}
    assert sorted((r["doc_id"] or -1, low(r["text"])) for r in got.collect()) == sorted((i or -1, t) for i, t in want)
