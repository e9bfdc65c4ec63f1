"""The filter audit: every cell against a plain simulation, the packed counters, and odd inputs."""

import random
import re
from itertools import permutations

import numpy as np

from ratecard.llm import filter_audit as fa


def plain(docs, labels):
    """(part, order, step) -> the counts, one document and one order at a time."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = {}
    for i, text, part in docs:
        text, part = text or "", part or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for s, f in enumerate(order, 1):
                cell = out.setdefault((part, order, s), [0] * 6)
                removed = fails[f] and not gone
                only = fails[f] and sum(fails.values()) == 1
                for k, hit in enumerate((not gone and not fails[f], removed, fails[f] and gone, only,
                                         removed and i in good, removed and i in toxic)):
                    cell[k] += hit
                gone = gone or fails[f]
    shapley = {}
    for (part, order, s), cell in out.items():
        key = part, order[s - 1]
        shapley[key] = shapley.get(key, 0) + cell[1]
    return {(p, o, s): tuple(c) + (shapley[p, o[s - 1]],) for (p, o, s), c in out.items()}


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*d, "x", 1) for d in docs],
                                  "doc_id long, text string, lang string, part string, cls int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def result(spark, docs, labels):
    rows = fa.filter_audit(*frames(spark, docs, labels)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def corpus():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(n)}" for _ in range(n)) for n in (20, 99, 100, 120, 150)]
    texts += [t.upper() for t in texts] + [t + " #" for t in texts] + ["a b\x1cc d é", "", None, " \t\n",
                                                                      "X" * 3 + "y" * 27, "X" * 3 + "y" * 26]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), (7, docs[7][1], "fr"), (3, "w " * 400, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)]
    return docs, labels + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (999, 1, 1)]


def test_every_cell_equals_a_plain_simulation(spark):
    docs, labels = corpus()
    got = result(spark, docs, labels)
    assert got == plain(docs, labels)
    assert len(got) == 600 * 4  # de, en, fr, and one part for null and empty


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, labels = corpus()
    monkeypatch.setattr(fa, "BROADCAST_ROWS", 0)
    assert result(spark, docs, labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert result(spark, [], []) == {}
    only = result(spark, [(1, None, None)], [])
    assert only == plain([(1, None, None)], []) and only["", "ABCDE", 1][1] == 1


def test_wide_counters_do_not_overflow():
    many = (1 << 62) // 128
    total = sum(many * fa.wide_counter(c) for c in range(128))
    assert np.array_equal(fa.unpacked(total), sum(many * fa.outcomes(c).astype(np.int64) for c in range(128)))
    assert len(fa.ORDERS) == 120 and fa.unpacked(0).sum() == 0
