"""Interaction audit of five document filters over all their orders, with wide packed counters.

A document either passes or fails each filter, whatever the order, so five bits say how it fares. For
each such mask (with two more bits: labelled good, labelled toxic) one big integer has a field of
``FIELD_BITS`` bits for every outcome of every step of every order, 1 where a document of that mask
counts. Adding up the integers of a part's documents adds all fields at once; the sum is unpacked into
the part's 600 rows. A field holds 2^64 - 1 documents, so none runs over into its neighbour.

Documents of one part and mask have equal integers, so they are counted before the shuffle and their
integer is multiplied by that count: a part sums at most 128 integers, however many rows it has.

The filters fail a text (null counts as empty; words are maximal ``[^\\x20\\x09-\\x0D]+``,
case-sensitive) if A: it has under 100 words; B: 100 * distinct words < 80 * words; C: 100 * ``[A-Z]``
characters > 10 * code points; D: it holds one of ``#$%&*|``; E: a smaller doc_id has an identical text.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
GOOD, TOXIC = 32, 64  # bits of a class beside the five of the filters
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BITS = 64
BROADCAST_ROWS = 1_000_000  # labels beyond this are joined by a shuffle
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


def outcomes(cls: int) -> np.ndarray:
    """What a document of class ``cls`` counts for, by order, step and outcome (0 or 1)."""
    out = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), dtype="<u8")
    mask = cls & 31
    for o, order in enumerate(ORDERS):
        gone = False
        for s, name in enumerate(order):
            fails = bool(mask >> FILTERS.index(name) & 1)
            removed = fails and not gone
            out[o, s] = (not fails and not gone, removed, fails and gone,
                         mask == 1 << FILTERS.index(name), removed and cls & GOOD, removed and cls & TOXIC)
            gone = gone or fails
    return np.minimum(out, 1)


@lru_cache(maxsize=None)
def wide_counter(cls: int) -> int:
    """The outcomes of class ``cls`` as one integer with a field for each."""
    return int.from_bytes(outcomes(cls).tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of wide counters, by order, step and outcome."""
    shape = (len(ORDERS), len(FILTERS), len(OUTCOMES))
    raw = total.to_bytes(int(np.prod(shape)) * FIELD_BITS // 8, "little")
    return np.frombuffer(raw, dtype="<u8").reshape(shape).astype(np.int64)


def failures_of_text(text: Column) -> Column:
    """The bits of filters A to D for a text that isn't null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    tests = (F.size(words) < 100,
             100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
             100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"),
             text.rlike(r"[#$%&*|]"))
    return sum((test.cast("int") * (1 << i) for i, test in enumerate(tests)), F.lit(0))


def classes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            part_col: str = "lang") -> DataFrame:
    """One row per document: ``id``, ``part`` and ``cls``, the failed filters' bits plus GOOD and TOXIC.

    Texts are compared by SHA-256. Of a document's labels any quality or toxic of 1 counts; labels
    with a null id match nothing. A row with a null id is never later or earlier than another; rows of
    one id are not later than each other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                              failures_of_text(text).alias("mask"),
                              F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "audit-rows")
    first = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    # keyed by text and id: the copies of one text are spread over all tasks
    rows = (rows.join(first.withColumn("is_first", F.lit(True)).hint("merge"), ["digest", "id"], "left")
            .withColumn("mask", F.col("mask") + F.when(F.col("id").isNotNull() & F.col("is_first").isNull(), 16)
                        .otherwise(0)))
    flags = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg((F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0))
                   + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).alias("flags"))
             .filter("flags > 0"))
    flags = stored(flags, "audit-labels")
    rows = rows.select("id", "part", "mask")
    if flags.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(flags), "id", "left")
    else:  # rows without an id match nothing and stay out of the shuffle
        rows = (rows.filter("id IS NOT NULL").join(flags.hint("merge"), "id", "left")
                .unionByName(rows.filter("id IS NULL").withColumn("flags", F.lit(None).cast("int"))))
    return rows.select("id", "part", (F.col("mask") + F.coalesce("flags", F.lit(0))).alias("cls"))


def audit(classed: DataFrame) -> DataFrame:
    """``part``, ``cls`` of all documents -> one row per part, filter order and step, zeros included."""
    counts = classed.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))

    def rows(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(int(n) * wide_counter(int(c)) for c, n in zip(group["cls"], group["n"]))
        fields = unpacked(total)
        out = pd.DataFrame(fields.reshape(-1, len(OUTCOMES)), columns=list(OUTCOMES))
        out.insert(0, "part", group["part"].iloc[0])
        out.insert(1, "filter_order", np.repeat(ORDERS, len(FILTERS)))
        out.insert(2, "step", np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)))
        by_filter = pd.Series([name for order in ORDERS for name in order])
        out["shapley"] = out["removed"].groupby(by_filter).transform("sum")
        return out

    return counts.groupBy("part").applyInPandas(rows, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all ``docs``. An empty table has no parts and gives no rows; a null part counts as
    the empty string; repeated rows count each; other columns are never read."""
    return audit(classes(docs, labels))
