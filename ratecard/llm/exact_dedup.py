"""Exact dedup by distributed MSD radix partitioning.

A document is the byte string of its text with A-Z lower-cased, led by its length as a first digit,
so that no string is the prefix of another. Round by round, groups are split by their next
successive bytes: (group, next bytes) is a new group. A group that is down to one row leaves as a
singleton; a group whose bytes have ended holds equal texts and leaves as a class. Equality is
settled by the bytes themselves; no digest is compared.

The first round reads the table's rows narrowly (length and first bytes); only rows of groups with
two or more members (found by a broadcast of fixed size before the shuffle) carry their remaining
bytes into the next rounds, and each round takes
``GROWTH`` times as many bytes as the one before, up to ``WIDEST`` at once, which bounds a task's
row. Group counts are combined before the shuffle, so a group holding a third of all rows is one row
per task there, and the join that hands rows their new group is an ordinary equi-join whose hot keys
Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, likely_in, stored, text_bytes

FIRST = 32
GROWTH = 16
WIDEST = 1 << 20


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``keep_id`` (largest id among rows of equal text), ``group_size``
    (rows of equal text), ``kept`` and ``text_sha256`` of the normalised text.

    Null text counts as empty; empty texts are equal. Repeated rows (same id and text) count as
    members and are returned each, all ``kept`` if their id is the largest. A row with a null id
    cannot be named: it is returned with null ``keep_id``, ``group_size`` 1 and ``kept`` true. An
    empty table gives an empty result. Other columns are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    named = rows.filter("id IS NOT NULL").select(
        "id", F.translate(F.col("raw").cast("string"), UPPER, LOWER).cast("binary").alias("norm"))
    digit = named.select("id", F.octet_length("norm").alias("len"),
                         F.substring("norm", 1, FIRST).alias("chunk"), "norm")
    groups = stored(digit.groupBy("len", "chunk").agg(F.count(F.lit(1)).alias("n"),
                                                      F.max("id").alias("grp"))
                    .filter("n > 1"), "radix-groups")
    sha = F.sha2("norm", 256).alias("text_sha256")
    single = digit.select("id", "len", "chunk", sha).join(groups, ["len", "chunk"], "left_anti")
    out = [single.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                         "text_sha256")]
    active = stored(likely_in(digit, groups, ["len", "chunk"]).join(groups.hint("merge"), ["len", "chunk"])
                    .select("id", "len", "grp", "n", sha,
                            F.expr(f"substring(norm, {FIRST + 1})").alias("rest")), "radix-rows")
    at, width = FIRST, FIRST * GROWTH
    while True:
        ended = active.filter(F.col("len") <= at)
        out.append(ended.select("id", F.col("grp").alias("keep_id"), F.col("n").alias("group_size"),
                                "text_sha256"))
        left = active.filter(F.col("len") > at)
        if left.isEmpty():
            break
        left = left.select("id", "len", F.col("grp").alias("old"), "text_sha256",
                           F.expr(f"substring(rest, 1, {width})").alias("chunk"),
                           F.expr(f"substring(rest, {width + 1})").alias("rest"))
        # written, so that the rows of a hot part, dealt for the join alone, can be split
        parts = stored(left.groupBy("old", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("grp")),
                       "radix-parts")
        moved = stored(left.join(parts, ["old", "chunk"])
                       .select("id", "len", "grp", "n", "text_sha256", "rest"), "radix-rows")
        out.append(moved.filter("n = 1").select("id", F.col("grp").alias("keep_id"),
                                                F.col("n").alias("group_size"), "text_sha256"))
        active = moved.filter("n > 1")
        at, width = at + width, min(width * GROWTH, WIDEST)
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    nameless = rows.filter("id IS NULL").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.sha2(F.translate(F.col("raw").cast("string"), UPPER, LOWER).cast("binary"), 256)
        .alias("text_sha256"))
    return (result.unionByName(nameless)
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    F.coalesce(F.col("id") == F.col("keep_id"), F.lit(True)).alias("kept"),
                    "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text equals that of a row with a larger id. Of rows that repeat
    the kept id and text, one stays; rows with a null id all stay."""
    classes = exact_classes(docs, id_col, text_col)
    # (id, text) names a row; sha256 only tells apart texts that share one id
    named = classes.select(F.col(id_col).alias("__radix_id"), F.col("text_sha256").alias("__radix_sha"), "kept",
                           "group_size").filter("__radix_id IS NOT NULL")
    gone = stored(named.filter("NOT kept").select("__radix_id", "__radix_sha").distinct(), "radix-gone")
    again = stored(named.filter("kept AND group_size > 1").groupBy("__radix_id", "__radix_sha")
                   .agg(F.count(F.lit(1)).alias("__radix_n")).filter("__radix_n > 1").drop("__radix_n"), "radix-again")
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).cast("binary"), 256)
    marked = docs.withColumn("__radix_sha", sha).withColumn("__radix_id", F.col(id_col))
    # only rows that may go are shuffled
    left = likely_in(marked, gone, ["__radix_id"], others=True).unionByName(
        likely_in(marked, gone, ["__radix_id"]).join(gone.hint("merge"), ["__radix_id", "__radix_sha"], "left_anti"))
    if not again.isEmpty():
        twice = left.join(again, ["__radix_id", "__radix_sha"], "left_semi").dropDuplicates(["__radix_id", "__radix_sha"])
        left = left.join(again, ["__radix_id", "__radix_sha"], "left_anti").unionByName(twice)
    return left.select(*docs.columns)
