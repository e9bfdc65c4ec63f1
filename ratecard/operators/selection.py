"""Exact quantiles of several columns by radix selection: no sort, no shuffle of rows.

A double's 64 bits, turned so that they compare like the numbers, are read as
four digits of 16 bits. For every (group, column, rank) sought, a pass counts
the next digit among the rows whose leading digits are the ones found so far;
the digit that holds the rank is kept and the rank moves inside it. After at most
four passes the bits are the value. A pass reads only the group and value columns,
serves all columns and ranks at once, and sends per task a count per digit
seen, at most 65,536 per (group, column, prefix) whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecard.operators.ranking import exact_quantiles
from ratecard.session import freeze

DIGIT = 16
MAX_GROUPS = 1000  # their ranks are held by the driver; beyond, columns are ordered one by one
COUNTS_ROWS = 1 << 20
GATHER = 100_000  # values that the driver may take to end a search


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers that compare like the doubles (-0.0 counts as 0.0)."""
    bits = (v + 0.0).view(np.uint64)
    negative = bits >> np.uint64(63) == 1
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([raw], dtype=np.uint64).view(np.float64)[0])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counts(rows: DataFrame, columns: Sequence[str], sought: list[tuple[int, int, int]], known: int,
            take: int) -> DataFrame:
    """(place in ``sought``, digit, n): how often the next ``take`` bits have each value behind a (column,
    group, prefix of ``known`` bits) of ``sought``."""
    by_column = {c: sorted((g << known | p, i) for i, (at, g, p) in enumerate(sought) if at == c)
                 for c in range(len(columns))}
    shift, mask = np.uint64(64 - known - take), np.uint64((1 << take) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            group = b.column("_g").to_numpy().astype(np.uint64)
            for c, name in enumerate(columns):
                if not by_column[c]:
                    continue
                wanted = np.array([k for k, _ in by_column[c]], dtype=np.uint64)
                place = np.array([i for _, i in by_column[c]], dtype=np.int64)
                v = b.column(name).to_numpy(zero_copy_only=False)
                there = ~np.isnan(v)
                bits = ordered_bits(v[there])
                prefix = bits >> np.uint64(64 - known) if known else np.zeros(len(bits), np.uint64)
                key = group[there] << np.uint64(known) | prefix
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                hit = wanted[at] == key
                digit = (bits[hit] >> shift & mask).astype(np.int64)
                parts.append(np.unique(place[at[hit]] << take | digit, return_counts=True))
            if sum(len(k) for k, _ in parts) > COUNTS_ROWS:
                parts = [_merged(parts)]
        if parts:
            keys, n = _merged(parts)
            yield pa.record_batch({"place": (keys >> take).astype(np.int32), "digit": keys & (1 << take) - 1, "n": n})

    return (rows.mapInArrow(count, "place int, digit long, n long")
            .groupBy("place", "digit").agg(F.sum("n").alias("n")))


def selected_quantiles(df: DataFrame, group_cols: Sequence[str], columns: Sequence[str],
                       qs: Sequence[float], written: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation of all ``columns`` per group: group columns, ``column``,
    ``q_idx``, ``q``, ``value`` (double). Nulls and NaN don't count; a column without values in a group
    gives no rows there. A null group is a group.

    Runs jobs while the plan is built: one for the groups, one that writes the columns (unless ``df`` is
    ``written`` already) and one per digit. As soon as at most GATHER values share the digits found, they
    go to the driver and end the search. Groups are counted: beyond MAX_GROUPS the columns go through
    ``exact_quantiles`` one after another."""
    g = list(group_cols)
    groups = df.select(*g).distinct().limit(MAX_GROUPS + 1).collect() if g else [()]
    if len(groups) > MAX_GROUPS:
        parts = [exact_quantiles(df, g, c, qs).withColumn("column", F.lit(c)) for c in columns]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*g, "column", "q_idx", "q", "value")
    spark = df.sparkSession
    kinds = [f"{df.schema[c].dataType.simpleString()}" for c in g]
    out_schema = ", ".join([*(f"`{c}` {k}" for c, k in zip(g, kinds)),
                            "column string, q_idx int, q double, value double"])
    if not groups:
        return spark.createDataFrame([], out_schema)
    if g:
        names = spark.createDataFrame([(*r, i) for i, r in enumerate(groups)],
                                      ", ".join([*(f"_k{i} {k}" for i, k in enumerate(kinds)), "_g int"]))
        same = F.lit(True)
        for i, c in enumerate(g):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        rows = df.join(F.broadcast(names), same)
    else:
        rows = df.withColumn("_g", F.lit(0))
    labels = [f"_v{i}" for i in range(len(columns))]
    rows = rows.select("_g", *[F.col(c).cast("double").alias(v) for c, v in zip(columns, labels)])
    if not written:
        rows = freeze(rows)

    # the first digit, and with it the ranks that the quantiles ask for
    sought = [(c, group, 0) for c in range(len(columns)) for group in range(len(groups))]
    w = Window.partitionBy("place").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy("place"))
    upto = _counts(rows, labels, sought, 0, DIGIT).withColumn("upto", F.sum("n").over(w)).withColumn("total", total)
    places = F.array(*[F.lit(float(q)) for q in qs])
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda q: F.array(
        F.floor(q * (F.col("total") - 1)), F.ceil(q * (F.col("total") - 1))))))
    inside = lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))
    state: dict[tuple[int, int, int], tuple[int, int, int]] = {}  # rank sought -> prefix, rank in it, its rows
    sizes: dict[tuple[int, int], int] = {}
    for r in (upto.withColumn("ranks", F.filter(ranks, inside)).where(F.size("ranks") > 0)
              .select("place", "digit", "n", "upto", "total", "ranks").collect()):
        c, group, _ = sought[r["place"]]
        sizes[c, group] = r["total"]
        for rank in r["ranks"]:
            state[c, group, rank] = (r["digit"], rank - (r["upto"] - r["n"]), r["n"])
    known = DIGIT
    while state and known < 64:
        sought = sorted({(c, group, prefix) for (c, group, _), (prefix, _, _) in state.items()})
        place = {s: i for i, s in enumerate(sought)}
        left = sum({(c, group, prefix): n for (c, group, _), (prefix, _, n) in state.items()}.values())
        take = 64 - known if left <= GATHER and len(sought) < 1 << (known - 1) else DIGIT
        counts = _counts(rows, labels, sought, known, take)
        found = {}
        if take == DIGIT:
            asked = spark.createDataFrame(sorted({(place[c, group, prefix], rank) for (c, group, _), (prefix, rank, _)
                                                  in state.items()}), "place int, rank long")
            # one digit per rank sought
            for r in (counts.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(asked), "place")
                      .where(inside(F.col("rank"))).collect()):
                found[r["place"], r["rank"]] = (r["digit"], r["upto"] - r["n"], r["n"])
        else:
            per_place: dict[int, list] = {}
            for r in counts.collect():
                per_place.setdefault(r["place"], []).append((r["digit"], r["n"]))
            ends = {}
            for at, values in per_place.items():
                digits, n = np.array(sorted(values)).T
                ends[at] = (digits, np.cumsum(n), n)
            for (c, group, _), (prefix, rank, _) in state.items():
                at = place[c, group, prefix]
                digits, upto_here, n = ends[at]
                k = int(np.searchsorted(upto_here, rank, side="right"))
                found[at, rank] = (int(digits[k]), int(upto_here[k] - n[k]), int(n[k]))
        for (c, group, rank), (prefix, at_rank, _) in state.items():
            digit, before, n = found[place[c, group, prefix], at_rank]
            state[c, group, rank] = (prefix << take | digit, at_rank - before, n)
        known += take
    out = []
    for (c, group), n in sizes.items():
        for i, q in enumerate(qs):
            at = q * (n - 1)
            lo, hi = int(np.floor(at)), int(np.ceil(at))
            below, above = (from_bits(state[c, group, rank][0]) for rank in (lo, hi))
            value = below if lo == hi or below == above else (hi - at) * below + (at - lo) * above
            out.append((*groups[group], columns[c], i, float(q), value))
    return spark.createDataFrame(out, out_schema)
