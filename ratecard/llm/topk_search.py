"""Exact top-k search by a three-phase uniform threshold.

A vector's score for a query is the sum of its partial scores over ``LISTS`` groups of components, and
every task has, for its rows, one list of partial scores per group.

1. Each task takes the k best of each local list and adds up their scores. The k-th best total found
   anywhere is a lower bound t for the k-th best score: a safe cutoff.
2. The cutoff goes to all tasks. A vector that scores t or more has a partial score of at least
   t / LISTS in some list, so the entries at or above that threshold suffice.
3. The remaining partial scores of just these entries are added, and those that reach t are ranked.

Equal vectors are one candidate and one query: their rows join in at the end, at most the k + 1 of
the smallest ids of each (no more can be among a query's k best, its own row aside). Every row has a
key of its own, so rows that share an id all take part. Queries and cutoffs are written to the shared
folder in blocks of ``BLOCK`` vectors; every task reads them block by block, so neither the driver nor
a broadcast holds them all. A task holds its own rows and, for one block at a time, the best totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_path, stored

LISTS = 2
BLOCK = 4096
CHUNK = 8192


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``row`` (a key of its own), ``id`` and ``v`` (floor(scale * x) of every component x) of the rows that
    take part: those with an id, a vector and finite components only."""
    x = F.col(vec_col).cast("array<double>")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return (rows.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(good)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                    F.transform(x, lambda e: F.floor(e * scale)).alias("v")))


@lru_cache(maxsize=4)
def block_table(folder: str, number: int) -> pa.Table:
    """One block of queries (and cutoffs), read from the shared folder."""
    place, base = fs.FileSystem.from_uri(f"{folder}/block={number}")
    return pq.read_table(base, filesystem=place, partitioning=None)


def matrix(vectors: pa.Array, dims: int, kind) -> np.ndarray:
    """Vectors as rows; components that a shorter one lacks are 0."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims), kind)
    row = np.repeat(np.arange(len(vectors)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = vectors.flatten().to_numpy()
    return out


def joined_list(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            part = b.slice(at, CHUNK)
            if n + part.num_rows > CHUNK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def partial_scores(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """For each group of components, the partial scores of all rows of ``x`` for all of ``q``."""
    cuts = np.linspace(0, q.shape[1], LISTS + 1).astype(int)
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:])]


def safe_totals(lists: list[np.ndarray], k: int) -> np.ndarray:
    """Phase 1: totals of the k best entries of each list, best first; -inf where there are fewer."""
    n = min(k, lists[0].shape[1])
    found = np.concatenate([np.argpartition(p, -n, axis=1)[:, -n:] for p in lists], axis=1)
    found.sort(axis=1)
    totals = sum(np.take_along_axis(p, found, 1) for p in lists).astype(float)
    totals[:, 1:][found[:, 1:] == found[:, :-1]] = -np.inf  # an entry of several lists counts once
    return -np.sort(-totals, axis=1)[:, :k]


def sufficient(lists: list[np.ndarray], cutoff: np.ndarray, ids: np.ndarray, k: int):
    """Phases 2 and 3: (query, entry, score) of the entries whose total reaches the cutoff; of each
    query at most the k best, ties to smaller ids."""
    enough = lists[0] >= (cutoff / len(lists))[:, None]
    for p in lists[1:]:
        enough |= p >= (cutoff / len(lists))[:, None]
    query, entry = np.nonzero(enough)
    total = sum(p[query, entry] for p in lists)
    good = total >= cutoff[query]
    query, entry, total = query[good], entry[good], total[good]
    order = np.lexsort((ids[entry], -total, query))
    query, entry, total = query[order], entry[order], total[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    return query[nth < k], entry[nth < k], total[nth < k]


def search(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by ``every`` its ``k`` best other rows: query_id, rank (from
    1), vec_id, score; ties to smaller ids, fewer rows where there are fewer.

    Rows with a null id, a null vector or a null or non-finite component take no part. Rows that share
    an id are rows like any other: each is a candidate, a query if the id says so, and among the others
    of its namesakes. A shorter vector counts as padded with zeros. An empty table gives an empty result;
    other columns are ignored."""
    spark = rows.sparkSession
    # written once, so that the keys are the same for all that follows
    vectors = stored(integer_vectors(rows, scale, id_col, vec_col), "vectors")
    classes = stored(vectors.groupBy("v").agg(F.min("id").alias("least"))
                     .withColumn("cls", F.monotonically_increasing_id()), "classes")
    ids = stored(vectors.join(classes, "v").select("row", "id", "cls"), "ids")
    dims, largest = classes.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda e: F.abs(e))))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    asked = ids.filter(F.pmod("id", F.lit(every)) == 0)
    n = asked.select("cls").distinct().count()
    if not n:
        return spark.createDataFrame([], empty)
    dims, reach = max(1, dims), max(1, dims) * float(largest or 0) ** 2
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64  # exact sums
    keep, blocks = k + 1, -(-n // BLOCK)

    folder = shared_path(spark, "queries")
    block = F.pmod(F.xxhash64("cls"), F.lit(blocks)).alias("block")
    (asked.select("cls").distinct().join(classes, "cls").select("cls", "v", block)
     .repartition(blocks, "block").write.partitionBy("block").parquet(folder))
    numbers = [int(r[0]) for r in spark.read.parquet(folder).select("block").distinct().collect()]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [matrix(joined_list(part.column("v")), dims, kind) for part in chunks(batches)]
        for number in numbers if mine else []:
            table = block_table(folder, number)
            q = matrix(joined_list(table.column("v")), dims, kind)
            best = np.zeros((len(q), 0))
            for x in mine:
                best = np.concatenate([best, safe_totals(partial_scores(q, x), keep)], axis=1)
                best = -np.sort(-best, axis=1)[:, :keep]
            query = np.repeat(table.column("cls").to_numpy(), best.shape[1])
            real = np.isfinite(best.ravel())
            yield pa.record_batch({"query": query[real], "score": best.ravel()[real].astype(np.int64)})

    lists = classes.mapInArrow(totals, "query long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    cutoffs = (lists.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= keep)
               .groupBy("query").agg(F.when(F.count(F.lit(1)) == keep, F.min("score")).alias("cutoff")))
    folder2 = shared_path(spark, "cutoffs")
    (spark.read.parquet(folder).join(cutoffs, F.col("cls") == F.col("query"), "left").select("cls", "v", "cutoff", "block")
     .repartition(blocks, "block").write.partitionBy("block").parquet(folder2))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            x = matrix(joined_list(part.column("v")), dims, kind)
            own, least = part.column("cls").to_numpy(), part.column("least").to_numpy()
            for number in numbers:
                table = block_table(folder2, number)
                cutoff = table.column("cutoff").to_numpy().astype(float)
                cutoff[np.isnan(cutoff)] = -np.inf  # fewer than k rows: all are sufficient
                q = matrix(joined_list(table.column("v")), dims, kind)
                query, entry, total = sufficient(partial_scores(q, x), cutoff, least, keep)
                yield pa.record_batch({"query": table.column("cls").to_numpy()[query], "cls": own[entry],
                                       "least": least[entry], "score": total.astype(np.int64)})

    found = classes.mapInArrow(entries, "query long, cls long, least long, score long")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "least", "cls")
    found = found.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= keep).drop("nth")
    same = Window.partitionBy("cls").orderBy("id", "row")
    members = ids.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= keep).drop("nth")
    each = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    known = (found.join(members, "cls").withColumn("nth", F.row_number().over(each)).filter(F.col("nth") <= keep)
             .select("query", "row", F.col("id").alias("vec_id"), "score"))
    mine = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    askers = asked.select(F.col("cls").alias("query"), F.col("id").alias("query_id"), F.col("row").alias("asker"))
    return (known.join(askers, "query").filter("row <> asker")
            .withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
