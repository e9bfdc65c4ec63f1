"""Near-dedup of word shingles by MinHash with tensored banding.

Two collections of ``A`` small hashes, each of K MinHash values, are computed per document. A table
key is a pair of one hash of either collection, so A * A tables of 2K values each need only 2AK MinHash
values instead of 2A^2K. Two documents meet in a table if they agree in a hash of the first collection
and in one of the second; K and A are chosen so that a pair at the threshold meets in none with a
probability of at most ``MISS``. Only hashes that occur in two documents can form a key that does, so
all others are dropped before pairs are formed.

Documents of equal shingle sets are one node. In every bucket each node is compared with the bucket's
smallest, on full sets; links join nodes to components. Buckets whose members are then in one
component are done. The members of all others are compared once more, across components only: two
sets at the threshold share one of their rarest shingles (prefix filter with sizes and positions,
which is exact), so candidates come from these shingles and never from all pairs of a bucket. Each
candidate is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, likely_in, shared_path, small, stored
from .graph import components
from .shingles import MULT, mix, runs_of_documents, shingle_hashes

SHINGLE = 5
MISS = 1e-4
MOST_HASHES = 14
SLOT_BITS = 21


def banding(percent: int) -> tuple[int, int]:
    """K and A for a threshold: the longest hashes of which at most MOST_HASHES a collection do."""
    s = percent / 100
    for k in (6, 5, 4, 3, 2, 1):
        a = math.ceil(math.log(MISS / 2) / math.log(1 - s ** k)) if s < 1 else 1
        if a <= MOST_HASHES:
            return k, a
    return 1, math.ceil(math.log(MISS / 2) / math.log(1 - s))


def signatures(raw: np.ndarray, off: np.ndarray, k: int, a: int):
    """Per document: set size, two fingerprints of the set, and the 2A hashes (0 without shingles)."""
    rng = np.random.default_rng(20240501)
    mult = rng.integers(0, 1 << 63, 2 * a * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, 2 * a * k, dtype=np.uint64)
    n = len(off) - 1
    sizes, prints, hashes = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, 2 * a), np.uint64)
    for lo, hi in runs_of_documents(off):
        h, counts = shingle_hashes(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], SHINGLE)
        sizes[lo:hi] = counts
        at = np.flatnonzero(counts > 0)
        if not len(at):
            continue
        start = (np.cumsum(counts) - counts)[at]
        for j in (0, 1):
            prints[lo + at, j] = np.add.reduceat(mix(h * MULT + np.uint64(j)), start)
        for j in range(2 * a):
            value = np.full(len(at), np.uint64(j))
            for m, c in zip(mult[j * k:(j + 1) * k], add[j * k:(j + 1) * k]):
                value = mix(value * MULT + np.minimum.reduceat(h * m + c, start))
            hashes[lo + at, j] = value
    return sizes, prints, hashes


def list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def with_signatures(rows: DataFrame, k: int, a: int) -> DataFrame:
    """``rows`` (id, text) with n, fp1, fp2 and the hash collections a and b."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, prints, hashes = signatures(*buffers(batch.column("text")), k, a)
            prints, hashes = prints.view(np.int64), hashes.view(np.int64)
            each = np.full(len(n), a)
            yield pa.record_batch({"id": batch.column("id"), "n": n, "fp1": prints[:, 0], "fp2": prints[:, 1],
                                   "a": list_array(hashes[:, :a].ravel(), each),
                                   "b": list_array(hashes[:, a:].ravel(), each)})

    return rows.mapInArrow(signed, "id long, n long, fp1 long, fp2 long, a array<long>, b array<long>")


def with_sets(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with the shingle set as sorted hashes."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw, off = buffers(batch.column("text"))
            for lo, hi in runs_of_documents(off):
                h, counts = shingle_hashes(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], SHINGLE)
                yield pa.record_batch({"node": batch.column("id").slice(lo, hi - lo),
                                       "hashes": list_array(h.view(np.int64), counts)})

    return rows.mapInArrow(listed, "node long, hashes array<long>")


def shared_hashes(nodes: DataFrame, col: str) -> DataFrame:
    """``node``, ``n`` and the hashes of collection ``col`` that another node has too."""
    one = nodes.select("node", "n", F.posexplode(col).alias("at", "h")).select(
        "node", "n", F.xxhash64("at", "h").alias(col))
    both = one.groupBy(col).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select(col)
    return one.join(both, col)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough."""
    first = sets.select(F.col("node").alias("x"), F.col("hashes").alias("hx"))
    second = sets.select(F.col("node").alias("y"), F.col("hashes").alias("hy"))
    both = F.size(F.array_intersect("hx", "hy"))
    return (pairs.select("x", "y").join(first, "x").join(second, "y")
            .withColumn("both", both).withColumn("all", F.size("hx") + F.size("hy") - F.col("both"))
            .filter(F.col("both").cast("long") * 100 >= F.col("all").cast("long") * percent).select("x", "y"))


def sizes_allow(percent: int):
    """Whether sets of nx and ny shingles can be similar enough."""
    return F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent


@lru_cache(maxsize=1)
def rarity(folder: str) -> np.ndarray:
    """Occurrences per slot, read once per worker."""
    place, base = fs.FileSystem.from_uri(folder)
    rows = pq.read_table(base, filesystem=place)
    often = np.zeros(1 << SLOT_BITS, np.int32)
    often[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return often


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """Prefixes of ``sets`` (node, comp, n, hashes): the shingles of which two sets at the threshold
    share at least one, rarest first, with their positions. Rarity is counted in 2^SLOT_BITS slots, a
    table of fixed size; any fixed order of shingles is exact, a rough one only costs time."""
    slot = F.shiftrightunsigned(F.col("hash"), 64 - SLOT_BITS).cast("int").alias("slot")
    folder = shared_path(sets.sparkSession, "rarity")
    (sets.select(F.explode("hashes").alias("hash")).select(slot).groupBy("slot")
     .agg(F.least(F.count(F.lit(1)), F.lit(2**31 - 1)).cast("int").alias("n")).write.parquet(folder))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n = batch.column("n").to_numpy()
            off = batch.column("hashes").offsets.to_numpy().astype(np.int64)
            h = batch.column("hashes").values.to_numpy()[off[0]:off[-1]]
            doc = np.repeat(np.arange(len(n)), np.diff(off))
            f = rarity(folder)[(h.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            order = np.lexsort((h, f, doc))
            at = np.arange(len(h)) - (off[:-1] - off[0])[doc]
            length = n - -(-n * percent // 100) + 1
            keep = (at < length[doc]) & (f[order] > 1)  # a shingle counted once is in no other set
            doc, h, at = doc[keep], h[order][keep], at[keep]
            yield pa.record_batch({"hash": h, "node": batch.column("node").to_numpy()[doc],
                                   "comp": batch.column("comp").to_numpy()[doc], "n": n[doc], "at": at})

    return sets.select("node", "comp", "n", "hashes").mapInArrow(
        prefixes, "hash long, node long, comp long, n long, at long")


def cross_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of ``live`` (hash, node, comp, n, at) that share a hash, lie in different components
    and may be similar enough, once per shared hash. Components are paired first, by hash and by the
    bounds of their nodes, and only then joined with their nodes, so that no pair inside a component,
    however large, is ever formed."""
    # the first shared shingle leaves n - at that can still be shared
    held = live.groupBy("hash", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"),
                                            F.max(F.col("n") - F.col("at")).alias("rest"))
    one, other = (held.select("hash", F.col("comp").alias(f"c{i}"), F.col("least").alias(f"l{i}"),
                              F.col("most").alias(f"m{i}"), F.col("rest").alias(f"r{i}")) for i in "xy")
    sizes = F.least("mx", "my") * 100 >= F.greatest("lx", "ly") * percent
    enough = F.least("rx", "ry") * (100 + percent) >= (F.col("lx") + F.col("ly")) * percent
    apart = one.join(other, "hash").filter("cx < cy").filter(sizes & enough).select("hash", "cx", "cy", "ly", "my", "ry")
    left = live.select("hash", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"),
                       (F.col("n") - F.col("at")).alias("sx"))
    right = live.select("hash", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"),
                        (F.col("n") - F.col("at")).alias("sy"))
    # a node against the bounds of the other component, then node against node
    sizes = F.least("nx", "my") * 100 >= F.greatest("nx", "ly") * percent
    enough = F.least("sx", "ry") * (100 + percent) >= (F.col("nx") + F.col("ly")) * percent
    near = apart.join(left, ["hash", "cx"]).filter(sizes & enough).select("hash", "cy", "x", "nx", "sx")
    enough = F.least("sx", "sy") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    return (near.join(right, ["hash", "cy"]).filter(sizes_allow(percent) & enough)
            .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))


def across_components(sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (x, y) of ``sets`` (node, comp, n, hashes) in different components; every pair
    that is similar enough is among them."""
    rare = stored(rare_shingles(sets, percent), "rare")
    live = rare.groupBy("hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("hash")
    live = stored(rare.join(live, "hash"), "rare")
    return cross_pairs(live, percent).distinct()


def near_classes(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_shingles`` (distinct shingles of the text), ``component_id`` (the smallest
    id reachable by links of 100 * shared >= percent * united shingles) and ``kept``.

    Null, empty and blank texts have no shingles and no links. Rows that repeat an id are one document
    with several texts, so they are in one component. A row with a null id is linked with nothing: its
    component is null and it is kept. An empty table gives an empty result; other columns are ignored.
    A link at the threshold that connects two otherwise unconnected parts is missed with a probability
    of at most MISS. Shingles are compared as 64-bit hashes; sets of one size with equal fingerprints of
    128 bits are taken as equal, which two different sets are with a probability of 2^-128."""
    k, a = banding(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = stored(with_signatures(rows, k, a), "signatures")
    full = signed.filter("id IS NOT NULL AND n > 0")
    same = ["n", "fp1", "fp2"]
    # written, so that the rows of a hot group, dealt for the join alone, can be split
    groups = stored(full.groupBy(*same).agg(F.min("id").alias("node")), "groups")
    members = stored(full.select("id", *same).join(groups, same).select("id", "node").distinct(), "members")
    nodes = stored(full.join(groups.select(*same, F.col("node").alias("id")), [*same, "id"])
                   .select(F.col("id").alias("node"), "n", "a", "b"), "nodes")

    keys = stored(shared_hashes(nodes, "a").join(shared_hashes(nodes, "b").drop("n"), "node")
                  .select("node", "n", F.xxhash64("a", "b").alias("key")).distinct(), "keys")
    buckets = stored(keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last"),
                                             F.count(F.lit(1)).alias("size"))
                     .filter("first.node < last").select("key", F.col("first.node").alias("x"),
                                                         F.col("first.n").alias("nx"), "size"), "buckets")
    keys = stored(keys.join(buckets.select("key", "size"), "key"), "keys")
    star = (keys.join(buckets.drop("size"), "key").select("x", "nx", F.col("node").alias("y"), F.col("n").alias("ny"))
            .filter("x < y").filter(sizes_allow(percent)).distinct())
    wanted = stored(keys.select(F.col("node").alias("id")).distinct(), "wanted")
    named = rows.filter("id IS NOT NULL")
    sets = stored(with_sets(likely_in(named, wanted, ["id"]).join(wanted.hint("merge"), "id").select("id", "text"))
                  .filter(F.size("hashes") > 0), "sets")
    links = stored(confirmed(star, sets, percent), "links")

    # members of buckets that still hold several components
    comps = components(links)
    placed = (keys.filter("size > 2").join(comps, "node", "left")
              .select("node", "n", "key", F.coalesce("comp", "node").alias("comp")))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    left = stored(placed.join(mixed, "key").select("node", "comp").distinct(), "left")
    if not left.isEmpty():
        open_sets = sets.join(left, "node").select("node", "comp", F.size("hashes").cast("long").alias("n"), "hashes")
        more = confirmed(across_components(stored(open_sets, "open"), percent), sets, percent)
        comps = components(links.unionByName(stored(more, "links")))

    where = members.join(comps, "node", "left").select("id", F.coalesce("comp", "node").alias("comp"))
    # an id with several texts is in the components of all of them
    twice = where.groupBy("id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    where = stored(twice, "where")
    if not where.filter("lo < hi").isEmpty():
        merged = components(where.select(F.col("id").alias("x"), F.col("lo").alias("y")).unionByName(
            where.select(F.col("id").alias("x"), F.col("hi").alias("y"))))
        where = where.join(merged, F.col("id") == F.col("node"), "left").select("id", F.coalesce("comp", "lo").alias("lo"))
    return (signed.select("id", "n").join(where.select("id", "lo"), "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("lo", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id."""
    gone = stored(near_classes(docs, percent, id_col, text_col).filter("NOT kept")
                  .select(F.col(id_col)).distinct(), "gone")
    maybe = likely_in(docs, gone, [id_col]).join(gone.hint("merge"), id_col, "left_anti")
    return likely_in(docs, gone, [id_col], others=True).unionByName(maybe.select(*docs.columns))
