"""Sharding by balanced label propagation.

Documents of equal text are linked. Every document gets a first shard, its label, by dealing all
documents out evenly. Then labels spread along the links, round by round: neighbours are counted per
shard (the documents of a group in one shard are a cell, one aggregated row; a group has at most one
cell for each shard, never a list of neighbours), and the documents of every cell want to move to the
shard that holds most of their neighbours. Moves are granted under the shards' capacities: the driver
gets how many documents want to go from each shard to each other (shards^2 numbers) and lets as many go
as room and the places given up by others allow; among the documents of one such flow those with most
neighbours at their goal go first. Then neighbours are counted anew. A shard that is full and that nobody
wants to leave is no goal. Every granted move lowers the number of cut links, so the rounds end: when
nothing moves, or after ``ROUNDS``.

What propagation leaves apart for want of room is then settled, larger groups first (by powers of two of
their size): each group wants the shard with room for all of it that holds most of it, else any with
room. A group larger than a shard is cut into parts of a shard's size first. Groups that no shard has room
for fill the last places in order, so that each shard's border parts one group at most. At the end,
unlinked documents fill up the shards, so that the numbers of rows differ by at most one (law ``rows``).

Documents of a group are interchangeable, so the rounds move counts; which document goes where is decided
once, by its rank in the group. Every order that decides who moves is a distributed running total or rank:
no shard, group or quota is ever gathered in one task, and a hot group is a few cells.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, stored, text_bytes

ROUNDS = 12
LOG = logging.getLogger(__name__)


def granted(demand: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may go from shard to shard, at most what is asked for, such that no shard takes
    in more than its free places and those that its own leavers give up. Where too many come, the largest
    flows are cut first."""
    flow = {k: n for k, n in demand.items() if n > 0}
    changed = True
    while changed:
        changed = False
        for to in range(len(free)):
            over = (sum(n for (_, t), n in flow.items() if t == to) - sum(n for (s, _), n in flow.items() if s == to)
                    - free[to])
            for k in sorted((k for k in flow if k[1] == to), key=lambda k: (-flow[k], k)):
                if over <= 0:
                    break
                less = min(over, flow[k])
                flow[k] -= less
                over -= less
                changed = True
        flow = {k: n for k, n in flow.items() if n}
    return flow


def cut_links(groups: DataFrame) -> int:
    """Links between documents of different shards, of ``groups`` (size, held)."""
    pairs = lambda n: n.cast("decimal(19,0)") * (n - 1).cast("decimal(19,0)")
    inside = F.aggregate(F.transform("held", lambda x: pairs(x["n"]).cast("decimal(38,0)")),
                         F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)"))
    twice = groups.agg(F.sum(pairs(F.col("size")).cast("decimal(38,0)") - inside)).first()[0]
    return int(twice or 0) // 2


def regrouped(cells: DataFrame, name: str) -> DataFrame:
    """``cells`` (grp, shard, n) as one row per group: grp, size, held (n and shard of its cells)."""
    held = cells.groupBy("grp", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
    return stored(held.groupBy("grp").agg(F.sum("n").alias("size"), F.collect_list(F.struct("n", "shard")).alias("held")),
                  name)


def propagated(cells: DataFrame, capacity: list[int]) -> tuple[DataFrame, list[int]]:
    """The groups (grp, size, held) after propagation, and the cut links before it and after each round."""
    groups = regrouped(cells, "groups")
    free = list(capacity)
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        free[r["shard"]] -= r["n"]
    cuts, done, leaving = [cut_links(groups)], [], None
    for nth in range(ROUNDS):
        done.append(groups.filter(F.size("held") == 1))
        apart = groups.filter(F.size("held") > 1)
        # a full shard that nobody wanted to leave is no goal
        goal = F.array(*[F.lit(leaving is None or free[s] + leaving[s] > 0) for s in range(len(free))])
        tie = lambda x: F.xxhash64("grp", x["shard"], F.lit(nth))
        best = F.array_max(F.transform(F.filter("held", lambda x: F.element_at(goal, x["shard"] + 1)),
                                       lambda x: F.struct(x["n"].alias("n"), tie(x).alias("tie"), x["shard"].alias("shard"))))
        movers = (apart.withColumn("best", best).filter("best IS NOT NULL")
                  .select("grp", "best", F.explode("held").alias("cell"))
                  .filter("cell.shard <> best.shard AND cell.n <= best.n")
                  .select("grp", F.col("cell.shard").alias("shard"), F.col("best.shard").alias("to"),
                          F.col("cell.n").alias("n"), (-F.col("best.n")).alias("first")))
        movers = stored(movers, "movers")
        demand = {(r["shard"], r["to"]): r["n"] for r in
                  movers.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        flow = granted(demand, free)
        leaving = [sum(n for (s, _), n in demand.items() if s == here) for here in range(len(free))]
        if not flow:
            groups = apart
            break
        for (s, t), n in flow.items():
            free[s] += n
            free[t] -= n
        limits = movers.sparkSession.createDataFrame([(s, t, n) for (s, t), n in flow.items()],
                                                     "shard int, to int, most long")
        ordered = running(movers, ["shard", "to"], ["first", "grp"], "n", "before")
        moves = stored(ordered.join(F.broadcast(limits), ["shard", "to"])
                       .withColumn("n", F.least(F.col("n"), F.col("most") - F.col("before"))).filter("n > 0")
                       .select("grp", "shard", "to", "n"), "moves")
        cells = (apart.select("grp", F.inline("held")).select("grp", "shard", "n")
                 .unionByName(moves.select("grp", "shard", (-F.col("n")).alias("n")))
                 .unionByName(moves.select("grp", F.col("to").alias("shard"), "n")))
        groups = regrouped(cells, "groups")
        cuts.append(cut_links(groups))
        LOG.info("round %d: %d documents moved, %d links cut", nth + 1, sum(flow.values()), cuts[-1])
    for part in done:
        groups = groups.unionByName(part)
    return stored(groups, "propagated"), cuts


def settle(units: DataFrame, free: list[int], nth: int) -> tuple[DataFrame, DataFrame, int]:
    """One round of placing whole ``units`` (unit, part, size, held). Returns those that are placed (unit,
    shard), those that are left, and how many were placed; ``free`` is reduced."""
    room = F.array(*[F.lit(n).cast("long") for n in free])
    has_room = lambda shard: F.element_at(room, shard + 1) >= F.col("size")
    tie = lambda shard: F.xxhash64("unit", shard, F.lit(nth))
    of_group = lambda x: F.xxhash64(F.substring("unit", 1, 16), x["shard"]).alias("tie")
    near = F.sort_array(F.transform(F.filter("held", lambda x: has_room(x["shard"])),
                                    lambda x: F.struct(x["n"].alias("n"), of_group(x), x["shard"].alias("shard"))), False)
    # parts of one group want different shards
    mine = F.get(near, F.pmod(F.col("part"), F.greatest(F.size(near), F.lit(1))))["shard"]
    # the others are dealt to shards in proportion to their room
    share = lambda x: F.log((F.pmod(tie(x), F.lit(1 << 20)) + 1) / (1 << 20)) / F.element_at(room, x + 1)
    far = F.transform(F.filter(F.array(*[F.lit(s) for s in range(len(free))]), has_room),
                      lambda x: F.struct(share(x).alias("share"), x.alias("shard")))
    wished = stored(units.withColumn("want", F.coalesce(mine, F.array_max(far)["shard"]))
                    .withColumn("first", -F.col("size")), "wishes")
    before = running(wished.filter("want IS NOT NULL").select("want", "first", "unit", "size"),
                     ["want"], ["first", "unit"], "size", "before")
    moves = stored(before.filter(F.col("before") + F.col("size") <= F.element_at(room, F.col("want") + 1))
                   .select("unit", F.col("want").alias("shard"), "size"), "moves")
    moved = 0
    for r in moves.groupBy("shard").agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("n")).collect():
        free[r["shard"]] -= r["rows"]
        moved += r["n"]
    left = wished.join(moves.select("unit"), "unit", "left_anti").drop("want", "first")
    return moves.select("unit", "shard"), stored(left, "units"), moved


def settled(groups: DataFrame, capacity: list[int]) -> DataFrame:
    """Places of the groups' documents: grp, first, end, shard for runs of ranks in a group. No shard gets
    more than its capacity; documents beyond all capacities are in no run."""
    free, most = list(capacity), max(1, min(capacity))
    parts = F.ceil(F.col("size") / most)
    units = (groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
             .withColumn("first", F.col("part") * most)
             .withColumn("size", F.least(F.col("size") - F.col("first"), F.lit(most).cast("long")))
             .withColumn("unit", F.concat("grp", F.unhex(F.lpad(F.hex("part"), 16, "0"))))
             .withColumn("tier", F.floor(F.log2("size")).cast("int")))
    units = stored(units, "units")
    tiers = sorted((r["tier"] for r in units.select("tier").distinct().collect()), reverse=True)
    placed, rest = [], []
    for tier in tiers:
        now, moved = units.filter(F.col("tier") == tier), 1
        count = now.count()
        while moved and count:
            moves, now, moved = settle(now, free, len(placed))
            placed.append(moves)
            count -= moved
        if count:
            rest.append(now)
    runs = units.select("unit", "grp", "first", (F.col("first") + F.col("size")).alias("end"))
    out = []
    if placed:
        whole = placed[0]
        for moves in placed[1:]:
            whole = whole.unionByName(moves)
        out.append(runs.join(whole, "unit").select("grp", "first", "end", "shard"))
    if rest and sum(free):
        last = rest[0]
        for more in rest[1:]:
            last = last.unionByName(more)
        order = running(stored(last.select(F.lit(0).alias("all"), "unit", "size"), "last"), ["all"], ["unit"], "size", "before")
        gaps, at = [], 0
        for s, n in enumerate(free):
            gaps.append(F.struct(F.lit(at).cast("long").alias("a"), F.lit(at + n).cast("long").alias("b"), F.lit(s).alias("shard")))
            at += n
        a, b = F.greatest("before", "gap.a"), F.least(F.col("before") + F.col("size"), F.col("gap.b"))
        pieces = (order.withColumn("gap", F.explode(F.array(*gaps))).withColumn("a", a).withColumn("b", b).filter("a < b")
                  .select("unit", (F.col("a") - F.col("before")).alias("a"), (F.col("b") - F.col("before")).alias("b"),
                          F.col("gap.shard").alias("shard")))
        out.append(runs.join(pieces, "unit").select("grp", (F.col("first") + F.col("a")).alias("first"),
                                                    (F.col("first") + F.col("b")).alias("end"), "shard"))
    if not out:
        return groups.sparkSession.createDataFrame([], "grp binary, first long, end long, shard int")
    return stored(out[0] if len(out) == 1 else out[0].unionByName(out[1]), "runs")


def places(nodes: DataFrame, groups: DataFrame, runs: DataFrame) -> DataFrame:
    """``row`` and ``moved`` (its shard) of the ``nodes`` (row, grp) that lie in a run of their group."""
    per = runs.groupBy("grp").agg(F.collect_list(F.struct("first", "end", "shard")).alias("runs"))
    per = stored(per.join(groups.select("grp", "size"), "grp"), "places")
    one = (F.size("runs") == 1) & (F.get("runs", F.lit(0))["end"] == F.col("size"))
    whole = nodes.join(per.filter(one), "grp").select("row", F.get("runs", F.lit(0))["shard"].alias("moved"))
    several = per.filter(~one)
    numbered = ranked(stored(nodes.join(several.select("grp"), "grp", "left_semi"), "several"), ["grp"], ["row"], "nth")
    mine = F.get(F.filter("runs", lambda x: (x["first"] <= F.col("nth")) & (F.col("nth") < x["end"])), F.lit(0))["shard"]
    spread = numbered.join(several, "grp").select("row", mine.alias("moved")).filter("moved IS NOT NULL")
    return whole.unionByName(spread)


def running(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows of its group in column ``out``.

    Rows are dealt to ranges of a hash of ``order``'s last column inside each value of the others, so
    that no group is sorted in one task; totals per range give each range its start."""
    buckets = max(1, -(-df.count() // 50_000))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(order[-1]), F.lit(buckets)))
    keys = [*order[:-1], "_b"]
    totals = dealt.groupBy(*group, *keys).agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, *keys, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*group, *keys).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_p", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(starts, [*group, *keys]).withColumn(out, F.col("_s") + F.col("_p")).drop("_b", "_s", "_p"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: the id, ``size`` (UTF-8 bytes and 8), ``text_crc32``, ``law`` (``rows``), ``shard``,
    ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null under this law).

    Null text is empty, and empty texts are linked like any equal texts. Repeated rows and rows with
    a null id are documents of their own; they take a place each. An empty table gives an empty
    result; other columns are ignored."""
    raw = text_bytes(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"),
                       F.crc32(raw).alias("crc"),
                       F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("grp"))
    # rows get a number of their own, for documents that repeat an id; it deals them out evenly
    base = ranked(stored(rows, "documents"), [], ["id", "grp"], "row")
    base = stored(base.withColumn("start", F.pmod("row", F.lit(shards)).cast("int")), "documents")
    least, more = divmod(base.count(), shards)
    size = [least + (s < more) for s in range(shards)]
    # written, so that the rows of a hot group, dealt for the join alone, can be split
    linked = stored(base.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp"), "linked")
    nodes = stored(base.join(linked, "grp").select("row", "grp", F.col("start").alias("shard")), "nodes")
    cells = stored(nodes.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")), "cells")
    groups, _ = propagated(cells, size)
    moved = places(nodes.select("row", "grp"), groups, settled(groups, size))
    placed = stored(base.join(moved, "row", "left")
                    .select("row", "id", "size", "crc", F.coalesce("moved", "start").alias("shard"),
                            F.col("moved").isNull().cast("int").alias("single")), "placed")
    # settled documents first: they never exceed a shard
    ranks = stored(ranked_linked_first(placed), "ranks")
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.element_at(F.array(*[F.lit(size[s]) for s in range(shards)]), F.col("shard") + 1)
    kept = ranks.filter(F.col("rank") < limit)
    surplus = stored(ranks.filter(F.col("rank") >= limit), "surplus")
    gaps, at = [], 0  # open places: (first surplus rank, shard, first slot)
    for s in range(shards):
        if counts.get(s, 0) < size[s]:
            gaps.append((at, s, counts.get(s, 0)))
            at += size[s] - counts.get(s, 0)
    moved = ranked(surplus, [], ["row"], "nth") if gaps else surplus.withColumn("nth", F.lit(0).cast("long"))
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for first, s, slot0 in gaps:
        to = F.when(F.col("nth") >= first, F.lit(s)).otherwise(to)
        slot = F.when(F.col("nth") >= first, F.col("nth") - first + slot0).otherwise(slot)
    moved = moved.select("id", "size", "crc", to.alias("shard"), slot.alias("slot"))
    out = kept.select("id", "size", "crc", "shard", F.col("rank").alias("slot")).unionByName(moved)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                      F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def ranked_linked_first(placed: DataFrame) -> DataFrame:
    """``placed`` with the rank in its shard, linked documents before single ones."""
    inside = ranked(placed, ["shard", "single"], ["row"], "nth")
    linked = placed.filter("single = 0").groupBy("shard").agg(F.count(F.lit(1)).alias("linked"))
    return (inside.join(F.broadcast(linked), "shard", "left")  # a row per shard
            .withColumn("rank", F.col("nth") + F.when(F.col("single") == 1, F.coalesce("linked", F.lit(0))).otherwise(0))
            .drop("nth", "linked", "single"))
