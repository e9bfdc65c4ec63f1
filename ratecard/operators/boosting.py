"""Boosted classification trees from counts over binned rows.

The trees are those of ``GBTClassifier``: each fits the log-loss residuals by variance, level by level, and the
result is an MLlib ``GBTClassificationModel``. What differs is what a level costs. MLlib counts every position
of the assembled vector for every row, some 160 of them for 8 columns, as a category with 150 values is 150
positions. Here a column is one code per row: the gain of "is category c" follows from the counts per category
as that of "at most t" follows from the counts per bin. The codes are written once as blocks; per level every task
adds up its blocks and sends (rows, residuals) per code and node, of two siblings in a large table the smaller one
only: a bounded table whatever the rows. In those tasks a node's rows are found by comparing whole columns of codes,
and counted per combination of a few columns' codes, whose sums give those of each column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecard.session import ensure_checkpoint_dir, freeze

BLOCK_ROWS = 100_000      # rows counted at a time
PART_ROWS = 8_000_000     # at most so many rows a task, which holds one block of them at a time
SPREAD_ROWS = 50_000      # a small table is not spread over more tasks than one for so many rows
# up to so many rows the rounds run inside one task (of some 60 MB: a round of jobs takes longer than counting
# them), beyond as jobs over all blocks
ONE_TASK_ROWS = 2_000_000
REBASE = 50               # rounds after which the margins are computed anew from the written blocks
BOTH_ROWS = 100_000       # of a node with at most so many rows both children are counted
JOINT_CODES = 8_192       # combinations of several columns' codes that are counted at once
VALUES = 255 * 255        # distinct values of a column that the driver may take to place its cuts


# ---- codes ------------------------------------------------------------------------

def strided_cuts(values: Sequence[float], counts: Sequence[int], bins: int) -> list[float]:
    """Between neighbouring values: all of them, or those next to ``bins`` equal shares of the rows."""
    if len(values) <= bins:
        return [(a + b) / 2 for a, b in zip(values, values[1:])]
    step = sum(counts) / bins
    out, target, seen = [], step, counts[0]
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += step
    return out


def numeric_cuts(rows: DataFrame, columns: Sequence[str], n: int, max_bins: int) -> list[list[float]]:
    """Per column the thresholds a split may use, from all rows: exact counts per value, or (more than
    VALUES of them) the quantiles of a mergeable summary, which are values of the column."""
    bins = min(max_bins, n)
    if not columns or bins < 2:
        return [[] for _ in columns]
    shares = [i / bins for i in range(1, bins)]
    row = rows.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
                   *[F.percentile_approx(c, shares, 100 * bins).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if n <= VALUES or row[f"d{i}"] <= VALUES]
    seen: dict[str, list] = {c: [] for c in few}
    if few:
        lines = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in few])
        for r in rows.select(F.inline(lines)).groupBy("c", "v").count().collect():
            if r["v"] is not None:   # coded_blocks refuses such rows
                seen[r["c"]].append((r["v"], r["count"]))
    out = []
    for i, c in enumerate(columns):
        if c in seen:
            seen[c].sort()
            out.append(strided_cuts([v for v, _ in seen[c]], [k for _, k in seen[c]], bins))
        else:
            out.append(sorted(set(row[f"q{i}"] or [])))
    return out


def coded_blocks(rows: DataFrame, n: int, n_cat: int, cuts: list[list[float]], kind: type) -> DataFrame:
    """(n, codes, y): up to BLOCK_ROWS rows as one code per row and column, column after column."""
    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts, axis=1)
        y = x[-1]
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("labels must be 0 or 1")
        if not np.isfinite(x).all():
            raise ValueError("a feature is null, NaN or infinite")
        codes = [x[i] for i in range(n_cat)]
        codes += [np.searchsorted(c, x[n_cat + i], side="left") for i, c in enumerate(cuts)]
        return pa.record_batch({
            "n": pa.array([x.shape[1]], pa.int64()), "y": pa.array([(2 * y - 1).astype(np.int8).tobytes()]),
            "codes": pa.array([np.array(codes).astype(kind).tobytes()])})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(np.array([c.to_numpy(zero_copy_only=False) for c in b.columns], dtype=float))
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // PART_ROWS), min(cores, -(-n // SPREAD_ROWS)))
    if parts > cores:
        parts = cores * -(-parts // cores)                   # no core waits for another one's last task
    # short tasks on a small table: its few rows need not be split further
    few = rows.coalesce(-(-n // BLOCK_ROWS)) if n <= cores * BLOCK_ROWS else rows
    return freeze(few.mapInArrow(pack, "n long, y binary, codes binary").repartition(parts))


# ---- trees over codes ---------------------------------------------------------------

@dataclass
class Growing:
    """A tree by heap position: node i has the children 2i+1 and 2i+2."""

    weight: float
    depth: int
    codes: int
    column: np.ndarray = field(init=False)      # column a node asks for, -1: a leaf
    to_right: np.ndarray = field(init=False)    # node x code: whether a row with the code goes right
    value: np.ndarray = field(init=False)
    stats: dict = field(default_factory=dict)   # node: rows, sum and sum of squares of the residuals
    split: dict = field(default_factory=dict)   # node: gain, feature, threshold or left categories, arity

    def __post_init__(self):
        self.column = np.full(2 ** (self.depth + 1) - 1, -1)
        self.to_right = np.zeros((2 ** self.depth, self.codes), bool)
        self.value = np.zeros(2 ** (self.depth + 1) - 1)

    def nodes(self, codes: np.ndarray, levels: int) -> dict[int, np.ndarray]:
        """The rows of every node that rows have reached after ``levels`` steps."""
        at = {0: np.arange(codes.shape[1])}
        for _ in range(levels):
            at = self.step_down(codes, at)
        return at

    def step_down(self, codes: np.ndarray, at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """The nodes' rows ``at`` one step further; rows at a leaf stay."""
        out = {}
        for node, rows in at.items():
            if self.column[node] < 0:
                out[node] = rows
                continue
            right = self.to_right[node].take(codes[self.column[node]].take(rows))
            out[2 * node + 1], out[2 * node + 2] = rows.compress(~right), rows.compress(right)
        return out

    def moved(self, margin: np.ndarray, at: dict[int, np.ndarray]) -> None:
        """Adds the value of every leaf to its rows' margins."""
        for node, rows in at.items():
            margin[rows] += self.weight * self.value[node]

    def masks(self, codes: np.ndarray, levels: int) -> dict[int, np.ndarray]:
        """``nodes`` as marks: comparing a column's codes at once is cheaper than picking rows."""
        at = {0: np.ones(codes.shape[1], bool)}
        for _ in range(levels):
            out = {}
            for node, there in at.items():
                if self.column[node] < 0:
                    out[node] = there
                else:
                    right = there & _among(codes[self.column[node]], self.to_right[node])
                    out[2 * node + 1], out[2 * node + 2] = there ^ right, right
            at = out
        return at

    def steps(self, codes: np.ndarray) -> np.ndarray:
        """What the tree adds to every row's margin."""
        at = self.masks(codes, self.depth)
        place = np.zeros(codes.shape[1], np.uint8 if len(at) <= 256 else np.uint32)
        for k, there in enumerate(at.values()):
            if k:
                place += there.astype(place.dtype) * place.dtype.type(k)
        return (self.weight * self.value[list(at)]).take(place)

    def bare(self) -> tuple:
        return self.weight, self.depth, self.codes, self.column, self.to_right, self.value


def _tree(weight, depth, codes, column, to_right, value) -> Growing:
    t = Growing(weight, depth, codes)
    t.column, t.to_right, t.value = column, to_right, value
    return t


def _among(codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """``flags`` of the codes: by comparison where the flagged codes are a run or all but a run of them."""
    some = np.flatnonzero(flags)
    if not len(some):
        return np.zeros(len(codes), bool)
    lo, hi = int(some[0]), int(some[-1])
    if hi - lo + 1 == len(some):
        # no code of the column lies beyond the last flag of a threshold's run: the second test costs little
        return (codes >= lo) & (codes <= hi) if lo else codes <= hi
    gap = lo + np.flatnonzero(~flags[lo:hi])
    first, last = int(gap[0]), int(gap[-1])
    if last - first + 1 == len(gap) and not lo:
        return ((codes < first) | (codes > last)) & (codes <= hi)
    return flags.take(codes)


def _counted(tree: tuple, asked: list[int], level: int, first: bool, widths: list[int], known: bool = False):
    """A task's (rows, residuals) per node asked for and code, and squares per such node; with ``known`` rows
    are not counted (they are 0)."""
    def count(blocks):
        grown, sums = _tree(*tree), JointSums(len(asked), widths, known)
        for codes, y, margin in blocks:
            sums.read(codes)
            at = grown.masks(codes, level)
            for k, node in enumerate(asked):
                if level == 0:
                    sums.add(k, codes, None, _residuals(y, margin, first))
                else:
                    rows = np.flatnonzero(at[node])
                    sums.add(k, codes, rows, _residuals(y.take(rows), margin.take(rows), first))
        yield sums.marginal()
    return count


def _joint_columns(widths: list[int]) -> list[list[int]]:
    """The columns in groups of at most JOINT_CODES combinations of codes (a wider column by itself)."""
    groups: list[tuple[int, list[int]]] = []
    for j in sorted(range(len(widths)), key=lambda j: (-widths[j], j)):
        fitting = [g for g in groups if g[0] * widths[j] <= JOINT_CODES]
        if fitting:
            size, columns = best = max(fitting, key=lambda g: g[0])
            groups[groups.index(best)] = (size * widths[j], [*columns, j])
        else:
            groups.append((widths[j], [j]))
    return [columns for _, columns in groups]


class JointSums:
    """A task's sums per node and code. A node with many rows in a block is counted per combination of the codes
    of a few columns, which costs a count per group of columns instead of one per column; the columns' own sums
    are added up from those of the combinations at the end."""

    def __init__(self, k: int, widths: list[int], known: bool = False):
        self.widths, self.known = widths, known
        self.groups = _joint_columns(widths)
        self.sizes = [int(np.prod([widths[j] for j in g])) for g in self.groups]
        self.starts = np.cumsum([0, *widths]).tolist()
        self.n, self.s, self.squares = _no_sums(k, widths)
        self.joint: dict = {}   # (node, group): rows and residuals per combination

    def read(self, codes: np.ndarray) -> None:
        """Combines the codes of a block."""
        self.codes = []
        for columns, size in zip(self.groups, self.sizes):
            code = codes[columns[0]].astype(np.uint16 if size <= 2 ** 16 else np.intp)
            for j in columns[1:]:
                code = code * code.dtype.type(self.widths[j]) + codes[j]
            self.codes.append(code)

    def add(self, k: int, codes: np.ndarray, rows: np.ndarray | None, g: np.ndarray) -> None:
        """Adds the residuals ``g`` of a block's ``rows`` (None: all of them) to the k-th node."""
        self.squares[k] += g @ g
        for i, (columns, size) in enumerate(zip(self.groups, self.sizes)):
            if len(columns) > 1 and len(g) >= size:
                code = (self.codes[i] if rows is None else self.codes[i].take(rows)).astype(np.intp)
                if (k, i) not in self.joint:
                    self.joint[k, i] = np.zeros(0 if self.known else size), np.zeros(size)
                n, s = self.joint[k, i]
                s += np.bincount(code, g, size)
                if not self.known:
                    n += np.bincount(code, minlength=size)
                continue
            for j in columns:
                at = slice(self.starts[j], self.starts[j + 1])
                code = (codes[j] if rows is None else codes[j].take(rows)).astype(np.intp)
                self.s[k, at] += np.bincount(code, g, self.widths[j])
                if not self.known:
                    self.n[k, at] += np.bincount(code, minlength=self.widths[j])

    def marginal(self) -> tuple:
        for (k, i), tables in self.joint.items():
            columns = self.groups[i]
            shape = [self.widths[j] for j in columns]
            for out, table in zip((self.n, self.s), tables):
                if len(table):
                    for axis, j in enumerate(columns):
                        others = tuple(a for a in range(len(shape)) if a != axis)
                        out[k, self.starts[j]:self.starts[j + 1]] += table.reshape(shape).sum(axis=others)
        return self.n, self.s, self.squares


def _residuals(y: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    return y.astype(float) if first else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def _no_sums(k: int, widths: list[int]) -> tuple:
    return np.zeros((k, sum(widths))), np.zeros((k, sum(widths))), np.zeros(k)


def _add_block(sums: tuple, codes: np.ndarray, g: np.ndarray, at: dict[int, np.ndarray], asked: list[int],
               widths: list[int]) -> None:
    """Adds a block's rows, residuals and squares to the sums per node asked for (its rows: ``at``) and code."""
    n, s, squares = sums
    for k, node in enumerate(asked):
        rows = at[node]
        everything = len(rows) == len(g)
        own = g if everything else g.take(rows)
        squares[k] += np.bincount(np.zeros(len(own), np.intp), own * own, 1)[0]
        start = 0
        for j, w in enumerate(widths):
            code = (codes[j] if everything else codes[j].take(rows)).astype(np.intp)
            n[k, start:start + w] += np.bincount(code, minlength=w)
            s[k, start:start + w] += np.bincount(code, own, w)
            start += w


def _remaining(whole: tuple, part: tuple) -> tuple:
    """A node's sums without those of one child: the other child's."""
    n = whole[0] - part[0]
    return n, np.where(n > 0, whole[1] - part[1], 0.0), max(whole[2] - part[2], 0.0)


class Held:
    """The blocks of one task, and of every row its margin and residual, of every node its rows: a level is
    one step down from the level before, and a tree's residuals are computed once."""

    def __init__(self, blocks: list[tuple], widths: list[int]):
        self.codes, self.y, self.margin = (list(x) for x in zip(*blocks))
        self.widths = widths

    def counted(self, tree: Growing, asked: list[int], level: int, first: bool) -> tuple:
        if level == 0:
            self.g = [_residuals(y, m, first) for y, m in zip(self.y, self.margin)]
            self.at = [tree.nodes(codes, 0) for codes in self.codes]
        else:
            self.step(tree)
        sums = _no_sums(len(asked), self.widths)
        for codes, g, at in zip(self.codes, self.g, self.at):
            _add_block(sums, codes, g, at, asked, self.widths)
        return sums

    def step(self, tree: Growing) -> None:
        self.at = [tree.step_down(codes, at) for codes, at in zip(self.codes, self.at)]

    def add(self, trees: list[Growing]) -> None:
        """The newest tree's values to the margins; its last counted level is one step above the leaves."""
        self.step(trees[-1])
        for margin, at in zip(self.margin, self.at):
            trees[-1].moved(margin, at)


def _moved(trees: list[tuple]):
    """Blocks with the trees' values added to their margins."""
    def move(blocks):
        grown = [_tree(*t) for t in trees]
        for codes, y, margin in blocks:
            for t in grown:
                margin = margin + t.steps(codes)
            yield codes, y, margin
    return move


def _best_split(n: np.ndarray, s: np.ndarray, squares: float, sizes: list[int], cuts: list[list[float]],
                widths: list[int]):
    """The split of one node with the largest gain, the first one of equals; None without a gain."""
    rows, total = n[:widths[0]].sum(), s[:widths[0]].sum()
    left_n, left_s, at = [], [], 0
    for size, w in zip(sizes, widths):                       # is category c
        left_n.append(n[at:at + size])
        left_s.append(s[at:at + size])
        at += w
    for w in widths[len(sizes):]:                            # at most the threshold
        left_n.append(np.cumsum(n[at:at + w])[:-1])
        left_s.append(np.cumsum(s[at:at + w])[:-1])
        at += w
    a, b = np.concatenate(left_n), np.concatenate(left_s)
    ok = (a >= 1) & (rows - a >= 1)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (b ** 2 / a + (total - b) ** 2 / (rows - a) - total ** 2 / rows) / rows, -np.inf)
    best = int(gain.argmax())
    if gain[best] <= 1e-14 * squares / rows:                 # equal residuals but for rounding
        return None
    sides = (a[best], b[best]), (rows - a[best], total - b[best])
    feature, at = best, 0
    for j, size in enumerate(sizes):
        if best < at + size:
            low = sides[0][1] / sides[0][0] <= sides[1][1] / sides[1][0]
            right = np.arange(widths[j]) == best - at
            # the side of the lower mean is the left one
            return (float(gain[best]), j, ~right if low else right, (feature, [1.0 if low else 0.0], 2),
                    sides if low else sides[::-1])
        at += size
    for i, cut in enumerate(cuts):
        if best < at + len(cut):
            j = len(sizes) + i
            return (float(gain[best]), j, np.arange(widths[j]) > best - at,
                    (sum(sizes) + i, [float(cut[best - at])], -1), sides)
        at += len(cut)
    raise AssertionError("a split beyond the columns")


def _rounds(rounds: int, depth: int, step: float, sizes: list[int], cuts: list[list[float]], widths: list[int],
            counted: Callable, add: Callable) -> list[Growing]:
    """The boosted trees: ``counted`` gives the sums of some nodes of a level over all blocks, ``add`` moves the
    margins. Of a large node's children the one with fewer rows is counted, the other one is what the node has
    beyond it. Those of a small node are both counted, in the order of the rows: where few rows make splits of
    equal gain likely, their last bits, which decide between them, are those of the rows themselves."""
    trees: list[Growing] = []
    for m in range(rounds):
        tree = Growing(1.0 if m == 0 else step, depth, max(widths))
        opened, asked, above = [0], [0], {}
        for level in range(depth):
            if not opened:
                break
            sums = dict(zip(asked, zip(*counted(tree, asked, level, m == 0))))
            following, asked = [], []
            for node in opened:
                if node not in sums:
                    sums[node] = _remaining(above[(node - 1) // 2], sums[node + 1 if node % 2 else node - 1])
                n, s, squares = sums[node]
                rows, total = n[:widths[0]].sum(), s[:widths[0]].sum()
                tree.stats[node] = (rows, total, squares)
                tree.value[node] = total / rows
                found = _best_split(n, s, squares, sizes, cuts, widths)
                if found is None:
                    continue
                gain, column, right, split, sides = found
                tree.column[node] = column
                tree.to_right[node, :len(right)] = right
                tree.split[node] = (gain, *split)
                children = (2 * node + 1, 2 * node + 2)
                for child, (rows, total) in zip(children, sides):
                    tree.stats[child] = (rows, total, float("nan"))
                    tree.value[child] = total / rows
                following += children
                if sides[0][0] + sides[1][0] <= BOTH_ROWS:
                    asked += children
                else:
                    asked.append(children[0] if sides[0][0] <= sides[1][0] else children[1])
            opened, above = following, sums
        trees.append(tree)
        if m + 1 < rounds:
            add(trees)
    return trees


def _summed(parts) -> tuple:
    parts = list(parts)
    return tuple(sum(p[i] for p in parts) for i in range(3))


def grown_trees(blocks: DataFrame, n: int, sizes: list[int], cuts: list[list[float]], widths: list[int], kind: type,
                rounds: int, depth: int, step: float) -> list[Growing]:
    """The boosted trees of the blocks' ``n`` rows: a small table's in one task, else ``depth`` short jobs a
    round over the cached margins."""
    columns = len(widths)
    settings = (rounds, depth, step, sizes, cuts, widths)

    def unpacked(r):
        return (np.frombuffer(r["codes"], kind).reshape(columns, r["n"]), np.frombuffer(r["y"], np.int8),
                np.zeros(r["n"]))

    def whole(lines):
        blocks = [unpacked(r) for r in lines]
        if blocks:
            held = Held(blocks, widths)
            yield _rounds(*settings, held.counted, held.add)

    if n <= ONE_TASK_ROWS:
        return blocks.rdd.coalesce(1).mapPartitions(whole).first()

    base = blocks.rdd.map(unpacked)
    # on disk where memory is short: a lost block would be moved by all trees since the last REBASE
    held = [base.persist(StorageLevel.MEMORY_AND_DISK)]
    at_root = []                                             # the rows per code, the same in every round

    def counted(tree, asked, level, first):
        known = level == 0 and bool(at_root)
        sums = _summed(held[-1].mapPartitions(_counted(tree.bare(), asked, level, first, widths, known)).collect())
        while len(held) > 1:                                 # what the margins came from
            held.pop(0).unpersist()
        if level == 0 and not known:
            at_root.append(sums[0])
        return (at_root[0], *sums[1:]) if known else sums

    def add(trees):
        again = len(trees) % REBASE == 0
        moved = (base if again else held[-1]).mapPartitions(
            _moved([t.bare() for t in (trees if again else trees[-1:])]))
        held.append(moved.persist(StorageLevel.MEMORY_AND_DISK))

    try:
        return _rounds(*settings, counted, add)
    finally:
        for old in held:
            old.unpersist()


# ---- the MLlib model -----------------------------------------------------------------

def _saved_nodes(tree: Growing) -> list[tuple]:
    """The nodes as MLlib stores them, numbered from the root, left before right. The squares of a leaf on
    the last level are not counted: its impurity is NaN."""
    out: list = []

    def add(node: int) -> int:
        at = len(out)
        out.append(None)
        rows, total, squares = tree.stats[node]
        impurity = (squares - total ** 2 / rows) / rows
        stats = [float(rows), float(total), float(squares)]
        if node in tree.split:
            gain, feature, where, arity = tree.split[node]
            left, right = add(2 * node + 1), add(2 * node + 2)
            split = (feature, where, arity)
        else:
            gain, left, right, split = -1.0, -1, -1, (-1, [], -1)
        out[at] = (at, float(tree.value[node]), float(impurity), stats, int(rows), float(gain), left, right, split)
        return at

    add(0)
    return out


def as_model(trees: list[Growing], rows: DataFrame, gbt: GBTClassifier) -> GBTClassificationModel:
    """The trees as a fitted MLlib model: a model of one round, saved, gets them as its nodes."""
    spark = rows.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grown-{uuid.uuid4().hex}"
    # two rows with both labels, so that the model knows its vector and classes
    head = rows.select(gbt.getFeaturesCol()).limit(1).withColumn(
        gbt.getLabelCol(), F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    gbt.copy({gbt.maxIter: 1, gbt.maxDepth: 0}).fit(head).save(f"{root}/one")
    meta = json.loads(spark.read.text(f"{root}/one/metadata").first()[0])
    meta["numTrees"] = len(trees)
    meta["paramMap"].update(maxIter=len(trees), maxDepth=gbt.getMaxDepth())
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{root}/all/metadata")
    names = spark.read.parquet(f"{root}/one/treesMetadata")
    line = json.loads(names.first()[1])
    line["paramMap"]["maxDepth"] = gbt.getMaxDepth()
    lines = [(i, json.dumps({**line, "uid": f"{line['uid']}{i:04d}"}), t.weight) for i, t in enumerate(trees)]
    spark.createDataFrame(lines, names.schema).coalesce(1).write.parquet(f"{root}/all/treesMetadata")
    nodes = [(i, n) for i, t in enumerate(trees) for n in _saved_nodes(t)]
    spark.createDataFrame(nodes, spark.read.parquet(f"{root}/one/data").schema).coalesce(1).write.parquet(
        f"{root}/all/data")
    return GBTClassificationModel.load(f"{root}/all")


def fit_boosted(prepared: PipelineModel, train: DataFrame, cat_index: Sequence[str], sizes: Sequence[int],
                num_cols: Sequence[str], gbt: GBTClassifier) -> GBTClassificationModel:
    """``gbt`` fitted to ``train`` as ``prepared`` encodes it: ``cat_index`` are its indexed categories, of
    which the first ``sizes`` have a position each in the vector, before the numeric columns."""
    assembled = prepared.transform(train)
    rows = assembled.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cat_index)],
                            *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(num_cols)],
                            F.col(gbt.getLabelCol()).cast("double").alias("y"))
    n = rows.count()
    if not n:
        raise ValueError("no training rows")
    cuts = numeric_cuts(rows, [f"v{i}" for i in range(len(num_cols))], n, gbt.getMaxBins())
    # a code beyond the positions of a category: none of them
    widths = [s + 1 for s in sizes] + [len(c) + 1 for c in cuts]
    kind = np.uint8 if max(widths) <= 256 else np.uint32
    blocks = coded_blocks(rows, n, len(sizes), cuts, kind)
    trees = grown_trees(blocks, n, list(sizes), cuts, widths, kind, gbt.getMaxIter(), gbt.getMaxDepth(),
                        gbt.getStepSize())
    return as_model(trees, assembled, gbt)
