"""Quality scores: ridge regression on random Fourier features, then isotonic calibration.

A document is described by ``STATISTICS`` (lengths, shares of character kinds, repetition, shape of its
lines and sentences), computed from its whole text. ``FEATURES`` random cosines of the standardised
statistics approximate a Gaussian kernel. Every task adds up the normal equations of its labelled rows,
fold by fold; the sums are added in blocks, and the driver gets one matrix of fixed size per fold. The
penalty is chosen by the squared error on each fold of the fit to the others, which the matrices give
without another pass. The same fits score each fold's rows out of sample; the scores, counted on a grid
of ``GRID`` steps a unit, are calibrated by isotonic regression.

All labelled rows outside the held-out fold take part; nothing is sampled. The text is read once: the
statistics of all documents are written to the shared folder and everything after works on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, small, stored, text_bytes
from .shingles import MULT, mix, runs_of_documents, word_hashes

BROADCAST_ROWS = 1_000_000  # labels beyond this are joined by a shuffle
FOLDS, HELD_OUT = 5, 0
FEATURES, SEED = 256, 11
WIDTH = 1.0  # of the Gaussian kernel, in units of the square root of the number of statistics
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2)  # per row
GRID = 5_000
BLOCK, SALTS = 32, 64  # rows of the matrix that travel together; first groups of their sum
THRESHOLD = 0.3

STATISTICS = ("characters", "words", "lines", "word_bytes", "capitals", "letters", "digits", "spaces", "pauses",
              "stresses", "symbols", "bars", "non_ascii", "entropy", "capital_words", "symbol_words",
              "short_words", "distinct_words", "distinct_lines", "line_words", "sentence_words")


def among(chars: str) -> np.ndarray:
    table = np.zeros(256)
    table[list(chars.encode())] = 1
    return table


LETTERS = among("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
CAPITALS = among("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SYMBOLS = among("#$%&*|<>{}[]=_~^@\\/+")
CONTINUES = np.arange(256) >> 6 == 2  # bytes inside a UTF-8 character
LEADS = np.arange(256) >= 192
SPACES = among(" \t\n\x0b\x0c\r")
KINDS = np.stack([~CONTINUES, CAPITALS, LETTERS + LEADS, among("0123456789"), SPACES, among(",;:."),
                  among("!?"), SYMBOLS, among("|"), LEADS, among(".!?"), among("\n")], axis=1).astype(float)


def histogram(raw: np.ndarray) -> np.ndarray:
    """Counts of the 256 bytes, a piece of the text at a time."""
    out = np.zeros(256, dtype=np.int64)
    for at in range(0, len(raw), 1 << 20):
        out += np.bincount(raw[at:at + (1 << 20)], minlength=256)
    return out


def distinct_per_document(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(mix(keys + doc.astype(np.uint64) * MULT), return_index=True)
    return np.bincount(doc[first], minlength=n)


def statistics_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """STATISTICS of the documents ``raw[off[i]:off[i + 1]]``, a row each."""
    parts = [_statistics(raw[off[a]:off[b]], off[a:b + 1] - off[a]) for a, b in runs_of_documents(off)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)), np.float32)


def _statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    counts = np.stack([histogram(raw[a:b]) for a, b in zip(off[:-1], off[1:])])
    (chars, capitals, letters, digits, spaces, pauses, stresses, symbols, bars, leads, stops,
     breaks) = (counts @ KINDS).T
    share = counts / np.maximum(np.diff(off), 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    hashes, words = word_hashes(raw, off)
    doc = np.repeat(np.arange(n), words)
    space = SPACES[raw] > 0
    inside = ~space
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    edges = off[(off > 0) & (off < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    line = np.cumsum(raw == 10)[first] if len(first) else np.zeros(0, np.int64)
    new_line = np.flatnonzero(np.diff(line, prepend=-1) | np.diff(doc, prepend=-1)) if len(first) else first
    per_doc = lambda test: np.bincount(doc, test, n)
    texts = np.add.reduceat(mix(hashes), new_line) if len(first) else np.zeros(0, np.uint64)
    lines = np.bincount(doc[new_line], minlength=n)  # with words in them
    some_words, some_lines, some_chars = (np.maximum(x, 1) for x in (words, lines, chars))
    out = (np.log1p(chars), np.log1p(words), np.log1p(breaks), (np.diff(off) - spaces) / some_words,
           capitals / some_chars, letters / some_chars, digits / some_chars, spaces / some_chars,
           pauses / some_words, stresses / some_words, symbols / some_words, bars / some_words,
           leads / some_chars, entropy, per_doc(CAPITALS[raw[first]]) / some_words,
           per_doc(SYMBOLS[raw[last]]) / some_words, per_doc(last - first < 2) / some_words,
           distinct_per_document(hashes, doc, n) / some_words,
           distinct_per_document(texts, doc[new_line], n) / some_lines,
           np.log1p(words / some_lines), np.log1p(words / (stops + 1)))
    return np.stack(out, axis=1).astype(np.float32)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``x``, the statistics of each row's text, written to the shared folder."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            x = statistics_of(*buffers(b.column("text")))
            width = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.ListArray.from_arrays(width, pa.array(x.ravel()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return stored(rows.mapInArrow(describe, f"id {kind}, x array<float>"), "statistics")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of statistics as an array."""
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS)).astype(float)


@dataclass(frozen=True)
class Basis:
    """The standardised random cosines; the last feature is constant."""

    mean: np.ndarray
    scale: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        turn = rng.standard_normal((len(self.mean), FEATURES)) / (WIDTH * np.sqrt(len(self.mean)))
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.cos((x - self.mean) / self.scale @ turn + shift) * np.sqrt(2 / FEATURES)
        return np.column_stack([z, np.ones(len(z))])


def basis_of(x: DataFrame) -> Basis:
    """Means and deviations over all documents."""
    columns = [f(F.col("x")[i].cast("double")) for f in (F.avg, F.stddev_pop) for i in range(len(STATISTICS))]
    values = np.array([0.0 if v is None else v for v in x.agg(*columns).first()])
    mean, scale = values[:len(STATISTICS)], values[len(STATISTICS):]
    return Basis(mean, np.where(scale > 1e-9, scale, 1.0))


def fold_sums(rows: DataFrame, basis: Basis) -> dict[int, np.ndarray]:
    """Per fold A'A of the matrix A of its rows, features then label. ``rows``: x, good, fold."""
    size = FEATURES + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in small(batches, 2000):
            a = np.column_stack([basis.features(matrix(b.column("x"))),
                                 b.column("good").to_numpy().astype(float)])
            fold = b.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                sums[f] = sums.get(f, 0) + a[fold == f].T @ a[fold == f]
        salt = TaskContext.get().partitionId() % SALTS
        for f, total in sums.items():
            at = list(range(0, size, BLOCK))
            yield pa.record_batch({"fold": pa.array([f] * len(at), pa.int32()), "at": pa.array(at, pa.int32()),
                                   "salt": pa.array([salt] * len(at), pa.int32()),
                                   "sums": pa.array([total[i:i + BLOCK].tobytes() for i in at], pa.binary())})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in group["sums"])
        return group.iloc[:1].assign(sums=[total.tobytes()])

    schema = "fold int, at int, salt int, sums binary"
    blocks = (rows.mapInArrow(partial, schema).groupBy("fold", "at", "salt").applyInPandas(add, schema)
              .groupBy("fold", "at").applyInPandas(add, schema).toPandas())
    return {f: np.concatenate([np.frombuffer(s) for s in g.sort_values("at")["sums"]]).reshape(size, size)
            for f, g in blocks.groupby("fold")}


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Weights from the normal equations; the constant isn't penalised."""
    n = sums[-2, -2]
    return np.linalg.solve(sums[:-1, :-1] + np.diag([penalty * n] * FEATURES + [1e-9 * n]), sums[:-1, -1])


def squared_error(sums: np.ndarray, weights: np.ndarray) -> float:
    both = np.append(weights, -1.0)
    return float(both @ sums @ both)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean place and share of good rows, both rising.
    ``x`` rises; ``good`` of ``n`` rows are good there."""
    blocks: list[list[float]] = []
    for place, g, rows in zip(x.tolist(), good.tolist(), n.tolist()):
        blocks.append([place * rows, g, rows])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


@dataclass(frozen=True)
class Model:
    """Basis, weights and calibration; without them every score is ``constant``."""

    constant: float
    basis: Basis | None = None
    weights: np.ndarray | None = None
    places: np.ndarray | None = None
    shares: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.basis is None:
            return np.full(len(x), self.constant)
        return np.interp(self.basis.features(x) @ self.weights, self.places, self.shares)


def labelled_rows(x: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``x``, ``good`` and ``fold`` of the labelled rows outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    known = (labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("good"), fold.alias("fold"))
             .filter(f"id IS NOT NULL AND good IS NOT NULL AND fold <> {HELD_OUT}")
             .groupBy("id", "fold").agg(F.max("good").alias("good")))
    known = stored(known, "quality-labels")
    if known.count() <= BROADCAST_ROWS:
        joined = x.join(F.broadcast(known), "id")
    else:
        joined = x.filter("id IS NOT NULL").join(known.hint("merge"), "id")
    return stored(joined.select("x", "good", "fold"), "quality-rows")


def fit(x: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """A model from all labelled rows outside the held-out fold. Of several labels of one document the
    largest counts; rows with a null id or label are left out. With rows of one class only the score is
    that class, and 0.5 without rows."""
    rows = labelled_rows(x, labels, id_col)
    basis = basis_of(x)
    sums = fold_sums(rows, basis)
    if not sums:
        return Model(0.5)
    whole = sum(sums.values())
    if whole[-1, -1] in (0.0, whole[-2, -2]):
        return Model(float(whole[-1, -1] > 0))
    rest = {f: whole - s for f, s in sums.items()} if len(sums) > 1 else sums
    penalty = min(PENALTIES, key=lambda p: sum(squared_error(s, ridge(rest[f], p)) for f, s in sums.items()))
    held = {f: ridge(s, penalty) for f, s in rest.items()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2000):
            z, fold = basis.features(matrix(b.column("x"))), b.column("fold").to_numpy()
            s = np.zeros(len(z))
            for f, w in held.items():
                s[fold == f] = z[fold == f] @ w
            place = np.rint(np.clip(s, -1, 2) * GRID).astype(np.int32)
            yield pa.record_batch({"place": place, "good": b.column("good")})

    # at most 3 * GRID + 1 places
    curve = (rows.mapInArrow(counted, "place int, good int").groupBy("place")
             .agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("place"))
    places, shares = isotonic(curve["place"].to_numpy() / GRID, curve["good"].to_numpy(float),
                              curve["n"].to_numpy(float))
    return Model(0.0, basis, ridge(whole, penalty), places, shares)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` in 0 to 1 and ``predicted``.

    Null texts count as empty; empty texts are scored by their statistics like any other. Rows are
    independent: repeated rows score alike, a row with a null id is scored and not held out; an empty
    table gives an empty result; other columns are never read."""
    x = described(docs, id_col, text_col)
    model = fit(x, labels, id_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2000):
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(model.score(matrix(b.column("x"))))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS))
    return (x.mapInArrow(scored, f"id {kind}, score double")
            .select(F.col("id").alias(id_col), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
