"""Toxicity from two class-conditional Kneser-Ney models.

Each class has a word model of Kneser-Ney type: a word counts by the number of distinct words it
follows in that class (so repeating a phrase adds nothing), each count is discounted by D, and exactly
the mass that the discount took backs off to counts that both classes share:

    p(word | class) = max(count - D, 0) / N + (taken / N) * (count in both classes / N of both)

so the probabilities of a class sum to 1. A word that neither class has kept anything of (a rare or an
unknown one) has one ratio for all such words, that of the two backoff masses; it is taken out of every
word's evidence, so that such words say nothing. Toxic documents are ordinary prose with some toxic
expressions in it, so their model is in turn a mixture with the ordinary one, of a share s.

A document's evidence is the difference of its two log-likelihoods divided by its number of words;
a logistic curve turns it into a score. The counts come from all labelled rows outside the held-out
fold; D, s and the curve are fitted on one further fold (about ``CURVE_ROWS`` of its rows) with counts
from the other folds.

Words are counted by their full 64-bit hash, so that the model grows with the vocabulary. Their weights
lie in the shared folder; the driver never holds them. Up to ``TABLE_ROWS`` words with evidence
(counted) every worker reads them once; beyond, a document's words are counted in place and joined with
the weights by their hash, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, likely_in, shared_path, small, stored
from .shingles import MULT, mix, word_hashes

BROADCAST_ROWS = 1_000_000  # labels beyond this are joined by a shuffle
FOLDS, HELD_OUT, CURVE_FOLD = 5, 0, 1
CURVE_ROWS = 20_000
DISCOUNTS = (1.0, 1.5, 2.0, 3.0, 5.0)
SHARES = (0.01, 0.03, 0.1, 0.3, 1.0)  # of toxic expressions among the words of a toxic document
TABLE_ROWS = 6_000_000  # words with evidence that a worker may hold


def words_of(col: str = "text"):
    """Lower-cased runs of letters with single spaces between; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}\p{M}]+", " ")


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def slots_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: the words' hashes, the same as signed numbers (slots), and the number of words per
    document."""
    hashes, counts = word_hashes(*buffers(words))
    return hashes, hashes.view(np.int64), counts


class Masses:
    """Of the two models with discount ``d``: the classes' totals and the shares that back off."""

    def __init__(self, d: float, total: dict[str, float], kept: dict[str, float]):
        self.d, self.total = d, total
        self.backoff = {c: 1 - kept[c] / total[c] for c in total}

    def probability(self, cls: str, toxic: Column, ordinary: Column) -> Column:
        own = toxic if cls == "toxic" else ordinary
        n = self.total[cls]
        shared = (toxic + ordinary) / F.lit(float(sum(self.total.values())))
        return F.greatest(own - self.d, F.lit(0.0)) / n + F.lit(self.backoff[cls]) * shared

    def ratio(self, toxic: Column, ordinary: Column) -> Column:
        """The toxic over the ordinary probability of a word."""
        return self.probability("toxic", toxic, ordinary) / self.probability("ordinary", toxic, ordinary)

    def rest(self) -> float:
        """The ratio of words that neither class has kept anything of."""
        return self.backoff["toxic"] / self.backoff["ordinary"]


def masses(counts: DataFrame, part: str, discounts: tuple[float, ...]) -> list[Masses] | None:
    """One aggregation over the counts; None if a class has none."""
    names = {"toxic": "toxic" + part, "ordinary": "ordinary" + part}
    kept = {(c, d): F.sum(F.greatest(F.col(name) - F.lit(d), F.lit(0.0))).alias(f"{c}{i}")
            for c, name in names.items() for i, d in enumerate(discounts)}
    row = counts.agg(*[F.sum(name).cast("double").alias(c) for c, name in names.items()], *kept.values()).first()
    total = {c: row[c] or 0.0 for c in names}
    if not all(total.values()):
        return None
    return [Masses(d, total, {c: row[f"{c}{i}"] for c in names}) for i, d in enumerate(discounts)]


def weight(ratio, rest: float, share: float, log1p=np.log1p):
    """What a word says: the log-ratio of the mixture and the ordinary model, less that of a rare word."""
    return log1p(share * (ratio - 1.0)) - float(np.log1p(share * (rest - 1.0)))


def words_with_evidence(counts: DataFrame, part: str, by: list[Masses]) -> DataFrame:
    """``slot`` and the ratios ``r0``, ``r1``, ... by each of ``by``, of the words that differ from a rare one
    in any."""
    toxic, ordinary = (F.col(c + part).cast("double") for c in ("toxic", "ordinary"))
    least = min(m.d for m in by)
    return (counts.filter((toxic > least) | (ordinary > least))
            .select("slot", *[m.ratio(toxic, ordinary).cast("float").alias(f"r{i}") for i, m in enumerate(by)]))


@lru_cache(maxsize=1)
def held_table(folder: str, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted words (the last one larger than any) and their columns ``names``, read from the shared
    folder once per worker."""
    place, base = fs.FileSystem.from_uri(folder)

    def column(name: str) -> np.ndarray:  # one at a time: a worker holds little beside the result
        values = pq.read_table(base, columns=[name], filesystem=place).column(name).to_numpy()
        pa.default_memory_pool().release_unused()
        return values

    keys = column("slot")
    order = np.argsort(keys)
    return (np.append(keys[order], np.iinfo(np.int64).max),
            [np.append(column(n)[order], np.float32(np.nan)) for n in names])


def evidence(words: pa.Array, keys: np.ndarray, columns: list[np.ndarray], weigh) -> list[np.ndarray]:
    """Per document the length-normalised sums of its words' weights. ``weigh`` turns the columns' values
    of the words found in ``keys`` into one or more weights each; other words say nothing. Fifty
    documents at a time, so arrays per word stay small."""
    parts = []
    for at in range(0, max(len(words), 1), 50):
        _, slot, counts = slots_of(words.slice(at, 50))
        doc = np.repeat(np.arange(len(counts)), counts)
        at_key = np.searchsorted(keys, slot)
        known = np.flatnonzero(keys[at_key] == slot)
        doc, at_key = doc[known], at_key[known]
        parts.append([np.bincount(doc, w, len(counts)) / np.maximum(counts, 1)
                      for w in weigh([c[at_key].astype(float) for c in columns])])
    return [np.concatenate(x) for x in zip(*parts)]


def occurrences(rows: DataFrame) -> DataFrame:
    """(key, slot, part): every distinct word of every row of ``rows`` (key, words) with its share of the
    row's words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            _, slot, counts = slots_of(b.column("words"))
            doc = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((slot, doc))
            slot, doc = slot[order], doc[order]
            first = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (doc[1:] != doc[:-1]))[:len(slot)])
            times = np.diff(np.append(first, len(slot)))
            yield pa.record_batch({"key": b.column("key").to_numpy()[doc[first]], "slot": slot[first],
                                   "part": times / counts[doc[first]]})

    return rows.mapInArrow(count, "key long, slot long, part double")


def joined_evidence(rows: DataFrame, table: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """``key`` and the named sums for every row of ``rows`` (key, words), by a join on the words' hashes.
    A frequent word meets one row of ``table``: Spark splits its occurrences."""
    sums = (occurrences(rows).join(table.hint("merge"), "slot").groupBy("key")
            .agg(*[F.sum(F.col("part") * w).alias(name) for name, w in weights.items()]))
    return rows.select("key").join(sums, "key", "left").select(
        "key", *[F.coalesce(name, F.lit(0.0)).alias(name) for name in weights])


def continuation_counts(labelled: DataFrame) -> DataFrame:
    """Per word (``slot``, its hash): its distinct predecessors in toxic and ordinary rows (``toxic``,
    ``ordinary``), and the same without the curve fold (``toxic_rest``, ``ordinary_rest``).
    ``labelled``: words, toxic, fold."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            hashes, slot, counts = slots_of(b.column("words"))
            if not len(hashes):
                continue
            before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])
            first = np.cumsum(counts) - counts
            before[first[counts > 0]] = 0
            toxic = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False), counts).astype(np.uint64)
            curve = np.repeat(b.column("fold").to_numpy(zero_copy_only=False) == CURVE_FOLD, counts)
            # the word, and one number: a hash of the pair, the class; the part
            pair = (mix(before * MULT + hashes) >> np.uint64(16)) & ~np.uint64(3)  # 48 bits: they compress
            pair |= toxic << np.uint64(1) | curve.astype(np.uint64)
            _, at = np.unique(pair ^ hashes, return_index=True)
            pair = pair[at]
            yield pa.record_batch({"slot": slot[at], "pair": (pair & ~np.uint64(1)).view(np.int64),
                                   "part": np.where(pair & np.uint64(1), 1, 2).astype(np.int8)})

    seen = labelled.mapInArrow(pairs, "slot long, pair long, part tinyint")
    distinct = seen.groupBy("slot", "pair").agg(F.bit_or("part").alias("parts")).select(
        "slot", F.col("pair").bitwiseAND(F.lit(2)) > 0, F.col("parts") >= 2).toDF("slot", "is_toxic", "in_rest")
    count = lambda test: F.sum(F.expr(test).cast("int")).cast("int")
    return distinct.groupBy("slot").agg(
        count("is_toxic").alias("toxic"), count("NOT is_toxic").alias("ordinary"),
        count("is_toxic AND in_rest").alias("toxic_rest"),
        count("NOT is_toxic AND in_rest").alias("ordinary_rest"))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and mean log-loss of a one-variable logistic fit (Newton, lightly damped)."""
    scale = x.std() or 1.0
    z, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    damp = np.diag([1e-3, 1e-6]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + damp @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + damp, grad)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w[0] / scale, w[1], float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@dataclass(frozen=True)
class Model:
    """Where the words' weights are (``slot``, ``w``), how many, and the curve; a constant score if there
    is no folder."""

    folder: str | None
    words: int = 0
    discount: float = 0.0
    share: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    constant: float = 0.0

    def held(self) -> bool:
        """Whether workers hold the weights; else they are joined."""
        return self.folder is None or self.words <= TABLE_ROWS

    def curve(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -500, 500)))

    def score(self, words: pa.Array) -> np.ndarray:
        if self.folder is None:
            return np.full(len(words), self.constant)
        return self.curve(evidence(words, *held_table(self.folder, ("w",)), lambda columns: columns)[0])

    def scored(self, rows: DataFrame) -> DataFrame:
        """``key`` and ``score`` of ``rows`` (key, words), by the join."""
        table = rows.sparkSession.read.parquet(self.folder)
        z = F.col("x") * self.slope + self.offset
        return joined_evidence(rows, table, {"x": F.col("w").cast("double")}).select(
            "key", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from all labelled rows outside the held-out fold. Of several labels of one document the
    largest counts; rows with a null id or label are left out. With rows of one class only, or none,
    the score is the constant share of toxic rows (0 without rows)."""
    fold = fold_of(id_col).alias("fold")
    known = (labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"), fold)
             .filter(f"id IS NOT NULL AND toxic IS NOT NULL AND fold <> {HELD_OUT}")
             .groupBy("id", "fold").agg(F.max("toxic").alias("toxic")))
    known = stored(known, "labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if known.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(known), "id")
    else:
        joined = likely_in(rows, known, ["id"]).join(known.hint("merge"), "id")
    labelled = stored(joined.select("id", words_of("text").alias("words"), "toxic", "fold"), "labelled")
    counts = stored(continuation_counts(labelled), "counts")
    whole = masses(counts, "", DISCOUNTS)
    if whole is None:
        toxic = counts.agg(F.sum("toxic")).first()[0]
        return Model(None, constant=float(bool(toxic)))
    best = fit_curve(labelled, known, counts)
    if best is None:  # too few rows to fit a curve: equal likelihoods score 0.5
        best = (100.0, 0.0, DISCOUNTS[0], SHARES[1])
    slope, offset, discount, share = best
    by = whole[DISCOUNTS.index(discount)]
    table = words_with_evidence(counts, "", [by])
    w = F.log1p(F.lit(share) * (F.col("r0") - 1.0)) - float(np.log1p(share * (by.rest() - 1.0)))
    folder = shared_path(docs.sparkSession, "weights")
    table.select("slot", w.cast("float").alias("w")).write.parquet(folder)
    return Model(folder, docs.sparkSession.read.parquet(folder).count(), discount, share, float(slope), float(offset))


def fit_curve(labelled: DataFrame, known: DataFrame, counts: DataFrame) -> tuple | None:
    """Slope, offset, discount and share with the least log-loss on the curve fold, counted without it;
    None if it lacks rows of a class."""
    by = masses(counts, "_rest", DISCOUNTS)
    if by is None:
        return None
    # a bounded sample by a hash of the id: what a task sends does not grow with the number of tasks
    rows = known.filter(f"fold = {CURVE_FOLD}").count()
    sample = (labelled.filter(f"fold = {CURVE_FOLD}")
              .filter(F.pmod(F.xxhash64("id"), F.lit(max(CURVE_ROWS, rows))) < CURVE_ROWS).select("words", "toxic"))
    folder = shared_path(labelled.sparkSession, "ratios")
    words_with_evidence(counts, "_rest", by).write.parquet(folder)
    table = labelled.sparkSession.read.parquet(folder)
    names = {(i, j): f"x{i}_{j}" for i in range(len(by)) for j in range(len(SHARES))}
    if table.count() <= TABLE_ROWS:
        rests, ratios = [m.rest() for m in by], tuple(f"r{i}" for i in range(len(by)))

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, columns = held_table(folder, ratios)
            weigh = lambda r: [weight(r[i], rests[i], SHARES[j]) for i, j in names]
            for b in small(batches):
                x = evidence(b.column("words"), keys, columns, weigh)
                yield pa.record_batch({"toxic": b.column("toxic"), **dict(zip(names.values(), x))})

        schema = "toxic int, " + ", ".join(f"{n} double" for n in names.values())
        curve = sample.mapInArrow(measured, schema).toPandas()
    else:
        keyed = stored(sample.withColumn("key", F.monotonically_increasing_id()), "curve")
        weights = {n: weight(F.col(f"r{i}").cast("double"), by[i].rest(), SHARES[j], F.log1p)
                   for (i, j), n in names.items()}
        curve = joined_evidence(keyed.select("key", "words"), table, weights).join(
            keyed.select("key", "toxic"), "key").toPandas()
    y = curve["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    fits = ((*logistic(curve[n].to_numpy(), y), DISCOUNTS[i], SHARES[j]) for (i, j), n in names.items())
    slope, offset, _, discount, share = min(fits, key=lambda f: f[2])
    return slope, offset, discount, share


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` in 0 to 1 and ``predicted``.

    Null and empty texts get the score of no evidence. Rows are independent: repeated rows score
    alike, a row with a null id is scored and not held out; an empty table gives an empty result;
    other columns are never read."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.record_batch({"id": b.column("id"), "score": model.score(b.column("words"))})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    if model.held():
        rows = rows.mapInArrow(scored, f"id {kind}, score double")
    else:
        rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "words")
        rows = rows.select("key", "id").join(model.scored(rows.select("key", "words")), "key")
    return rows.select(F.col("id").alias(id_col),
                       F.coalesce(fold_of("id") == HELD_OUT, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns unchanged."""
    if not model.held():
        keyed = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("key")),
                       "keyed")
        rows = keyed.select("key", words_of(f"doc.`{text_col}`").alias("words"))
        toxic = model.scored(rows).filter("score >= 0.5").select("key")
        return keyed.join(toxic, "key", "left_anti").select("doc.*")

    @F.pandas_udf("boolean")
    def ordinary(words: pd.Series) -> pd.Series:
        return pd.Series(model.score(pa.array(words, pa.string())) < 0.5)

    return docs.filter(ordinary(words_of(text_col)))
