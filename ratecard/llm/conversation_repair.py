"""Cheapest repair of conversations by a dynamic programme over a shared grammar.

Every row of a conversation becomes one letter (its role and its first fault), every conversation a
string. Re-Pair rounds over the distinct strings of the whole table replace frequent neighbours by new
symbols, so that what conversations share is written once. Each symbol has one transfer matrix: the
cheapest way, in min-plus arithmetic, from each state of the role pattern ``(s?(ua)+)?`` to each other
while it reads the symbol's rows, with the edits' initials as a rope (a shared tree of strings, written
out only at the end). A rule's matrix is the product of its two parts' matrices, computed once,
bottom-up; a conversation multiplies the few symbols its string is left with.

Ties go to the ASCII-least audit. Two audits of equal cost over the same rows never begin with one
another (the longer one would have paid for more inserts), so the order of two ropes stays as it is
whatever follows, and least audits may be formed part by part.

Scale: rows travel as ids, digests and letters; they are dealt by range of (conversation, turn), so the
rows of one very long conversation lie in many tasks. Its string and its audit are one value of a byte
per row, as the result itself asks for. Learning the grammar sends at most ``RULES`` pairs a round to the
driver; whatever the ``ROUNDS`` leave is multiplied symbol by symbol, so the bound costs no exactness.
The digest of the repaired text is a single SHA-256 over the conversation in order, which cannot be split:
its rows are streamed in batches through one task, never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# letters: chr(FIRST + 4 * fault + role)
FIRST = 65
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETED = 4 * BLANK  # the symbol of all rows that have to go
ALPHABET = 16
STATES, ACCEPTING = 4, (0, 3)  # nothing yet, after s, after u, after a
STEP = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
ROUNDS, RULES = 12, 64
SPACES = " \t\n\x0b\x0c\r"


# ---- rows and faults -----------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` after damage, and ``copies``: 0 for a dropped row, 2
    for a repeated one. A null counts as one space, but a null turn or conv_id stays null."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                                kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def faulty_rows(damaged: DataFrame) -> DataFrame:
    """Rows without their texts: ``conv_id``, ``turn``, ``role``, ``digest``, ``copies`` and ``code``
    (4 * fault + role). Equal rows of one turn are one row with their number of copies; ``code`` is that
    of the first. Texts are compared by SHA-256."""
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
             .otherwise(SOUND))
    first = F.left(F.col("role"), F.lit(1))
    role = (F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT)
            .otherwise(OTHER))
    rows = (damaged.select("conv_id", "turn", "role", digest_of(F.col("text")).alias("digest"), "copies",
                           fault.alias("fault"), role.alias("initial"))
            .groupBy("conv_id", "turn", "role", "digest", "fault", "initial")
            .agg(F.sum("copies").alias("copies")))
    rows = stored(rows, "turns")
    # role and text that occur at several turns: all but the first are duplicates
    seen = (rows.filter("copies > 0").groupBy("conv_id", "role", "digest")
            .agg(F.count(F.lit(1)).alias("turns"), F.max(F.col("turn").isNull()).alias("at_null"),
                 F.min("turn").alias("at"))
            .filter("turns > 1").select(*[F.col(c).alias(f"s_{c}") for c in ("conv_id", "role", "digest")],
                                        "at_null", "at"))
    same = (F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("role") == F.col("s_role"))
            & (F.col("digest") == F.col("s_digest")))
    later = F.when(F.col("at_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("at"))
    return (rows.join(seen, same, "left")
            .select("conv_id", "turn", "role", "digest", "copies",
                    (4 * F.when((F.col("fault") != BLANK) & F.coalesce(later, F.lit(False)), DUPLICATE)
                     .otherwise(F.col("fault")) + F.col("initial")).cast("int").alias("code")))


def letters_of(codes: np.ndarray, copies: np.ndarray) -> str:
    """The letters of rows in order; a row's later copies are duplicates, or blank like itself."""
    out = np.repeat(codes, copies)
    again = np.ones(len(out), dtype=bool)
    again[(np.cumsum(copies) - copies)[copies > 0]] = False
    out = np.where(again & (out >> 2 < BLANK), 4 * DUPLICATE + (out & 3), out)
    return (out + FIRST).astype(np.uint8).tobytes().decode("ascii")


def conversation_strings(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``letters`` (in order of turn, nulls first, then role and digest) and ``gaps``."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b.column("conv_id").to_pylist()
            codes, copies = (b.column(c).to_numpy() for c in ("code", "copies"))
            out, start = {"conv_id": [], "part": [], "at": [], "letters": []}, 0
            for key, run in groupby(ids):
                stop = start + sum(1 for _ in run)
                for name, value in zip(out, (key, part, at, letters_of(codes[start:stop], copies[start:stop]))):
                    out[name].append(value)
                start, at = stop, at + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["conv_id"], b.schema.field("conv_id").type), pa.array(out["part"], pa.int32()),
                 pa.array(out["at"], pa.int64()), pa.array(out["letters"], pa.string())], list(out))

    rows = stored(rows, "letters")
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = (rows.select("conv_id", "turn", "role", "digest", "code", "copies")
               .repartitionByRange("conv_id", "turn", "role", "digest")
               .sortWithinPartitions("conv_id", "turn", "role", "digest"))
    there = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = (rows.groupBy("conv_id").agg((F.max(there) - F.min(there) + 1 - F.countDistinct(there)).alias("gaps"))
            .select("conv_id", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("at"),
                    F.lit(None).cast("string").alias("letters"), "gaps"))
    return (ordered.mapInArrow(pieces, f"conv_id {kind}, part int, at long, letters string")
            .withColumn("gaps", F.lit(None).cast("long")).unionByName(gaps)
            .groupBy("conv_id").agg(
                F.collect_list(F.when(F.col("letters").isNotNull(), F.struct("part", "at", "letters"))).alias("p"),
                F.coalesce(F.max("gaps"), F.lit(0)).cast("long").alias("gaps"))
            .select("conv_id", F.array_join(F.transform(F.array_sort("p"), lambda x: x["letters"]), "")
                    .alias("letters"), "gaps"))


# ---- the grammar ---------------------------------------------------------------------------------

Round = list[tuple[int, int, int]]  # rules of a round: left, right, new symbol


def symbols_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all strings, each string followed by -1, and the place of each string's first."""
    codes = np.frombuffer("\x00".join([*strings, ""]).encode("ascii"), dtype=np.uint8).astype(np.int64) - FIRST
    codes = np.where(codes >= DELETED, DELETED, codes)
    codes[codes < 0] = -1
    return codes, starts_of(codes)


def starts_of(codes: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(codes == -1)
    return np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)


def pair_places(codes: np.ndarray) -> np.ndarray:
    """Where a pair of symbols begins; in a run of one symbol, at every other place."""
    if len(codes) < 2:
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    in_run = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
    pair = (codes[:-1] >= 0) & (codes[1:] >= 0)
    pair &= (codes[:-1] != codes[1:]) | (in_run[:-1] % 2 == 0)
    return np.flatnonzero(pair)


def rewritten(codes: np.ndarray, rules: Round) -> np.ndarray:
    """``codes`` with every pair of one round's rules replaced. No symbol is the left side of one rule
    and the right side of another, so the places never overlap."""
    at = pair_places(codes)
    if not len(at) or not rules:
        return codes
    keys = np.array([left << 32 | right for left, right, _ in rules])
    order = np.argsort(keys)
    new = np.array([n for _, _, n in rules])[order]
    keys = keys[order]
    pair = codes[at] << 32 | codes[at + 1]
    found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    hit = keys[found] == pair
    codes = codes.copy()
    codes[at[hit]] = new[found[hit]]
    return np.delete(codes, at[hit] + 1)


def chosen(counted: list[tuple[int, int]], next_symbol: int) -> Round:
    """The most frequent pairs of which no symbol is the left side of one and the right side of another."""
    lefts, rights, rules = set(), set(), []
    for a, b in counted:
        if a in rights or b in lefts:
            continue
        lefts.add(a)
        rights.add(b)
        rules.append((a, b, next_symbol + len(rules)))
    return rules


def learn(strings: DataFrame) -> list[Round]:
    """Re-Pair over all distinct strings (weighted by how often they occur), a round per Spark job."""
    distinct = stored(strings.groupBy("letters").agg(F.count(F.lit(1)).alias("n")), "strings")
    grammar: list[Round] = []

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, _ = symbols_of(b.column("letters").to_pylist())
            for rules in grammar:
                codes = rewritten(codes, rules)
            string = np.cumsum(codes == -1)
            at = pair_places(codes)
            keys, which = np.unique(codes[at] << 32 | codes[at + 1], return_inverse=True)
            n = np.bincount(which, b.column("n").to_numpy()[string[at]], len(keys)).astype(np.int64)
            yield pa.record_batch({"left": (keys >> 32).astype(np.int32),
                                   "right": (keys & 0xFFFFFFFF).astype(np.int32), "n": n})

    symbol = ALPHABET
    for _ in range(ROUNDS):
        top = (distinct.mapInArrow(pairs, "left int, right int, n long").groupBy("left", "right")
               .agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "left", "right").limit(RULES))
        rules = chosen([(r["left"], r["right"]) for r in top.collect()], symbol)
        if not rules:
            break
        grammar.append(rules)
        symbol += len(rules)
    return grammar


# ---- min-plus matrices with ropes ----------------------------------------------------------------

class Rope:
    """A string as a tree; parts are shared and never copied."""

    __slots__ = ("text", "left", "right")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right

    def __add__(self, other: Rope) -> Rope:
        if self.text == "":
            return other
        return self if other.text == "" else Rope(None, self, other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            rope = stack.pop()
            if rope.text is None:
                stack += (rope.right, rope.left)
            else:
                yield rope.text

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """Whether this string is ASCII-less; equal parts that are shared are passed over whole."""
        x, y = [self], [other]
        while x and y:
            a, b = x.pop(), y.pop()
            if a is b:
                continue
            if a.text is None:
                x += (a.right, a.left)
                y.append(b)
            elif b.text is None:
                y += (b.right, b.left)
                x.append(a)
            else:
                n = min(len(a.text), len(b.text))
                if a.text[:n] != b.text[:n]:
                    return a.text < b.text
                if len(a.text) > n:
                    x.append(Rope(a.text[n:]))
                elif len(b.text) > n:
                    y.append(Rope(b.text[n:]))
        return any(r.text != "" for r in y) and not any(r.text != "" for r in x)


Entry = tuple[int, Rope]
Matrix = list[dict[int, Entry]]  # by state before: state after -> cheapest


def better(row: dict[int, Entry], state: int, cost: int, audit: Rope) -> None:
    old = row.get(state)
    if old is None or cost < old[0] or (cost == old[0] and audit < old[1]):
        row[state] = (cost, audit)


def times(row: dict[int, Entry], matrix: Matrix) -> dict[int, Entry]:
    out: dict[int, Entry] = {}
    for between, (cost, audit) in row.items():
        for after, (more, rest) in matrix[between].items():
            better(out, after, cost + more, audit + rest)
    return out


def inserts() -> Matrix:
    """Any number of inserted rows, the cheapest first."""
    out: Matrix = []
    for state in range(STATES):
        row, edge, cost = {state: (0, Rope(""))}, [state], 0
        while edge:
            cost += INSERT
            edge = [STEP[s, r] for s in edge for r in (USER, ASSISTANT) if (s, r) in STEP]
            edge = [s for s in edge if s not in row]
            for s in edge:
                row[s] = (cost, Rope("I" * (cost // INSERT)))
        out.append(row)
    return out


def row_matrix(code: int) -> Matrix:
    """What one row allows, with inserts before it."""
    fault, role = code >> 2, code & 3
    own: Matrix = []
    for state in range(STATES):
        row: dict[int, Entry] = {}
        better(row, state, DELETE, Rope("D"))
        if fault < BLANK:
            extra = CUT_OFF if fault == TRUNCATED else 0
            if (state, role) in STEP:
                better(row, STEP[state, role], KEEP + extra, Rope("K"))
            for other in (USER, ASSISTANT):
                if (state, other) in STEP:
                    better(row, STEP[state, other], REROLE + extra, Rope("R"))
        own.append(row)
    return [times(row, own) for row in inserts()]


def rule_matrices(grammar: list[Round]) -> dict[int, Matrix]:
    """The matrix of every symbol, bottom-up: each rule's from those of its two parts."""
    known = {code: row_matrix(code) for code in [*range(2 * 4), DELETED]}
    for rules in grammar:
        for left, right, symbol in rules:
            known[symbol] = [times(row, known[right]) for row in known[left]]
    return known


def cheapest(symbols: list[int], matrices: dict[int, Matrix], tail: Matrix) -> tuple[int, str]:
    """Cost and audit of one conversation."""
    row: dict[int, Entry] = {0: (0, Rope(""))}
    for symbol in symbols:
        row = times(row, matrices[symbol])
    row = times(row, tail)
    best: dict[int, Entry] = {}
    for state in ACCEPTING:
        if state in row:
            better(best, 0, *row[state])
    return best[0][0], str(best[0][1])


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNT_NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def repairs(strings: DataFrame, grammar: list[Round]) -> DataFrame:
    """Per conversation its faults, the cost of the cheapest repair and its audit. Equal symbol strings of
    a batch are solved once."""
    kind = strings.schema["conv_id"].dataType.simpleString()
    legal = np.zeros(256, dtype=bool)
    legal[[SYSTEM << 4 | USER, USER << 4 | ASSISTANT, ASSISTANT << 4 | USER]] = True

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, tail = rule_matrices(grammar), inserts()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                strings = b.column("letters").to_pylist()
                codes, starts = symbols_of(strings)
                for rules in grammar:
                    codes = rewritten(codes, rules)
                starts = np.append(starts_of(codes), len(codes)).tolist()
                known: dict[bytes, tuple[int, str]] = {}
                out = {name: [] for name in COUNT_NAMES[1:]}
                for i, string in enumerate(strings):
                    mine = codes[starts[i]:starts[i + 1] - 1]
                    key = mine.tobytes()
                    if key not in known:
                        known[key] = cheapest(mine.tolist(), matrices, tail)
                    raw = np.frombuffer(string.encode("ascii"), dtype=np.uint8) - FIRST
                    faults = np.bincount(raw >> 2, minlength=4)
                    role = raw & 3
                    values = (faults[BLANK], faults[DUPLICATE], faults[TRUNCATED],
                              np.count_nonzero(~legal[role[:-1] << 4 | role[1:]]), *known[key])
                    for name, value in zip(out, values):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id"), b.column("gaps"),
                     *[pa.array(out[c], pa.string() if c == "audit" else pa.int64()) for c in out]],
                    ["conv_id", "gaps", *out])

    return strings.mapInArrow(solve, f"conv_id {kind}, {COUNTS}")


# ---- the repaired text ---------------------------------------------------------------------------

class Rebuilt:
    """One conversation's repaired rows as they come, hashed on the way."""

    def __init__(self, audit: str):
        self.audit, self.at, self.n = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with a system row
        self.hash = hashlib.sha256()

    def put(self, role: str | None, text: str) -> None:
        if role is None:
            role = "user" if (self.n - self.odd) % 2 == 0 else "assistant"
        self.hash.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
        self.n += 1

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.put(None, "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self.put(role if edit == "K" else None, text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def rebuilt(damaged: DataFrame, repaired: DataFrame) -> DataFrame:
    """``repaired`` with ``repaired_sha256``: conversations' rows in order behind their audit."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    empty = lambda name, t: F.lit(None).cast(t).alias(name)
    heads = repaired.select("conv_id", F.lit(0).alias("kind"), empty("turn", damaged.schema["turn"].dataType),
                            empty("role", "string"), empty("digest", "binary"), empty("text", "string"),
                            F.lit(0).alias("copies"), *COUNT_NAMES)
    rows = damaged.filter("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", digest_of(F.col("text")).alias("digest"), "text",
        "copies", *[empty(*c.split()) for c in COUNTS.split(", ")])
    order = ["conv_id", "kind", "turn", "role", "digest"]
    ordered = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)
    given = ["conv_id", *COUNT_NAMES]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, done = None, None, []
        kinds = None

        def finished() -> pa.RecordBatch:
            names = [*given, "repaired_sha256"]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*done), [*kinds, pa.string()])], names)

        for whole in batches:
            kinds = [whole.schema.field(c).type for c in given]
            for at in range(0, whole.num_rows, 1000):
                for row in whole.slice(at, 1000).to_pylist():
                    if row["kind"] == 0:
                        if now is not None:
                            done.append((*head, now.digest()))
                        now, head = Rebuilt(row["audit"]), [row[c] for c in given]
                    else:
                        now.row(row["role"], row["text"], row["copies"])
                if len(done) >= 1000:
                    yield finished()
                    done = []
        if now is not None:
            done.append((*head, now.digest()))
        if done:
            yield finished()

    return ordered.mapInArrow(stream, f"conv_id {kind}, {COUNTS}, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations`` and repairs them: one row per original conv_id.

    A null conv_id is a conversation of its own; nulls elsewhere count as one space (a null turn comes
    first and has no gap); an empty table gives no rows; equal rows of one turn are adjacent; rows that
    share a turn are ordered by role, then by the SHA-256 of their text; other columns are never read."""
    damaged = damage(conversations)
    strings = stored(conversation_strings(faulty_rows(damaged)), "conversations")
    repaired = stored(repairs(strings, learn(strings)), "repairs")
    return rebuilt(damaged, repaired)
