"""BPE encoding and decoding by tree concatenation.

A long text is cut into halves, quarters, ... down to leaves of at most ``LEAF`` code points. The
leaves are rows of their own and are encoded in parallel, without regard to where the cuts fall.
Neighbours are then joined in a tree. At a join a window is split and encoded again; it grows until
both sides agree with it exactly:

- on the splitting into pieces: the window starts at a piece of the left side that later text cannot
  change, and ends at a piece boundary that the right side has too. Whether a piece ends somewhere
  depends only on the text from its start to ``MARGIN`` code points past its end, so from a common
  boundary on both splittings are the same;
- on the merges, inside one unsplit piece of any length: the window is the last k tokens of the left
  and the first k of the right. If its encoding begins with the left's token and ends with the
  right's, every pair of neighbouring tokens is one that BPE keeps apart, and a sequence all of whose
  neighbouring pairs are kept apart is the encoding of its text. Else k doubles.

The merges come from the tokenizer file; splitting uses the file's own pre-tokenizer wherever a text
holds characters outside ``PLAIN``, whose classes might differ between regular-expression libraries.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored

LEAF = 32_768
PIECE_LEAF = 1_024
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧€]")


def byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from
    U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer file with the joins described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_of_char()
        self.library = Tokenizer.from_file(path)
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {b: i for b, i in ranks.items() if i not in self.special.values()}
        self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.between = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.margin = 4 + max([0, *map(len, self.special)])
        size = 1 + max([*ranks.values(), *self.special.values()])
        self.token_bytes = [b""] * size
        for b, i in ranks.items():
            self.token_bytes[i] = b
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        self.token_names = [str(i) for i in range(size)]
        self.cache: dict[str, list[int]] = {}

    def parts(self, text: str) -> list[str]:
        """Text between special tokens, and the special tokens, in order."""
        return [p for p in self.between.split(text) if p] if self.between else [text]

    def split(self, text: str) -> list[str]:
        """The pieces inside which merges happen; special tokens are pieces of their own."""
        out = []
        for part in self.parts(text):
            if part in self.special:
                out.append(part)
            elif NOT_PLAIN.search(part):
                out += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
            else:
                out += self.pattern.findall(part)
        return out

    def merge_ids(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring texts inside one piece, from the ids of each."""
        k = 4
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = b"".join(self.token_bytes[i] for i in left[a:] + right[:b])
            ids = self.core._encode_single_piece(window)
            if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[:a] + ids + right[b:]
            k *= 2

    def piece(self, text: str) -> list[int]:
        """The ids of one piece."""
        if text in self.special:
            return [self.special[text]]
        if len(text) > PIECE_LEAF:
            mid = len(text) // 2
            return self.merge_ids(self.piece(text[:mid]), self.piece(text[mid:]))
        return self.core._encode_single_piece(text.encode())

    def leaf(self, text: str) -> Encoded:
        ids, ends, id_ends, at = [], [], [], 0
        for p in self.split(text):
            got = self.cache.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) < 64:
                    if len(self.cache) > 200_000:
                        self.cache.clear()
                    self.cache[p] = got
            ids += got
            at += len(p)
            ends.append(at)
            id_ends.append(len(ids))
        return Encoded(text, np.array(ids, np.uint32), np.array(ends, np.int64), np.array(id_ends, np.int64))

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        """The encoding of two neighbouring texts from the encoding of each."""
        if not left.text or not right.text:
            return left if left.text else right
        cut, text = len(left.text), left.text + right.text
        kept = int(np.searchsorted(left.ends, cut - self.margin, side="right"))
        begin = int(left.ends[kept - 1]) if kept else 0
        theirs = np.concatenate([[0], right.ends]) + cut
        reach = 64
        while True:
            stop = min(len(text), cut + reach)
            pieces = self.split(text[begin:stop])
            ends = begin + np.cumsum([len(p) for p in pieces])
            sure = ends[(ends >= cut) & ((ends <= stop - self.margin) | (stop == len(text)))]
            both = sure[np.isin(sure, theirs)]
            if len(both):
                break
            reach *= 2
        sync = int(both[0])
        used = int(np.searchsorted(theirs, sync))  # pieces of the right side that the window replaces
        n = int(np.searchsorted(ends, sync)) + 1
        starts = np.concatenate([[begin], ends[:-1]])
        ids, id_ends = [], []
        last = int(left.ends[-2]) if len(left.ends) > 1 else 0
        first = int(right.ends[0]) + cut
        for p, s, e in zip(pieces[:n], starts, ends):
            if s == last and e == first and p not in self.special:
                ids += self.merge_ids(left.ids_of(len(left.ends) - 1), right.ids_of(0))
            else:
                ids += self.piece(p)
            id_ends.append(len(ids))
        before = int(left.id_ends[kept - 1]) if kept else 0
        after = int(right.id_ends[used - 1]) if used else 0
        return Encoded(text, np.concatenate([left.ids[:before], np.array(ids, np.uint32), right.ids[after:]]),
                       np.concatenate([left.ends[:kept], ends[:n], right.ends[used:] + cut]),
                       np.concatenate([left.id_ends[:kept], np.array(id_ends, np.int64) + before,
                                       right.id_ends[used:] - after + before + len(ids)]))

    def join_all(self, leaves: list[Encoded]) -> Encoded:
        """Joins neighbours, then neighbours of those, up to the whole text."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i:i + 2]) if i + 1 < len(leaves) else leaves[i]
                      for i in range(0, len(leaves), 2)]
        return leaves[0]

    def encode(self, text: str) -> list[int]:
        """The ids of a text of at most one leaf."""
        if NOT_PLAIN.search(text):
            return self.leaf(text).ids.tolist()
        ids = []
        for part in self.parts(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                ids += self.core.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes of the text that the ids stand for, special tokens included."""
        raw = b"".join(map(self.token_bytes.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


class Encoded:
    """A text, its ids, and for each of its pieces where it ends in the text and in the ids."""

    def __init__(self, text: str, ids: np.ndarray, ends: np.ndarray, id_ends: np.ndarray):
        self.text, self.ids, self.ends, self.id_ends = text, ids, ends, id_ends

    def ids_of(self, i: int) -> list[int]:
        return self.ids[int(self.id_ends[i - 1]) if i else 0:int(self.id_ends[i])].tolist()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The tokenizer, once per worker."""
    return ByteBpe(path)


def cut(text: str, leaf: int) -> list[str]:
    """The leaves of a text: halves of halves, none longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return cut(text[:mid], leaf) + cut(text[mid:], leaf)


def digest(bpe: ByteBpe, ids: list[int]) -> tuple[int, str, str]:
    """The number of ids, and the SHA-256 of the comma-joined ids and of the decoded text."""
    names = ",".join(map(bpe.token_names.__getitem__, ids)).encode()
    return len(ids), hashlib.sha256(names).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


DIGEST = ("n_tokens long, ids_sha256 string, decoded_sha256 string", digest)
IDS = ("ids array<int>", lambda bpe, ids: (ids,))


def encode_documents(docs: DataFrame, path: str, result=IDS, leaf: int = LEAF,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and what ``result`` (a schema and a function of the tokenizer and the ids; see
    ``IDS``, ``DIGEST``) makes of the encoding of the whole text.

    Null counts as empty and has no ids. Repeated rows are returned as often as they occur, rows with
    a null id too; an empty table gives an empty result; other columns are ignored. A task holds at most
    the leaves of one long text, once, whichever rows share it."""
    schema, made = result
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    id_type = docs.schema[id_col].dataType.simpleString()
    # the first pass writes, side by side, the results of short texts, a row for each long one, and the
    # leaves of the long texts, once per text and task
    first_schema = f"id {id_type}, {schema}, doc_sha string, leaf int, text string"

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, seen = load(path), set()
        none = [None] * len(names)
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"].array, batch["text"]):
                if len(text) <= leaf:
                    rows.append((i, *made(bpe, bpe.encode(text)), None, None, None))
                    continue
                sha = hashlib.sha256(text.encode()).hexdigest()
                rows.append((i, *none, sha, None, None))
                if sha not in seen:
                    seen.add(sha)
                    rows += [(None, *none, sha, n, p) for n, p in enumerate(cut(text, leaf))]
            yield frame(rows, ["id", *names, "doc_sha", "leaf", "text"])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            got = [bpe.leaf(t) for t in batch["text"]]
            batch["ids"] = [e.ids.tobytes() for e in got]
            batch["ends"] = [e.ends.astype(np.uint32).tobytes() for e in got]
            batch["id_ends"] = [e.id_ends.astype(np.uint32).tobytes() for e in got]
            yield batch

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        bpe = load(path)
        group = group.sort_values("leaf")
        back = lambda b: np.frombuffer(b, np.uint32).astype(np.int64)
        whole = bpe.join_all([Encoded(t, np.frombuffer(i, np.uint32), back(e), back(x))
                              for t, i, e, x in zip(group["text"], group["ids"], group["ends"], group["id_ends"])])
        return frame([(group["doc_sha"].array[0], *made(bpe, whole.ids.tolist()))], ["doc_sha", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done = stored(rows.mapInPandas(short, first_schema), "bpe")
    # a text is encoded once, however many rows hold it; its leaves meet in one group, as its ids are one value
    encoded = (done.filter("leaf IS NOT NULL").select("doc_sha", "leaf", "text").dropDuplicates(["doc_sha", "leaf"])
               .mapInPandas(leaves, "doc_sha string, leaf int, text string, ids binary, ends binary, id_ends binary"))
    long = encoded.groupBy("doc_sha").applyInPandas(joined, f"doc_sha string, {schema}")
    holders = done.filter("leaf IS NULL AND doc_sha IS NOT NULL").select("id", "doc_sha")
    out = (done.filter("leaf IS NULL AND doc_sha IS NULL").select("id", *names)
           .unionByName(holders.join(stored(long, "long"), "doc_sha").select("id", *names)))
    return out.withColumnRenamed("id", id_col)


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as objects, so that Arrow converts integers beside nulls without a detour over floats."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text that the ids in ``ids_col`` stand for; null ids give null."""
    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return ids.map(lambda x: None if x is None else bpe.decode(list(x)).decode())

    return rows.withColumn(out, decoded(F.col(ids_col)))
