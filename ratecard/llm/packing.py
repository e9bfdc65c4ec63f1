"""Sequence packing by shortest-pack-first over the length histogram.

Documents become token ids; each is cut into pieces of exactly ``size`` ids and a shorter rest. The
piece lengths are counted (a table of at most ``size`` rows, whatever the input), and lengths are
placed longest first: all pieces of one length go, as counts, to the packing patterns with the most
room left, that is to the shortest packs, several to a pattern where they fit. Only patterns and counts
are handled there, never documents. Every pattern then owns a run of ranks of each length it holds,
and pieces find their sequence and offset by their rank within their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_of_char
from .common import ranked, stored

END_ID = 1
PLAIN_WORD = re.compile("[!-~¡-¬®-ɏ]{1,200}")
# Fixed value: the pieces into which the tokenizer file splits normalised text.
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = b"\xff"  # no UTF-8 text holds this byte
CACHE = 300_000  # recent distinct words that a worker keeps, twice


class WordBpe:
    """A tokenizer file whose pieces never cross white space, applied word by word.

    Words repeat, so each distinct word is encoded once and its ids kept as bytes. Words of plain
    characters go through the file's merges directly; all others, and words that might hold a special
    token, through the library."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        back, mark, ranks = byte_of_char(), spec["model"]["end_of_word_suffix"], {}
        for token, i in spec["model"]["vocab"].items():
            stem = token.removesuffix(mark)
            ranks[bytes(back[c] for c in stem) + WORD_END * (stem != token)] = i
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def word(self, raw: bytes) -> bytes:
        """The ids of one word as little-endian 32-bit numbers."""
        text = raw.decode()
        if PLAIN_WORD.fullmatch(text) and "<|" not in text:
            pieces = WORD_PIECES.findall(unicodedata.normalize("NFC", text).lower())
            ids = [i for p in pieces for i in self.core._encode_single_piece(p.encode() + WORD_END)]
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def missing(self, raw: bytes) -> bytes:
        """Ids of a word that is not among the recent ones. Two generations keep the cache bounded."""
        got = self.old.get(raw)
        if got is None:
            got = self.word(raw)
        if len(raw) <= 64:
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[raw] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        get, missing = self.young.get, self.missing
        out = []
        for w in text.encode().split():  # ASCII white space
            got = get(w)
            if got is None:
                got = missing(w)
                get = self.young.get
            out.append(got)
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path: str, cache: int = CACHE) -> WordBpe:
    """The tokenizer, once per worker."""
    return WordBpe(path, cache)


def token_pieces(docs: DataFrame, path: str, size: int, with_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """Every document's ids, END_ID included, cut into pieces of at most ``size``: id, start, length,
    CRC-32 of the ids and the document's number of ids (and the ids themselves if ``with_ids``)."""
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path, cache)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"].array, batch["text"]):
                ids = model.encode(text) + np.array([END_ID], "<u4").tobytes()
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start:4 * (start + size)]
                    rows.append((i, start, len(part) // 4, zlib.crc32(part), total,
                                 *[np.frombuffer(part, "<u4").astype(np.int32)] * with_ids))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .mapInPandas(pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
                         + ", ids array<int>" * with_ids))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns as (count, lengths) for a histogram of lengths.

    Lengths are placed longest first. Each piece goes to the pattern with the most room, also if that
    already holds pieces of its length; what finds no room opens patterns that are filled with as many
    pieces of the length as fit, and one for the remainder."""
    open_patterns: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], size
        while left and room >= length:
            if not open_patterns.get(room):
                room -= 1
                continue
            count, held = open_patterns[room].pop()
            used = min(count, left)
            left -= used
            if count > used:
                open_patterns[room].append((count - used, held))
            same = held[-1][1] if held[-1][0] == length else 0
            # less room now: met again further down, as long as it has room
            open_patterns[room - length].append((used, (*(held[:-1] if same else held), (length, same + 1))))
        full, rest = divmod(left, size // length)
        for count, copies in ((full, size // length), (1, rest)):
            if count and copies:
                open_patterns[size - length * copies].append((count, ((length, copies),)))
    return [(count, tuple(length for length, copies in held for _ in range(copies)))
            for room in sorted(open_patterns) for count, held in open_patterns[room]]


def pack(docs: DataFrame, path: str, size: int = 2048, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text has the single id END_ID. Repeated rows are packed as often as they occur;
    rows with a null id are packed too; an empty table gives an empty result; other columns are
    ignored. Sequences hold at most ``size`` ids, gapless from offset 0."""
    pieces = stored(token_pieces(docs, path, size, with_ids, id_col, text_col, cache), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= size rows
    patterns = shortest_pack_first(histogram, size)
    # runs of ranks: of its length, ranks from lo on lie in the sequences from seq on, from offset on,
    # as many next to each other as there are copies
    runs, sequence, used = [], 0, defaultdict(int)
    for count, lengths in patterns:
        offset = 0
        for length, same in groupby(lengths):
            copies = len(list(same))
            runs.append((length, used[length], sequence, offset, copies))
            used[length] += count * copies
            offset += length * copies
        sequence += count
    runs.sort()
    runs = np.array(runs, np.int64).reshape(-1, 5)
    ranks = ranked(pieces, ["length"], ["id", "start", "ids_crc32"], "rank")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            at = np.zeros(len(b), np.int64)
            for n in np.unique(length):
                lo, hi = np.searchsorted(runs[:, 0], [n, n + 1])
                mine = length == n
                at[mine] = lo + np.searchsorted(runs[lo:hi, 1], rank[mine], side="right") - 1
            nth, copies = rank - runs[at, 1], runs[at, 4]
            b["sequence_id"] = runs[at, 2] + nth // copies
            b["offset"] = runs[at, 3] + nth % copies * length
            yield b.drop(columns="rank")

    columns = [*pieces.columns, "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return (ranks.select(*columns).mapInPandas(placed, f"{schema}, sequence_id long, offset long")
            .withColumnRenamed("id", id_col))
