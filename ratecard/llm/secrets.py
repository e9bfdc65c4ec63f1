"""Secret scan: an Aho-Corasick pass finds keywords, anchored regular expressions are tried only at
the hits, and tokens that embed a checksum count only if it is right.

Kinds ``assign``, ``access`` and ``hex`` are plain patterns. ``github`` and ``npm`` tokens end in six
base-62 digits that hold the CRC-32 of the thirty characters before them. A hexadecimal run has no
keyword of its own; its runs are found by their character class alone.

The scan works on UTF-8 bytes (all patterns are ASCII, so case folding touches A-Z only) and reports
code-point offsets, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns' keywords, the patterns, and the order of kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
CHECKED_WORDS = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github",
                 "ghr_": "github", "npm_": "npm"}
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    rb"([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

_automaton: ahocorasick.Automaton | None = None


def _keywords() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for kind, words in (("assign", ASSIGN_WORDS), ("access", (ACCESS_WORD,))):
            for w in words:
                _automaton.add_word(w, (kind, len(w)))
        for w, kind in CHECKED_WORDS.items():
            _automaton.add_word(w, (kind, len(w)))
        _automaton.make_automaton()
    return _automaton


def checksum62(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of ``body``."""
    n, digits = zlib.crc32(body), bytearray()
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return bytes(digits[::-1])


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All secrets of one whole text as (kind, start, end), by start, then by kind as listed."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found, resume = [], dict.fromkeys(KINDS, 0)
    # no keyword contains another, so hits ordered by their ends are also ordered by their starts
    for end, (kind, n) in _keywords().iter(raw.lower().decode("latin-1")):
        start = end + 1 - n
        if start < resume[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(raw, start)
            good = m and len(m[2]) >= 6
        elif kind == "access":
            m = ACCESS.match(raw, start)
            good = m and len(m[0]) >= 20
        else:
            m = CHECKED.match(raw, start)
            good = m and checksum62(m[1]) == m[2]
        if m:
            resume[kind] = m.end()  # a failing match still uses up its text
        if good:
            found.append((kind, m.start(), m.end()))
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(raw)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    if len(raw) != len(text or ""):
        points, at, seen = {}, 0, 0
        for p in sorted({p for s in found for p in s[1:]}):
            seen += len(raw[at:p].decode("utf-8", "surrogatepass"))
            at = p
            points[p] = seen
        found = [(k, points[a], points[b]) for k, a, b in found]
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``found``, an array of (kind, start, end).

    Null and empty texts have no secrets. Rows are independent, so nulls in other columns, repeated
    rows and extra columns change nothing; an empty table gives an empty result."""
    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)])

    return docs.select(F.col(id_col), spans(F.coalesce(F.col(text_col), F.lit(""))).alias("found"))


def scan_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, the digest of the base spans and all spans per document, in one pass over the texts."""
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = find_spans(text)
            said = [f"{k}:{a}:{b}" for k, a, b in found]
            base = ",".join(s for s, f in zip(said, found) if f[0] in BASE_KINDS)
            rows.append((*(sum(f[0] == k for f in found) for k in BASE_KINDS),
                         hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return (docs.select(F.col(id_col), digest(F.coalesce(F.col(text_col), F.lit(""))).alias("d"))
            .select(id_col, "d.*"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark`` (overlapping spans by one mark).
    Null stays null; clean texts are unchanged."""
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            parts, at = [], 0
            for _, a, b in find_spans(t):
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            return "".join(parts) + t[at:] if parts else t
        return texts.map(one)

    return docs.withColumn(text_col, cleaned(F.col(text_col)))
