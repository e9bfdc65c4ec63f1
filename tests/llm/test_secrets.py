"""Secret scan against plain regular expressions over whole texts."""

import hashlib
import random
import re

from ratecard.llm import secrets

PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                          re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)}


def expected(text):
    found = [(k, m.start(), m.end()) for k, (p, good) in PATTERNS.items() for m in p.finditer(text or "") if good(m)]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def github(body="a" * 30):
    return "ghp_" + body + secrets.checksum62(body.encode()).decode()


def texts(n=600):
    rng = random.Random(9)
    parts = ["password", "PassWd", "secretoken", "token", "api_key", "APIKEY", "=", ": ", " = '", "AKIA", "AKIAAKIA",
             "ABCDEFGH12345678", "deadbeef" * 3, "0123456789abcdef01234567", "é", "日本", " ", "\n", "x", "abc123", "_-./",
             "ſecret=abcdef", "K", github(), "ghp_" + "b" * 36]
    for _ in range(n):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_base_spans():
    for t in [None, "", *texts()]:
        got = [s for s in secrets.find_spans(t) if s[0] in secrets.BASE_KINDS]
        assert got == expected(t), t


def test_checksums():
    good, bad = github("Abc" * 10), "ghp_" + "z" * 30 + "000000"
    assert secrets.find_spans(f"é {good}.") == [("github", 2, 42)]
    assert secrets.find_spans(bad) == [] and secrets.find_spans(good + "x") == []
    assert secrets.find_spans("npm_" + good[4:])[0][0] == "npm"


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "token=abcdefg", None), (3, "é password: hunter22 x", "y"),
            (3, "é password: hunter22 x", "y"), *[(10 + i, t, "z") for i, t in enumerate(texts(40))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = sorted(map(tuple, secrets.scan_digest(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        base = expected(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *(sum(s[0] == k for s in base) for k in secrets.BASE_KINDS),
                     hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.find_spans(t))))
    assert got == sorted(want, key=str)
    assert secrets.scan_digest(docs.limit(0)).count() == 0
    cleaned = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert cleaned[1] is None and cleaned[2] == "" and cleaned[3] == "é [SECRET] x"
