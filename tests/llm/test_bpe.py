"""BPE against the tokenizers library: ids, decoding, and joins at every kind of cut."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratecard.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["abc ", "the and of 's 're 'll\n", "a", " ", "  \n\t", "é ü ß ñ x", "日本語 中文 한국 ", "'rvesdl ",
             "!?.,'\"- ", "0123456789 a", "🙂👩‍👩‍👧 x", "a\x00\x1c\x85   b", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts(n, longest, seed=7):
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = "".join(rng.sample(ALPHABETS, rng.randint(1, 3)))
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(t))
            t = t[:at] + "<|endoftext|>" + t[at:]
        yield t


def test_tree_concatenation_is_exact(library):
    model = bpe.load(PATH)
    for t in texts(400, 120):
        want = library.encode(t, add_special_tokens=False).ids
        for leaf in (1, 3, 17):
            assert model.join_all([model.leaf(p) for p in bpe.cut(t, leaf)]).ids.tolist() == want, (t, leaf)
        assert model.encode(t) == want
        assert model.decode(want).decode() == library.decode(want, skip_special_tokens=False)


def test_unsplit_text_of_any_length(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_LEAF", 5)
    model = bpe.ByteBpe(PATH)
    rng = random.Random(3)
    for n in (6, 50, 700):
        for alphabet in ("ab", "etaoinshr", "é", "日本", "!"):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            assert model.piece(t) == library.encode(t, add_special_tokens=False).ids
            assert model.join_all([model.leaf(p) for p in bpe.cut(t, 40)]).ids.tolist() == model.piece(t)


def expected(library, t):
    ids = library.encode(t or "", add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(said.encode()).hexdigest())


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", None), (3, "word " * 50, "y"), (3, "word " * 50, "y"),
            (4, "z" * 300, None), *[(10 + i, t, "q") for i, t in enumerate(texts(20, 200, 11))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaf string")
    got = bpe.encode_documents(docs, PATH, bpe.DIGEST, leaf=32).collect()
    want = sorted((-1 if i is None else i, *expected(library, t)) for i, t, _ in rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert bpe.encode_documents(docs.limit(0), PATH, bpe.DIGEST).count() == 0
    back = bpe.decode_ids(bpe.encode_documents(docs, PATH, leaf=32), PATH).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((i or -1, t or "") for i, t, _ in rows)


def test_a_long_text_that_many_rows_share(spark, library, monkeypatch):
    """Megabytes under one id, many times, and under null ids: encoded once, in leaves."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    assert len(long.encode()) > 2_000_000
    other = long[:70_000] + "x"
    rows = [(7, long)] * 25 + [(None, long)] * 5 + [(7, other), (8, other), (8, "short"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, bpe.encode_documents(docs, PATH, bpe.DIGEST).collect()), key=str)
    known = {t: expected(library, t) for t in {t for _, t in rows}}
    assert got == sorted(((i, *known[t]) for i, t in rows), key=str)
