"""Packing: ids against the tokenizers library, and the layout of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ratecard.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_like_the_library():
    library, model = Tokenizer.from_file(PATH), packing.load(PATH)
    rng = random.Random(5)
    alphabet = "aaeinorst'\"<>|.,!?0123 \t\n éÉßñÜ日本́İǅ🙂"
    texts = ["", " ", "it's THE word's", "<|endoftext|> x<|startoftext|>y", "a" * 500, "q\x0bz\x1cw", "ÿ ÿÿ é"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [t.replace("</w>", "") for t in list(library.get_vocab())[::7]]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(model.encode(t), "<u4").tolist() == want, t


def test_patterns_place_every_piece():
    rng = random.Random(2)
    for size in (1, 7, 64, 2048):
        lengths = [rng.randint(1, size) for _ in range(3000)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        patterns = packing.shortest_pack_first(histogram, size)
        assert all(sum(p) <= size and c > 0 for c, p in patterns)
        got = defaultdict(int)
        for c, p in patterns:
            for n in p:
                got[n] += c
        assert got == histogram
        full = sum(lengths) / (size * sum(c for c, _ in patterns))
        assert full > (0.95 if size > 1 else 0.99), (size, full)
    assert packing.shortest_pack_first({}, 8) == []


def test_sequences(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, None, 5), (2, "", 5), (None, "a b c", 5), (3, "word " * 40, 5), (3, "word " * 40, 5),
            *[(10 + i, "the quick brown fox " * (i % 9), None) for i in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = packing.pack(docs, PATH, size=16, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(by_doc[i, len(ids)], key=lambda r: r["start"])
        copies = sum((a, b) == (i, t) for a, b, _ in rows)
        assert [x for r in mine[::copies] for x in r["ids"]] == ids
        assert [r["start"] for r in mine[::copies]] == list(range(0, len(ids), 16))
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 16
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_a_hot_length_fills_its_patterns():
    assert sum(c for c, _ in packing.shortest_pack_first({100: 1000}, 2048)) == 50
    rng = random.Random(6)
    usual = [min(2048, max(1, int(rng.lognormvariate(5.2, 1)))) for _ in range(4000)]
    for hot in (1, 60, 300):
        lengths = usual + [hot] * 2000
        patterns = packing.shortest_pack_first({n: lengths.count(n) for n in set(lengths)}, 2048)
        assert all(sum(p) <= 2048 for _, p in patterns)
        assert sum(c * p.count(hot) for c, p in patterns) == lengths.count(hot)
        assert sum(c for c, _ in patterns) <= 1.02 * sum(lengths) / 2048 + 1


def test_copies_lie_side_by_side(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(50)] + [(99, "a b c d e")], "doc_id long, text string")
    got = packing.pack(docs, PATH, size=16).collect()
    places = {(r["sequence_id"], r["offset"] + k) for r in got for k in range(r["length"])}
    assert len(places) == sum(r["length"] for r in got) and max(p for _, p in places) < 16
    assert len({s for s, _ in places}) == 11  # five copies of three ids to a sequence, the long text beside three
