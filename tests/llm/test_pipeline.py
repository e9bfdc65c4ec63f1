"""The pipeline against brute force, stage by stage."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ratecard.llm import secrets, toxicity

from .test_exact_dedup import low
from .test_near_dedup import shingles
from .test_toxicity import corpus


def documents():
    rng = random.Random(6)
    rows = [(i, t, "en", "s%d" % (i % 3), len(t)) for i, t, _ in corpus(400)]
    words = ["v%d" % i for i in range(500)]
    for g in range(20):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            t[rng.randrange(80)] = rng.choice(words)
            rows.append((len(rows), " ".join(t), "en", "s0", 0))
    rows += [(len(rows) + i, "Same text here", "en", None, 14) for i in range(5)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, "no id", "en", "s", 5),
             (2002, "password: hunter22 and AKIA" + "Q" * 16, "en", "s", 0)]
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, t) for i, _, t in corpus(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test")
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = [tuple(r) for r in docs.collect()]
    by = lambda got: sorted(got, key=str)

    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(source, spark.read.parquet(str(tmp_path / "labels.parquet")))
    toxic = {r["doc_id"] for r in toxicity.score(source, model).collect() if r["predicted"]}
    assert len(toxic) > 20
    want = [r for r in rows if r[0] not in toxic]
    assert by(kept["toxicity"]) == by(want)
    last = {}
    for r in want:
        if r[0] is not None:
            last[low(r[1])] = max(r[0], last.get(low(r[1]), -1))
    want = [r for r in want if r[0] is None or last[low(r[1])] == r[0]]
    assert by(kept["exact_dedup"]) == by(want)
    sets = {r[0]: shingles(r[1]) for r in want if r[0] is not None}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    want = [r for r in want if r[0] is None or find(r[0]) == r[0]]
    assert by(kept["near_dedup"]) == by(want)
    blank = lambda t: t if t is None else (
        "[SECRET] and [SECRET]" if "hunter22" in t else t)
    assert not any(secrets.find_spans(r[1]) for r in want if r[0] != 2002)
    want = [(*r[:1], blank(r[1]), *r[2:4], None if r[1] is None else len(blank(r[1]))) for r in want]
    assert by(kept["secrets"]) == by(want)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in want}
    whole = spark.createDataFrame(kept["packing"], docs.schema).toPandas()
    assert whole.groupby("doc_id", dropna=False)["length"].sum().sum() == sum(tokens.values())
    assert whole.groupby("sequence_id")["length"].sum().max() <= corpus_pipeline.SEQUENCE
    final = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert np.array_equal(np.sort(final["ids_crc32"]), np.sort(whole["ids_crc32"]))


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # rows, but no label
    (tmp_path / "some").mkdir()
    spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "A B", None, None, None), (3, None, "en", "s", None)],
                          schema).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "some" / "labels.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()} == {2, 3}
