import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from marquee.llm import minhash, quality
from marquee.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "packing"]
    good = stages["quality"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    verdict = quality.judge(docs).select("doc_id", "verdict.kept").collect()
    assert set(kept) == {r["doc_id"] for r in verdict if r["kept"]}
    assert not any(brute.quality(t)[-1] for t in kept.values())

    single = stages["near_duplicates"](spark, good, FOLDER)
    assert single.columns == docs.columns
    ids = sorted(kept)
    classes = brute.near_classes([kept[i] for i in ids], minhash.SMOOTHING)
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert left == {ids[c]: kept[ids[c]] for c in set(classes)}

    cut = stages["repeats"](spark, single, FOLDER)
    assert sorted(cut.columns) == sorted(docs.columns)
    ids = sorted(left)
    bodies = [left[i].encode() for i in ids]
    want = {}
    for i, body, gone in zip(ids, bodies, brute.covered(bodies, corpus_pipeline.PASSAGE), strict=True):
        want[i] = bytes(b for b, g in zip(body, gone, strict=True) if not g).decode(errors="ignore")
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want

    packed = stages["packing"](spark, cut, FOLDER).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in ids:
        n = len(tokenizer.encode(want[i], add_special_tokens=False).ids) + 1
        assert sum(r["length"] for r in packed if r["doc_id"] == i) == n
    ends = [r["offset"] + r["length"] for r in packed]
    assert np.max(ends) <= 2048


def test_run_returns_the_last_stage(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count()


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries()) == list(range(1, 14))
