import hashlib
import random

import public_tokenizers
import tiktoken

from marquee.llm import bpe
from marquee.llm.vocabularies import ranks_from_json, ranks_from_tiktoken

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = ranks_from_tiktoken(PATH)
ENCODER = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    random.seed(6)
    out = [None, "", " ", "\n\n a", "don't  stop\t\x1c\x85\u3000x", "x" * 3000, " " * 500 + "a", "é語😀 १२३", "<|endoftext|>"]
    letters = "abcdefgh \n'st1é語\u00a0"
    return out + ["".join(random.choice(letters) for _ in range(random.randint(0, 300))) for _ in range(100)]


def test_both_files_have_the_same_ranks():
    assert ranks_from_json(public_tokenizers.path("byte_bpe_50k.json")) == RANKS


def test_round_trip_equals_the_library(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(rows):
        ids = ENCODER.encode_ordinary(text or "")
        packed = b"".join(n.to_bytes(4, "little") for n in ids)
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        assert got[i] == (len(ids), hashlib.sha256(packed).hexdigest(), digest)


def test_long_words_merge_alike():
    random.seed(8)
    for _ in range(200):
        word = bytes(random.choice(b"abtheing ") for _ in range(random.randint(49, 200)))
        slow, bpe._LONG = bpe._LONG, 10**9
        try:
            want = bpe.fold(word, RANKS)
        finally:
            bpe._LONG = slow
        assert bpe.fold(word, RANKS) == want


def test_empty_table_and_extra_columns(spark):
    schema = "doc_id long, text string"
    assert bpe.round_trip(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN).collect() == []
    df = spark.createDataFrame([(1, "a", 2, "b")], schema + ", ids int, bytes string")
    assert bpe.round_trip(df, PATH, public_tokenizers.PATTERN).first()["n_tokens"] == 1
