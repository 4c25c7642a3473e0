import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marquee.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def bins(counts, capacity):
    slots, n = packing.plan_sequences(counts, capacity)
    out = {}
    for s in slots:
        for k in range(s.count):
            out.setdefault(s.sequence + k, []).append((s.offset, s.length))
    assert sorted(out) == list(range(n))
    placed = Counter(length for b in out.values() for _, length in b)
    assert placed == Counter({k: v for k, v in counts.items() if v})
    for b in out.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return out


def best(items, capacity):
    """The least number of bins, by trying all sets for the largest item."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    return 1 + min(
        best([x for i, x in enumerate(rest) if i not in chosen], capacity)
        for k in range(len(rest) + 1)
        for chosen in combinations(range(len(rest)), k)
        if first + sum(rest[i] for i in chosen) <= capacity
    )


@pytest.mark.parametrize("seed", range(60))
def test_plans_are_whole_and_tight(seed):
    random.seed(seed)
    capacity = random.choice([10, 20, 64, 100])
    counts = Counter(random.randint(1, capacity) for _ in range(random.randint(0, 200)))
    n = len(bins(counts, capacity))
    assert n <= 1.25 * -(-sum(k * v for k, v in counts.items()) // capacity) + 2


@pytest.mark.parametrize("seed", range(60))
def test_fixed_sets_never_cost_a_sequence(seed):
    random.seed(seed)
    capacity = random.choice([10, 13, 20])
    items = sorted((random.randint(2, capacity) for _ in range(random.randint(1, 8))), reverse=True)
    plan = packing._Plan(Counter(items), capacity)
    packing.reduce_by_dominance(plan)
    left = [w for w in range(capacity, 0, -1) for _ in range(plan.left[w])]
    assert plan.sequences + best(left, capacity) == best(items, capacity)


def test_the_work_does_not_grow_with_the_counts():
    few = packing.plan_sequences({k: 3 for k in range(1, 2049)})[0]
    many = packing.plan_sequences({k: 3_000_000_000 for k in range(1, 2049)})[0]
    assert len(many) < 4 * len(few)


def texts():
    random.seed(2)
    words = "the quick brown fox's jumps over 12 lazy dogs \n é語".split(" ")
    out = [None, "", "a"] + [" ".join(random.choice(words) for _ in range(random.randint(0, 900))) for _ in range(40)]
    out += ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|>b", "b\n<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endof text|>", "x<|endoftext|"]
    return out + [" ".join(random.choice(words) for _ in range(9000))]


def test_pieces_equal_the_library_and_fill_sequences(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(3)
    got = packing.pack(df, PATH, public_tokenizers.PATTERN).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(by_doc[i]):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(30)], SCHEMA)
    pieces = packing.token_pieces(df, PATH, public_tokenizers.PATTERN)
    places = packing.place(pieces)
    packed = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces, places).collect()}
    where = {r["uid"]: r for r in places.collect()}
    for r in pieces.collect():
        p = where[r["uid"]]
        assert packed[p["sequence_id"]][4 * p["offset"] : 4 * (p["offset"] + p["length"])] == r["ids"]


def test_repeated_rows_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(7, "x", 1, 2)] * 3 + [(None, None, 1, 2)], SCHEMA + ", uid int, length int")
    got = packing.pack(df, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(r["length"] for r in got) == [1, 2, 2, 2]
    assert {r["sequence_id"] for r in got} == {0} and len({r["offset"] for r in got}) == 4
    assert packing.pack(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
