import random

import numpy as np
import pytest

import brute
from marquee.llm import queries, runs

SCHEMA = "doc_id long, text string, runs int, n_words string"
NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def sequences(seed):
    random.seed(seed)
    for _ in range(150):
        n, kinds = random.randint(0, 70), random.randint(1, 4)
        w = [random.randint(1, kinds) for _ in range(n)]
        if random.random() < 0.5:
            w = (w[: random.randint(1, 9)] * 80)[:n]
            for _ in range(random.randint(0, 2)):
                if w:
                    w[random.randrange(len(w))] = random.randint(1, kinds)
        yield w


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_of_short_alphabets(least):
    for w in sequences(least):
        assert [tuple(r) for r in runs.runs_of(np.array(w, np.int64), least).tolist()] == brute.runs(w, least)


def test_known_words():
    # Fibonacci words have very many runs; a single symbol has one.
    a, b = [1], [1, 2]
    while len(b) < 300:
        a, b = b, b + a
    assert [tuple(r) for r in runs.runs_of(np.array(b), 2).tolist()] == brute.runs(b, 2)
    assert runs.runs_of(np.full(500, 3)).tolist() == [[0, 500, 1]]


def test_common_extensions_by_the_tree():
    for w in sequences(5):
        if len(w) > 1:
            tree = runs.SuffixTree(w)
            assert tree.prepare().tolist() == sorted(range(len(w) + 1), key=lambda i: w[i:])
            i, j = (np.array(x) for x in zip(*random.sample([(a, b) for a in range(len(w)) for b in range(a)], 1), strict=True))
            k = 0
            while i[0] + k < len(w) and w[i[0] + k] == w[j[0] + k]:
                k += 1
            assert tree.common(i, j)[0] == k


def test_least_values_of_all_ranges():
    values = np.random.default_rng(1).integers(0, 99, 150).astype(np.int32)
    low, high = np.triu_indices(len(values))
    want = [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]
    assert runs._Minima(values).between(low, high).tolist() == want


def test_stretches_hold_every_run():
    for w in sequences(8):
        codes = np.array(w + [9] + w, np.int64)
        owner = np.repeat([0, 1], [len(w), len(w) + 1])
        parts = runs.stretches(codes, owner, 4)
        for a, n, _ in brute.runs(w, 4):
            assert any(x <= a and a + n <= y for x, y in parts) and any(x <= a + len(w) + 1 and a + len(w) + 1 + n <= y for x, y in parts)
        assert all(owner[x] == owner[y - 1] for x, y in parts)


def texts(seed):
    random.seed(seed)
    out = []
    for w in sequences(seed):
        gap = random.choice([" ", "\n", " \t", "\x0b"])
        out.append(gap.join(f"w{x}é" for x in w) + random.choice(["", " ", " one two"]))
    return out


def test_report_equals_brute_force(spark, monkeypatch):
    """Through the registered query, with its periodic texts."""
    prose = " ".join(f"p{i % 997}" for i in range(3000))
    line = "all rights reserved by the very same owner of this long page\n"
    rows = list(enumerate(texts(3))) + [(None, line * 4), (900, None), (901, ""), (902, prose), (902, prose), (903, "x" * 30_000)]
    rows += [(1000 + i, f"{prose} {i}") for i in range(30)] + [(2000, " ".join(f"q{i}" for i in range(5)) + " z" * 4000)]
    df = spark.createDataFrame([(d, t, 1, "own") for d, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = queries.op12_periodic_runs(spark, "").collect()
    mine = sorted((tuple(r[n] for n in NAMES) for r in got), key=repr)
    assert mine == sorted((brute.run_report(d, t) for d, t in rows), key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > 50


def test_small_batches_give_the_same(spark, monkeypatch):
    rows = list(enumerate(texts(4)))
    df = spark.createDataFrame([(d, t, 1, "own") for d, t in rows], SCHEMA)
    want = sorted(map(repr, runs.find_runs(df).collect()))
    monkeypatch.setattr(runs, "_BATCH_BYTES", 1)
    assert sorted(map(repr, runs.find_runs(df).collect())) == want
    assert runs.find_runs(df.limit(0)).collect() == []
