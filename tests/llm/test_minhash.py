import random

import numpy as np

import brute
from marquee.llm import minhash
from marquee.llm.hashing import Shingles, mix

SCHEMA = "doc_id long, text string"


def texts(seed=1, n=40):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(random.randint(30, 200))] for _ in range(n)]
    out = [None, "", " \n", "one two", "one  two", "a b c d e"]
    for body in base:
        out.append(" ".join(body))
        for _ in range(random.randint(0, 3)):
            copy = list(body)
            for _ in range(random.randint(0, 2)):
                copy[random.randrange(len(copy))] = word()
            out.append(random.choice([" ", "\n"]).join(copy))
    hot = [word() for _ in range(150)]
    for k in range(60):
        copy = list(hot)
        copy[k % 150] = word()
        out.append(" ".join(copy))
    return out + [" ".join(hot)] * 30


def classes(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(4)
    return minhash.near_duplicates(df).collect()


def test_classes_equal_brute_force(spark):
    rows = texts()
    got = {r["doc_id"]: r for r in classes(spark, rows)}
    want = brute.near_classes(rows, minhash.SMOOTHING)
    sizes = {c: want.count(c) for c in want}
    assert [got[i]["class_id"] for i in range(len(rows))] == want
    assert all(got[i]["class_size"] == sizes[c] and got[i]["kept"] == (i == c) for i, c in enumerate(want))


def test_one_row_of_each_class_stays_with_its_columns(spark):
    rows = texts(2, 10)
    df = spark.createDataFrame([(i, t, f"s{i}", i) for i, t in enumerate(rows)], SCHEMA + ", key string, node long")
    got = minhash.deduplicate(df.union(df)).collect()
    want = sorted(set(brute.near_classes(rows, minhash.SMOOTHING)))
    assert sorted(r["doc_id"] for r in got) == want
    assert all(r["key"] == f"s{r['doc_id']}" and r["text"] == rows[r["doc_id"]] for r in got)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "q")], SCHEMA)
    got = {(r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True)}
    assert minhash.deduplicate(df).count() == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).collect() == [] and minhash.deduplicate(empty).collect() == []


def test_frequencies_cover_all_documents(spark):
    rows = ["a b c d e f"] * 7 + ["x y z", None]
    cells, n = minhash.document_frequencies(spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(3))
    assert n == 9 and sorted(cells[cells > 0].tolist()) == [1, 7, 7]


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    value = mix(np.arange(1, 301, dtype=np.uint64))
    agree, rounds = 0, 60
    for k in range(rounds):
        names = mix(value + np.uint64(1000 * k))
        a, b = rng.uniform(0.5, 2, 300), rng.uniform(0.5, 2, 300)
        sampler = minhash.Sampler()
        x = sampler.bands(names, a, np.array([300]))
        y = sampler.bands(names, b, np.array([300]))
        agree += (x == y).sum()
    expected = 0.0
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        a, b = rng.uniform(0.5, 2, 300), rng.uniform(0.5, 2, 300)
        expected += (np.minimum(a, b).sum() / np.maximum(a, b).sum()) ** minhash.ROWS * minhash.BANDS
    assert abs(agree / expected - 1) < 0.2


def test_shingles_of_long_texts_do_not_depend_on_windows(monkeypatch):
    from marquee.llm import hashing

    rng = random.Random(1)
    text = " ".join("w" * rng.randint(1, 30) + str(rng.randint(0, 99)) for _ in range(3000)).encode()
    whole = Shingles().of([text, b"tail of it all here"])
    monkeypatch.setattr(hashing, "CHUNK_BYTES", 100)
    parts = Shingles().of([text, b"tail of it all here"])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert len(whole[0]) == len(brute.shingles(text.decode())) + 1
