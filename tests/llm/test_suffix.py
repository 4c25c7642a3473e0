import random

import pytest
from pyspark.sql import functions as F

import brute
from marquee.llm import suffix

SCHEMA = "doc_id long, text string"


def texts(seed):
    random.seed(seed)
    base = [bytes(random.choice(b"abcdefgh \n") for _ in range(random.randint(0, 2500))) for _ in range(18)]
    out = []
    for body in base:
        out.append(body)
        for _ in range(random.randint(0, 2)):
            copy = bytearray(body)
            for _ in range(random.randint(0, 3)):
                if copy:
                    copy[random.randrange(len(copy))] = random.choice(b"XYZ")
            other = random.choice(base)
            at = random.randint(0, len(other))
            out.append(bytes(copy) + other[at : at + random.randint(300, 700)])
    out += [b"ab" * 700, b"", b"z" * 399, b"q" * 400, b"q" * 401, ("é" * 300).encode(), ("xé" * 300).encode()]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t.decode()) for i, t in enumerate(rows)], SCHEMA).repartition(4)


@pytest.mark.parametrize(("max_group", "chunk"), [(16384, 1 << 18), (2, 1 << 18), (16384, 300)])
def test_report_equals_brute_force(spark, monkeypatch, max_group, chunk):
    monkeypatch.setattr(suffix, "_CHUNK", chunk)
    rows = texts(max_group + chunk)
    got = suffix.repeat_report(frame(spark, rows), max_group=max_group).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == brute.repeats(rows)


def test_null_and_repeated_rows(spark):
    body = "".join(random.Random(1).choice("abcdefghij ") for _ in range(500))
    df = spark.createDataFrame([(1, None), (2, body), (2, body), (None, body), (3, body[:450] + "!")], SCHEMA)
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.repeat_report(df).collect()}
    assert got == {(1, 0, 0, 0), (2, 500, 500, 1), (None, 500, 500, 1), (3, 451, 450, 1)}


def test_cut_texts(spark):
    rows = texts(7)
    df = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit("own"))
    got = {r["doc_id"]: r for r in suffix.remove_repeats(df).collect()}
    assert len(got) == len(rows)
    for i, (t, gone) in enumerate(zip(rows, brute.covered(rows, 400), strict=True)):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode(errors="ignore")
        assert (got[i]["text"], got[i]["n_chars"], got[i]["key"]) == (kept, len(kept), "own")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix.repeat_report(empty).collect() == [] and suffix.remove_repeats(empty).collect() == []


def test_columns_sort_as_whole_suffixes_do():
    random.seed(9)
    pieces, left = [], []
    for _ in range(60):
        a, b = random.randint(0, 12), random.randint(4, 20)
        pieces.append(bytes(random.choice(b"ab") for _ in range(a)) + b"ANCHOR" + bytes(random.choice(b"ab") for _ in range(b)))
        left.append(a)
    import numpy as np

    got = suffix.repeated_windows(pieces, np.array(left), 14)
    for i, p in enumerate(pieces):
        want = set()
        for s in range(len(p) - 13):
            at = s - left[i]
            for j, q in enumerate(pieces):
                t = at + left[j]
                if i != j and t >= 0 and len(q) - t >= 14 and q[t : t + 14] == p[s : s + 14]:
                    want.update(range(at, at + 14))
        assert {x for a, b in got[i] for x in range(a, b)} == want


def test_query_returns_the_text_that_is_left(spark, tmp_path):
    from marquee.llm import queries

    rows = texts(3)
    frame(spark, rows).unionByName(spark.createDataFrame([(1000, None)], SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 1 and got[1000]["text"] is None and got[1000]["n_bytes"] == 0
    for i, (t, gone) in enumerate(zip(rows, brute.covered(rows, 400), strict=True)):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        assert (got[i]["text"], got[i]["n_kept"]) == (kept.decode(errors="ignore"), len(kept))
