import hashlib
import itertools
import random

import pytest

import brute
from marquee.llm import covers

SCHEMA = "doc_id long, text string, key long, s long, uid string"


def checked(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1, 2, "u") for d, t in rows], SCHEMA).repartition(3)
    got = covers.cut_passages(df, **options).collect()
    for r in got:
        if r["kept_text"] is not None:
            assert r["n_removed"] == sum(x["e"] - x["s"] for x in r["spans"]) > 0
    whole = {hashlib.sha256(" ".join(brute.words(t)).encode()).hexdigest(): " ".join(brute.words(t)) for _, t in rows}
    mine = [(r["doc_id"], r["n_words"], r["n_removed"], whole[r["words_sha256"]] if r["kept_text"] is None else r["kept_text"]) for r in got]
    assert sorted(mine, key=repr) == brute.earlier_passages(rows, options.get("length", covers.LENGTH))
    return {r["doc_id"]: r for r in got}


def passages(seed, n, long, vocabulary=400):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdé") for _ in range(random.randint(1, 6))) if vocabulary > 2 else random.choice("ab")
    base = [[word() for _ in range(random.randint(0, long))] for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(random.randint(0, 3)):
            source = random.choice(base)
            a = random.randint(0, len(source))
            parts += source[a : a + random.randint(1, long)] + [word() for _ in range(random.randint(0, 5))]
        out.append(random.choice([" ", "\n", "\t ", "  "]).join(parts))
    ids = random.sample(range(1000), n)
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("share", [covers.HOT_SHARE, 0.02])
def test_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(covers.join_keyed, "__defaults__", (share,))
    checked(spark, passages(3, 60, 160))


@pytest.mark.parametrize(("length", "period", "cover"), [(8, 7, (0, 1, 3)), (7, 7, (0, 1, 3)), (13, 13, (0, 1, 3, 9)), (4, 1, (0,))])
def test_other_covers_on_few_different_words(spark, length, period, cover):
    checked(spark, passages(length, 40, 30, vocabulary=2), length=length, period=period, cover=cover)


def test_a_cover_must_have_all_differences():
    with pytest.raises(ValueError, match="differences"):
        covers.Cover(50, 31, (0, 1, 3))
    with pytest.raises(ValueError, match="differences"):
        covers.Cover(30, 31)


def test_any_two_windows_share_a_shift_at_cover_positions():
    cover = covers.Cover()
    for i, j in itertools.product(range(200, 231), range(300, 331)):
        both = [d for d in range(31) if (i + d) % 31 in covers.COVER and (j + d) % 31 in covers.COVER]
        assert both and min(both) + cover.gram <= covers.LENGTH


def test_null_empty_short_repeated_and_long(spark):
    body = " ".join(f"w{i}" for i in range(60))
    far = " ".join(f"x{i}" for i in range(90_000))
    rows = [(5, body), (5, body), (3, None), (4, ""), (None, body), (9, f"a {body} b"), (1, f"c {body}\n"), (2, " ".join(body.split()[:49]))]
    rows += [(20, far), (21, f"y {far}"), (22, "same " * 5000), (23, "same " * 70)]
    got = checked(spark, rows)
    assert got[None]["n_removed"] == 0 and got[1]["n_removed"] == 0 and got[9]["n_removed"] == 60
    assert got[21]["n_removed"] == 90_000 and got[23]["n_removed"] == 70


def test_a_passage_in_very_many_documents(spark):
    body = " ".join(f"w{i}" for i in range(70))
    rows = [(i, f"{i} a{i} {body} {i}") for i in range(400)] + [(i, body) for i in range(400, 700)]
    got = checked(spark, rows)
    assert sum(r["n_removed"] > 0 for r in got.values()) == 699


def test_empty_table(spark):
    assert covers.cut_passages(spark.createDataFrame([], SCHEMA)).collect() == []
