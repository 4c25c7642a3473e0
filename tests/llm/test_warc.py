import random

import brute
from marquee.llm import warc


def record(inside):
    return (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77777>\r\nContent-Length: {len(inside)}"
        f"\r\n\r\n{inside}\r\n\r\n"
    )


def pages():
    random.seed(1)
    rows = [
        (1, "http://a/é\r\nX: y", "x" * 150),
        (2, None, "x" * 150),
        (3, "u", None),
        (4, "u", ""),
        (5, "u", "é" * 60),
        (6, "u", "short"),
        (7, "u", "short"),
        (None, "u", "x" * 150),
        (8, "u", "abc\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\ntail"),
        (9, "u", "a\r\n\r\n" + record("one") + record("two")),
        (10, "u", "\r\n\r\nWARC/1."),
        (11, "u", "\r\n\r\nWARC/1.\r\n\r\nWARC/1.0\r\n\r\n"),
        (12, "u", "p" * 9000 + "\r\n\r\n" + record("q" * 9000) + "\r\n\r\nWARC/1.0"),
        (13, "u", "\r\n\r\n\r\n"),
        (14, "u", "\r\r\r\n"),
        (15, "u", record("z" * 99) * 2),
        (16, "u", "z" * 200),
        (16, "u", "z" * 200),
        (17, "u", "z" * 200),
    ]
    return rows + [(100 + i, "h", random.choice(["", "w"]) * random.randint(0, 300) + str(i % 20)) for i in range(60)]


def there_and_back(spark, rows, path, parts=3):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    warc.write(df, path)
    return sorted((tuple(r) for r in warc.read(spark, path).collect()), key=repr)


def test_read_back_equals_brute_force(spark, tmp_path):
    rows = pages()
    assert there_and_back(spark, rows, f"{tmp_path}/a") == brute.archive(rows)


def test_files_split_inside_records(spark, tmp_path):
    rows = pages()
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert there_and_back(spark, rows, f"{tmp_path}/a", 1) == brute.archive(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_broken_chain_ends(spark, tmp_path):
    (tmp_path / "a").mkdir()
    whole = record("a" * 10) + record("b" * 20)
    (tmp_path / "a" / "one.warc").write_bytes((whole + record("c" * 30)[:-20]).encode())
    (tmp_path / "a" / "two.warc").write_bytes(b"no archive\r\n\r\n" + whole.encode())
    got = warc.read(spark, f"{tmp_path}/a").collect()
    assert len(got) == 2 and all(r["page_id"] == 77777 for r in got)


def test_empty_table(spark, tmp_path):
    assert there_and_back(spark, [], f"{tmp_path}/a") == []


def test_extra_columns_are_ignored(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "h", 5, "d")], "page_id long, url string, html string, bytes int, digest string")
    warc.write(df, f"{tmp_path}/a")
    assert [r["page_id"] for r in warc.read(spark, f"{tmp_path}/a").collect()] == [1]
