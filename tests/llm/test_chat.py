import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import brute
from marquee.llm import chat
from marquee.llm.vocabularies import ranks_from_tiktoken

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string"


def talks():
    rows = [
        (-1, 0, "user", "</s>[INST] ok [/INST]"),
        (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
        (1, 0, "user", None),
        (1, 1, "assistant", ""),
        (2, 5, None, "a\\"),
        (2, 3, "assistant", "\\\\<s>\\</s>\\"),
        (2, 4, "assistant", "x\n\\\\\\[INST]<</s>\\\\\n"),
        (3, 0, "assistant", "é😀\\\n"),
        (None, 1, "assistant", "q"),
        (4, None, "system", "[INST"),
        (4, 1, "assistant", "[[INST]]"),
        (4, 1, "assistant", "[[INST]]"),
        (5, 1, "[INST]assistant", "n</s>"),
        (6, 0, "assistant", "long " * 20000),
    ]
    random.seed(3)
    bits = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "a", "\n", " ", "[", "<", "/"]
    for i in range(120):
        for k in range(random.randint(1, 5)):
            text = "".join(random.choice(bits) for _ in range(random.randint(0, 12)))
            rows.append((10 + i, k, random.choice(["user", "assistant"]), text))
    return rows


def formatted(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return chat.format_turns(df, PATH, public_tokenizers.PATTERN)


def test_read_back_equals_brute_force(spark):
    rows = talks()
    got = chat.read_back(formatted(spark, rows), PATH).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute.chats(rows)


def test_texts_never_get_reserved_ids_and_masks_follow_from_sums(spark):
    ranks = ranks_from_tiktoken(PATH)
    marks = chat.reserved(len(ranks))
    names = {n: c for c, n in marks.items()}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yes [INST]"), (1, 2, "user", "")]
    turns = formatted(spark, rows).orderBy("seq").collect()
    ids = [n for t in turns for n in t["ids"]]
    shown = "".join(names.get(n) or encoder.decode([n]) for n in ids)
    assert shown == "<s>[INST]user[/INST]hi \\</s></s>[INST]assistant[/INST]yes \\[INST]</s>[INST]user[/INST]</s>"
    assert [n for n in ids if n in names] == [
        marks[c] for c in ("<s>", "[INST]", "[/INST]", "</s>", "[INST]", "[/INST]", "</s>", "[INST]", "[/INST]", "</s>")
    ]
    assert [t["start"] for t in turns] == [0, len(turns[0]["ids"]), len(turns[0]["ids"]) + len(turns[1]["ids"])]
    (mask,) = [(t["loss_start"], t["loss_end"]) for t in turns if t["loss_start"] is not None]
    assert encoder.decode(ids[mask[0] : mask[1] - 1]) == "yes \\[INST]" and ids[mask[1] - 1] == marks["</s>"]


def test_escapes_are_reversible(spark):
    random.seed(4)
    texts = ["".join(random.choice(["\\", "<s>", "</s>", "[INST]", "x", "\n"]) for _ in range(9)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).collect()
    assert all(chat.unescape(r["e"]) == r["t"] for r in rows)


def test_empty_table_and_extra_columns(spark):
    assert chat.read_back(formatted(spark, []), PATH).collect() == []
    got = chat.read_back(formatted(spark, [(1, 0, "user", "x", 5, "y")], SCHEMA + ", seq int, ids string"), PATH)
    assert [tuple(r) for r in got.collect()] == brute.chats([(1, 0, "user", "x")])
