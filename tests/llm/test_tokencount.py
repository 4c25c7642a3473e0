import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer, models

from marquee.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))


def texts():
    random.seed(3)
    out = [None, "", " ", "   ", "a", " lead", "trail ", "x" * 2000, "▁a▁", "😀😀 ﬁ\x00"]
    letters = "abtheinorwh  \n\té😀▁fi語"
    return out + ["".join(random.choice(letters) for _ in range(random.randint(0, 200))) for _ in range(300)]


def test_counts_equal_the_library(spark):
    rows, tokenizer = texts(), library()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(df, PATH).collect()}
    for i, text in enumerate(rows):
        text = text or ""
        n = len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids) if text else 0
        assert got[i] == (len(text.encode()), n), text


def test_of_equal_scores_the_longest_last_piece_wins():
    pieces = [("▁", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abb", -3.0), ("bb", -2.0)]
    counter = tokencount.Counter(pieces, -3.0)
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0))
    for word in ("ab", "abb", "abbb", "babab", "aabb"):
        assert counter.search("▁" + word) == len(tokenizer.encode("▁" + word).ids)


def test_pieces_across_words_are_searched_whole():
    counter = tokencount.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("a▁b", -1.5)], -1.5)
    assert not counter.apart and counter.tokens("a b") == 2


def test_empty_table_and_extra_columns(spark):
    schema = "doc_id long, text string"
    assert tokencount.count_tokens(spark.createDataFrame([], schema), PATH).collect() == []
    df = spark.createDataFrame([(1, "hi", 9)], schema + ", n_tokens int")
    assert tokencount.count_tokens(df, PATH).first()["n_bytes"] == 2
