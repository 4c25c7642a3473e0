"""Token counts of a unigram tokenizer without the tokens: a count-only Viterbi search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Added to the least score of the vocabulary for a character that no piece has.
PENALTY = 10.0
#: Words a task remembers; others are searched anew each time.
REMEMBERED = 500_000


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], float]:
    """Pieces that texts can match, with their scores, and the least score of the whole vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = range(model.vocab_size())
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = [(model.id_to_piece(n), model.get_score(n)) for n in numbers if not any(is_so(n) for is_so in special)]
    return pieces, min(model.get_score(n) for n in numbers)


class Counter(dict):
    """The number of pieces on the best path through a word that follows one space.

    For each end position the pieces that end there come from an Aho-Corasick automaton, longest first; a path replaces
    another only if its score is higher, so that of equal scores the one with the longest last piece stays, as in
    the tokenizer. A character that is no piece itself may stand alone at the least score of the vocabulary less a
    penalty, and counts as many pieces as it has bytes. Scores are doubles, and sums of whole numbers are exact.
    """

    def __init__(self, pieces: list[tuple[str, float]], least: float) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = least - PENALTY
        # No piece goes on from a letter to a space: then words can be searched one by one.
        self.apart = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", piece) for piece, _ in pieces)

    def search(self, text: str) -> int:
        none = float("-inf")
        score, count = [none] * (len(text) + 1), [0] * (len(text) + 1)
        score[0] = 0.0
        matches = self.automaton.iter(text)
        last, found = next(matches, (-1, None))
        for end, letter in enumerate(text):
            best, pieces = none, 0
            while last == end:
                length, value = found
                candidate = score[end + 1 - length] + value
                if candidate > best:
                    best, pieces = candidate, count[end + 1 - length] + 1
                last, found = next(matches, (-1, None))
            if letter not in self.single:
                candidate = score[end] + self.unknown
                if candidate > best:
                    best, pieces = candidate, count[end] + len(letter.encode())
            score[end + 1], count[end + 1] = best, pieces
        return count[-1]

    def __missing__(self, word: str) -> int:
        n = self.search(SPACE + word)
        if len(self) < REMEMBERED:
            self[word] = n
        return n

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        if not self.apart:
            return self.search(SPACE + text.replace(" ", SPACE))
        words = text.split(" ")
        if "" in words or SPACE in text:
            whole = SPACE + text.replace(" ", SPACE)
            words = [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", whole)]
        return sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text, by the pieces and scores of the file ``vocabulary``.

    A text that is not empty gets one space before it, and spaces become the piece character for spaces; there is
    no other normalisation. Null and empty texts have no tokens. Other columns are ignored; each row counts by itself, and
    an empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*known.value)
        for batch in batches:
            found = [counter.tokens(text.as_py() or "") for text in batch.column("text")]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
