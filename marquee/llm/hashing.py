"""Word and shingle hashes of many texts at once, on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words (runs of bytes other than ASCII white space) of concatenated texts."""

    def __init__(self) -> None:
        self.gap = np.zeros(256, bool)
        self.gap[[9, 10, 11, 12, 13, 32]] = True
        self._grow(CHUNK_BYTES + 1)

    def _grow(self, n: int) -> None:
        self.power = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        self.undo = np.multiply.accumulate(np.full(n, _INVERSE, np.uint64))

    def _window(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(part) > len(self.power):
            self._grow(len(part))
        inside = np.concatenate(([0], ~self.gap[part], [0])).astype(np.int8)
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.power[: len(part)], out=total[1:])
        value = (total[end] - total[start]) * self.undo[start]
        return start, mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the number of words of each text; byte windows bound the memory."""
        data = np.frombuffer(b" ".join(texts), np.uint8)
        starts, hashes, at = [], [], 0
        while at < len(data):
            to = min(at + CHUNK_BYTES, len(data))
            while to < len(data):
                cut = np.flatnonzero(self.gap[data[at:to]])
                if len(cut):
                    to = at + int(cut[-1]) + 1
                    break
                to = min(to + CHUNK_BYTES, len(data))
            start, value = self._window(data[at:to])
            starts.append(start + at)
            hashes.append(value)
            at = to
        edges = np.cumsum([len(t) + 1 for t in texts])
        if not starts:
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        first = np.searchsorted(np.concatenate(starts), edges)
        return np.concatenate(hashes), np.diff(first, prepend=0)


class Shingles:
    """The distinct five-word shingles of texts, with how often each occurs in its text.

    A text of one to four words has one shingle of all its words; one without words has none.
    """

    def __init__(self) -> None:
        self.words = Words()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, counts, and the number of distinct shingles of each text, in the order of hashes."""
        word, n_words = self.words.of(texts)
        text_of = np.repeat(np.arange(len(texts)), n_words)
        first = np.cumsum(n_words) - n_words
        factor = np.uint64(0xFF51AFD7ED558CCD)
        n = max(0, len(word) - SHINGLE + 1)
        value = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            value = value * factor + word[k : k + n]
        whole = np.arange(n) + SHINGLE <= (first + n_words)[text_of[:n]]
        hashes, owner = [value[whole]], [text_of[:n][whole]]
        for t in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)):
            short = int(n_words[t])
            for w in word[first[t] : first[t] + n_words[t]]:
                short = (short * int(factor) + int(w)) % (1 << 64)
            hashes.append(np.array([short], np.uint64))
            owner.append(np.array([t]))
        value, text = mix(np.concatenate(hashes)), np.concatenate(owner)
        order = np.lexsort((value, text))
        value, text = value[order], text[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(value)))
        return value[at], counts, np.bincount(text[at], minlength=len(texts))


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as bytes (null: empty), some at a time: (first row, texts)."""
    texts = batch.column(column).cast(pa.binary())
    first, held, size = 0, [], 0
    for row, value in enumerate(texts):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield first, held
            first, held, size = row + 1, [], 0
    if held:
        yield first, held
