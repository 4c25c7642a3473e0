"""Periodic runs of words in each text, by suffix trees of the text and of its reversal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run; a run has at least two periods besides.
LEAST = 12

_BLOCK = 16
_BATCH_BYTES = 4 << 20


class SuffixTree:
    """The suffix tree of a sequence of numbers from 1 up, closed by a 0 that stands nowhere else, by Ukkonen's algorithm."""

    def __init__(self, symbols: list[int]) -> None:
        self.text = text = [*symbols, 0]
        self.n = n = len(text)
        self.start, self.end = [-1, -1], [-1, -1]  # node 0 is unused, node 1 the root; an open end is n
        link: list[int] = [1, 1]
        self.edges: dict[int, int] = {}
        self.width = width = max(text) + 1
        start, end, edges = self.start, self.end, self.edges
        node, edge, length, remaining = 1, 0, 0, 0
        for at, symbol in enumerate(text):
            remaining += 1
            last = 0
            while remaining:
                if not length:
                    edge = at
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(at)
                    end.append(n)
                    link.append(1)
                    if last:
                        link[last] = node
                    last = node
                else:
                    span = (end[child] if end[child] <= at else at + 1) - start[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[start[child] + length] == symbol:
                        if last and node != 1:
                            link[last] = node
                        length += 1
                        break
                    split = len(start)
                    start += [start[child], at]
                    end += [start[child] + length, n]
                    link += [1, 1]
                    edges[key] = split
                    edges[split * width + symbol] = split + 1
                    start[child] += length
                    edges[split * width + text[start[child]]] = child
                    if last:
                        link[last] = split
                    last = split
                remaining -= 1
                if node == 1 and length:
                    length -= 1
                    edge = at - remaining + 1
                elif node != 1:
                    node = link[node]

    def tour(self, mirrored: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Euler tour: depth of the node at each visit, the visit of each suffix, and the suffixes as they come.

        Children come in the order of their symbols, or of the reversed symbols; the closing 0 is first in both.
        """
        keys = np.fromiter(self.edges, np.int64, len(self.edges))
        child = np.fromiter(self.edges.values(), np.int64, len(self.edges))
        parent, symbol = keys // self.width, keys % self.width
        order = np.lexsort(((self.width - symbol) % self.width if mirrored else symbol, parent))
        parent, child = parent[order], child[order].tolist()
        first = np.searchsorted(parent, np.arange(len(self.start) + 1)).tolist()
        start, end, n = self.start, self.end, self.n
        seen, visit, leaves = [0], [0] * n, []
        stack = [[1, first[1], 0]]
        while stack:
            top = stack[-1]
            node, place, depth = top
            if place == first[node + 1]:
                stack.pop()
                if stack:
                    seen.append(stack[-1][2])
                continue
            top[1] = place + 1
            below = child[place]
            if first[below] == first[below + 1]:
                suffix = start[below] - depth
                visit[suffix] = len(seen)
                leaves.append(suffix)
                seen += [n - suffix, depth]
            else:
                down = depth + end[below] - start[below]
                seen.append(down)
                stack.append([below, first[below], down])
        return np.array(seen, np.int32), np.array(visit), np.array(leaves)

    def prepare(self) -> np.ndarray:
        """Make :meth:`common` ready; the suffixes in the order of their symbols."""
        depths, self.visit, leaves = self.tour()
        self.depth = _Minima(depths)
        return leaves

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``i`` and ``j`` (not the same) begin with alike: the depth of their lowest common ancestor."""
        a, b = self.visit[i], self.visit[j]
        return self.depth.between(np.minimum(a, b), np.maximum(a, b))


class _Minima:
    """Least values between two places in constant time: minima inside of blocks, and over powers of two of blocks."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        padded = np.full(-(-len(values) // _BLOCK) * _BLOCK, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, _BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while 2 ** len(self.levels) <= len(self.levels[0]):
            half, below = 2 ** (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.onward[low], self.upto[high])
        near = np.flatnonzero(first == last)
        if len(near):
            offsets = np.minimum(low[near, None] + np.arange(_BLOCK), high[near, None])
            out[near] = self.values[offsets].min(axis=1)
        inner = np.flatnonzero(last - first > 1)
        if len(inner):
            a, b = first[inner] + 1, last[inner]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                here = np.flatnonzero(level == k)
                table = self.levels[k]
                least = np.minimum(table[a[here]], table[b[here] - 2**k])
                out[inner[here]] = np.minimum(out[inner[here]], least)
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix the next one of smaller rank (the end of the sequence if there is none before it)."""
    out, stack = np.empty(len(rank), np.int64), []
    for i in range(len(rank) - 1, -1, -1):
        while stack and rank[stack[-1]] > rank[i]:
            stack.pop()
        out[i] = stack[-1] if stack else len(rank)
        stack.append(i)
    return out


def runs_of(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of numbers from 1 up, sorted by start, then period.

    The longest Lyndon word from each place, in the order of symbols and in the reversed one, ends at the next smaller
    suffix. One of these words is a root of each run, so each gives one candidate: its length is the period, and common
    extensions to the right (suffix tree of the sequence) and to the left (of the reversed one) give the run's ends.
    """
    n = len(symbols)
    if n < least:
        return np.empty((0, 3), np.int64)
    listed = symbols.tolist()
    forward, backward = SuffixTree(listed), SuffixTree(listed[::-1])
    sorted_suffixes = forward.prepare()
    backward.prepare()
    found = []
    for leaves in (sorted_suffixes, forward.tour(mirrored=True)[2]):
        rank = np.empty(n + 1, np.int64)
        rank[leaves] = np.arange(n + 1)
        begin = np.arange(n)
        after = _next_smaller(rank[:n].tolist())
        right = np.zeros(n, np.int64)
        inside = np.flatnonzero(after < n)
        right[inside] = forward.common(begin[inside], after[inside])
        left = np.zeros(n, np.int64)
        back = np.flatnonzero(begin > 0)
        left[back] = backward.common(n - begin[back], n - after[back])
        found.append(np.stack([begin - left, after + right - begin + left, after - begin], axis=1))
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= np.maximum(least, 2 * rows[:, 2])]
    return np.unique(rows[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(codes: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The parts [a, b) of texts in which runs can lie: every symbol of a part stands in it at least twice.

    ``codes`` are the words of some texts one after the other, ``owner`` the text of each. Each word of a run has an equal one a period away in the run, and a
    run can't be extended over a word without an equal one; so a word that is single in its part ends all runs, and parts are split there until
    none is left.
    """
    place = np.arange(len(codes))
    part = owner.astype(np.int64)
    while len(place):
        key = part * (int(codes.max()) + 1) + codes[place]
        _, which, often = np.unique(key, return_inverse=True, return_counts=True)
        single = often[which] == 1
        keep = np.flatnonzero(~single)
        new = np.ones(len(keep), bool)
        new[1:] = (np.diff(place[keep]) != 1) | (np.diff(part[keep]) != 0)
        label = np.cumsum(new) - 1
        large = np.bincount(label)[label] >= least
        done = not single.any() and large.all()
        place, part = place[keep][large], label[large]
        if done:
            break
    if not len(place):
        return []
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(edges[1:], len(place))
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(edges, ends, strict=True)]


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, runs, collapsed``.

    ``runs`` are (start, length, period) of every longest stretch of consecutive words that repeats with that smallest period, of at
    least ``least`` words and two periods, by start, then period; words are runs without ASCII white space, counted from 0.
    ``collapsed`` is the text's words joined by one space, without those that a run has after its first period.

    Null and empty texts have no words and no runs. Each row is judged alone, so repeated rows have equal results; other columns
    are ignored; an empty table gives an empty result. A task holds one text and its trees at a time: trees are made only
    for the stretches whose words all occur twice (:func:`stretches`), which leaves out most of ordinary prose.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts])
            flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
            codes = flat.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), sizes)
            begin = np.cumsum(sizes) - sizes
            found: dict[int, list] = {}
            for a, b in stretches(codes, owner, least):
                _, symbols = np.unique(codes[a:b], return_inverse=True)
                rows = runs_of(symbols + 1, least)
                if len(rows):
                    rows[:, 0] += a - begin[owner[a]]
                    found.setdefault(int(owner[a]), []).append(rows)
            runs, collapsed = [], []
            for i, words in enumerate(texts):
                rows = np.concatenate(found[i]) if i in found else np.empty((0, 3), np.int64)
                rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in rows.tolist()])
                if len(rows):
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
                    np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                collapsed.append(b" ".join(words).decode())
            columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(runs, kind), pa.array(collapsed, pa.string())]
            return pa.record_batch(columns, names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                body = text.as_py() or b""
                ids.append(doc_id.as_py())
                texts.append(body.split())
                size += len(body)
                if size >= _BATCH_BYTES:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield flush(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        find,
        "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    )


def run_report(found: DataFrame) -> DataFrame:
    """Counts and digests of the rows of :func:`find_runs`, with each text's longest run (ties: smallest start, then period)."""
    longest = F.array_max(F.transform(
        "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    ))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = found.select("doc_id", "runs", "collapsed", longest.alias("best"), F.array_join(F.transform("runs", line), "").alias("lines"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
