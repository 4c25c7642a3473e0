"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.hashing import Shingles, chunks, mix
from marquee.llm.shared import connected_components, content_key, drop_stage, split_by_key, stage

SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Document frequencies are kept in this many hashed cells, whatever the size of the corpus.
CELLS = 1 << 18
#: Texts of a bucket that one task compares; larger buckets are dealt out as pairs of parts.
TILE = 1024
#: Added to each frequency as a share of all documents: it bounds how far weights differ, and outweighs by far
#: what other shingles add to a cell (a document's shingles / CELLS).
SMOOTHING = 0.25


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have a shingle in each hashed cell, and how many documents there are.

    A cell's count bounds from above the frequency of each shingle in it. Every task sums its
    own documents first; the driver gets one number for each cell.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, cells, rows = Shingles(), np.zeros(CELLS + 1, np.int64), 0
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                value, _, each = shingles.of(texts)
                text = np.repeat(np.arange(len(texts), dtype=np.int64), each)
                cell = np.unique(text * CELLS + (value & np.uint64(CELLS - 1)).astype(np.int64)) % CELLS
                cells += np.bincount(cell, minlength=CELLS + 1)
                rows += len(texts)
        cells[CELLS] = rows
        for at in range(0, CELLS + 1, 1 << 16):
            used = np.flatnonzero(cells[at : at + (1 << 16)]) + at
            yield pa.record_batch([pa.array(used), pa.array(cells[used])], names=["cell", "n"])

    counts = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    cells = np.zeros(CELLS + 1, np.int64)
    cells[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return cells[:CELLS], int(cells[CELLS])


def inverse_frequencies(docs: DataFrame) -> Broadcast:
    """Weights of the cells, ln(1 + documents / smoothed frequency): a broadcast of fixed size."""
    cells, n = document_frequencies(docs)
    return docs.sparkSession.sparkContext.broadcast(np.log1p(n / (cells + SMOOTHING * max(n, 1))))


class Sampler:
    """Consistent weighted samples: equal for two texts with the probability of their weighted Jaccard similarity.

    For a shingle of weight w and one sample, r and c are gamma(2, 1) and b is uniform, all from the
    shingle's hash; t = floor(ln w / r + b), and the shingle with the least ln c - r (t - b + 1)
    is drawn together with its t. The gamma variables come from a table of 65,536 quantiles.
    """

    def __init__(self) -> None:
        grid = np.concatenate(([0], np.geomspace(1e-5, 40, 400_000)))
        share = -np.expm1(-grid) - grid * np.exp(-grid)
        self.gamma = np.interp((np.arange(65536) + 0.5) / 65536, share, grid).astype(np.float32)
        self.log_gamma = np.log(self.gamma)
        self.uniform = (np.arange(65536, dtype=np.float32) + 0.5) / 65536
        self.seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def bands(self, value: np.ndarray, weight: np.ndarray, each: np.ndarray) -> np.ndarray:
        """One hash for each band of each text that has shingles: texts x BANDS."""
        start = np.cumsum(each) - each
        low = np.uint64(0xFFFF)
        log_weight = np.log(weight).astype(np.float32)
        out = np.zeros((len(each), BANDS), np.uint64)
        for k, seed in enumerate(self.seeds):
            z = mix(value ^ seed)
            r = self.gamma[z & low]
            b = self.uniform[(z >> np.uint64(16)) & low]
            t = np.floor(log_weight / r + b)
            score = self.log_gamma[(z >> np.uint64(32)) & low] - r * (t - b + np.float32(1))
            least = np.minimum.reduceat(score, start)
            hit = np.flatnonzero(score == np.repeat(least, each))
            first = hit[np.searchsorted(hit, start)]
            drawn = mix(value[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            band = out[:, k // ROWS]
            band[:] = mix(band * np.uint64(0xFF51AFD7ED558CCD) + drawn + np.uint64(k))
        return out


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """``doc_id, key, weight, bands`` of every document; bands are empty where a text has no words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sampler = Shingles(), Sampler()
        for batch in batches:
            for first, texts in chunks(batch, "text"):
                value, count, each = shingles.of(texts)
                weight = count * idf.value[(value & np.uint64(CELLS - 1)).astype(np.int64)]
                some = np.flatnonzero(each)
                total = np.zeros(len(texts))
                flat, sizes = np.empty(0, np.int64), np.zeros(len(texts), np.int64)
                if len(some):
                    flat = sampler.bands(value, weight, each[some]).view(np.int64).ravel()
                    total[some] = np.add.reduceat(weight, np.cumsum(each[some]) - each[some])
                    sizes[some] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))
                keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                ids = batch.column("doc_id").slice(first, len(texts))
                yield pa.record_batch([ids, keys, pa.array(total), bands], names=["doc_id", "key", "weight", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, key binary, weight double, bands array<long>"
    )


def verified(pairs: DataFrame, texts: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of nodes whose texts have at least this weighted Jaccard similarity, exactly."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            near = np.zeros(len(a), bool)
            for rows in _row_groups(batch):
                nodes: dict[int, bytes] = {}
                for side in ("a", "b"):
                    names, bodies = batch.column(side), batch.column(f"text_{side}").cast(pa.binary())
                    for row in rows:
                        nodes.setdefault(names[row].as_py(), bodies[row].as_py())
                value, count, each = shingles.of(list(nodes.values()))
                weight = count * idf.value[(value & np.uint64(CELLS - 1)).astype(np.int64)]
                end = np.cumsum(each)
                span = {node: slice(end[i] - each[i], end[i]) for i, node in enumerate(nodes)}
                for row in rows:
                    x, y = span[a[row]], span[b[row]]
                    _, i, j = np.intersect1d(value[x], value[y], assume_unique=True, return_indices=True)
                    shared = np.minimum(weight[x][i], weight[y][j]).sum()
                    near[row] = shared >= similarity * (weight[x].sum() + weight[y].sum() - shared) * (1 - 1e-12)
            yield pa.record_batch([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    def _row_groups(batch: pa.RecordBatch) -> Iterator[list[int]]:
        rows, size, seen = [], 0, set()
        sizes = {s: batch.column(f"text_{s}").cast(pa.binary()) for s in ("a", "b")}
        names = {s: batch.column(s).to_numpy() for s in ("a", "b")}
        for row in range(batch.num_rows):
            rows.append(row)
            for s in ("a", "b"):
                if names[s][row] not in seen:
                    seen.add(names[s][row])
                    size += len(sizes[s][row].as_py())
            if size >= 1 << 20:
                yield rows
                rows, size, seen = [], 0, set()
        if rows:
            yield rows

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        compare, "a long, b long"
    )


def linked_components(members: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """Links ``a, b`` between components of ``members(bucket, low, high, node, component, text)``.

    One tile, the rows of one (bucket, low, high), at a time: a shingle that occurs n times in a text is n elements, so
    that weights in common are a product of 0/1 rows over the elements that several texts have. A task returns
    one row for each node that reaches a smaller component.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        key, rows, found = None, [], []

        def tile() -> None:
            nodes = np.array([r[0] for r in rows])
            labels = np.array([r[1] for r in rows])
            if labels.min() != labels.max():
                reached = _least_reached(shingles, [r[2] for r in rows], labels, idf.value, similarity)
                found.extend(zip(nodes[reached < labels].tolist(), reached[reached < labels].tolist(), strict=True))

        for batch in batches:
            names = ("bucket", "low", "high", "node", "component")
            plain = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            for (bucket, low, high, node, component), text in zip(plain, batch.column("text").cast(pa.binary()), strict=True):
                if key != (bucket, low, high):
                    if rows:
                        tile()
                    key, rows = (bucket, low, high), []
                rows.append((node, component, text.as_py()))
        if rows:
            tile()
        a, b = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
        yield pa.record_batch([a, b], names=["a", "b"])

    place = ("bucket", "low", "high")
    return (
        members.select(*place, "node", "component", "text")
        .repartition(*place)
        .sortWithinPartitions(*place)
        .mapInArrow(compare, "a long, b long")
    )


def _least_reached(
    shingles: Shingles, texts: list[bytes], labels: np.ndarray, idf: np.ndarray, similarity: float
) -> np.ndarray:
    """The least label that each text reaches by links among ``texts``."""
    value, count, each = shingles.of(texts)
    owner = np.repeat(np.repeat(np.arange(len(texts)), each), count)
    weight = np.repeat(idf[(value & np.uint64(CELLS - 1)).astype(np.int64)], count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    element = mix(np.repeat(value, count) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    whole = np.bincount(owner, weight, len(texts))
    _, column, often = np.unique(element, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often[column] > 1)
    rank = np.cumsum(often > 1) - 1
    column, owner, weight = rank[column[shared]], owner[shared], weight[shared]
    order = np.argsort(column, kind="stable")
    column, owner, weight = column[order], owner[order], weight[order]
    common = np.zeros((len(texts), len(texts)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        part = np.zeros((len(texts), 4096 if b < len(column) else int(column[-1]) + 1 - first))
        part[owner[a:b], column[a:b] - first] = np.sqrt(weight[a:b])
        common += part @ part.T
    near = common >= similarity * (whole[:, None] + whole[None, :] - common) * (1 - 1e-12)
    near &= (whole > 0)[:, None] & (labels[:, None] != labels[None, :])
    i, j = np.nonzero(near)
    reached = labels.copy()
    while True:
        before = reached.copy()
        np.minimum.at(reached, i, before[j])
        np.minimum.at(reached, j, before[i])
        if np.array_equal(before, reached):
            return reached


def _close(left: str, right: str, similarity: float):
    """Texts whose whole weights differ more than this can't be similar enough."""
    smaller, larger = F.least(left, right), F.greatest(left, right)
    return smaller >= larger * (similarity * (1 - 1e-9))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every row of ``docs`` with its class: ``doc_id, key, class_id, class_size, kept``.

    A class holds equal texts and texts linked, directly or through others, by a weighted Jaccard
    similarity of at least ``similarity`` over TF-IDF weighted shingles of five words. ``class_id`` is the
    smallest doc_id of the class. Exactly one row of each class is kept: the one with the smallest doc_id, whose text has the smallest key
    where several share it; a repeated row is kept once. Null and empty texts are equal texts, and texts without words link with nothing else;
    a null doc_id comes last. Columns other than doc_id and text are ignored. An empty table gives an empty result.

    Equal texts are one node. In each bucket of equal band hashes every node is first compared with one of them only.
    Buckets that then still hold several components are compared whole, in tiles of bounded size, so that no link
    between components is lost and no pairs are written out.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    idf = inverse_frequencies(docs)
    rows = stage(signatures(docs, idf), "signatures")
    nodes = stage(
        rows.groupBy("key")
        .agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    members = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    heads = (
        members.groupBy("bucket")
        .agg(F.min(F.struct("node", "weight")).alias("head"), F.count("*").alias("n"))
        .where("n > 1")
        .select("bucket", "head")
    )
    shared = stage(members.join(heads, "bucket"), "buckets")
    involved = stage(nodes.select("node", "key").join(shared.select("node").distinct(), "node"), "involved")
    keyed = docs.select(content_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = stage(
        split_by_key(keyed, involved, "key")[0]
        .join(involved, "key")
        .groupBy("key", "node")
        .agg(F.first("text").alias("text"))
        .select("node", "text"),
        "texts",
    )
    star = (
        shared.where((F.col("node") != F.col("head.node")) & _close("weight", "head.weight", similarity))
        .select(F.col("node").alias("a"), F.col("head.node").alias("b"))
        .distinct()
    )
    links = stage(verified(star, texts, idf, similarity), "links")
    parts = connected_components(links)

    placed = shared.select("bucket", "node", "weight").join(parts, "node", "left")
    placed = stage(placed.withColumn("component", F.coalesce("component", "node")), "placed")
    sizes = (
        placed.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    )
    dealt = (
        placed.join(sizes, "bucket")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "component")
    )
    more = stage(linked_components(dealt.join(texts, "node"), idf, similarity), "links")
    parts = connected_components(links.unionByName(more))

    labelled = (
        rows.select("doc_id", "key")
        .join(nodes.select("key", "node"), "key")
        .join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    labelled = stage(labelled, "labelled")
    classes = labelled.groupBy("component").agg(
        F.min("doc_id").alias("class_id"),
        F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"), F.col("uid"))).alias("first"),
    )
    for used in (rows, nodes, shared, involved, texts, placed, links, more):
        drop_stage(used)
    return labelled.join(classes, "component").select(
        "doc_id", "key", "class_id", "class_size", (F.col("uid") == F.col("first.uid")).alias("kept")
    )


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class of near duplicates, all columns as they were."""
    found = stage(near_duplicates(docs, similarity).select("key", "doc_id", "kept"), "classes")
    # Texts with a row that goes are few; a text all of whose rows stay (just one) needs no join.
    touched = stage(found.where("not kept").select("key").distinct(), "touched")
    keep = found.where("kept").join(touched, "key", "left_semi").select("key", F.col("doc_id").alias("kept_id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(content_key(F.col("text").cast("string")).alias("key"), row)
    likely, whole = split_by_key(keyed, touched, "key")
    untouched = likely.join(touched, "key", "left_anti").unionByName(whole)
    chosen = (
        likely.join(keep, "key")
        .where(F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id")))
        .groupBy("key")
        .agg(F.first("row").alias("row"))
    )
    return chosen.select("row.*").unionByName(untouched.select("row.*"))
