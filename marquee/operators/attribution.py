"""Which words drove a score: masked copies of each text and a local linear fit."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import text

N_WORDS, N_SAMPLES = 8, 100
KERNEL_WIDTH, RIDGE = 25.0, 1.0
# What is shown where there is nothing to show.
NO_SIGNAL = "No clear signals found"
UNAVAILABLE = "LIME unavailable"

_BATCH_CHARS, _BATCH_WORDS, _BATCH_TEXTS = 1 << 14, 1 << 14, 64

ScoreFn = Callable[[pd.Series], pd.Series]


def _masks(n_words: int, n_samples: int, seed: int, review_id: int) -> np.ndarray:
    """Which words each copy keeps: the first copy all, every other one all but a random number of random words."""
    rng = np.random.default_rng([seed, review_id & 0xFFFFFFFFFFFFFFFF])
    drawn = rng.random((n_samples, n_words))
    hidden = rng.integers(1, n_words + 1, n_samples)
    hidden[0] = 0
    # A copy hides the words of its least draws: sorted draws tell the least one that is kept.
    least = np.column_stack([np.sort(drawn, axis=1), np.full(n_samples, np.inf)])[np.arange(n_samples), hidden]
    return (drawn >= least[:, None]).astype(float)


def _fit(masks: list[np.ndarray], scores: list[np.ndarray]) -> list[np.ndarray]:
    """Weighted ridge coefficients of some texts, nearer copies counting more: one stacked solve over their samples."""
    # The centred, weighted samples are never laid out: their products follow from those of the masks.
    kernels, ys, parts = [], [], []
    for mask, score in zip(masks, scores, strict=True):
        distance = 100.0 * (1.0 - np.sqrt(mask.mean(axis=1)))  # 100 * cosine distance to the whole text
        weight = np.sqrt(np.exp(-(distance**2) / KERNEL_WIDTH**2))
        share, root = weight / weight.sum(), np.sqrt(weight)
        mean = share @ mask
        off = mask @ mean
        kernels.append((mask @ mask.T - off[:, None] - off + mean @ mean) * (root[:, None] * root))
        ys.append(root * (score - share @ score))
        parts.append((mask, root, mean))
    solved = np.linalg.solve(np.stack(kernels) + RIDGE * np.eye(len(ys[0])), np.stack(ys)[:, :, None])[:, :, 0]
    return [(root * one) @ mask - (root @ one) * mean for (mask, root, mean), one in zip(parts, solved, strict=True)]


def _leading(review_id: int, words: np.ndarray, weights: np.ndarray, n_words: int) -> list[tuple]:
    lead = np.lexsort((words, -np.round(np.abs(weights), 9)))[:n_words]
    return [(review_id, i + 1, str(words[at]), float(weights[at])) for i, at in enumerate(lead)]


def _scored(copies: list[list[str]], score: ScoreFn) -> list[np.ndarray | None]:
    """Scores of the copies of some texts in one call; text by text if that fails, None for those that fail alone."""
    try:
        found = np.asarray(score(pd.Series([c for own in copies for c in own])), dtype=float)
        if not np.isfinite(found).all():
            raise ValueError("scores must be finite")
        return list(found.reshape(len(copies), -1))
    except Exception:  # noqa: BLE001  a scorer may fail in any way
        if len(copies) == 1:
            return [None]
        return [one for own in copies for one in _scored([own], score)]


def attribute_words(
    reviews: DataFrame, score: ScoreFn, n_words: int = N_WORDS, n_samples: int = N_SAMPLES, seed: int = 0
) -> DataFrame:
    """(review_id, rank, word, weight): the most influential words of each text.

    ``score`` maps a Series of texts to scores and travels with the task; it is called once for some texts with all their masked
    copies, which live only inside the task that holds the texts. A text that it fails on has the one row
    ``UNAVAILABLE`` of weight 0. The mask stream depends on the seed and the id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answer(texts: list[tuple]) -> pd.DataFrame:
            held, copies = [], []
            for review_id, review in texts:
                pieces = np.array(re.split(r"(\w+)", review), dtype=object)
                words, which = np.unique(pieces[1::2].astype(str), return_inverse=True)
                if not len(words):
                    continue
                masks = _masks(len(words), n_samples, seed, review_id)
                shown = np.repeat(pieces[None, :], n_samples, axis=0)
                shown[:, 1::2][masks[:, which] == 0.0] = ""
                held.append((review_id, words, masks))
                copies.append(["".join(row) for row in shown])
            found = _scored(copies, score) if copies else []
            good = [i for i, x in enumerate(found) if x is not None]
            weights = dict(zip(good, _fit([held[i][2] for i in good], [found[i] for i in good]), strict=True)) if good else {}
            rows = []
            for i, (review_id, words, _) in enumerate(held):
                known = i in weights
                rows += _leading(review_id, words, weights[i], n_words) if known else [(review_id, 1, UNAVAILABLE, 0.0)]
            return pd.DataFrame(rows, columns=["review_id", "rank", "word", "weight"])

        for batch in batches:
            texts, size = [], 0
            for row in zip(batch["review_id"].tolist(), batch["review"], strict=True):
                texts.append(row)
                size += len(row[1])
                if size >= _BATCH_CHARS:
                    yield answer(texts)
                    texts, size = [], 0
            if texts:
                yield answer(texts)

    return (
        reviews.where(F.col("review").isNotNull())
        .select("review_id", "review")
        .mapInPandas(run, "review_id long, rank int, word string, weight double")
    )


def attribute_features(
    reviews: DataFrame, pulls: DataFrame, intercept: float, n_words: int = N_WORDS, n_samples: int = N_SAMPLES, seed: int = 0
) -> DataFrame:
    """As :func:`attribute_words`, for a classifier that adds up a pull of each word: ``pulls(word, pull)``.

    Such a model needs no masked texts: the probability of a copy follows from the counts of the words it keeps, so masks and pulls are
    multiplied as matrices. Words are the lower-cased tokens that the classifier sees; those without a pull count 0.
    """
    counted = (
        reviews.where(F.col("review").isNotNull())
        .select("review_id", F.explode(text.tokens(F.col("review"))).alias("word"))
        .groupBy("review_id", "word")
        .agg(F.count("*").alias("n"))
    )
    held = (
        counted.join(pulls, "word", "left")
        .groupBy("review_id")
        .agg(F.array_sort(F.collect_list(F.struct("word", (F.col("n") * F.coalesce("pull", F.lit(0.0))).alias("pull")))).alias("x"))
        .select("review_id", F.col("x.word").alias("words"), F.col("x.pull").alias("pulls"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(texts: list[tuple]) -> pa.RecordBatch:
            masks = [_masks(len(words), n_samples, seed, review_id) for review_id, words, _ in texts]
            scores = [1 / (1 + np.exp(-(intercept + m @ p))) for m, (_, _, p) in zip(masks, texts, strict=True)]
            rows = [
                row
                for (review_id, words, _), weights in zip(texts, _fit(masks, scores), strict=True)
                for row in _leading(review_id, words, weights, n_words)
            ]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.record_batch(columns, names=["review_id", "rank", "word", "weight"])

        for batch in batches:
            texts, size = [], 0
            for review_id, words, own in zip(*(batch.column(i) for i in range(3)), strict=True):
                texts.append((review_id.as_py(), np.array(words.as_py(), dtype=str), own.values.to_numpy()))
                size += len(texts[-1][1])
                if size >= _BATCH_WORDS or len(texts) >= _BATCH_TEXTS:
                    yield answer(texts)
                    texts, size = [], 0
            if texts:
                yield answer(texts)

    return held.mapInArrow(run, "review_id long, rank int, word string, weight double")


def attribution_text(words: Column) -> Column:
    """'Positive signals: a, b | Negative signals: c' from ranked (word, weight) structs."""

    def part(label: str, held) -> Column:
        chosen = F.transform(F.slice(F.filter(words, held), 1, 4), lambda w: w["word"])
        return F.when(F.size(chosen) > 0, F.concat(F.lit(f"{label} signals: "), F.array_join(chosen, ", ")))

    joined = F.concat_ws(
        " | ",
        part("Positive", lambda w: w["weight"] > 0),
        part("Negative", lambda w: w["weight"] < 0),
    )
    return F.when(joined == "", F.lit(NO_SIGNAL)).otherwise(joined)


def attribution_summary(attributions: DataFrame) -> DataFrame:
    """(review_id, summary); at most ``n_words`` rows are gathered per text."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "word", "weight")))
    return attributions.groupBy("review_id").agg(ranked.alias("words")).select(
        "review_id", attribution_text(F.col("words")).alias("summary")
    )
