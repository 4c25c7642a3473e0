"""Review classifier: trained, saved and applied as a Spark ML pipeline over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import text


def train_classifier(
    train: DataFrame, n_features: int = 1 << 18, max_iter: int = 30, regularisation: float = 0.01
) -> PipelineModel:
    """Fit on ``train(review, label)``."""
    stages = [
        RegexTokenizer(inputCol="review", outputCol="words", pattern=text.TOKEN_PATTERN, gaps=False),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=n_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=max_iter, regParam=regularisation),
    ]
    known = train.where(F.col("review").isNotNull()).select("review", F.col("label").cast("double"))
    return Pipeline(stages=stages).fit(known)


def score_reviews(model: PipelineModel, reviews: DataFrame) -> DataFrame:
    """``reviews`` with the probability that each is positive; NULL text has none."""
    filled = reviews.withColumns(
        {"has_text": F.col("review").isNotNull(), "review": F.coalesce("review", F.lit(""))}
    )
    positive = F.when(F.col("has_text"), vector_to_array("probability")[1])
    kept = {c: F.when(F.col("has_text"), F.col(c)) if c == "review" else F.col(c) for c in reviews.columns}
    return model.transform(filled).select(
        *(column.alias(name) for name, column in kept.items()), positive.alias("probability")
    )


def word_pulls(model: PipelineModel, words: DataFrame) -> tuple[DataFrame, float]:
    """``words(word)`` with ``pull``, what one occurrence adds to the margin of a text, and the margin of no words at all."""
    tf, idf, regression = model.stages[1:]
    alone = words.select("word", F.array("word").alias("words"))
    scored = regression.transform(idf.transform(tf.transform(alone)))
    intercept = float(regression.intercept)
    return scored.select("word", (vector_to_array("rawPrediction")[1] - intercept).alias("pull")), intercept


def score_with(
    reviews: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]]
) -> DataFrame:
    """(review_id, probability) by any model: ``load`` runs once per task, its result once per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            yield pd.DataFrame({"review_id": batch["review_id"], "probability": score(batch["review"])})

    known = reviews.where(F.col("review").isNotNull()).select("review_id", "review")
    return known.mapInPandas(run, "review_id long, probability double")


def validation_metrics(model: PipelineModel, validation: DataFrame) -> dict[str, object]:
    """Accuracy on held-out rows and the training loss per iteration."""
    scored = model.transform(validation.withColumn("label", F.col("label").cast("double")))
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)
    return {"accuracy": accuracy, "loss": list(model.stages[-1].summary.objectiveHistory)}


def save_classifier(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(folder)


def load_classifier(folder: str) -> PipelineModel:
    return PipelineModel.load(folder)
