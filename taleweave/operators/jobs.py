"""Train / score jobs on Spark ML: the same tables in, the same prediction tables and metrics out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from taleweave.functions.arrays import above, argmax
from taleweave.functions.text import word_tokens
from taleweave.operators.bayes import (
    BayesModel,
    WordRegression,
    fit_bayes,
    fit_bayes_each,
    fit_word_regression,
    predict_word_regression,
    score_bayes,
    score_bayes_each,
)
from taleweave.operators.evaluate import classification_report, multilabel_report
from taleweave.operators.shaping import cloze_prompt, story_text
from taleweave.operators.stats import class_weights
from taleweave.session import hand_over
from taleweave.sources.schemas import CLOZE_ENDINGS, IMPORTANCE_NAMES

ClassModel = PipelineModel | BayesModel

N_FEATURES = 1 << 18
# Learning ends when a step changes the loss by less than the tolerance.
MAX_ITER, TOLERANCE = 200, 1e-4


def text_stages(token_columns: Sequence[str], extra: Sequence[str] = (), n_features: int = N_FEATURES) -> list:
    """Hashed TF-IDF of each token column, side by side, with numeric columns appended."""
    stages: list = []
    for name in token_columns:
        stages.append(HashingTF(inputCol=name, outputCol=f"{name}_tf", numFeatures=n_features))
        stages.append(IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf", minDocFreq=1))
    inputs = [f"{name}_idf" for name in token_columns] + list(extra)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def fit_classes(
    train: DataFrame,
    token_columns: Sequence[str],
    weighted: bool = False,
    max_iter: int = MAX_ITER,
    learner: str = "bayes",
    n_labels: int = 4,
) -> ClassModel:
    """Class model on the train rows, with balanced class weights when asked for.

    ``bayes`` counts all words of each class; ``logistic`` fits hashed TF-IDF features until it converges.
    """
    if learner == "bayes":
        return fit_bayes(train, token_columns, n_labels, weighted)
    learner = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=0.01, tol=TOLERANCE)
    if weighted:
        weights = hand_over(class_weights(train).select("label", "weight"), "class-weights")
        train = train.join(weights, "label")
        learner = learner.setWeightCol("weight")
    return Pipeline(stages=[*text_stages(token_columns), learner]).fit(train)


def score_classes(model: ClassModel, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prediction table: key, raw scores per class, predicted class and label."""
    if isinstance(model, BayesModel):
        return score_bayes(model, df, key).select(key, *keep, "z", "label").withColumn("pred", argmax(F.col("z")))
    z = vector_to_array("rawPrediction")
    return model.transform(df).select(key, *keep, z.alias("z"), "label").withColumn("pred", argmax(F.col("z")))


def ending_choice_input(cloze: DataFrame) -> DataFrame:
    """Context and the two endings as separate token columns, so the endings can be told apart."""
    return cloze.select(
        F.col("InputStoryid").alias("row_id"),
        "split",
        word_tokens(cloze_prompt(), lower=True).alias("context"),
        word_tokens(F.col(CLOZE_ENDINGS[0]), lower=True).alias("ending1"),
        word_tokens(F.col(CLOZE_ENDINGS[1]), lower=True).alias("ending2"),
        "label",
    )


def story_input(stories: DataFrame, label: Column | None = None) -> DataFrame:
    return stories.select(
        F.col("story_id").alias("row_id"),
        "split",
        word_tokens(story_text(), lower=True).alias("tokens"),
        (F.col("label") if label is None else label).alias("label"),
    )


def class_job(
    table: DataFrame, token_columns: Sequence[str], weighted: bool = False, learner: str = "bayes", n_labels: int = 4
) -> tuple[ClassModel, DataFrame]:
    """Fit on the train split; prediction table of the other splits."""
    table = hand_over(table, "class-input")
    model = fit_classes(table.filter("split = 'train'"), token_columns, weighted, learner=learner, n_labels=n_labels)
    return model, score_classes(model, table.filter("split <> 'train'"), "row_id", ["split"])


def ending_choice(cloze: DataFrame, learner: str = "bayes") -> tuple[ClassModel, DataFrame]:
    return class_job(ending_choice_input(cloze), ["context", "ending1", "ending2"], learner=learner, n_labels=2)


def category(stories: DataFrame, learner: str = "bayes") -> tuple[ClassModel, DataFrame]:
    return class_job(story_input(stories), ["tokens"], weighted=True, learner=learner)


def fit_importance(table: DataFrame, learner: str = "bayes", max_iter: int = MAX_ITER) -> list[ClassModel]:
    """One binary model per sentence over one shared table of texts; ``logistic`` has their shared features first."""
    train = table.filter("split = 'train'")
    if learner == "bayes":
        return fit_bayes_each(train, ["tokens"], 2, [F.get("label", F.lit(i)) for i in range(len(IMPORTANCE_NAMES))])
    features = Pipeline(stages=text_stages(["tokens"])).fit(train)
    shared = hand_over(features.transform(train).select("features", "label"), "importance-input")
    models: list[ClassModel] = [features]
    for i, name in enumerate(IMPORTANCE_NAMES):
        logistic = LogisticRegression(
            featuresCol="features",
            labelCol="y",
            maxIter=max_iter,
            tol=TOLERANCE,
            regParam=0.01,
            rawPredictionCol=f"raw_{name}",
            probabilityCol=f"p_{name}",
            predictionCol=f"c_{name}",
        )
        models.append(Pipeline(stages=[logistic]).fit(shared.select("features", F.get("label", F.lit(i)).cast("double").alias("y"))))
    return models


def score_importance(models: Sequence[ClassModel], table: DataFrame) -> DataFrame:
    """Prediction table: ``z`` is the margin of "important" over "not important" for each sentence."""
    if isinstance(models[0], BayesModel):
        names = [f"z_{name}" for name in IMPORTANCE_NAMES]
        scored = score_bayes_each(models, table, "row_id", names)
        z = F.array(*[F.get(name, F.lit(1)) - F.get(name, F.lit(0)) for name in names])
        predictions = scored.select("row_id", "split", z.alias("z"), "label")
        return predictions.withColumn("pred", F.transform("z", lambda m: (m > 0).cast("int")))
    scored = table
    for model in models:
        scored = model.transform(scored)
    z = F.array(*[F.element_at(vector_to_array(f"raw_{name}"), -1) for name in IMPORTANCE_NAMES])
    return scored.select("row_id", "split", z.alias("z"), "label").withColumn("pred", above(F.col("z")))


def importance(stories: DataFrame, learner: str = "bayes", max_iter: int = MAX_ITER) -> tuple[list[ClassModel], DataFrame]:
    """Four independent labels, fitted on the train split; prediction table of the other splits."""
    table = hand_over(story_input(stories), "importance-input")
    models = fit_importance(table, learner, max_iter)
    return models, score_importance(models, table.filter("split <> 'train'"))


def pair_input(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.select(
        F.col(key).alias("row_id"),
        "split",
        word_tokens(F.col("original"), lower=True).alias("a"),
        word_tokens(F.col("edit"), lower=True).alias("b"),
        "label",
    )


def pair_regression(pairs: DataFrame, key: str, length: int = 128) -> tuple[PipelineModel | WordRegression, DataFrame]:
    """Score of a text pair from the words of both texts and from what the first ``length`` words of each attend to in the
    other one by their phonetic similarity."""
    return regression_job(pair_input(pairs, key), ["a", "b"], length=length)


def single_text_input(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(
        F.col(key).alias("row_id"), "split", word_tokens(F.col("text"), lower=True).alias("tokens"), "label"
    )


def text_scalar(texts: DataFrame, key: str) -> tuple[PipelineModel | WordRegression, DataFrame]:
    """Score of a single text."""
    table = single_text_input(texts, key).withColumn("label", F.col("label").cast("double"))
    return regression_job(table, ["tokens"])


def regression_job(
    table: DataFrame,
    token_columns: Sequence[str],
    extra: Sequence[str] = (),
    max_iter: int = MAX_ITER,
    learner: str = "words",
    length: int = 0,
) -> tuple[PipelineModel | WordRegression, DataFrame]:
    """``words`` fits a line on the mean labels of words, with ``length`` also on those they attend to in the other of two
    columns; ``linear`` fits hashed TF-IDF features until it converges."""
    table = hand_over(table, "regression-input")
    train, rest = table.filter("split = 'train'"), table.filter("split <> 'train'")
    if learner == "words":
        words = fit_word_regression(train, token_columns, "row_id", extra, length)
        return words, predict_word_regression(words, rest, "row_id").select("row_id", "split", "pred", "label")
    linear = LinearRegression(
        featuresCol="features", labelCol="label", maxIter=max_iter, regParam=0.1, tol=TOLERANCE, solver="l-bfgs"
    )
    model = Pipeline(stages=[*text_stages(token_columns, extra), linear]).fit(train)
    return model, model.transform(rest).select("row_id", "split", F.col("prediction").alias("pred"), "label")


def class_split_report(predictions: DataFrame) -> DataFrame:
    """All class metrics of every split in one aggregation."""
    return classification_report(predictions, by=["split"])


def multilabel_split_report(predictions: DataFrame, n_labels: int = 4) -> DataFrame:
    return multilabel_report(predictions, n_labels, by=["split"])


def regression_split_report(predictions: DataFrame) -> DataFrame:
    gap = F.col("pred") - F.col("label")
    return predictions.groupBy("split").agg(F.avg(gap * gap).alias("mse"), F.count(F.lit(1)).alias("samples"))


def joint_report(class_report: DataFrame, perplexities: DataFrame) -> DataFrame:
    """Class metrics and language-model perplexity of each split side by side."""
    return class_report.join(perplexities.select("split", "perplexity"), "split")


def save_model(model: ClassModel, path: str) -> None:
    if isinstance(model, (BayesModel, WordRegression)):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def save_models(models: ClassModel | Sequence[ClassModel], path: str) -> None:
    """One model, or several side by side under their numbers."""
    if isinstance(models, list):
        for k, model in enumerate(models):
            save_model(model, f"{path}/{k}")
    else:
        save_model(models, path)


def load_model(path: str, learner: str = "bayes") -> ClassModel:
    return BayesModel.load(path) if learner == "bayes" else PipelineModel.load(path)


def load_models(path: str, learner: str = "bayes") -> list[ClassModel]:
    """The models of :func:`fit_importance`."""
    count = len(IMPORTANCE_NAMES) + (learner != "bayes")
    return [load_model(f"{path}/{k}", learner) for k in range(count)]


def score_regression(model: WordRegression, table: DataFrame) -> DataFrame:
    return predict_word_regression(model, table, "row_id").select("row_id", "split", "pred", "label")
