"""Whole runs over a saved dataset: split, fit, evaluate every split, write predictions and metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taleweave.functions.text import whitespace_tokens
from taleweave.operators import evaluate, jobs, ngram, shaping, splits, textmetrics, tokens
from taleweave.operators.bayes import WordRegression
from taleweave.operators.ranking import row_index
from taleweave.operators.runs import Run, fingerprint
from taleweave.session import hand_over, scratch_path
from taleweave.sources import readers, schemas, writers

END = "</s>"
CLASS_KEYS = {"ending": "InputStoryid", "category": "story_id", "importance": "story_id", "text": "id"}
CLASS_NAMES = {"ending": schemas.ENDING_NAMES, "category": schemas.CATEGORY_NAMES, "text": ("0", "1")}


def prepare_category(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    rows = schemas.cast_to(readers.read_delimited(spark, source), schemas.CATEGORY)
    writers.write_columnar(rows, target, overwrite)


def prepare_importance(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    rows = readers.read_delimited(spark, source)
    wrong = F.raise_error(F.concat(F.lit("bad sentence index list: "), F.col("label"))).cast("array<bigint>")
    label = F.when(readers.multihot_bad(F.col("label")), wrong).otherwise(readers.multihot(F.col("label")))
    writers.write_columnar(schemas.cast_to(rows.withColumn("label", label), schemas.IMPORTANCE), target, overwrite)


def prepare_cloze(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    rows = shaping.rename_target(readers.read_cloze_csv(spark, source), "AnswerRightEnding")
    writers.write_columnar(schemas.cast_to(shaping.zero_based_label(rows), schemas.CLOZE), target, overwrite)


def limited(df: DataFrame, key: str, limits: Mapping[str, int]) -> DataFrame:
    """Row limits for the splits that have one, the other splits whole."""
    if not limits:
        return df
    rest = df.filter(~F.col("split").isin(*limits))
    return splits.first_n_per_split(df, key, limits).unionByName(rest)


def _write_predictions(predictions: DataFrame, line, path: str, overwrite: bool) -> None:
    indexed = row_index(predictions.filter("split = 'test'"), "row_id")
    writers.write_lines(indexed, "row_index", line, path, overwrite)


def _named_target(data: DataFrame, task: str) -> DataFrame:
    """The target column of a named task as ``label``, unless the data have one already."""
    return data if "label" in data.columns else shaping.rename_target(data, shaping.TARGET_COLUMNS[task])


def _class_input(task: str, rows: DataFrame, key: str) -> DataFrame:
    if task == "ending":
        return jobs.ending_choice_input(rows)
    return jobs.single_text_input(rows, key) if task == "text" else jobs.story_input(rows)


# Token columns, balanced weights and number of classes of the tasks with one model.
CLASS_FITS = {
    "ending": (["context", "ending1", "ending2"], False, 2),
    "category": (["tokens"], True, 4),
    "text": (["tokens"], False, 2),
}


def _class_table(data: DataFrame, task: str) -> DataFrame:
    if task != "text":
        return data
    data = _named_target(data, "humor_classification")
    return data.select("id", "text", F.col("label").cast("int").alias("label"))


def _class_report(task: str, predictions: DataFrame) -> tuple[DataFrame, Column]:
    """Metrics of each split, and the line of a prediction."""
    index = F.col("row_index")
    if task == "importance":
        report = jobs.multilabel_split_report(predictions)
        return report, writers.multi_label_line(index, F.col("pred"), F.col("label"), schemas.IMPORTANCE_NAMES)
    report = jobs.class_split_report(predictions)
    if task == "text":
        return report, writers.class_line(index, F.col("pred"), CLASS_NAMES[task])
    return report, writers.single_label_line(index, F.col("pred"), F.col("label"), CLASS_NAMES[task])


def classify(
    data: DataFrame,
    task: str,
    output: str,
    test: DataFrame | None = None,
    limits: Mapping[str, int] | None = None,
    seed: int = splits.DEFAULT_SEED,
    overwrite: bool = False,
    save: str | None = None,
    learner: str = "bayes",
    resume: str | None = None,
) -> DataFrame:
    """``ending``, ``category``, ``importance`` or ``text``; returns the metrics of each held-out split.

    ``save`` keeps the fitted model for :func:`score`. ``resume`` is a folder for finished stages: the same run started
    again goes on after the last of them.
    """
    spark = data.sparkSession
    key = CLASS_KEYS[task]
    data = _class_table(data, task)
    if resume is None:
        resume = scratch_path(spark, "run")
        source = "once"
    else:
        source = fingerprint(data) if test is None else fingerprint(data, test)
    run = Run(spark, resume, source, task=task, seed=seed, limits=dict(limits or {}), learner=learner)

    def marked() -> DataFrame:
        own = splits.split3(data, key, seed=seed) if test is None else splits.split_external(data, test, key, seed=seed)
        return _class_input(task, limited(own, key, limits or {}), key)

    table = run.table("input", marked)
    if task == "importance":
        model = run.model("model", lambda: jobs.fit_importance(table, learner), jobs.save_models, lambda path: jobs.load_models(path, learner))
    else:
        columns, weighted, n_labels = CLASS_FITS[task]
        train = table.filter("split = 'train'")
        model = run.model(
            "model",
            lambda: jobs.fit_classes(train, columns, weighted, learner=learner, n_labels=n_labels),
            jobs.save_models,
            lambda path: jobs.load_model(path, learner),
        )
    held = table.filter("split <> 'train'")
    predictions = run.table("predictions", lambda: _class_scores(task, model, held))
    report, line = _class_report(task, predictions)
    if save:
        jobs.save_models(model, save)
    _write_predictions(predictions, line, f"{output}/predict_results", overwrite)
    writers.write_metrics(report, f"{output}/eval_results", overwrite)
    writers.write_metrics(_samples(table), f"{output}/samples", overwrite)
    return report


def _class_scores(task: str, model, table: DataFrame) -> DataFrame:
    if task == "importance":
        return jobs.score_importance(model, table)
    return jobs.score_classes(model, table, "row_id", ["split"])


def _samples(table: DataFrame) -> DataFrame:
    """Number of rows of each split, the train split's included."""
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("samples"))


def score(
    data: DataFrame, task: str, model: str, output: str, overwrite: bool = False, learner: str = "bayes"
) -> DataFrame:
    """Predictions of a saved model for all rows of ``data``: class names, or the scores of ``pair`` and ``rating``."""
    if task in REGRESSION_KEYS:
        rows = _named_target(data, "humor_regression") if task == "rating" else data
        inputs = _regression_input(task, rows.withColumn("split", F.lit("test")), REGRESSION_KEYS[task])
        predictions = hand_over(jobs.score_regression(WordRegression.load(model), inputs), "predictions")
        _write_predictions(predictions, writers.regression_line(F.col("row_index"), F.col("pred")), f"{output}/predict_results", overwrite)
        return jobs.regression_split_report(predictions)
    key = CLASS_KEYS[task]
    inputs = _class_input(task, _class_table(data, task).withColumn("split", F.lit("test")), key)
    fitted = jobs.load_models(model, learner) if task == "importance" else jobs.load_model(model, learner)
    predictions = hand_over(_class_scores(task, fitted, inputs), "predictions")
    report, line = _class_report(task, predictions)
    if task != "importance":
        line = writers.class_line(F.col("row_index"), F.col("pred"), CLASS_NAMES[task])
    _write_predictions(predictions, line, f"{output}/predict_results", overwrite)
    return report


# Keys of the saved regressions: text pairs, and single rated texts.
REGRESSION_KEYS = {"pair": "id", "rating": "id"}


def _regression_input(task: str, rows: DataFrame, key: str) -> DataFrame:
    if task == "pair":
        return jobs.pair_input(rows, key)
    return jobs.single_text_input(rows, key).withColumn("label", F.col("label").cast("double"))


def regress(
    data: DataFrame,
    task: str,
    output: str,
    key: str = "id",
    seed: int = 69,
    overwrite: bool = False,
    limits: Mapping[str, int] | None = None,
    save: str | None = None,
) -> DataFrame:
    """``pair`` scores original/edit texts, ``text`` a single text; ``save`` keeps the fitted model."""
    if task == "text":
        data = _named_target(data, "humor_regression")
    marked = limited(splits.split3(data, key, seed=seed), key, limits or {})
    model, predictions = (jobs.pair_regression if task == "pair" else jobs.text_scalar)(marked, key)
    if save:
        jobs.save_models(model, save)
    predictions = hand_over(predictions, "predictions")
    report = jobs.regression_split_report(predictions)
    line = writers.regression_line(F.col("row_index"), F.col("pred"))
    _write_predictions(predictions, line, f"{output}/test_results", overwrite)
    writers.write_metrics(report, f"{output}/eval_results", overwrite)
    return report


def next_token_tables(marked: DataFrame, key: str, cloze: bool, block_size: int = 128) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packed blocks of all splits, training pair counts, and perplexity of each held-out split."""
    text = shaping.lm_text(cloze, END)
    tokenized = marked.select(key, "split", whitespace_tokens(text).alias("tokens"))
    batched = tokens.batches_of(tokenized, key, 1000, within="split")
    blocks = hand_over(tokens.pack_blocks(batched, key, "tokens", "batch", block_size, by=("split",)), "blocks")
    train = blocks.filter("split = 'train'")
    counts = hand_over(ngram.train_counts(train), "pairs")
    held = tokens.pair_counts(blocks.filter("split <> 'train'"), "input_ids", by=("split",))
    size = ngram.vocabulary_size(counts).select("v").scalar()
    return blocks, counts, ngram.lm_perplexity(held, counts, size, by=["split"])


def generate_endings(
    data: DataFrame,
    cloze: bool,
    output: str,
    test: DataFrame | None = None,
    seed: int = splits.DEFAULT_SEED,
    overwrite: bool = False,
    max_new_tokens: int = ngram.MAX_NEW_TOKENS,
    top_p: float = ngram.TOP_P,
    top_k: int = ngram.TOP_K,
    temperature: float = ngram.TEMPERATURE,
    repetition_penalty: float = ngram.REPETITION_PENALTY,
    limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Endings for the test split; returns bleu, rouge and meteor and writes them with the texts and perplexities."""
    key = "InputStoryid" if cloze else "story_id"
    marked = (
        splits.split3(data, key, seed=seed) if test is None else splits.split_external(data, test, key, seed=seed)
    )
    marked = limited(marked, key, limits or {})
    _, counts, perplexities = next_token_tables(marked, key, cloze)
    prompts = shaping.prompt_reference(marked.filter("split = 'test'"), key, cloze)
    starts = prompts.select(key, whitespace_tokens(F.col("prompt")).alias("p"))
    kept = ngram.candidate_set(counts, top_p, top_k, temperature, fine=repetition_penalty != 1.0)
    endings = ngram.generate(starts, kept, key, "p", END, max_new_tokens, seed, penalty=repetition_penalty)
    scored = hand_over(prompts.join(endings, key), "generated")
    report = textmetrics.metric_bundle(scored, key, "text", "reference", stems=True)
    text = shaping.total_sequence(F.col("prompt"), F.col("text"))
    line = writers.generated_line(F.col("row_index"), text, F.col("reference"))
    writers.write_lines(row_index(scored, key), "row_index", line, f"{output}/predict_results", overwrite)
    writers.write_metrics(perplexities, f"{output}/eval_results", overwrite)
    writers.write_metrics(report, f"{output}/eval_results_extra", overwrite)
    return report


def multitask(
    data: DataFrame,
    task: str,
    output: str,
    seed: int = splits.DEFAULT_SEED,
    overwrite: bool = False,
    limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Class metrics of ``category`` or ``importance`` with the perplexity of the same splits."""
    marked = limited(splits.split3(data, "story_id", seed=seed), "story_id", limits or {})
    if task == "importance":
        _, predictions = jobs.importance(marked)
        report = jobs.multilabel_split_report(predictions)
    else:
        _, predictions = jobs.category(marked)
        report = jobs.class_split_report(predictions)
    _, _, perplexities = next_token_tables(marked, "story_id", cloze=False)
    joint = hand_over(jobs.joint_report(report, perplexities), "joint")
    writers.write_metrics(joint, f"{output}/eval_results", overwrite)
    return joint


def post_evaluate(spark: SparkSession, path: str) -> DataFrame:
    """Class metrics read back from a prediction file."""
    return evaluate.classification_report(readers.read_prediction_lines(spark, path), "label", "prediction")
