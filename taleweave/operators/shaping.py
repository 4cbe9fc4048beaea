"""Projections that shape stories into texts, prompts and model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from taleweave.functions.text import join_text
from taleweave.sources.schemas import CLOZE_CONTEXT, CLOZE_ENDINGS, STORY_COLUMNS

# Text columns of each named task (second one absent for single texts).
TASK_COLUMNS = {
    "semeval_regression": ("original", "edit"),
    "humor_regression": ("text", None),
    "humor_classification": ("text", None),
}
# Names of two texts that belong together.
PAIR_COLUMNS = [("sentence1", "sentence2")]
#: Columns that name a row and are no text of it.
KEY_COLUMNS = ("id", "row_id", "pair_id", "story_id", "InputStoryid")
# Target column of each source, renamed to ``label``.
TARGET_COLUMNS = {
    "cloze_csv": "AnswerRightEnding",
    "humor_regression": "humor_rating",
    "humor_classification": "is_humor",
}


def rename_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumnRenamed(target, "label")


def zero_based_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.col("label") - 1).cast("int"))


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def cloze_text() -> Column:
    """Four context sentences and both endings."""
    return join_text(*cols(CLOZE_CONTEXT), *cols(CLOZE_ENDINGS))


def story_text() -> Column:
    return join_text(*cols(STORY_COLUMNS))


def cloze_prompt() -> Column:
    return join_text(*cols(CLOZE_CONTEXT))


def story_prompt() -> Column:
    return join_text(*cols(STORY_COLUMNS[:4]))


def right_ending() -> Column:
    return F.when(F.col("label") == 0, F.col(CLOZE_ENDINGS[0])).otherwise(F.col(CLOZE_ENDINGS[1]))


def prompt_reference(df: DataFrame, key: str, cloze: bool) -> DataFrame:
    prompt, reference = (
        (cloze_prompt(), right_ending()) if cloze else (story_prompt(), F.col(STORY_COLUMNS[4]))
    )
    return df.select(key, prompt.alias("prompt"), reference.alias("reference"))


def end_marker(eos: str | None, sep: str | None) -> str:
    """The end-of-text marker, or the separator where a vocabulary has no end-of-text marker."""
    marker = eos if eos is not None else sep
    if marker is None:
        raise ValueError("need an end or separator marker")
    return marker


def lm_text(cloze: bool, eos: str | None, sep: str | None = None, between: str | None = None) -> Column:
    """Prompt, right ending and end marker; ``between`` puts a separator before the ending."""
    prompt, ending = (
        (cloze_prompt(), right_ending()) if cloze else (story_prompt(), F.col(STORY_COLUMNS[4]))
    )
    middle = [F.lit(between)] if between is not None else []
    return join_text(prompt, *middle, ending, F.lit(end_marker(eos, sep)))


def total_sequence(prompt: Column, text: Column) -> Column:
    return join_text(prompt, text)


def keep_only_label(df: DataFrame, added: Sequence[str]) -> DataFrame:
    """After a map: the label and the new columns stay, the source columns go."""
    return df.select("label", *added)


def choose_text_columns(df: DataFrame, task: str | None = None, keys: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """``text_a`` (and ``text_b``): the columns of a named task, or else what the schema has as texts.

    Texts are string columns that are no keys and not the label. A known pair of names goes before the order of columns.
    """
    if task is not None:
        found = [name for name in TASK_COLUMNS[task] if name]
    else:
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in {*keys, "label"}]
        found = next((list(pair) for pair in PAIR_COLUMNS if set(pair) <= set(texts)), texts[:2])
    if not found:
        raise ValueError("no text column")
    return df.withColumns({f"text_{side}": F.col(name) for side, name in zip("ab", found, strict=False)})


def model_input(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Columns a model takes: strings, void columns and source sentences go, ``label`` becomes ``labels``.

    An integer label stays integral, any other becomes floating point; an array of integers stays integral.
    """
    dropped = {"label", "label_ids", *STORY_COLUMNS, *ignore}
    kept = [
        F.col(f.name)
        for f in df.schema.fields
        if f.name not in dropped and not isinstance(f.dataType, (T.StringType, T.NullType))
    ]
    source = next((n for n in ("label", "label_ids") if n in df.columns), None)
    if source is None:
        return df.select(*kept)
    kind = df.schema[source].dataType
    if isinstance(kind, T.ArrayType):
        target = "array<bigint>" if isinstance(kind.elementType, T.IntegralType) else "array<double>"
    else:
        target = "bigint" if isinstance(kind, T.IntegralType) else "double"
    return df.select(F.col(source).cast(target).alias("labels"), *kept)


def joint_labels(df: DataFrame) -> DataFrame:
    """Target of the joint task: a copy of the token ids, and the class label."""
    return df.withColumn(
        "labels", F.struct(F.col("input_ids").alias("lm_labels"), F.col("label").cast("bigint").alias("cls_labels"))
    ).drop("label")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose model inputs are all present."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return df.filter(condition)


def squeeze(vector: Column) -> Column:
    """The only element of a one-element prediction vector."""
    return F.element_at(vector, 1)


def pair_by_position(predictions: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Join predictions to labels on the row position; a row missing on either side is an error."""
    left = predictions.withColumn("_p", F.lit(True))
    right = labels.withColumn("_l", F.lit(True))
    joined = left.join(right, key, "full_outer")
    both = F.col("_p").isNotNull() & F.col("_l").isNotNull()
    ok = F.when(both, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unpaired row "), F.col(key).cast("string"))).cast("boolean")
    )
    return joined.filter(ok).drop("_p", "_l")
