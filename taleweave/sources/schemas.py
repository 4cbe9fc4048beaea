"""Declared schemas of the five source datasets and the class-label domain check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Class names in label order.
CATEGORY_NAMES = ["behavior_based", "objective_based", "emotional_based", "goal_driven"]
ENDING_NAMES = ["ending1", "ending2"]
IMPORTANCE_NAMES = ["sentence1", "sentence2", "sentence3", "sentence4"]

# Column names of the source datasets.
STORY_COLUMNS = ["first_sentence", "second_sentence", "third_sentence", "fourth_sentence", "fifth_sentence"]
CLOZE_CONTEXT = ["InputSentence1", "InputSentence2", "InputSentence3", "InputSentence4"]
CLOZE_ENDINGS = ["RandomFifthSentenceQuiz1", "RandomFifthSentenceQuiz2"]


def class_label(name: str, names: Sequence[str]) -> T.StructField:
    return T.StructField(name, T.IntegerType(), True, {"names": list(names)})


def _strings(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CATEGORY = T.StructType(_strings(["story_id", *STORY_COLUMNS]) + [class_label("label", CATEGORY_NAMES)])
IMPORTANCE = T.StructType(
    _strings(["story_id", *STORY_COLUMNS]) + [T.StructField("label", T.ArrayType(T.LongType()))]
)
CLOZE = T.StructType(
    _strings(["InputStoryid", *CLOZE_CONTEXT, *CLOZE_ENDINGS]) + [class_label("label", ENDING_NAMES)]
)
CLOZE_CSV = T.StructType(
    _strings(["InputStoryid", *CLOZE_CONTEXT, *CLOZE_ENDINGS])
    + [T.StructField("AnswerRightEnding", T.IntegerType())]
)
HUMOR = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_humor", T.LongType()),
        T.StructField("humor_rating", T.DoubleType()),
        T.StructField("humor_controversy", T.DoubleType()),
        T.StructField("offense_rating", T.DoubleType()),
    ]
)
EDIT_PAIRS = T.StructType(
    _strings(["id", "original", "edit", "grades"]) + [T.StructField("label", T.DoubleType())]
)


def in_domain(value: Column, n: int) -> Column:
    return value.isNotNull() & (value >= 0) & (value < n)


def cast_to(df: DataFrame, schema: T.StructType, on_bad: str = "fail") -> DataFrame:
    """Cast to a declared schema; class labels outside their domain fail the job or are flagged in ``bad``."""
    columns: list[Column] = []
    bad: Column = F.lit(False)
    for field in schema.fields:
        names = (field.metadata or {}).get("names")
        value = F.col(field.name).cast(field.dataType)
        if names:
            ok = in_domain(value, len(names))
            bad = bad | ~ok
            if on_bad == "fail":
                message = F.concat(F.lit(f"{field.name} outside its class domain: "), F.coalesce(value.cast("string"), F.lit("null")))
                value = F.when(ok, value).otherwise(F.raise_error(message).cast(field.dataType))
            columns.append(value.alias(field.name, metadata=field.metadata))
        else:
            columns.append(value.alias(field.name))
    if on_bad == "flag":
        columns.append(bad.alias("bad"))
    return df.select(*columns)
