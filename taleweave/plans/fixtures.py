"""Views over the driver tables in the shapes of the library's inputs, once in Spark and once in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from taleweave.functions.arrays import argmax
from taleweave.functions.text import (
    one_line,
    sentences,
    whitespace_tokens,
    words_by_any_space,
)
from taleweave.operators.ranking import row_index
from taleweave.session import hand_over
from taleweave.sources.readers import FIELD_SEPARATOR
from taleweave.sources.schemas import STORY_COLUMNS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work on whole texts. A row group is one task's work: where the files have fewer than there are
    cores, which only a small table has, rows are dealt out first."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def _sentence_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of each document and how many whole stories they make."""
    parts = texts(spark, sf).select("doc_id", F.explode(F.array(sentences(F.col("text")))).alias("p"))
    return parts.withColumn("whole", F.floor(F.size("p") / len(STORY_COLUMNS)).cast("int"))


def stories(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive groups of five sentences of every document, keyed by document and group."""
    width = len(STORY_COLUMNS)
    parts = _sentence_lists(spark, sf).filter("whole > 0")
    parts = parts.select("doc_id", "p", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    return parts.select(
        F.concat_ws("-", "doc_id", "part").alias("story_id"),
        *[F.get("p", F.col("part") * width + i).alias(n) for i, n in enumerate(STORY_COLUMNS)],
    )


def story_rests(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of a document that are too few for another story, in order."""
    parts = _sentence_lists(spark, sf).withColumn("rest", F.expr(f"slice(p, whole * {len(STORY_COLUMNS)} + 1, size(p))"))
    return parts.filter(F.size("rest") > 0).select("doc_id", "rest")


def story_document(story_id: str = "story_id"):
    """The document a story comes from."""
    return F.substring_index(story_id, "-", 1).cast("long")


def story_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"))
    return stories(spark, sf).withColumn("doc_id", story_document()).join(labels, "doc_id").drop("doc_id")


def story_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Index list of the first four sentences that hold a quarter or more of their length."""
    lengths = [F.length(c) for c in STORY_COLUMNS[:4]]
    whole = lengths[0] + lengths[1] + lengths[2] + lengths[3]
    marks = [F.when(n * 4 >= whole, F.lit(str(i))) for i, n in enumerate(lengths)]
    return stories(spark, sf).withColumn("index_list", F.concat_ws(",", *marks))


def cloze(spark: SparkSession, sf: str) -> DataFrame:
    """A story with its own ending and the ending of the next story in order; the first follows the last.

    Only keys are ranked; the labels alternate along the order.
    """
    s = stories(spark, sf)
    order = hand_over(row_index(s.select("story_id"), "story_id"), "story-order")
    last = order.agg(F.max("row_index")).first()[0]
    endings = s.select("story_id", F.col("fifth_sentence").alias("wrong")).join(order, "story_id")
    before = F.when(F.col("row_index") == 0, F.lit(last)).otherwise(F.col("row_index") - 1)
    other = endings.select(before.alias("row_index"), "wrong").join(order, "row_index").select("story_id", "wrong", "row_index")
    label = (F.col("row_index") % 2).cast("int")
    right, wrong = F.col("fifth_sentence"), F.col("wrong")
    return s.join(other, "story_id").select(
        F.col("story_id").alias("InputStoryid"),
        *[F.col(n).alias(f"InputSentence{i + 1}") for i, n in enumerate(STORY_COLUMNS[:4])],
        F.when(label == 0, right).otherwise(wrong).alias("RandomFifthSentenceQuiz1"),
        F.when(label == 0, wrong).otherwise(right).alias("RandomFifthSentenceQuiz2"),
        label.alias("label"),
    )


def delimited_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = story_labels(spark, sf)
    fields = [F.col("story_id"), *[one_line(F.col(c)) for c in STORY_COLUMNS], F.col("label").cast("string")]
    return s.select(F.concat_ws(FIELD_SEPARATOR, *fields).alias("value"))


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive turns of a conversation as candidate and reference."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return turns.join(following, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
        F.col("text").alias("candidate"),
        "reference",
    )


def edit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    gap = words_by_any_space(F.col("candidate")) - words_by_any_space(F.col("reference"))
    return text_pairs(spark, sf).select(
        F.col("pair_id").alias("id"),
        F.col("candidate").alias("original"),
        F.col("reference").alias("edit"),
        gap.cast("double").alias("label"),
    )


def humor(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("quality").cast("long").alias("is_humor"),
        (F.col("quality") * 2.0 + F.col("toxic")).alias("humor_rating"),
    )


def _scores(n: int):
    """All values of the vector, added up by position modulo ``n``."""

    def folded(i):
        own = F.filter("embedding", lambda _, k: k % n == i)
        return F.aggregate(own, F.lit(0.0), lambda total, x: total + x.cast("double")) * 10

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), folded)


def cls_logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), _scores(10).alias("z"), "label")


def cat_logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), _scores(4).alias("z"), (F.col("label") % 4).alias("label")
    )


def cat_preds(spark: SparkSession, sf: str) -> DataFrame:
    return cat_logits(spark, sf).withColumn("pred", argmax(F.col("z")))


def ml_logits(spark: SparkSession, sf: str) -> DataFrame:
    bits = F.array(*[F.shiftright("label", i).bitwiseAND(F.lit(1)).cast("int") for i in range(4)])
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), _scores(4).alias("z"), bits.alias("label"))


def reg_preds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), _scores(1).alias("vector"), F.col("label").cast("double").alias("label")
    )


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(
        "doc_id", F.floor(F.col("doc_id") / 1000).alias("batch"), whitespace_tokens(F.col("text")).alias("tokens")
    )


# Fixed values for the SQL side: white space and letter folding as in taleweave.functions.text.
SQL_UNICODE_SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
SQL_WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f]"


def sql_ws_tokens(text: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({text}, '[ \\t\\n\\r]+', ' ', 'g'), ' '), ' '), lambda t: t <> '')"


def sql_word_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{SQL_WORD_OR_MARK}')"


def sql_any_space_count(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '{SQL_UNICODE_SPACE}'), lambda t: t <> ''))"


def sql_joined(values: str, separator: str = ",") -> str:
    return f"coalesce(array_to_string(list_transform({values}, lambda x: x::VARCHAR), '{separator}'), '')"


def sql_digest(values: str) -> str:
    return f"md5({sql_joined(values, ' ')})"


_STORY_COLS = ", ".join(STORY_COLUMNS)
_SCORES = (
    "list_transform(range({n}), lambda i: list_reduce(list_transform(range(i + 1, len(embedding) + 1, {n}),"
    " lambda k: embedding[k]::DOUBLE), lambda a, b: a + b) * 10)"
)
_SENTENCES = """SELECT doc_id, list_filter(string_split_regex(text, '[.!?][ \\t\\n\\r\\f]+'),
                lambda s: regexp_matches(s, '[^ \\t\\n\\r\\f]')) AS p FROM documents"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "stories": (
        (),
        f"""SELECT doc_id || '-' || g AS story_id, p[5 * g + 1] AS first_sentence, p[5 * g + 2] AS second_sentence,
                  p[5 * g + 3] AS third_sentence, p[5 * g + 4] AS fourth_sentence, p[5 * g + 5] AS fifth_sentence
           FROM (SELECT doc_id, p, unnest(range(len(p) // 5)) AS g FROM ({_SENTENCES}))""",
    ),
    "story_rests": (
        (),
        f"SELECT doc_id, p[len(p) // 5 * 5 + 1:] AS rest FROM ({_SENTENCES}) WHERE len(p) % 5 > 0",
    ),
    "story_labels": (
        ("stories",),
        """SELECT s.*, (quality * 2 + toxic)::INTEGER AS label FROM stories s
           JOIN labels l ON l.doc_id = split_part(s.story_id, '-', 1)::BIGINT""",
    ),
    "story_importance": (
        ("stories",),
        """SELECT *, array_to_string(list_filter([
                  CASE WHEN length(first_sentence) * 4 >= t THEN '0' END,
                  CASE WHEN length(second_sentence) * 4 >= t THEN '1' END,
                  CASE WHEN length(third_sentence) * 4 >= t THEN '2' END,
                  CASE WHEN length(fourth_sentence) * 4 >= t THEN '3' END], lambda x: x IS NOT NULL), ',') AS index_list
           FROM (SELECT *, length(first_sentence) + length(second_sentence) + length(third_sentence)
                        + length(fourth_sentence) AS t FROM stories)""",
    ),
    "cloze": (
        ("stories",),
        """SELECT story_id AS InputStoryid, first_sentence AS InputSentence1, second_sentence AS InputSentence2,
                  third_sentence AS InputSentence3, fourth_sentence AS InputSentence4,
                  CASE WHEN label = 0 THEN fifth_sentence ELSE wrong END AS RandomFifthSentenceQuiz1,
                  CASE WHEN label = 0 THEN wrong ELSE fifth_sentence END AS RandomFifthSentenceQuiz2, label
           FROM (SELECT *, ((row_number() OVER (ORDER BY story_id) - 1) % 2)::INTEGER AS label,
                        coalesce(lead(fifth_sentence) OVER (ORDER BY story_id),
                                 first_value(fifth_sentence) OVER (ORDER BY story_id)) AS wrong FROM stories)""",
    ),
    "delimited_lines": (
        ("story_labels",),
        "SELECT concat_ws(' | ', story_id, "
        + ", ".join(f"regexp_replace({c}, '[\\r\\n]+', ' ', 'g')" for c in STORY_COLUMNS)
        + ", label::VARCHAR) AS value FROM story_labels",
    ),
    "text_pairs": (
        (),
        """SELECT a.conv_id || '-' || a.turn AS pair_id, a.text AS candidate, b.text AS reference
           FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    ),
    "edit_pairs": (
        ("text_pairs",),
        f"""SELECT pair_id AS id, candidate AS original, reference AS edit,
                   ({sql_any_space_count('candidate')} - {sql_any_space_count('reference')})::DOUBLE AS label
            FROM text_pairs""",
    ),
    "humor": (
        (),
        """SELECT d.doc_id AS id, d.text, quality::BIGINT AS is_humor, (quality * 2 + toxic)::DOUBLE AS humor_rating
           FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "cls_logits": ((), f"SELECT vec_id AS row_id, {_SCORES.format(n=10)} AS z, label FROM embeddings"),
    "cat_logits": ((), f"SELECT vec_id AS row_id, {_SCORES.format(n=4)} AS z, (label % 4)::INTEGER AS label FROM embeddings"),
    "cat_preds": (
        ("cat_logits",),
        "SELECT *, (list_position(z, list_max(z)) - 1)::INTEGER AS pred FROM cat_logits",
    ),
    "ml_logits": (
        (),
        f"""SELECT vec_id AS row_id, {_SCORES.format(n=4)} AS z,
                   [label & 1, (label >> 1) & 1, (label >> 2) & 1, (label >> 3) & 1] AS label FROM embeddings""",
    ),
    "ml_cells": (
        ("ml_logits",),
        """SELECT row_id, i, z[i] AS z, label[i] AS y, CASE WHEN z[i] > 0.5 THEN 1 ELSE 0 END AS p
           FROM ml_logits, unnest([1, 2, 3, 4]) AS u(i)""",
    ),
    "reg_preds": ((), f"SELECT vec_id AS row_id, {_SCORES.format(n=1)} AS vector, label::DOUBLE AS label FROM embeddings"),
    "doc_tokens": (
        (),
        f"SELECT doc_id, doc_id // 1000 AS batch, {sql_ws_tokens('text')} AS tokens FROM documents",
    ),
    "bigrams": (
        ("doc_tokens",),
        """SELECT prev, next, count(*) AS n FROM (
             SELECT token AS prev, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS next
             FROM (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM doc_tokens))
           WHERE next IS NOT NULL GROUP BY 1, 2""",
    ),
}


def with_views(sql: str, views: Sequence[str]) -> str:
    """Put the named views, and the ones they read, in front of an SQL text."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    if not order:
        return sql
    parts = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    body = sql.strip()
    # An oracle may go on with views of its own.
    recursive = body.upper().startswith("RECURSIVE")
    if recursive:
        body = body[len("RECURSIVE") :].strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"
