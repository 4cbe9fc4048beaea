"""Readers and writers, checked by writing derived data to the shared folder and reading it back."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from taleweave.functions.arrays import above
from taleweave.operators.evaluate import classification_report
from taleweave.operators.ranking import row_index
from taleweave.operators.shaping import squeeze, total_sequence, zero_based_label, rename_target
from taleweave.operators.splits import split2, split3
from taleweave.operators.stats import label_counts
from taleweave.plans import fixtures as fx
from taleweave.plans.registry import query, r6
from taleweave.session import hand_over, scratch_path
from taleweave.sources import readers, writers
from taleweave.sources.schemas import CATEGORY_NAMES, CLOZE_CONTEXT, CLOZE_ENDINGS, IMPORTANCE_NAMES, STORY_COLUMNS

STORY_TEXT = T.StructType([T.StructField("story_id", T.StringType())] + [T.StructField(c, T.StringType()) for c in STORY_COLUMNS])

HUMOR_TEXT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.DoubleType())]
)

FIELDS_SQL = """
SELECT f[1] AS story_id, f[2] AS first_sentence, f[3] AS second_sentence, f[4] AS third_sentence,
       f[5] AS fourth_sentence, f[6] AS fifth_sentence, f[7] AS label
FROM (SELECT string_split(value, ' | ') AS f FROM delimited_lines) WHERE len(f) = 7
"""


def _line_file(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "story-lines")
    fx.delimited_lines(spark, sf).write.text(path)
    return path


@query("src_story_delimited", FIELDS_SQL, ["delimited_lines"])
def src_story_delimited(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = readers.read_delimited(spark, _line_file(spark, sf), bad="quarantine")
    return good


@query(
    "src_story_quarantine",
    "SELECT value FROM delimited_lines WHERE len(string_split(value, ' | ')) <> 7",
    ["delimited_lines"],
)
def src_story_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = readers.read_delimited(spark, _line_file(spark, sf), bad="quarantine")
    return bad


@query("src_cloze_csv", "SELECT * FROM cloze", ["cloze"])
def src_cloze_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "cloze-csv")
    (
        fx.cloze(spark, sf)
        .select("InputStoryid", *CLOZE_CONTEXT, *CLOZE_ENDINGS, (F.col("label") + 1).alias("AnswerRightEnding"))
        .write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return zero_based_label(rename_target(readers.read_cloze_csv(spark, path), "AnswerRightEnding"))


@query("src_columnar", "SELECT * FROM documents")
def src_columnar(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_columnar(spark, f"{sf}/documents.parquet")


@query(
    "src_story_rest",
    "SELECT doc_id, len(rest) AS n_sentences, array_to_string(rest, ' | ') AS sentences FROM story_rests",
    ["story_rests"],
)
def src_story_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences that make no whole story."""
    return fx.story_rests(spark, sf).select(
        "doc_id", F.size("rest").cast("long").alias("n_sentences"), F.array_join("rest", " | ").alias("sentences")
    )


@query(
    "src_tabular_files",
    """SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('690-' || story_id), story_id)
                      <= ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'validation' ELSE 'train' END AS split FROM stories""",
    ["stories"],
)
def src_tabular_files(spark: SparkSession, sf: str) -> DataFrame:
    marked = split2(fx.stories(spark, sf), "story_id", 0.1, held_name="validation")
    folder = scratch_path(spark, "split-files")
    files = {}
    for name in ("train", "validation"):
        files[name] = f"{folder}/{name}.json"
        marked.filter(F.col("split") == name).drop("split").write.json(files[name])
    return readers.read_split_files(spark, files, STORY_TEXT)


@query(
    "src_tabular_csv",
    """SELECT id, text, humor_rating AS label, CASE WHEN id % 3 = 2 THEN 'test' WHEN id % 3 = 1 THEN 'validation' ELSE 'train' END AS split
       FROM humor""",
    ["humor"],
)
def src_tabular_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Train, validation and test parts as csv; texts hold line ends and quotes."""
    rows = fx.humor(spark, sf).select("id", "text", F.col("humor_rating").alias("label"))
    folder = scratch_path(spark, "split-csv")
    files = {}
    for k, name in enumerate(("train", "validation", "test")):
        files[name] = f"{folder}/{name}.csv"
        part = rows.filter(F.col("id") % 3 == k)
        writer = part.write.option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(files[name])
    return readers.read_split_files(spark, files, HUMOR_TEXT)


CATEGORY_SQL = str(list(CATEGORY_NAMES))

PRED_SQL = f"""
SELECT {CATEGORY_SQL}[pred + 1] AS prediction,
       {CATEGORY_SQL}[label + 1] AS label FROM cat_preds
"""


def write_category_predictions(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "predictions")
    df = row_index(fx.cat_preds(spark, sf).select("row_id", "pred", "label"), "row_id")
    line = writers.single_label_line(F.col("row_index"), F.col("pred"), F.col("label"), CATEGORY_NAMES)
    writers.write_lines(df, "row_index", line, path)
    return path


@query("src_prediction_lines", PRED_SQL, ["cat_preds"])
def src_prediction_lines(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_prediction_lines(spark, write_category_predictions(spark, sf))


@query(
    "src_from_columns",
    "SELECT label, count(*) AS n FROM story_labels GROUP BY label",
    ["story_labels"],
)
def src_from_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A small result through a pandas frame and back: one row per class of the label domain."""
    small = label_counts(fx.story_labels(spark, sf)).toPandas()
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType())])
    return readers.from_columns(spark, small, schema)


@query(
    "snk_columnar",
    """SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('690-' || story_id), story_id)
                      <= ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM stories""",
    ["stories"],
)
def snk_columnar(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "columnar")
    writers.write_columnar(split2(fx.stories(spark, sf), "story_id"), path)
    return readers.read_columnar(spark, path)


HEADER_SQL = "SELECT 'index' || chr(9) || 'prediction' AS value UNION ALL "


@query(
    "snk_pred_single",
    HEADER_SQL
    + f"""SELECT (row_number() OVER (ORDER BY row_id) - 1) || ': '
         || {CATEGORY_SQL}[pred + 1] || ' / '
         || {CATEGORY_SQL}[label + 1] FROM cat_preds""",
    ["cat_preds"],
)
def snk_pred_single(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.text(write_category_predictions(spark, sf))


@query(
    "snk_pred_multi",
    HEADER_SQL
    + """SELECT (row_number() OVER (ORDER BY row_id) - 1) || ': ' || CASE WHEN p = '' THEN '[]' ELSE '[''' || p || ''']' END
         || ' / ' || CASE WHEN y = '' THEN '[]' ELSE '[''' || y || ''']' END
         FROM (SELECT row_id, coalesce(string_agg('sentence' || i, ''', ''' ORDER BY i) FILTER (WHERE p = 1), '') AS p,
                      coalesce(string_agg('sentence' || i, ''', ''' ORDER BY i) FILTER (WHERE y = 1), '') AS y
               FROM ml_cells GROUP BY row_id)""",
    ["ml_cells"],
)
def snk_pred_multi(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    df = row_index(fx.ml_logits(spark, sf).select("row_id", above(F.col("z")).alias("pred"), "label"), "row_id")
    line = writers.multi_label_line(F.col("row_index"), F.col("pred"), F.col("label"), IMPORTANCE_NAMES)
    writers.write_lines(df, "row_index", line, path)
    return spark.read.text(path)


@query(
    "snk_pred_regression",
    HEADER_SQL + "SELECT (row_number() OVER (ORDER BY row_id) - 1) || chr(9) || printf('%.3f', vector[1]) FROM reg_preds",
    ["reg_preds"],
)
def snk_pred_regression(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    df = row_index(fx.reg_preds(spark, sf).select("row_id", squeeze(F.col("vector")).alias("pred")), "row_id")
    writers.write_lines(df, "row_index", writers.regression_line(F.col("row_index"), F.col("pred")), path)
    return spark.read.text(path)


@query(
    "snk_generated",
    HEADER_SQL
    + """SELECT (row_number() OVER (ORDER BY pair_id) - 1) || ': '
         || regexp_replace(candidate || ' ' || reference, '[\\r\\n]+', ' ', 'g') || ' / '
         || regexp_replace(reference, '[\\r\\n]+', ' ', 'g') FROM text_pairs""",
    ["text_pairs"],
)
def snk_generated(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "generated")
    df = row_index(fx.text_pairs(spark, sf), "pair_id")
    text = total_sequence(F.col("candidate"), F.col("reference"))
    writers.write_lines(
        df, "row_index", writers.generated_line(F.col("row_index"), text, F.col("reference")), path
    )
    return spark.read.text(path)


@query(
    "snk_metrics_json",
    """SELECT round(avg((label = pred)::INTEGER), 6) AS accuracy, count(*) AS samples FROM cat_preds""",
    ["cat_preds"],
)
def snk_metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    report = classification_report(fx.cat_preds(spark, sf))
    writers.write_metrics(report, path)
    return spark.read.schema(report.schema).json(path).select(r6("accuracy").alias("accuracy"), "samples")


@query(
    "snk_output_guard",
    """WITH g AS (SELECT doc_id, quality FROM labels WHERE quality = 1),
        n AS (SELECT (SELECT count(*) FROM g) AS good, (SELECT sum(doc_id) FROM g) AS good_ids,
                     (SELECT count(*) FROM labels) AS every, (SELECT sum(doc_id) FROM labels) AS every_ids)
       SELECT 'written' AS step, false AS refused, good AS n_rows, good_ids::BIGINT AS ids FROM n
       UNION ALL SELECT 'refused', true, good, good_ids::BIGINT FROM n
       UNION ALL SELECT 'overwritten', false, every, every_ids::BIGINT FROM n
       UNION ALL SELECT 'failed', true, every, every_ids::BIGINT FROM n""",
)
def snk_output_guard(spark: SparkSession, sf: str) -> DataFrame:
    """What a target holds after a write, a refused one, an overwrite, and an overwrite that fails half-way."""
    labels = fx.table(spark, sf, "labels").select("doc_id", "quality")
    bad = F.raise_error(F.lit("a row that can't be written")).cast("bigint")
    broken = labels.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 4, bad).otherwise(F.col("doc_id")))
    path = scratch_path(spark, "guarded")
    state = None
    for step, rows, overwrite in (
        ("written", labels.filter("quality = 1"), False),
        ("refused", labels, False),
        ("overwritten", labels, True),
        ("failed", broken, True),
    ):
        try:
            writers.write_columnar(rows, path, overwrite)
            refused = False
        except (FileExistsError, PySparkException):
            refused = True
        seen = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("ids"))
        # what the target holds now, before the next step changes it
        seen = hand_over(seen.select(F.lit(step).alias("step"), F.lit(refused).alias("refused"), "n_rows", "ids"), "guard")
        state = seen if state is None else state.unionByName(seen)
    return state
