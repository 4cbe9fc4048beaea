"""Prediction metrics and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taleweave.functions.arrays import above, argmax, softmax
from taleweave.operators import evaluate, losses, splits, stats
from taleweave.operators.shaping import squeeze
from taleweave.plans import fixtures as fx
from taleweave.plans.registry import joined, query, r6
from taleweave.plans.source_queries import write_category_predictions
from taleweave.sources.readers import read_prediction_lines

NLL_SQL = "(ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[{y} + 1])"
PRF_SQL = """
, c AS (SELECT DISTINCT label AS c FROM {t} UNION SELECT DISTINCT pred FROM {t}),
s AS (SELECT c, (SELECT count(*) FROM {t} WHERE label = c AND pred = c)::DOUBLE AS tp,
             (SELECT count(*) FROM {t} WHERE label = c)::DOUBLE AS sup,
             (SELECT count(*) FROM {t} WHERE pred = c)::DOUBLE AS pp FROM c),
m AS (SELECT sup, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS r FROM s),
prf AS (SELECT round(sum(sup * p) / sum(sup), 6) AS "precision", round(sum(sup * r) / sum(sup), 6) AS recall,
               round(sum(sup * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) / sum(sup), 6) AS f1,
               round(avg(CASE WHEN sup > 0 THEN r END), 6) AS balanced_accuracy FROM m)
"""


def preds(spark: SparkSession, sf: str) -> DataFrame:
    return fx.cat_preds(spark, sf)


def ml_preds(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ml_logits(spark, sf).withColumn("pred", above(F.col("z")))


def reg(spark: SparkSession, sf: str) -> DataFrame:
    return fx.reg_preds(spark, sf).select("row_id", squeeze(F.col("vector")).alias("pred"), "label")


@query("evl_argmax", "SELECT row_id, pred FROM cat_preds", ["cat_preds"])
def evl_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return fx.cat_logits(spark, sf).select("row_id", argmax(F.col("z")).alias("pred"))


@query(
    "evl_threshold",
    "SELECT row_id, string_agg(p, ',' ORDER BY i) AS pred FROM ml_cells GROUP BY row_id",
    ["ml_cells"],
)
def evl_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ml_logits(spark, sf).select("row_id", joined(above(F.col("z"))).alias("pred"))


@query("evl_confusion", "SELECT label, pred, count(*) AS n FROM cat_preds GROUP BY label, pred", ["cat_preds"])
def evl_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(preds(spark, sf))


@query("evl_accuracy", "SELECT round(avg((label = pred)::INTEGER), 6) AS accuracy FROM cat_preds", ["cat_preds"])
def evl_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.accuracy(preds(spark, sf)).select(r6("accuracy").alias("accuracy"))


@query(
    "evl_balanced_accuracy",
    """SELECT round(avg(r), 6) AS balanced_accuracy
       FROM (SELECT label, avg((label = pred)::INTEGER) AS r FROM cat_preds GROUP BY label)""",
    ["cat_preds"],
)
def evl_balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.balanced_accuracy(preds(spark, sf)).select(r6("balanced_accuracy").alias("balanced_accuracy"))


@query(
    "evl_weighted_prf",
    PRF_SQL.format(t="cat_preds").replace(",", "WITH", 1) + 'SELECT "precision", recall, f1 FROM prf',
    ["cat_preds"],
)
def evl_weighted_prf(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.weighted_prf(preds(spark, sf)).select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "evl_subset_accuracy",
    """SELECT round(avg(same), 6) AS accuracy FROM (SELECT row_id, min((y = p)::INTEGER) AS same FROM ml_cells GROUP BY row_id)""",
    ["ml_cells"],
)
def evl_subset_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.multilabel_report(ml_preds(spark, sf), 4).select(r6("accuracy").alias("accuracy"))


@query(
    "evl_hamming_loss",
    "SELECT round(avg((y <> p)::INTEGER), 6) AS hamming_loss FROM ml_cells",
    ["ml_cells"],
)
def evl_hamming_loss(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.multilabel_report(ml_preds(spark, sf), 4).select(r6("hamming_loss").alias("hamming_loss"))


@query(
    "evl_multilabel_prf",
    """WITH s AS (SELECT i, sum(y * p)::DOUBLE AS tp, sum(y)::DOUBLE AS sup, sum(p)::DOUBLE AS pp FROM ml_cells GROUP BY i),
         m AS (SELECT sup, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS r FROM s)
       SELECT round(sum(sup * p) / sum(sup), 6) AS "precision", round(sum(sup * r) / sum(sup), 6) AS recall,
              round(sum(sup * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) / sum(sup), 6) AS f1 FROM m""",
    ["ml_cells"],
)
def evl_multilabel_prf(spark: SparkSession, sf: str) -> DataFrame:
    report = evaluate.multilabel_report(ml_preds(spark, sf), 4)
    return report.select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("evl_mse", "SELECT round(avg((vector[1] - label) * (vector[1] - label)), 6) AS mse FROM reg_preds", ["reg_preds"])
def evl_mse(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.mean_squared_error(reg(spark, sf)).select(r6("mse").alias("mse"))


@query(
    "evl_elementwise_accuracy",
    "SELECT round(avg((round(vector[1]) = label)::INTEGER), 6) AS accuracy FROM reg_preds",
    ["reg_preds"],
)
def evl_elementwise_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rounded = reg(spark, sf).withColumn("pred", F.round("pred"))
    return evaluate.elementwise_accuracy(rounded).select(r6("accuracy").alias("accuracy"))


@query(
    "evl_combined_score",
    PRF_SQL.format(t="cat_preds").replace(",", "WITH", 1)
    + """SELECT a AS accuracy, f1, round((a + f1) / 2, 5) AS combined_score
         FROM prf, (SELECT round(avg((label = pred)::INTEGER), 6) AS a FROM cat_preds)""",
    ["cat_preds"],
)
def evl_combined_score(spark: SparkSession, sf: str) -> DataFrame:
    report = evaluate.classification_report(preds(spark, sf)).select(
        r6("accuracy").alias("accuracy"), r6("f1").alias("f1")
    )
    scored = evaluate.with_combined_score(report, ["accuracy", "f1"])
    return scored.withColumn("combined_score", r6("combined_score", 5))


REPORT_COLUMNS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")


@query(
    "evl_posthoc_report",
    PRF_SQL.format(t="cat_preds").replace(",", "WITH", 1)
    + """SELECT (SELECT round(avg((label = pred)::INTEGER), 6) FROM cat_preds) AS accuracy, balanced_accuracy,
                "precision", recall, f1 FROM prf""",
    ["cat_preds"],
)
def evl_posthoc_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_prediction_lines(spark, write_category_predictions(spark, sf))
    report = evaluate.classification_report(lines, "label", "prediction")
    return report.select(*[r6(c).alias(c) for c in REPORT_COLUMNS])


SPLIT_PREDS_SQL = """
WITH a AS (SELECT row_id, row_number() OVER (ORDER BY md5('690-' || row_id), row_id) AS r, count(*) OVER () AS n FROM cat_preds),
     h AS (SELECT row_id, row_number() OVER (ORDER BY md5('690-held-' || row_id), row_id) AS r, count(*) OVER () AS n
           FROM a WHERE r <= ceil(0.2::DOUBLE * n)),
     t AS (SELECT label, pred, CASE WHEN h.r <= ceil(0.5::DOUBLE * h.n) THEN 'test' ELSE 'validation' END AS split
           FROM h JOIN cat_preds USING (row_id)),
     c AS (SELECT DISTINCT split, label AS c FROM t UNION SELECT DISTINCT split, pred FROM t),
     s AS (SELECT c.split, c, count(*) FILTER (WHERE label = c AND pred = c)::DOUBLE AS tp,
                  count(*) FILTER (WHERE label = c)::DOUBLE AS sup, count(*) FILTER (WHERE pred = c)::DOUBLE AS pp
           FROM c JOIN t ON t.split = c.split GROUP BY c.split, c),
     m AS (SELECT split, sup, tp, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS r FROM s)
SELECT split, round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(CASE WHEN sup > 0 THEN r END), 6) AS balanced_accuracy,
       round(sum(sup * p) / sum(sup), 6) AS "precision", round(sum(sup * r) / sum(sup), 6) AS recall,
       round(sum(sup * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) / sum(sup), 6) AS f1,
       sum(sup)::BIGINT AS samples FROM m GROUP BY split
"""


@query("evl_split_report", SPLIT_PREDS_SQL, ["cat_preds"])
def evl_split_report(spark: SparkSession, sf: str) -> DataFrame:
    marked = splits.split3(preds(spark, sf).select("row_id", "label", "pred"), "row_id").filter("split <> 'train'")
    report = evaluate.classification_report(marked, by=["split"])
    return report.select("split", *[r6(c).alias(c) for c in REPORT_COLUMNS], "samples")


@query(
    "los_softmax",
    """SELECT row_id, i::INTEGER AS class, round(exp(z[i + 1] - list_max(z))
              / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS p
       FROM cls_logits, unnest(range(10)) AS u(i)""",
    ["cls_logits"],
)
def los_softmax(spark: SparkSession, sf: str) -> DataFrame:
    cells = fx.cls_logits(spark, sf).select("row_id", F.posexplode(softmax(F.col("z"))).alias("class", "p"))
    return cells.withColumn("p", r6("p"))


@query("los_cross_entropy", f"SELECT round(avg({NLL_SQL.format(y='label')}), 6) AS loss FROM cls_logits", ["cls_logits"])
def los_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return losses.cross_entropy(fx.cls_logits(spark, sf)).select(r6("loss").alias("loss"))


@query(
    "los_weighted_cross_entropy",
    f"""WITH w AS (SELECT label, (SELECT count(*) FROM cls_logits)
                          / ((SELECT count(DISTINCT label) FROM cls_logits) * count(*))::DOUBLE AS w FROM cls_logits GROUP BY label)
        SELECT round(sum(w * {NLL_SQL.format(y='l.label')}) / sum(w), 6) AS loss FROM cls_logits l JOIN w ON w.label = l.label""",
    ["cls_logits"],
)
def los_weighted_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.cls_logits(spark, sf)
    return losses.weighted_cross_entropy(rows, stats.class_weights(rows)).select(r6("loss").alias("loss"))


@query(
    "los_bce_logits",
    "SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS loss FROM ml_cells",
    ["ml_cells"],
)
def los_bce_logits(spark: SparkSession, sf: str) -> DataFrame:
    return losses.bce_with_logits(fx.ml_logits(spark, sf)).select(r6("loss").alias("loss"))


@query("los_mse", "SELECT round(avg(pow(vector[1] - label, 2)), 6) AS loss FROM reg_preds", ["reg_preds"])
def los_mse(spark: SparkSession, sf: str) -> DataFrame:
    return losses.mse_loss(reg(spark, sf), "pred").select(r6("loss").alias("loss"))


SEQUENCE_SQL = """
WITH q AS (SELECT row_id // 20 AS seq, row_id % 20 AS pos, z, label FROM cls_logits),
     x AS (SELECT a.z, b.label AS y FROM q a JOIN q b ON b.seq = a.seq AND b.pos = a.pos + 1)
"""


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Per-token rows of sequences of 20: scores, and the class as the token."""
    return fx.cls_logits(spark, sf).select(
        F.floor(F.col("row_id") / 20).alias("seq"), (F.col("row_id") % 20).alias("pos"), "z", "label"
    )


@query(
    "los_next_token",
    SEQUENCE_SQL + f"SELECT round(avg({NLL_SQL.format(y='y')}), 6) AS loss, count(*) AS n FROM x",
    ["cls_logits"],
)
def los_next_token(spark: SparkSession, sf: str) -> DataFrame:
    rows = losses.next_token_nll(_sequences(spark, sf), "seq", "pos", "label")
    return losses.mean_loss(rows).select(r6("loss").alias("loss"), "n")


@query(
    "los_next_token_no_pad",
    SEQUENCE_SQL + f"SELECT round(avg({NLL_SQL.format(y='y')}), 6) AS loss, count(*) AS n FROM x WHERE y <> 0",
    ["cls_logits"],
)
def los_next_token_no_pad(spark: SparkSession, sf: str) -> DataFrame:
    rows = losses.next_token_nll(_sequences(spark, sf), "seq", "pos", "label", pad_token=0)
    return losses.mean_loss(rows).select(r6("loss").alias("loss"), "n")


@query(
    "los_perplexity",
    SEQUENCE_SQL + f"SELECT round(exp(avg({NLL_SQL.format(y='y')})), 6) AS perplexity FROM x",
    ["cls_logits"],
)
def los_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    rows = losses.next_token_nll(_sequences(spark, sf), "seq", "pos", "label")
    return losses.perplexity(rows).select(r6("perplexity").alias("perplexity"))


@query(
    "los_joint",
    SEQUENCE_SQL
    + f"""SELECT round((SELECT avg({NLL_SQL.format(y='y')}) FROM x) + (SELECT avg({NLL_SQL.format(y='label')}) FROM cls_logits), 6) AS loss,
                 round((SELECT avg({NLL_SQL.format(y='label')}) FROM cls_logits), 6) AS class_only""",
    ["cls_logits"],
)
def los_joint(spark: SparkSession, sf: str) -> DataFrame:
    lm = losses.mean_loss(losses.next_token_nll(_sequences(spark, sf), "seq", "pos", "label")).select("loss")
    both = losses.cross_entropy(fx.cls_logits(spark, sf)).select(
        F.col("loss").alias("cls"), lm.scalar().alias("lm")
    )
    return both.select(
        r6(losses.joint(F.col("lm"), F.col("cls"))).alias("loss"),
        r6(losses.joint(F.lit(None).cast("double"), F.col("cls"))).alias("class_only"),
    )
