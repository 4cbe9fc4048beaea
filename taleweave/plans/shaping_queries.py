"""Projections, filters, positional joins, splits and statistics."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from taleweave.functions.text import (
    names_where,
    stop_truncate,
    whitespace_tokens,
    word_tokens,
    words_by_any_space,
    words_by_single_space,
)
from taleweave.operators import shaping, splits, stats
from taleweave.operators.batched import map_batches, map_groups
from taleweave.operators.ngram import top_k
from taleweave.operators.ranking import row_index
from taleweave.operators.similarity import is_special, marked_tokens
from taleweave.operators.tokens import pair_counts
from taleweave.plans import fixtures as fx
from taleweave.plans.registry import joined, query, r6
from taleweave.sources import readers
from taleweave.sources.schemas import (
    CATEGORY_NAMES,
    ENDING_NAMES,
    IMPORTANCE_NAMES,
    cast_to,
    class_label,
)
from taleweave.sources.writers import label_id, label_name
# Spelled out for the SQL side.
STORY_SQL = "first_sentence || ' ' || second_sentence || ' ' || third_sentence || ' ' || fourth_sentence || ' ' || fifth_sentence"
CONTEXT_SQL = "InputSentence1 || ' ' || InputSentence2 || ' ' || InputSentence3 || ' ' || InputSentence4"
RIGHT_SQL = "CASE WHEN label = 0 THEN RandomFifthSentenceQuiz1 ELSE RandomFifthSentenceQuiz2 END"


@query("prj_rename", "SELECT id, humor_rating AS label FROM humor", ["humor"])
def prj_rename(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.rename_target(fx.humor(spark, sf), "humor_rating").select("id", "label")


@query("prj_label_shift", "SELECT InputStoryid, label FROM cloze", ["cloze"])
def prj_label_shift(spark: SparkSession, sf: str) -> DataFrame:
    answers = fx.cloze(spark, sf).select("InputStoryid", (F.col("label") + 1).alias("label"))
    return shaping.zero_based_label(answers)


@query(
    "prj_cast_domain",
    """SELECT row_id::VARCHAR AS row_id, label::INTEGER AS label,
              (label < 0 OR label >= 4)::INTEGER AS bad FROM cls_logits""",
    ["cls_logits"],
)
def prj_cast_domain(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType([T.StructField("row_id", T.StringType()), class_label("label", CATEGORY_NAMES)])
    flagged = cast_to(fx.cls_logits(spark, sf), schema, on_bad="flag")
    return flagged.withColumn("bad", F.col("bad").cast("int"))


@query(
    "prj_label_decode",
    """SELECT InputStoryid, CASE WHEN label = 0 THEN 'ending1' ELSE 'ending2' END AS name, label AS back FROM cloze""",
    ["cloze"],
)
def prj_label_decode(spark: SparkSession, sf: str) -> DataFrame:
    named = fx.cloze(spark, sf).select("InputStoryid", label_name(F.col("label"), ENDING_NAMES).alias("name"))
    return named.withColumn("back", label_id(F.col("name"), ENDING_NAMES))


@query(
    "prj_multihot_encode",
    """SELECT story_id, index_list, (index_list LIKE '%0%')::INTEGER || ',' || (index_list LIKE '%1%')::INTEGER || ','
              || (index_list LIKE '%2%')::INTEGER || ',' || (index_list LIKE '%3%')::INTEGER AS label FROM story_importance""",
    ["story_importance"],
)
def prj_multihot_encode(spark: SparkSession, sf: str) -> DataFrame:
    return fx.story_importance(spark, sf).select(
        "story_id", "index_list", joined(readers.multihot(F.col("index_list"))).alias("label")
    )


@query(
    "prj_multihot_decode",
    """SELECT row_id, coalesce(string_agg('sentence' || i, ',' ORDER BY i) FILTER (WHERE y = 1), '') AS names
       FROM ml_cells GROUP BY row_id""",
    ["ml_cells"],
)
def prj_multihot_decode(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ml_logits(spark, sf).select(
        "row_id", F.array_join(names_where(F.col("label"), IMPORTANCE_NAMES), ",").alias("names")
    )


@query(
    "prj_text_cloze",
    f"""SELECT InputStoryid, {CONTEXT_SQL} || ' ' || RandomFifthSentenceQuiz1 || ' ' || RandomFifthSentenceQuiz2 AS text
        FROM cloze""",
    ["cloze"],
)
def prj_text_cloze(spark: SparkSession, sf: str) -> DataFrame:
    return fx.cloze(spark, sf).select("InputStoryid", shaping.cloze_text().alias("text"))


@query("prj_text_story", f"SELECT story_id, {STORY_SQL} AS text FROM stories", ["stories"])
def prj_text_story(spark: SparkSession, sf: str) -> DataFrame:
    return fx.stories(spark, sf).select("story_id", shaping.story_text().alias("text"))


@query(
    "prj_prompt_reference",
    f"SELECT InputStoryid, {CONTEXT_SQL} AS prompt, {RIGHT_SQL} AS reference FROM cloze",
    ["cloze"],
)
def prj_prompt_reference(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.prompt_reference(fx.cloze(spark, sf), "InputStoryid", cloze=True)


@query(
    "prj_prompt_reference_story",
    """SELECT story_id, first_sentence || ' ' || second_sentence || ' ' || third_sentence || ' ' || fourth_sentence AS prompt,
              fifth_sentence AS reference FROM stories""",
    ["stories"],
)
def prj_prompt_reference_story(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.prompt_reference(fx.stories(spark, sf), "story_id", cloze=False)


@query(
    "prj_lm_text",
    f"""SELECT InputStoryid, {CONTEXT_SQL} || ' ' || {RIGHT_SQL} || ' </s>' AS text,
               {CONTEXT_SQL} || ' [SEP] ' || {RIGHT_SQL} || ' [SEP]' AS text_sep FROM cloze""".replace(
        "|| CASE", "|| (CASE"
    ).replace("Quiz2 END", "Quiz2 END)"),
    ["cloze"],
)
def prj_lm_text(spark: SparkSession, sf: str) -> DataFrame:
    return fx.cloze(spark, sf).select(
        "InputStoryid",
        shaping.lm_text(True, "</s>").alias("text"),
        shaping.lm_text(True, None, "[SEP]", between="[SEP]").alias("text_sep"),
    )


@query(
    "prj_drop_columns",
    f"SELECT label, len(string_split({STORY_SQL}, ' ')) AS n_words FROM story_labels",
    ["story_labels"],
)
def prj_drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    mapped = fx.story_labels(spark, sf).withColumn(
        "n_words", words_by_single_space(shaping.story_text()).cast("long")
    )
    return shaping.keep_only_label(mapped, ["n_words"])


@query("prj_pair_concat", "SELECT pair_id, candidate || ' ' || reference AS text FROM text_pairs", ["text_pairs"])
def prj_pair_concat(spark: SparkSession, sf: str) -> DataFrame:
    return fx.text_pairs(spark, sf).select(
        "pair_id", shaping.join_text(F.col("candidate"), F.col("reference")).alias("text")
    )


@query(
    "prj_choose_text_columns",
    "SELECT id, label, original AS text_a, edit AS text_b FROM edit_pairs",
    ["edit_pairs"],
)
def prj_choose_text_columns(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.edit_pairs(spark, sf)
    return shaping.choose_text_columns(pairs, "semeval_regression").select("id", "label", "text_a", "text_b")


@query(
    "prj_choose_by_schema",
    "SELECT id, label, original AS text_a, edit AS text_b FROM edit_pairs",
    ["edit_pairs"],
)
def prj_choose_by_schema(spark: SparkSession, sf: str) -> DataFrame:
    return shaping.choose_text_columns(fx.edit_pairs(spark, sf)).select("id", "label", "text_a", "text_b")


@query(
    "prj_model_input",
    f"""SELECT label::BIGINT AS labels, split_part(story_id, '-', 1)::BIGINT AS doc_id, len(string_split({STORY_SQL}, ' ')) AS n_words,
               length(first_sentence) / 10.0::DOUBLE AS score FROM story_labels""",
    ["story_labels"],
)
def prj_model_input(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.story_labels(spark, sf).withColumns(
        {
            "doc_id": fx.story_document(),
            "n_words": words_by_single_space(shaping.story_text()).cast("long"),
            "score": F.length("first_sentence") / F.lit(10.0),
            "note": F.lit("dropped"),
            "nothing": F.lit(None),
        }
    )
    return shaping.model_input(df)


@query(
    "prj_joint_labels",
    f"""SELECT story_id, {fx.sql_joined("list_transform(" + fx.sql_word_tokens(STORY_SQL) + ", lambda t: length(t))")} AS lm_labels,
               label::BIGINT AS cls_labels FROM story_labels""",
    ["story_labels"],
)
def prj_joint_labels(spark: SparkSession, sf: str) -> DataFrame:
    # Token lengths stand in for ids here; encoding has its own query.
    ids = F.transform(word_tokens(shaping.story_text()), lambda t: F.length(t))
    df = shaping.joint_labels(fx.story_labels(spark, sf).select("story_id", ids.alias("input_ids"), "label"))
    return df.select("story_id", joined("labels.lm_labels").alias("lm_labels"), "labels.cls_labels")


@query(
    "prj_stop_truncate",
    """SELECT doc_id, CASE WHEN strpos(text, '. ') > 0 THEN substr(text, 1, strpos(text, '. ') - 1)
                           ELSE substr(text, 1, greatest(length(text) - 1, 0)) END AS compat,
              CASE WHEN strpos(text, '. ') > 0 THEN substr(text, 1, strpos(text, '. ') - 1) ELSE text END AS plain
       FROM documents""",
)
def prj_stop_truncate(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        stop_truncate(text, ". ").alias("compat"),
        stop_truncate(text, ". ", compat=False).alias("plain"),
    )


@query(
    "prj_total_sequence",
    "SELECT pair_id, candidate || ' ' || reference AS sequence FROM text_pairs",
    ["text_pairs"],
)
def prj_total_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return fx.text_pairs(spark, sf).select(
        "pair_id", shaping.total_sequence(F.col("candidate"), F.col("reference")).alias("sequence")
    )


@query("prj_squeeze", "SELECT row_id, round(vector[1], 6) AS prediction FROM reg_preds", ["reg_preds"])
def prj_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return fx.reg_preds(spark, sf).select("row_id", r6(shaping.squeeze(F.col("vector"))).alias("prediction"))


@query(
    "prj_row_index",
    "SELECT story_id, row_number() OVER (ORDER BY story_id) - 1 AS row_index FROM stories",
    ["stories"],
)
def prj_row_index(spark: SparkSession, sf: str) -> DataFrame:
    return row_index(fx.stories(spark, sf).select("story_id"), "story_id")


@query(
    "flt_field_count",
    "SELECT value FROM delimited_lines WHERE len(string_split(value, ' | ')) = 7",
    ["delimited_lines"],
)
def flt_field_count(spark: SparkSession, sf: str) -> DataFrame:
    return fx.delimited_lines(spark, sf).filter(F.size(readers.delimited_fields(F.col("value"))) == 7)


PREDICTION_SQL = r"'([a-z_A-Z]+){blank}/{blank}([a-z_A-Z]+)'".replace("{blank}", fx.SQL_UNICODE_SPACE.removesuffix("+"))


@query(
    "flt_regex_match",
    f"SELECT doc_id, regexp_extract(text, {PREDICTION_SQL}, 1) AS prediction FROM documents WHERE regexp_matches(text, {PREDICTION_SQL})",
)
def flt_regex_match(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx.table(spark, sf, "documents").select("doc_id", "text")
    return lines.filter(F.col("text").rlike(readers.PREDICTION_PATTERN)).select(
        "doc_id", F.regexp_extract("text", readers.PREDICTION_PATTERN, 1).alias("prediction")
    )


TOKENS_128_SQL = f"""
WITH t AS (SELECT pair_id, (['[CLS]'] || list_transform({fx.sql_word_tokens("candidate || ' ' || reference")},
                  lambda x: trim(x, '#')) || ['[SEP]'])[1:128] AS c FROM text_pairs)
"""


TOKENS_SQL = TOKENS_128_SQL.replace("[1:128]", "")


@query(
    "flt_special_tokens",
    TOKENS_SQL
    + """SELECT pair_id, len(c) AS n_tokens,
                len(list_filter(c, lambda x: x IN ('[CLS]', '[SEP]', '[PAD]', '[UNK]', '[MASK]', ''))) AS n_special FROM t""",
    ["text_pairs"],
)
def flt_special_tokens(spark: SparkSession, sf: str) -> DataFrame:
    text = shaping.join_text(F.col("candidate"), F.col("reference"))
    tokens = fx.text_pairs(spark, sf).select("pair_id", marked_tokens(word_tokens(text), None).alias("c"))
    return tokens.select(
        "pair_id",
        F.size("c").cast("long").alias("n_tokens"),
        F.size(F.filter("c", lambda t: is_special(t))).cast("long").alias("n_special"),
    )


@query(
    "flt_nonnull_inputs",
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
       WHERE l.quality IS NOT NULL AND d.text IS NOT NULL""",
)
def flt_nonnull_inputs(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    labels = fx.table(spark, sf, "labels").select("doc_id", "quality")
    return shaping.complete_rows(docs.join(labels, "doc_id", "left"), ["text", "quality"]).select(
        "doc_id", "quality"
    )


@query("joi_positional", "SELECT row_id, pred, label FROM cat_preds", ["cat_preds"])
def joi_positional(spark: SparkSession, sf: str) -> DataFrame:
    preds = fx.cat_preds(spark, sf)
    return shaping.pair_by_position(preds.select("row_id", "pred"), preds.select("row_id", "label"))


@query(
    "joi_token_self",
    TOKENS_SQL
    + """, w AS (SELECT pair_id, x, count(*) AS k FROM (SELECT pair_id, unnest(c) AS x FROM t) GROUP BY pair_id, x)
         SELECT pair_id, count(*) AS n_words, (sum(k) * sum(k))::BIGINT AS n_pairs, sum(k * k)::BIGINT AS n_equal,
                (count(*) * (count(*) - 1) // 2)::BIGINT AS n_word_pairs FROM w GROUP BY pair_id""",
    ["text_pairs"],
)
def joi_token_self(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered token pairs of one text, counted over its different words; no pair becomes a row."""
    text = shaping.join_text(F.col("candidate"), F.col("reference"))
    tokens = fx.text_pairs(spark, sf).select("pair_id", marked_tokens(word_tokens(text), None).alias("c"))
    words = tokens.select("pair_id", F.explode_outer("c").alias("x")).groupBy("pair_id", "x").agg(F.count("*").alias("k"))
    n = F.count("*")
    return words.groupBy("pair_id").agg(
        n.alias("n_words"),
        (F.sum("k") * F.sum("k")).alias("n_pairs"),
        F.sum(F.col("k") * F.col("k")).alias("n_equal"),
        F.floor(n * (n - 1) / 2).alias("n_word_pairs"),
    )


@query(
    "joi_pair_columns",
    "SELECT pair_id, md5(candidate || ' ' || reference) AS digest FROM text_pairs",
    ["text_pairs"],
)
def joi_pair_columns(spark: SparkSession, sf: str) -> DataFrame:
    text = shaping.join_text(F.col("candidate"), F.col("reference"))
    return fx.text_pairs(spark, sf).select("pair_id", F.md5(text).alias("digest"))


def _split2_sql(source: str, key: str, held: str = "test", fraction: str = "0.1") -> str:
    return f"""SELECT {key}, CASE WHEN row_number() OVER (ORDER BY md5('690-' || {key}), {key})
                   <= ceil({fraction}::DOUBLE * count(*) OVER ()) THEN '{held}' ELSE 'train' END AS split FROM {source}"""


SPLIT3_SQL = """
WITH a AS (SELECT story_id, row_number() OVER (ORDER BY md5('690-' || story_id), story_id) AS r,
                  count(*) OVER () AS n FROM stories),
     h AS (SELECT story_id, row_number() OVER (ORDER BY md5('690-held-' || story_id), story_id) AS r,
                  count(*) OVER () AS n FROM a WHERE r <= ceil(0.2::DOUBLE * n)),
     s3 AS (SELECT a.story_id, CASE WHEN h.story_id IS NULL THEN 'train'
                   WHEN h.r <= ceil(0.5::DOUBLE * h.n) THEN 'test' ELSE 'validation' END AS split
            FROM a LEFT JOIN h ON h.story_id = a.story_id)
"""


@query("smp_split2", _split2_sql("stories", "story_id"), ["stories"])
def smp_split2(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split2(fx.stories(spark, sf).select("story_id"), "story_id")


@query("smp_split3", SPLIT3_SQL + "SELECT story_id, split FROM s3", ["stories"])
def smp_split3(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split3(fx.stories(spark, sf).select("story_id"), "story_id")


@query(
    "smp_split_external",
    _split2_sql("cloze", "InputStoryid", "validation") + " UNION ALL SELECT story_id, 'test' FROM stories",
    ["cloze"],
)
def smp_split_external(spark: SparkSession, sf: str) -> DataFrame:
    inside = fx.cloze(spark, sf).select("InputStoryid")
    outside = fx.stories(spark, sf).select(F.col("story_id").alias("InputStoryid"))
    return splits.split_external(inside, outside, "InputStoryid")


@query(
    "smp_first_n",
    SPLIT3_SQL
    + """SELECT story_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY story_id) AS r FROM s3)
         WHERE r <= CASE split WHEN 'train' THEN 30 ELSE 10 END""",
    ["stories"],
)
def smp_first_n(spark: SparkSession, sf: str) -> DataFrame:
    marked = splits.split3(fx.stories(spark, sf).select("story_id"), "story_id")
    return splits.first_n_per_split(marked, "story_id", {"train": 30, "validation": 10, "test": 10})


@query(
    "smp_random_k",
    "SELECT story_id, first_sentence FROM stories ORDER BY md5('690-' || story_id), story_id LIMIT 3",
    ["stories"],
)
def smp_random_k(spark: SparkSession, sf: str) -> DataFrame:
    return splits.random_rows(fx.stories(spark, sf).select("story_id", "first_sentence"), "story_id", 3)


@query(
    "smp_balance_down",
    """SELECT story_id, label FROM (
         SELECT story_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('690-' || story_id), story_id) AS r
         FROM story_labels) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM story_labels GROUP BY label))""",
    ["story_labels"],
)
def smp_balance_down(spark: SparkSession, sf: str) -> DataFrame:
    return splits.balance_down(fx.story_labels(spark, sf).select("story_id", "label"), "label", "story_id")


@query("smp_named_splits", SPLIT3_SQL + "SELECT split, count(*) AS n FROM s3 GROUP BY split", ["stories"])
def smp_named_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_counts(splits.split3(fx.stories(spark, sf).select("story_id"), "story_id"))


@query(
    "smp_effective_count",
    SPLIT3_SQL
    + """SELECT split, least(CASE split WHEN 'train' THEN 100 WHEN 'validation' THEN 1000000 ELSE count(*) END, count(*)) AS samples
         FROM s3 GROUP BY split""",
    ["stories"],
)
def smp_effective_count(spark: SparkSession, sf: str) -> DataFrame:
    marked = splits.split3(fx.stories(spark, sf).select("story_id"), "story_id")
    return splits.effective_counts(marked, {"train": 100, "validation": 1_000_000})


@query(
    "smp_topk_tokens",
    """SELECT prev, next, n FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, md5(next), next) AS r
       FROM bigrams) WHERE r <= 3""",
    ["bigrams"],
)
def smp_topk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(pair_counts(fx.doc_tokens(spark, sf), "tokens"), 3)


@query("agg_count", "SELECT count(*) AS n FROM stories", ["stories"])
def agg_count(spark: SparkSession, sf: str) -> DataFrame:
    return stats.row_count(fx.stories(spark, sf))


@query(
    "agg_mean_words",
    f"SELECT round(avg(len(string_split({STORY_SQL}, ' '))), 6) AS mean_words FROM stories",
    ["stories"],
)
def agg_mean_words(spark: SparkSession, sf: str) -> DataFrame:
    words = words_by_single_space(shaping.story_text())
    return stats.mean_of(fx.stories(spark, sf), words, "mean_words").select(r6("mean_words").alias("mean_words"))


def _histogram_sql(value: str, source: str, bins: int) -> str:
    return f"""WITH x AS (SELECT ({value})::DOUBLE AS x FROM {source}),
        b AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS w FROM x)
      SELECT i::INTEGER AS bin, round(lo + i * w, 6) AS lower,
             (SELECT count(*) FROM x WHERE least(floor((x - lo) / w), {bins - 1}) = i) AS n
      FROM b, unnest(range({bins})) AS u(i)"""


@query("agg_label_histogram", _histogram_sql("label", "story_labels", 4), ["story_labels"])
def agg_label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(fx.story_labels(spark, sf), F.col("label"), 4).withColumn("lower", r6("lower"))


@query(
    "agg_length_histogram",
    _histogram_sql(fx.sql_any_space_count(STORY_SQL), "stories", 30),
    ["stories"],
)
def agg_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    words = words_by_any_space(shaping.story_text())
    return stats.histogram(fx.stories(spark, sf), words, 30).withColumn("lower", r6("lower"))


@query("agg_distinct_labels", "SELECT DISTINCT label FROM story_labels ORDER BY label", ["story_labels"])
def agg_distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distinct_labels(fx.story_labels(spark, sf))


CLASS_WEIGHTS_SQL = SPLIT3_SQL + """
, tr AS (SELECT label FROM story_labels l JOIN s3 USING (story_id) WHERE split = 'train')
SELECT label, count(*) AS n,
       round((SELECT count(*) FROM tr) / ((SELECT count(DISTINCT label) FROM tr) * count(*))::DOUBLE, 6) AS weight
FROM tr GROUP BY label
"""


def train_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Stories, labels, exact 80/10/10 split, balanced class weights of the train split."""
    marked = splits.split3(fx.story_labels(spark, sf).select("story_id", "label"), "story_id")
    return stats.class_weights(marked.filter("split = 'train'")).withColumn("weight", r6("weight"))


@query("agg_class_weights", CLASS_WEIGHTS_SQL.replace("FROM stories)", "FROM story_labels)"), ["story_labels"])
def agg_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return train_class_weights(spark, sf)


@query(
    "agg_min_group",
    "SELECT min(n) AS n FROM (SELECT count(*) AS n FROM story_labels GROUP BY label)",
    ["story_labels"],
)
def agg_min_group(spark: SparkSession, sf: str) -> DataFrame:
    return stats.smallest_group(fx.story_labels(spark, sf))


@query(
    "agg_weights_complete",
    """SELECT count(DISTINCT label) AS n_present,
              coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM unnest(range(6)) AS u(i)
                        WHERE i NOT IN (SELECT label FROM story_labels)), '') AS missing,
              (count(DISTINCT label) = 6)::INTEGER AS complete FROM story_labels""",
    ["story_labels"],
)
def agg_weights_complete(spark: SparkSession, sf: str) -> DataFrame:
    return stats.weights_complete(fx.story_labels(spark, sf), 6)


@query(
    "udf_batched_map",
    f"SELECT doc_id, len({fx.sql_ws_tokens('text')}) AS n_words FROM documents",
)
def udf_batched_map(spark: SparkSession, sf: str) -> DataFrame:
    """The batched-map surface: column batches in, other columns out, sources dropped."""

    def count_words(batch):
        return batch.assign(n_words=batch["text"].str.count(r"[^ \t\n\r]+"))[["doc_id", "n_words"]]

    return map_batches(
        fx.table(spark, sf, "documents"), count_words, "doc_id long, n_words long", ["doc_id", "text"]
    )


@query(
    "udf_grouped_apply",
    f"""SELECT toxic, count(*) AS texts, sum(n)::BIGINT AS words, max(n)::BIGINT AS longest,
               min(doc_id) FILTER (n = top) AS longest_id
        FROM (SELECT doc_id, toxic, n, max(n) OVER (PARTITION BY toxic) AS top FROM (
                SELECT d.doc_id, toxic, len({fx.sql_ws_tokens('text')}) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id))
        GROUP BY toxic""",
)
def udf_grouped_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The grouped-map surface on groups of which one holds most of the rows: parts first, then their results."""
    labels = fx.table(spark, sf, "labels").select("doc_id", "toxic")
    texts = fx.texts(spark, sf).join(labels, "doc_id").select("toxic", "doc_id", F.size(whitespace_tokens(F.col("text"))).cast("long").alias("n"))

    def part(rows: pa.Table) -> pa.Table:
        n, ids = rows.column("n"), rows.column("doc_id")
        top = pc.max(n)
        first = pc.min(pc.filter(ids, pc.equal(n, top)))
        values = [rows.column("toxic")[0], pa.scalar(len(rows), pa.int64()), pc.sum(n), top, first]
        return pa.table([pa.array([v.as_py()], v.type) for v in values], ["toxic", "texts", "words", "longest", "longest_id"])

    def merged(rows: pa.Table) -> pa.Table:
        top = pc.max(rows.column("longest"))
        first = pc.min(pc.filter(rows.column("longest_id"), pc.equal(rows.column("longest"), top)))
        values = [rows.column("toxic")[0], pc.sum(rows.column("texts")), pc.sum(rows.column("words")), top, first]
        return pa.table([pa.array([v.as_py()], v.type) for v in values], rows.column_names)

    schema = "toxic long, texts long, words long, longest long, longest_id long"
    texts = texts.withColumn("toxic", F.col("toxic").cast("long"))
    out = map_groups(texts, ["toxic"], part, schema, merged, schema, spread=["doc_id"], most=100)
    return out.withColumn("toxic", F.col("toxic").cast(labels.schema["toxic"].dataType))
