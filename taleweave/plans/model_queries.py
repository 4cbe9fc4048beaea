"""Next-token model, decoding and the train / score jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taleweave.functions.text import whitespace_tokens
from taleweave.operators import jobs, joint, ngram, shaping, splits, textmetrics, tokens
from taleweave.plans import fixtures as fx
from taleweave.plans.registry import joined, query, r6
from taleweave.plans.shaping_queries import CONTEXT_SQL, SPLIT3_SQL, STORY_SQL
from taleweave.plans.text_queries import BUNDLE_SQL, metaphone_views
from taleweave.operators.runs import Run, fingerprint
from taleweave.session import hand_over, scratch_path
from taleweave.sources.readers import multihot

END = "</s>"
BLOCK = 128


def lm_texts(spark: SparkSession, sf: str, marked: DataFrame | None = None) -> DataFrame:
    """Stories with an end marker, split 80/10/10."""
    marked = splits.split3(fx.stories(spark, sf), "story_id") if marked is None else marked
    text = shaping.lm_text(cloze=False, eos=END)
    return marked.select("story_id", "split", text.alias("text"))


def lm_blocks(spark: SparkSession, sf: str, marked: DataFrame | None = None) -> DataFrame:
    """Packed blocks of every split, batches of 1,000 stories counted inside each split; ``marked``: the split stories.

    Texts are moved as they are and taken apart where their batch is: an array of short tokens is larger."""
    batched = tokens.batches_of(lm_texts(spark, sf, marked), "story_id", 1000, within="split").repartition("split", "batch")
    split = batched.select("split", "batch", "story_id", whitespace_tokens(F.col("text")).alias("tokens"))
    return tokens.pack_blocks(split, "story_id", "tokens", "batch", BLOCK, by=("split",))


LM_SQL = SPLIT3_SQL + f"""
, tx AS (SELECT split, story_id, (row_number() OVER (PARTITION BY split ORDER BY story_id) - 1) // 1000 AS batch,
               {fx.sql_ws_tokens(STORY_SQL + " || ' </s>'")} AS tokens FROM stories JOIN s3 USING (story_id)),
 flat AS (SELECT split, batch, token, row_number() OVER (PARTITION BY split, batch ORDER BY story_id, i) - 1 AS g
          FROM (SELECT split, batch, story_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM tx)),
 full_blocks AS (SELECT split, batch, g // 128 AS block FROM flat GROUP BY ALL HAVING count(*) = 128),
 inside AS (SELECT f.split, f.token AS prev,
                   lead(f.token) OVER (PARTITION BY f.split, f.batch, f.g // 128 ORDER BY f.g) AS next, f.token
            FROM flat f JOIN full_blocks b ON b.split = f.split AND b.batch = f.batch AND b.block = f.g // 128),
 counts AS (SELECT prev, next, count(*) AS n FROM inside WHERE split = 'train' AND next IS NOT NULL GROUP BY ALL)
"""


@query("lm_bigram_train", LM_SQL + "SELECT prev, next, n FROM counts", ["stories"])
def lm_bigram_train(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.train_counts(lm_blocks(spark, sf).filter("split = 'train'"))


PERPLEXITY_SQL = (
    LM_SQL
    + """, v AS (SELECT count(DISTINCT token) AS v FROM inside WHERE split = 'train'),
       tot AS (SELECT prev, sum(n) AS n FROM counts GROUP BY prev),
       held AS (SELECT split, prev, next FROM inside WHERE split <> 'train' AND next IS NOT NULL),
       nll AS (SELECT h.split, -ln((coalesce(c.n, 0) + 1)::DOUBLE / (coalesce(t.n, 0) + v)) AS nll
               FROM held h CROSS JOIN v LEFT JOIN counts c ON c.prev = h.prev AND c.next = h.next LEFT JOIN tot t ON t.prev = h.prev)
     SELECT split, count(*) AS pairs, round(avg(nll), 6) AS loss, round(exp(avg(nll)), 4) AS perplexity FROM nll GROUP BY split"""
)


@query("lm_perplexity", PERPLEXITY_SQL, ["stories"])
def lm_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return split_perplexity(spark, sf).select(
        "split", "pairs", r6("loss").alias("loss"), r6("perplexity", 4).alias("perplexity")
    )


def split_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    blocks = hand_over(lm_blocks(spark, sf), "lm-blocks")
    counts = hand_over(ngram.train_counts(blocks.filter("split = 'train'")), "pairs")
    held = tokens.pair_counts(blocks.filter("split <> 'train'"), "input_ids", by=("split",))
    return ngram.lm_perplexity(held, counts, ngram.vocabulary_size(counts).select("v").scalar(), by=["split"])


NUCLEUS_SQL = """
WITH r AS (SELECT prev, next, n, (sum(n) OVER (PARTITION BY prev ORDER BY n DESC, md5(next), next ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS before,
                  sum(n) OVER (PARTITION BY prev) AS total FROM bigrams),
     k AS (SELECT prev, next, n, before, (sum(n) OVER (PARTITION BY prev))::BIGINT AS kept_total,
                  count(*) OVER (PARTITION BY prev) AS kept_count FROM r WHERE before * 10 < 9 * total)
"""


def doc_nucleus(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate sets of the token pairs of whole documents."""
    return ngram.nucleus(hand_over(tokens.pair_counts(fx.doc_tokens(spark, sf), "tokens"), "pairs"))


@query("dec_top_p", NUCLEUS_SQL + "SELECT prev, next, n, before, kept_total, kept_count FROM k", ["bigrams"])
def dec_top_p(spark: SparkSession, sf: str) -> DataFrame:
    return doc_nucleus(spark, sf)


@query(
    "dec_sample",
    NUCLEUS_SQL
    + """, u AS (SELECT *, least(floor(('0x' || substr(md5('690-' || prev), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * kept_total)::BIGINT,
                                kept_total - 1) AS spot FROM k)
         SELECT prev, next FROM u WHERE before <= spot AND spot < before + n""",
    ["bigrams"],
)
def dec_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.sample_next(doc_nucleus(spark, sf), 690)


@query(
    "dec_adjust",
    """SELECT row_id, i::INTEGER AS token, round((CASE WHEN i IN (label, (label + 1) % 10)
              THEN CASE WHEN z[i + 1] > 0 THEN z[i + 1] / 1.2::DOUBLE ELSE z[i + 1] * 1.2::DOUBLE END ELSE z[i + 1] END) / 0.7::DOUBLE, 6) AS score
       FROM cls_logits, unnest(range(10)) AS u(i)""",
    ["cls_logits"],
)
def dec_adjust(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.array(F.col("label"), (F.col("label") + 1) % 10)
    adjusted = fx.cls_logits(spark, sf).select(
        "row_id", F.posexplode(ngram.adjust_scores(F.col("z"), seen, 0.7, 1.2)).alias("token", "score")
    )
    return adjusted.withColumn("score", r6("score"))


def generated(spark: SparkSession, sf: str, penalty: float = 1.0, **settings: float) -> DataFrame:
    """Endings for the prompts of the test split from the candidate sets of the train split.

    Stories are read many times, so they are cut out of the documents once."""
    texts = splits.split3(hand_over(fx.stories(spark, sf), "stories"), "story_id")
    prompts = shaping.prompt_reference(texts.filter("split = 'test'"), "story_id", cloze=False)
    blocks = lm_blocks(spark, sf, texts).filter("split = 'train'")
    kept = ngram.candidate_set(ngram.train_counts(blocks), fine=penalty != 1.0, **settings)
    starts = prompts.select("story_id", whitespace_tokens(F.col("prompt")).alias("prompt"))
    endings = ngram.generate(starts, kept, "story_id", "prompt", END, penalty=penalty)
    return prompts.join(endings, "story_id")


def _walk_sql() -> str:
    spot = "('0x' || substr(md5('690-' || g.story_id || '-' || step), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"""SELECT g.story_id, step + 1, next, CASE WHEN next = '{END}' THEN said ELSE list_append(said, next) END, next = '{END}'
          FROM walk g JOIN k ON k.prev = g.prev AND NOT g.done AND step < 50
           AND least(floor({spot} * kept_total)::BIGINT, kept_total - 1) BETWEEN before AND before + n - 1"""


def _penalty_walk_sql(penalty: float) -> str:
    """Every candidate of the context weighed anew, by what the prompt and its continuation hold."""
    spot = "('0x' || substr(md5('690-' || story_id || '-' || step), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    low = f"greatest(1, round(pow(n / 1000.0::DOUBLE, 1 / {penalty}::DOUBLE) * 1000))::BIGINT"
    return f"""SELECT story_id, step + 1, next, CASE WHEN next = '{END}' THEN said ELSE list_append(said, next) END, next = '{END}'
          FROM (SELECT *, (sum(w) OVER (PARTITION BY story_id ORDER BY before) - w)::BIGINT AS ahead,
                       (sum(w) OVER (PARTITION BY story_id))::BIGINT AS whole
                FROM (SELECT g.*, k.next, k.before, CASE WHEN list_contains(p.words, k.next) OR list_contains(g.said, k.next)
                             THEN {low} ELSE n END AS w
                      FROM walk g JOIN k ON k.prev = g.prev AND NOT g.done AND step < 50 JOIN pt p ON p.story_id = g.story_id))
          WHERE least(floor({spot} * whole)::BIGINT, whole - 1) BETWEEN ahead AND ahead + w - 1"""


def generation_sql(weight: str = "n", k: int = 0, share: str = "before * 10 < 9 * total", walk: str = "") -> str:
    """The same walk, each step decided by a hash: ``gen`` (story_id, prompt, text, reference)."""
    limit = f"QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, md5(next), next) <= {k}" if k else ""
    return (
        "RECURSIVE"
        + LM_SQL
        + f""", pw AS (SELECT * FROM (SELECT prev, next, {weight} AS n FROM counts) {limit}),
 rk AS (SELECT prev, next, n, (sum(n) OVER (PARTITION BY prev ORDER BY n DESC, md5(next), next ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS before,
               sum(n) OVER (PARTITION BY prev) AS total FROM pw),
 k AS (SELECT prev, next, n, before, (sum(n) OVER (PARTITION BY prev))::BIGINT AS kept_total FROM rk WHERE {share}),
 pr AS (SELECT story_id, first_sentence || ' ' || second_sentence || ' ' || third_sentence || ' ' || fourth_sentence AS prompt,
               fifth_sentence AS reference FROM stories JOIN s3 USING (story_id) WHERE split = 'test'),
 pt AS (SELECT story_id, {fx.sql_ws_tokens("prompt")} AS words FROM pr),
 walk AS (SELECT story_id, 0 AS step, list_last({fx.sql_ws_tokens("prompt")}) AS prev, []::VARCHAR[] AS said, false AS done FROM pr
          UNION ALL
          {walk or _walk_sql()}),
 gen AS (SELECT story_id, prompt, array_to_string(arg_max(said, step), ' ') AS text, reference FROM walk JOIN pr USING (story_id)
         GROUP BY story_id, prompt, reference)
"""
    )


@query("dec_generate_endings", generation_sql() + "SELECT * FROM gen", ["stories"])
def dec_generate_endings(spark: SparkSession, sf: str) -> DataFrame:
    return generated(spark, sf).select("story_id", "prompt", "text", "reference")


@query(
    "dec_generate_settings",
    generation_sql("greatest(1, round(pow(n, 2) * 1000))::BIGINT", 5, "before * 4 < 3 * total") + "SELECT * FROM gen",
    ["stories"],
)
def dec_generate_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The same with temperature 0.5, the five heaviest candidates and a share of 0.75."""
    return generated(spark, sf, p=0.75, k=5, temperature=0.5).select("story_id", "prompt", "text", "reference")


@query(
    "dec_generate_penalty",
    generation_sql("n * 1000", walk=_penalty_walk_sql(1.2)) + "SELECT * FROM gen",
    ["stories"],
)
def dec_generate_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a repetition penalty of 1.2 on what the prompt and its continuation hold."""
    return generated(spark, sf, penalty=1.2).select("story_id", "prompt", "text", "reference")


@query(
    "txt_generated_report",
    generation_sql()
    + f", text_pairs AS (SELECT story_id AS pair_id, text AS candidate, reference FROM gen) SELECT {BUNDLE_SQL}",
    ["stories"],
)
def txt_generated_report(spark: SparkSession, sf: str) -> DataFrame:
    """bleu, rouge and meteor of the generated endings of the test split."""
    endings = hand_over(generated(spark, sf).select("story_id", "text", "reference"), "endings")
    report = textmetrics.metric_bundle(endings, "story_id", "text", "reference")
    return report.select(*[r6(c).alias(c) for c in ("bleu", "rouge", "meteor")])


def split_stories(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split3(fx.story_labels(spark, sf), "story_id")


def bayes_sql(k: int, weighted: bool = False, mark: str = "") -> str:
    """Counted class scores and predictions ``preds`` over ``docs`` (row_id, split, label) and ``inp`` (row_id, field, token)."""
    weight = "CASE WHEN n > 0 THEN (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) ELSE 0 END" if weighted else "1.0::DOUBLE"
    return f"""
, c AS (SELECT label, count(*) AS n FROM docs WHERE split = 'train' GROUP BY label),
 w AS (SELECT label, n, {weight} AS weight FROM (SELECT k::INTEGER AS label, coalesce(n, 0) AS n FROM unnest(range({k})) AS u(k)
       LEFT JOIN c ON c.label = k)),
 pri AS (SELECT label, ln((n * weight + 1) / ((SELECT sum(n * weight) FROM w) + {k})) AS p FROM w),
 cnt AS (SELECT field, token, w.label, count(*) * weight AS n FROM inp JOIN docs USING (row_id) JOIN w ON w.label = docs.label
         WHERE split = 'train' GROUP BY field, token, w.label, weight),
 voc AS (SELECT DISTINCT field, token FROM cnt), v AS (SELECT field, count(*) AS v FROM voc GROUP BY field),
 tot AS (SELECT field, label, sum(n) AS n FROM cnt GROUP BY field, label),
 terms AS (SELECT voc.field, voc.token, w.label, ln((coalesce(cnt.n, 0) + 1) / (coalesce(tot.n, 0) + v)) AS s
           FROM voc JOIN v USING (field) CROSS JOIN w
           LEFT JOIN cnt ON cnt.field = voc.field AND cnt.token = voc.token AND cnt.label = w.label
           LEFT JOIN tot ON tot.field = voc.field AND tot.label = w.label),
 sums AS (SELECT row_id, terms.label, sum(s) AS s FROM inp JOIN terms USING (field, token) GROUP BY row_id, terms.label),
 z AS (SELECT d.row_id, d.split, d.label, pri.label AS class, p + coalesce(s, 0) AS z FROM docs d CROSS JOIN pri
       LEFT JOIN sums ON sums.row_id = d.row_id AND sums.label = pri.label WHERE d.split <> 'train'),
 preds AS (SELECT row_id, split, label, class AS pred FROM z QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY z DESC, class) = 1)
"""


def _words_sql(source: str, fields: dict[str, str]) -> str:
    parts = [f"SELECT row_id, '{f}' AS field, unnest({fx.sql_word_tokens('lower(' + text + ')')}) AS token FROM {source}" for f, text in fields.items()]
    return f", inp AS ({' UNION ALL '.join(parts)})"


REPORT_SQL = """
, cl AS (SELECT DISTINCT split, label AS c FROM preds UNION SELECT DISTINCT split, pred FROM preds),
 st AS (SELECT cl.split, c, count(*) FILTER (WHERE label = c AND pred = c)::DOUBLE AS tp,
               count(*) FILTER (WHERE label = c)::DOUBLE AS sup, count(*) FILTER (WHERE pred = c)::DOUBLE AS pp
        FROM cl JOIN preds ON preds.split = cl.split GROUP BY cl.split, c),
 m AS (SELECT split, sup, tp, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS r FROM st),
 report AS (SELECT split, round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(CASE WHEN sup > 0 THEN r END), 6) AS balanced_accuracy,
                   round(sum(sup * p) / sum(sup), 6) AS "precision", round(sum(sup * r) / sum(sup), 6) AS recall,
                   round(sum(sup * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) / sum(sup), 6) AS f1,
                   sum(sup)::BIGINT AS samples FROM m GROUP BY split)
"""


def class_report(predictions: DataFrame) -> DataFrame:
    report = jobs.class_split_report(predictions)
    return report.select("split", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")], "samples")


ENDING_SQL = (
    """WITH src AS (SELECT *, InputStoryid AS row_id FROM cloze),
     own AS (SELECT row_id, row_number() OVER (ORDER BY md5('690-' || row_id), row_id) AS r, count(*) OVER () AS n FROM src
             WHERE split_part(row_id, '-', 1)::BIGINT % 5 <> 4),
     docs AS (SELECT src.row_id, label, CASE WHEN own.row_id IS NULL THEN 'test' WHEN r <= ceil(0.1::DOUBLE * n) THEN 'validation'
                     ELSE 'train' END AS split FROM src LEFT JOIN own ON own.row_id = src.row_id)"""
    + _words_sql("src", {"context": CONTEXT_SQL, "ending1": "RandomFifthSentenceQuiz1", "ending2": "RandomFifthSentenceQuiz2"})
    + bayes_sql(2)
    + REPORT_SQL
)


@query("mlj_ending_choice", ENDING_SQL + "SELECT * FROM report", ["cloze"])
def mlj_ending_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Train and validation from one set of stories, the test from another one (every fifth document's)."""
    rows = hand_over(fx.cloze(spark, sf), "cloze")
    other = fx.story_document("InputStoryid") % 5 == 4
    marked = splits.split_external(rows.filter(~other), rows.filter(other), "InputStoryid")
    _, predictions = jobs.ending_choice(marked)
    return class_report(predictions)


CATEGORY_JOB_SQL = (
    SPLIT3_SQL.replace("FROM stories)", "FROM story_labels)")
    + ", docs AS (SELECT story_id AS row_id, label, split FROM story_labels JOIN s3 USING (story_id))"
    + _words_sql("(SELECT *, story_id AS row_id FROM story_labels)", {"tokens": STORY_SQL})
    + bayes_sql(4, weighted=True)
    + REPORT_SQL
)


@query("mlj_category", CATEGORY_JOB_SQL + "SELECT * FROM report", ["story_labels"])
def mlj_category(spark: SparkSession, sf: str) -> DataFrame:
    _, predictions = jobs.category(split_stories(spark, sf))
    return class_report(predictions)


@query("mlj_save_reuse", CATEGORY_JOB_SQL + "SELECT row_id, split, label, pred FROM preds", ["story_labels"])
def mlj_save_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a run that is started again after its model was saved: the second start reads the finished stages."""
    stories = fx.story_labels(spark, sf)
    folder, source = scratch_path(spark, "run"), fingerprint(stories)

    def started() -> tuple[DataFrame, jobs.ClassModel]:
        run = Run(spark, folder, source, task="category")
        table = run.table("input", lambda: jobs.story_input(splits.split3(stories, "story_id")))
        train = table.filter("split = 'train'")
        return table, run.model("model", lambda: jobs.fit_classes(train, ["tokens"], True), jobs.save_models, jobs.load_model)

    started()
    table, model = started()
    scored = jobs.score_classes(model, table.filter("split <> 'train'"), "row_id", ["split"])
    return scored.select("row_id", "split", "label", "pred")


def importance_predictions(spark: SparkSession, sf: str) -> DataFrame:
    stories = fx.story_importance(spark, sf).withColumn("label", multihot(F.col("index_list")))
    _, predictions = jobs.importance(splits.split3(stories, "story_id"))
    return predictions


def _slot_sql(slot: int) -> str:
    """Predictions for one sentence of a story, as a query of its own."""
    return (
        f"(WITH docs AS (SELECT story_id AS row_id, split, (index_list LIKE '%{slot}%')::INTEGER AS label FROM story_importance JOIN s3 USING (story_id)) "
        + bayes_sql(2)
        + f"SELECT row_id, split, {slot} AS slot, label, pred FROM preds)"
    )


IMPORTANCE_SQL = (
    SPLIT3_SQL
    + _words_sql("(SELECT *, story_id AS row_id FROM stories)", {"tokens": STORY_SQL})
    + f", cells AS ({' UNION ALL '.join('SELECT * FROM ' + _slot_sql(i) for i in range(4))})"
)


@query(
    "mlj_importance",
    IMPORTANCE_SQL
    + """, ex AS (SELECT split, row_id, min((label = pred)::INTEGER) AS same FROM cells GROUP BY split, row_id),
          sl AS (SELECT split, slot, sum(label * pred)::DOUBLE AS tp, sum(label)::DOUBLE AS sup, sum(pred)::DOUBLE AS pp,
                        sum((label <> pred)::INTEGER)::DOUBLE AS wrong FROM cells GROUP BY split, slot),
          m AS (SELECT split, sup, wrong, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS r FROM sl),
          e AS (SELECT split, avg(same) AS accuracy, count(*) AS samples FROM ex GROUP BY split)
        SELECT split, round(accuracy, 6) AS accuracy, round(any_value(hl) / samples / 4, 6) AS hamming_loss,
               round(any_value(pw), 6) AS "precision", round(any_value(rw), 6) AS recall, round(any_value(fw), 6) AS f1, samples
        FROM e JOIN (SELECT split, sum(wrong) AS hl, sum(sup * p) / sum(sup) AS pw, sum(sup * r) / sum(sup) AS rw,
                            sum(sup * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) / sum(sup) AS fw FROM m GROUP BY split) q
        USING (split) GROUP BY split, accuracy, samples""",
    ["stories", "story_importance"],
)
def mlj_importance(spark: SparkSession, sf: str) -> DataFrame:
    report = jobs.multilabel_split_report(importance_predictions(spark, sf))
    return report.select("split", *[r6(c).alias(c) for c in ("accuracy", "hamming_loss", "precision", "recall", "f1")], "samples")


@query(
    "mlj_importance_rows",
    IMPORTANCE_SQL
    + """SELECT row_id, split, string_agg(pred::VARCHAR, ',' ORDER BY slot) AS pred, string_agg(label::VARCHAR, ',' ORDER BY slot) AS label
         FROM cells GROUP BY row_id, split""",
    ["stories", "story_importance"],
)
def mlj_importance_rows(spark: SparkSession, sf: str) -> DataFrame:
    return importance_predictions(spark, sf).select(
        "row_id", "split", joined("pred").alias("pred"), joined("label").alias("label")
    )


def _line_sql(source: str, features: list[str], where: str) -> str:
    """Least squares of ``label``: centred sums, elimination column by column, substitution backwards. View ``line``."""
    n = len(features)
    names = [*features, "label"]
    means = ", ".join(f"avg({f}) AS u{i}" for i, f in enumerate(names))
    cells = ", ".join(f"sum(({names[i]} - u{i}) * ({names[j]} - u{j})) AS m0_{i}_{j}" for i in range(n) for j in range(n + 1))
    parts = [f"um AS (SELECT {means} FROM {source} WHERE {where})", f"el0 AS (SELECT {cells} FROM {source} CROSS JOIN um WHERE {where})"]
    for k in range(n):
        def left(i: int, j: int, k: int = k) -> str:
            now = f"m{k}_{i}_{j}"
            return f"{now} - m{k}_{i}_{k} * m{k}_{k}_{j} / m{k}_{k}_{k}" if i > k else now

        cells = ", ".join(f"{left(i, j)} AS m{k + 1}_{i}_{j}" for i in range(n) for j in range(n + 1))
        parts.append(f"el{k + 1} AS (SELECT {cells} FROM el{k})")
    solved = f"el{n}"
    for k in reversed(range(n)):
        rest = "".join(f" - m{n}_{k}_{j} * a{j}" for j in range(k + 1, n))
        parts.append(f"sub{k} AS (SELECT *, (m{n}_{k}_{n}{rest}) / m{n}_{k}_{k} AS a{k} FROM {solved})")
        solved = f"sub{k}"
    slopes = " + ".join(f"a{i} * ({f} - u{i})" for i, f in enumerate(features))
    return f"{', '.join(parts)}, line AS (SELECT x.*, u{n} + {slopes} AS pred FROM {source} x CROSS JOIN um CROSS JOIN {solved})"


PAIR_SQL = (
    SPLIT3_SQL.replace("story_id", "id").replace("FROM stories)", "FROM edit_pairs)").replace("'690-", "'69-")
    + ", docs AS (SELECT id AS row_id, label, split FROM edit_pairs JOIN s3 USING (id))"
    + _words_sql("(SELECT *, id AS row_id FROM edit_pairs)", {"a": "original", "b": "edit"})
    + f""", mu AS (SELECT avg(label) AS mu FROM docs WHERE split = 'train'),
 dw AS (SELECT DISTINCT row_id, field, token FROM inp),
 tv AS MATERIALIZED (SELECT field, token, (sum(label) + 5 * any_value(mu)) / (count(*) + 5) AS v FROM dw JOIN docs USING (row_id) CROSS JOIN mu
        WHERE split = 'train' GROUP BY field, token),
 own AS (SELECT row_id, avg(v) FILTER (field = 'a') AS xa, avg(v) FILTER (field = 'b') AS xb FROM dw JOIN tv USING (field, token) GROUP BY row_id),
 fw AS (SELECT DISTINCT row_id, field, unnest(t[1:128]) AS token FROM (
        SELECT id AS row_id, 'a' AS field, {fx.sql_word_tokens('lower(original)')} AS t FROM edit_pairs
        UNION ALL SELECT id, 'b', {fx.sql_word_tokens('lower(edit)')} FROM edit_pairs)),
 d AS (SELECT DISTINCT token FROM fw), {metaphone_views('d')},
 cc AS MATERIALIZED (SELECT row_id, field, code, count(*) AS n, sum(coalesce(v, mu)) AS v
        FROM fw JOIN meta USING (token) LEFT JOIN tv USING (field, token) CROSS JOIN mu GROUP BY row_id, field, code),
 att AS (SELECT row_id, field, sum(n * s) / sum(n) AS x FROM (
        SELECT p.row_id, p.field, p.code, any_value(p.n) AS n,
               sum(exp(-levenshtein(p.code, q.code)::DOUBLE) * q.v) / sum(exp(-levenshtein(p.code, q.code)::DOUBLE) * q.n) AS s
        FROM cc p JOIN cc q ON q.row_id = p.row_id AND q.field <> p.field GROUP BY p.row_id, p.field, p.code) GROUP BY row_id, field),
 x AS MATERIALIZED (SELECT docs.row_id, split, label, coalesce(xa, mu) AS xa, coalesce(xb, mu) AS xb, coalesce(f.x, mu) AS fa, coalesce(g.x, mu) AS fb
       FROM docs CROSS JOIN mu LEFT JOIN own USING (row_id) LEFT JOIN att f ON f.row_id = docs.row_id AND f.field = 'a'
       LEFT JOIN att g ON g.row_id = docs.row_id AND g.field = 'b'),
 """
    + _line_sql("x", ["xa", "xb", "fa", "fb"], "split = 'train'")
)


@query(
    "mlj_pair_regression",
    PAIR_SQL
    + """ SELECT split, round(avg((pred - label) * (pred - label)), 4) AS mse, count(*) AS samples
         FROM line WHERE split <> 'train' GROUP BY split""",
    ["edit_pairs"],
)
def mlj_pair_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of text pairs from their words' values and from those they attend to in the other text."""
    marked = splits.split3(fx.edit_pairs(spark, sf), "id", seed=69)
    _, predictions = jobs.pair_regression(marked, "id")
    return jobs.regression_split_report(predictions).withColumn("mse", r6("mse", 4))


HUMOR_SPLIT_SQL = (
    SPLIT3_SQL.replace("story_id", "id").replace("FROM stories)", "FROM humor)").replace("'690-", "'69-")
)


SCALAR_SQL = (
    HUMOR_SPLIT_SQL
    + ", docs AS (SELECT id AS row_id, humor_rating AS label, split FROM humor JOIN s3 USING (id))"
    + _words_sql("(SELECT *, id AS row_id FROM humor)", {"tokens": "text"})
    + """, mu AS (SELECT avg(label) AS mu FROM docs WHERE split = 'train'),
 dw AS (SELECT DISTINCT row_id, token FROM inp),
 tv AS (SELECT token, (sum(label) + 5 * any_value(mu)) / (count(*) + 5) AS v FROM dw JOIN docs USING (row_id) CROSS JOIN mu
        WHERE split = 'train' GROUP BY token),
 x AS (SELECT d.row_id, d.split, d.label, coalesce(f.x, mu) AS x FROM docs d CROSS JOIN mu
       LEFT JOIN (SELECT row_id, avg(v) AS x FROM dw JOIN tv USING (token) GROUP BY row_id) f ON f.row_id = d.row_id),
 fit AS (SELECT regr_slope(label, x) AS a, regr_intercept(label, x) AS b FROM x WHERE split = 'train')
"""
)


@query(
    "mlj_text_scalar",
    SCALAR_SQL
    + """SELECT split, round(avg((a * x + b - label) * (a * x + b - label)), 5) AS mse, count(*) AS samples
         FROM x CROSS JOIN fit WHERE split <> 'train' GROUP BY split""",
    ["humor"],
)
def mlj_text_scalar(spark: SparkSession, sf: str) -> DataFrame:
    rated = shaping.rename_target(fx.humor(spark, sf), "humor_rating").select("id", "text", "label")
    _, predictions = jobs.text_scalar(splits.split3(rated, "id", seed=69), "id")
    return jobs.regression_split_report(predictions).withColumn("mse", r6("mse", 5))


@query(
    "mlj_text_class",
    HUMOR_SPLIT_SQL
    + ", docs AS (SELECT id AS row_id, is_humor::INTEGER AS label, split FROM humor JOIN s3 USING (id))"
    + _words_sql("(SELECT *, id AS row_id FROM humor)", {"tokens": "text"})
    + bayes_sql(2)
    + REPORT_SQL
    + "SELECT * FROM report",
    ["humor"],
)
def mlj_text_class(spark: SparkSession, sf: str) -> DataFrame:
    """Classification of a single text by its renamed 0/1 target."""
    rated = shaping.rename_target(fx.humor(spark, sf), "is_humor").select("id", "text", F.col("label").cast("int").alias("label"))
    _, predictions = jobs.class_job(
        jobs.single_text_input(splits.split3(rated, "id", seed=69), "id"), ["tokens"], n_labels=2
    )
    return class_report(predictions)


JOINT_SQL = (
    "SELECT report.*, perplexity FROM (WITH "
    + (CATEGORY_JOB_SQL + "SELECT * FROM report) report").strip().removeprefix("WITH ")
    + f" JOIN ({PERPLEXITY_SQL.strip()}) USING (split)"
)


@query("mlj_joint_report", JOINT_SQL, ["story_labels"])
def mlj_joint_report(spark: SparkSession, sf: str) -> DataFrame:
    _, predictions = jobs.category(split_stories(spark, sf))
    return jobs.joint_report(class_report(predictions), split_perplexity(spark, sf)).withColumn("perplexity", r6("perplexity", 4))


def _joint_sql(steps: int, buckets: int, width: int, labels: int, rate: float) -> str:
    """Loss and gradient of every step as joins and sums over the weights' entries."""

    def start(name: str, rows: tuple[str, int], columns: tuple[str, int], salt: int) -> str:
        a, b, c, m = joint.START
        value = f"((({a} * {rows[0]} + {b} * {columns[0]} + {c} * {salt}) % {m}) / {m}::DOUBLE - 0.5)"
        return f"{name} AS MATERIALIZED (SELECT {rows[0]}, {columns[0]}, {value} AS v FROM range({rows[1]}) r({rows[0]}), range({columns[1]}) c({columns[0]}))"

    parts = [start("e0", ("h", buckets), ("d", width), 1), start("c0", ("d", width), ("k", labels), 2), start("o0", ("d", width), ("g", buckets), 3)]
    for r in range(steps + 1):
        parts += [
            f"x{r} AS MATERIALIZED (SELECT row_id, d, sum(w * v) AS x FROM f JOIN e{r} USING (h) GROUP BY row_id, d)",
            f"z{r} AS MATERIALIZED (SELECT row_id, k, sum(x * v) AS z FROM x{r} JOIN c{r} USING (d) GROUP BY row_id, k)",
            f"p{r} AS MATERIALIZED (SELECT row_id, k, label, z, exp(z) / sum(exp(z)) OVER w - (k = label)::INTEGER AS gap, ln(sum(exp(z)) OVER w) - z AS loss"
            f" FROM z{r} JOIN lab USING (row_id) WINDOW w AS (PARTITION BY row_id))",
            f"u{r} AS MATERIALIZED (SELECT h, g, u, exp(u) / sum(exp(u)) OVER w AS q, ln(sum(exp(u)) OVER w) - u AS loss"
            f" FROM (SELECT h, g, sum(e.v * o.v) AS u FROM e{r} e JOIN o{r} o USING (d) GROUP BY h, g) WINDOW w AS (PARTITION BY h))",
            f"l{r} AS (SELECT {r} AS step, (SELECT avg(loss) FROM p{r} WHERE k = label) AS class_loss,"
            f" (SELECT sum(n * loss) / sum(n) FROM pairs JOIN u{r} USING (h, g)) AS next_loss)",
        ]
        if r == steps:
            break
        parts += [
            f"gu{r} AS MATERIALIZED (SELECT u.h, u.g, (ctx.n * q - coalesce(pairs.n, 0)) / (SELECT sum(n) FROM pairs) AS gap"
            f" FROM u{r} u JOIN ctx ON ctx.h = u.h LEFT JOIN pairs ON pairs.h = u.h AND pairs.g = u.g)",
            f"gx{r} AS MATERIALIZED (SELECT row_id, d, sum(gap * v) AS gx FROM p{r} JOIN c{r} USING (k) GROUP BY row_id, d)",
            f"ge{r} AS (SELECT h, d, sum(m) AS m FROM ("
            f"SELECT h, d, sum(w * gx) / (SELECT count(*) FROM lab) AS m FROM f JOIN gx{r} USING (row_id) GROUP BY h, d"
            f" UNION ALL SELECT h, d, sum(gap * v) FROM gu{r} JOIN o{r} USING (g) GROUP BY h, d) GROUP BY h, d)",
            f"gc{r} AS (SELECT d, k, sum(x * gap) / (SELECT count(*) FROM lab) AS m FROM x{r} JOIN p{r} USING (row_id) GROUP BY d, k)",
            f"go{r} AS (SELECT d, g, sum(v * gap) AS m FROM e{r} JOIN gu{r} USING (h) GROUP BY d, g)",
            *[
                f"{n}{r + 1} AS MATERIALIZED (SELECT {i}, {j}, v - {rate} * coalesce(m, 0) AS v FROM {n}{r} LEFT JOIN g{n}{r} USING ({i}, {j}))"
                for n, i, j in (("e", "h", "d"), ("c", "d", "k"), ("o", "d", "g"))
            ],
        ]
    whole = " UNION ALL ".join(f"SELECT * FROM l{r}" for r in range(steps + 1))
    return f"""
, tok AS (SELECT row_id, i, ('0x' || substr(md5(token), 1, 6))::BIGINT % {buckets} AS h FROM (
          SELECT story_id AS row_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (
            SELECT story_id, {fx.sql_word_tokens('lower(' + STORY_SQL + ')')} AS t FROM story_labels JOIN s3 USING (story_id) WHERE split = 'train'))),
 lab AS MATERIALIZED (SELECT story_id AS row_id, label FROM story_labels JOIN s3 USING (story_id) WHERE split = 'train'),
 f AS MATERIALIZED (SELECT row_id, h, count(*)::DOUBLE / any_value(size) AS w FROM tok JOIN (SELECT row_id, count(*) AS size FROM tok GROUP BY row_id) USING (row_id)
      GROUP BY row_id, h),
 pairs AS MATERIALIZED (SELECT h, g, count(*)::DOUBLE AS n FROM (SELECT h, lead(h) OVER (PARTITION BY row_id ORDER BY i) AS g FROM tok) WHERE g IS NOT NULL GROUP BY h, g),
 ctx AS (SELECT h, sum(n) AS n FROM pairs GROUP BY h),
 {", ".join(parts)}
SELECT step::INTEGER AS step, round(class_loss, 6) AS class_loss, round(next_loss, 6) AS next_loss, round(class_loss + next_loss, 6) AS loss
FROM ({whole})"""


@query(
    "mlj_joint_fit",
    SPLIT3_SQL.replace("FROM stories)", "FROM story_labels)") + _joint_sql(2, 32, 4, 4, 2.0),
    ["story_labels"],
)
def mlj_joint_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of the first two steps of one model for the stories' classes and their next words."""
    train = jobs.story_input(split_stories(spark, sf)).filter("split = 'train'")
    _, history = joint.fit_joint(train, 4, buckets=32, width=4, steps=2, rate=2.0)
    return history.select("step", *[r6(c).alias(c) for c in ("class_loss", "next_loss", "loss")])
