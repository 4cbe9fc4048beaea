"""Tokens, packing, phonetic similarity and generated-text metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taleweave.functions import phonetic, stemmer
from taleweave.functions.arrays import bind
from taleweave.functions.text import (
    join_text,
    last_token_value,
    pad,
    padded_position_ids,
    truncate,
    whitespace_tokens,
    word_tokens,
    wrap_special,
)
from taleweave.operators import metricstate, pieces, similarity, textmetrics, tokens
from taleweave.operators.shaping import story_text
from taleweave.plans import fixtures as fx
from taleweave.plans.registry import digest, joined, query, r6
from taleweave.plans.shaping_queries import STORY_SQL, TOKENS_128_SQL
from taleweave.session import dealt, hand_over, scratch_path

WORDS_SQL = fx.sql_word_tokens("text")


def words(spark: SparkSession, sf: str) -> DataFrame:
    return fx.texts(spark, sf).select("doc_id", word_tokens(F.col("text")).alias("tokens"))


@query(
    "tok_tokenize",
    f"SELECT doc_id, len(t) AS n_tokens, {fx.sql_digest('t')} AS tokens FROM (SELECT doc_id, {WORDS_SQL} AS t FROM documents)",
)
def tok_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), digest("tokens").alias("tokens"))


VOCAB_SQL = f"""
WITH t AS (SELECT doc_id, {WORDS_SQL} AS t FROM documents),
     v AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id
           FROM (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM t) GROUP BY token))
"""


@query("tok_vocabulary", VOCAB_SQL + "SELECT token, n, token_id::INTEGER AS token_id FROM v")
def tok_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.build_vocab(words(spark, sf), "tokens")


@query(
    "tok_vocab_encode",
    VOCAB_SQL
    + f"""SELECT doc_id, count(i) AS n_tokens, md5(coalesce(string_agg(coalesce(token_id, 1)::VARCHAR, ' ' ORDER BY i) FILTER (WHERE i IS NOT NULL), '')) AS ids
          FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM t
                UNION ALL SELECT doc_id, NULL, NULL FROM t WHERE len(t) = 0) x
          LEFT JOIN v ON v.token = x.token GROUP BY doc_id""",
)
def tok_vocab_encode(spark: SparkSession, sf: str) -> DataFrame:
    texts = words(spark, sf)
    vocab = tokens.build_vocab(texts, "tokens")
    encoded = tokens.encode(texts, "doc_id", "tokens", vocab)
    return encoded.select(
        "doc_id", F.size("input_ids").cast("long").alias("n_tokens"), digest("input_ids").alias("ids")
    )


def story_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return fx.stories(spark, sf).select("story_id", word_tokens(story_text()).alias("tokens"))


STORY_TOKENS_SQL = f"WITH t AS (SELECT story_id, {fx.sql_word_tokens(STORY_SQL)} AS t FROM stories)\n"


@query(
    "tok_truncate",
    STORY_TOKENS_SQL + f"SELECT story_id, {fx.sql_joined('t[1:64]', ' ')} AS tokens FROM t",
    ["stories"],
)
def tok_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return story_tokens(spark, sf).select("story_id", joined(truncate(F.col("tokens"), 128, 64), " ").alias("tokens"))


@query(
    "tok_pad_mask",
    STORY_TOKENS_SQL
    + f"""SELECT story_id, {fx.sql_joined("t[1:128] || list_transform(range(greatest(128 - len(t), 0)), lambda x: '[PAD]')", ' ')} AS tokens,
                 repeat('1', least(len(t), 128)::INTEGER) || repeat('0', greatest(128 - len(t), 0)::INTEGER) AS mask FROM t""",
    ["stories"],
)
def tok_pad_mask(spark: SparkSession, sf: str) -> DataFrame:
    cut = story_tokens(spark, sf).withColumn("tokens", truncate(F.col("tokens"), 128))
    return tokens.fixed_input(cut, "tokens", 128, "[PAD]").select(
        "story_id", joined("tokens", " ").alias("tokens"), joined("attention_mask", "").alias("mask")
    )


@query(
    "tok_pad_dynamic",
    STORY_TOKENS_SQL
    + f""", b AS (SELECT *, max(len(t)) OVER (PARTITION BY split_part(story_id, '-', 1)::BIGINT // 16) AS longest FROM t),
          w AS (SELECT story_id, t, (ceil(longest / 8.0::DOUBLE) * 8)::INTEGER AS width FROM b)
        SELECT story_id, width AS padded_length,
               {fx.sql_digest("t || list_transform(range(width - len(t)), lambda x: '[PAD]')")} AS tokens, len(t) AS n_real FROM w""",
    ["stories"],
)
def tok_pad_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    batched = story_tokens(spark, sf).withColumn("batch", F.floor(fx.story_document() / 16))
    padded = tokens.pad_batches(batched, "batch", "tokens", "[PAD]")
    real = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, m: a + m)
    return padded.select("story_id", "padded_length", digest("tokens").alias("tokens"), real.alias("n_real"))


@query(
    "tok_overlength",
    f"""SELECT count(*) AS texts, count(*) FILTER (WHERE n > 512) AS too_long, max(n) AS longest
        FROM (SELECT len({WORDS_SQL}) AS n FROM documents)""",
)
def tok_overlength(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.overlength(words(spark, sf), "tokens", 512)


@query(
    "tok_wrap_special",
    TOKENS_128_SQL
    + f"SELECT pair_id, {fx.sql_digest('''c || list_transform(range(128 - len(c)), lambda x: '')''')} AS tokens FROM t",
    ["text_pairs"],
)
def tok_wrap_special(spark: SparkSession, sf: str) -> DataFrame:
    text = join_text(F.col("candidate"), F.col("reference"))
    return fx.text_pairs(spark, sf).select("pair_id", digest(wrap_special(word_tokens(text))).alias("tokens"))


PIECES_SQL = f"""
WITH RECURSIVE counted AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS word FROM documents) GROUP BY word),
 state AS (
    SELECT 0 AS round, [w[1]] || list_transform(w[2:], lambda c: '##' || c) AS s, n::BIGINT AS n,
           []::STRUCT(l VARCHAR, r VARCHAR, n BIGINT)[] AS merges, 0::BIGINT AS done
    FROM (SELECT string_split(word, '') AS w, n FROM counted)
    UNION ALL
    SELECT c.round + 1, list_transform(list_reduce(list_transform(c.s, lambda x: [x]),
               lambda a, x: CASE WHEN list_contains(b.keys, a[-1] || ' ' || x[1]) THEN a[:-2] || [a[-1] || x[1][3:] || chr(2)] ELSE a || x END),
               lambda x: replace(x, chr(2), '')), c.n, b.merges, c.done + len(b.merges)
    FROM state c, (
        SELECT list({{'l': l, 'r': r, 'n': n}} ORDER BY n DESC, l, r) AS merges, list(l || ' ' || r) AS keys
        FROM (SELECT l, r, n FROM (
                 SELECT l, r, n, done, row_number() OVER (ORDER BY n DESC, l, r) AS rank FROM (
                     SELECT l, r, n, done, count(*) AS k FROM (
                         SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, l, r) AS place FROM (
                             SELECT l, r, n, done, unnest(CASE WHEN l = r THEN [l] ELSE [l, r] END) AS symbol FROM (
                                 SELECT s[i] AS l, s[i + 1] AS r, sum(n)::BIGINT AS n, any_value(done) AS done
                                 FROM (SELECT s, n, done, unnest(range(1, len(s))) AS i FROM state) GROUP BY 1, 2)))
                     WHERE place = 1 GROUP BY l, r, n, done HAVING count(*) = CASE WHEN l = r THEN 1 ELSE 2 END))
              WHERE rank <= 200 - done)) b
    WHERE c.done < 200 AND len(b.merges) > 0),
 learned AS (
    SELECT (row_number() OVER (ORDER BY round, k) - 1)::INTEGER AS rank, (round - 1)::INTEGER AS round, m.l AS "left", m.r AS "right",
           m.l || m.r[3:] AS piece, m.n AS n
    FROM (SELECT round, k, merges[k] AS m FROM (SELECT round, any_value(merges) AS merges FROM state WHERE round > 0 GROUP BY round),
          LATERAL (SELECT unnest(range(1, len(merges) + 1)) AS k)))
"""
ENCODED_SQL = (
    PIECES_SQL
    + f""", pattern AS (
    SELECT '(?:' || string_agg(p, '|' ORDER BY length(p) DESC, p) || ')|\x01?(?s:.)' AS p
    FROM (SELECT DISTINCT CASE WHEN piece LIKE '##%' THEN piece[3:] ELSE chr(1) || piece END AS p FROM learned)),
 cut AS (SELECT word, list_transform(regexp_extract_all(chr(1) || word, (SELECT p FROM pattern)),
                lambda p: CASE WHEN p[1] = chr(1) THEN p[2:] ELSE '##' || p END) AS pieces FROM counted),
 said AS (SELECT doc_id, i, t[i] AS word FROM (SELECT doc_id, {WORDS_SQL} AS t FROM documents), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
 enc AS (SELECT doc_id, flatten(list(pieces ORDER BY i)) AS pieces FROM said JOIN cut USING (word) GROUP BY doc_id)
"""
)


@query("tok_piece_vocab", PIECES_SQL + "SELECT * FROM learned")
def tok_piece_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 merges learned from the words of all documents."""
    return pieces.learn_merges(pieces.word_counts(words(spark, sf), "tokens"), 200)


@query(
    "tok_piece_encode",
    ENCODED_SQL
    + f"""SELECT d.doc_id, coalesce(len(pieces), 0)::INTEGER AS n_pieces, {fx.sql_digest("coalesce(pieces, [])")} AS pieces,
       {fx.sql_digest("(['[CLS]'] || list_transform(coalesce(pieces, []), lambda p: regexp_replace(p, '^#+|#+$', '', 'g')) || ['[SEP]'])[:128]")} AS bare
       FROM documents d LEFT JOIN enc USING (doc_id)""",
)
def tok_piece_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's longest pieces, and the first 128 of them wrapped and without their marks."""
    own = words(spark, sf)
    learned = [r["piece"] for r in pieces.learn_merges(pieces.word_counts(own, "tokens"), 200).collect()]
    cut = own.select("doc_id", pieces.to_pieces(F.col("tokens"), learned).alias("p"))
    return cut.select(
        "doc_id", F.size("p").alias("n_pieces"), digest("p").alias("pieces"), digest(similarity.marked_tokens(F.col("p"), 128)).alias("bare")
    )


BLOCKS_SQL = """
WITH flat AS (SELECT batch, token, row_number() OVER (PARTITION BY batch ORDER BY doc_id, i) - 1 AS g
              FROM (SELECT batch, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM doc_tokens)),
     blocks AS (SELECT batch, g // 128 AS block, string_agg(token, ' ' ORDER BY g) AS text
                FROM flat GROUP BY batch, g // 128 HAVING count(*) = 128)
"""


@query("tok_pack_blocks", BLOCKS_SQL + "SELECT batch, block, md5(text) AS tokens FROM blocks", ["doc_tokens"])
def tok_pack_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = tokens.pack_blocks(fx.doc_tokens(spark, sf), "doc_id", "tokens", "batch", 128)
    return blocks.select("batch", "block", digest("input_ids").alias("tokens"))


@query(
    "tok_lm_labels",
    BLOCKS_SQL + "SELECT batch, block, md5(text) AS input_ids, md5(text) AS labels FROM blocks",
    ["doc_tokens"],
)
def tok_lm_labels(spark: SparkSession, sf: str) -> DataFrame:
    blocks = tokens.pack_blocks(fx.doc_tokens(spark, sf), "doc_id", "tokens", "batch", 128)
    return tokens.with_lm_labels(blocks).select(
        "batch", "block", digest("input_ids").alias("input_ids"), digest("labels").alias("labels")
    )


@query("tok_next_pairs", "SELECT prev, next, n FROM bigrams", ["bigrams"])
def tok_next_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.pair_counts(fx.doc_tokens(spark, sf), "tokens")


def padded_width(n_tokens: Column, multiple: int = 128) -> Column:
    """The smallest multiple that holds all tokens."""
    return (F.ceil(n_tokens / multiple) * multiple).cast("int")


@query(
    "tok_position_ids",
    STORY_TOKENS_SQL
    + """, m AS (SELECT story_id, p, (p <= len(t))::INTEGER AS mask
                 FROM (SELECT story_id, t, unnest(range(1, (ceil(len(t) / 128.0) * 128)::BIGINT + 1)) AS p FROM t)),
           c AS (SELECT story_id, p, CASE WHEN mask = 0 THEN 1 ELSE sum(mask) OVER (PARTITION BY story_id ORDER BY p) - 1 END AS id FROM m)
         SELECT story_id, string_agg(id::VARCHAR, ',' ORDER BY p) AS position_ids FROM c GROUP BY story_id""",
    ["stories"],
)
def tok_position_ids(spark: SparkSession, sf: str) -> DataFrame:
    sizes = story_tokens(spark, sf).select("story_id", F.size("tokens").alias("n"))
    return sizes.select("story_id", joined(padded_position_ids(F.col("n"), padded_width(F.col("n")))).alias("position_ids"))


@query(
    "tok_last_nonpad",
    STORY_TOKENS_SQL + "SELECT story_id, t[len(t)] AS last_token FROM t",
    ["stories"],
)
def tok_last_nonpad(spark: SparkSession, sf: str) -> DataFrame:
    padded = story_tokens(spark, sf).select(
        "story_id", pad(F.col("tokens"), padded_width(F.size("tokens")), F.lit("[PAD]")).alias("ids")
    )
    return padded.select(
        "story_id", last_token_value(F.col("ids"), F.col("ids"), F.lit("[PAD]")).alias("last_token")
    )


# ---------------------------------------------------------------- phonetic codes and similarity

FOLDED_SQL = (
    "replace(replace(replace(translate(lower({t}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'),"
    " 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
)
LETTERS_SQL = f"regexp_replace({FOLDED_SQL}, '[^a-z]', '', 'g')"
DICTIONARY_SQL = f"WITH d AS (SELECT DISTINCT token FROM (SELECT unnest({WORDS_SQL}) AS token FROM documents)),\n"


def _chain(start: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        start = f"regexp_replace({start}, '{pattern}', '{replacement}', 'g')"
    return start


# RE2 has no look-around and no back-references in patterns, so context is matched and put back, twice where two
# matches can share a letter, and doubled letters are collapsed letter by letter.
_DOUBLES = [(f"{c}+", c) for c in "bcdfhjklmnpqrstvwxyz"]
_OPENING = [("^ae", "E"), ("^[gkp]n", "N"), ("^wr", "R"), ("^x", "S"), ("^wh", "W"), ("mb$", "M")]
_MIDDLE = [
    ("th", "0"),
    ("t?ch|sh", "X"),
    ("c(ia)", r"X\1"),
    ("[st](i[ao])", r"X\1"),
    ("s?c([iey])", r"S\1"),
    ("ck|q", "K"),
    ("dg([iey])", r"J\1"),
    ("d", "T"),
    ("g(h[^aeiou])", r"\1"),
    ("g(h[^aeiou])", r"\1"),
    ("gn(ed)?", "N"),
    ("([^g]|^)g([iey])", r"\1J\2"),
    ("([^g]|^)g([iey])", r"\1J\2"),
    ("g+", "K"),
    ("ph", "F"),
    ("([aeiou])h([^aeiou]|$)", r"\1\2"),
    ("[wy]([^aeiou]|$)", r"\1"),
    ("[wy]([^aeiou]|$)", r"\1"),
    ("z", "S"),
    ("v", "F"),
]


def metaphone_views(source: str) -> str:
    """CTE text that codes the ``token`` column of ``source`` into view ``meta(token, code)``."""
    return f"""
  m1 AS (SELECT token, {_chain(LETTERS_SQL.format(t='token'), _DOUBLES + _OPENING)} AS x FROM {source}),
  m2 AS (SELECT token, substr(x, 1, 1) || replace(substr(x, 2), 'sch', 'SK') AS x FROM m1),
  m3 AS (SELECT token, {_chain('x', _MIDDLE)} AS x FROM m2),
  meta AS (SELECT token, upper(substr(x, 1, 1) || regexp_replace(substr(x, 2), '[aeiou]+', '', 'g')) AS code FROM m3)
"""


@query(
    "pho_soundex",
    DICTIONARY_SQL
    + f"""l AS (SELECT token, upper({LETTERS_SQL.format(t='token')}) AS w FROM d),
     c AS (SELECT token, w, translate(w, 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556') AS s,
                  regexp_replace(translate(substr(w, 2), 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556'), '[HW]', '', 'g') AS tail FROM l),
     k AS (SELECT token, w, substr(s, 1, 1) || tail AS s FROM c)
   SELECT token, CASE WHEN w = '' THEN '' ELSE substr(w, 1, 1) || rpad(coalesce(array_to_string(list_filter(string_split(s, ''),
              lambda x, i: i > 1 AND x <> substr(s, i - 1, 1) AND x <> '0')[1:3], ''), ''), 3, '0') END AS code FROM k""",
)
def pho_soundex(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary(spark, sf).select("token", phonetic.soundex(F.col("token")).alias("code"))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_rows(words(spark, sf), "tokens").distinct()


@query(
    "pho_refined_soundex",
    DICTIONARY_SQL
    + f"""l AS (SELECT token, upper({LETTERS_SQL.format(t='token')}) AS w FROM d),
     k AS (SELECT token, w, translate(regexp_replace(w, '[HW]', '', 'g'), 'AEIOUYBPFVCKSGJQXZDTLMNR', '000000112233344555667889') AS s FROM l)
   SELECT token, substr(w, 1, 1) || coalesce(array_to_string(list_filter(string_split(s, ''),
              lambda x, i: i = 1 OR x <> substr(s, i - 1, 1)), ''), '') AS code FROM k""",
)
def pho_refined_soundex(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary(spark, sf).select("token", phonetic.refined_soundex(F.col("token")).alias("code"))


@query("pho_metaphone", DICTIONARY_SQL + metaphone_views("d") + "SELECT token, code FROM meta")
def pho_metaphone(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary(spark, sf).select("token", phonetic.metaphone(F.col("token")).alias("code"))


# Long form of the matrix: one row per cell of the padded square.
CELLS_SQL = (
    TOKENS_128_SQL
    + """, pos AS (SELECT pair_id, i, CASE WHEN i <= len(c) THEN c[i] ELSE '' END AS token FROM t, unnest(range(1, 129)) AS u(i)),
  d AS (SELECT DISTINCT token FROM pos WHERE token NOT IN ('[CLS]', '[SEP]', '[PAD]', '[UNK]', '[MASK]', '')),"""
    + metaphone_views("d")
    + """, coded AS (SELECT pair_id, i, code FROM pos LEFT JOIN meta USING (token)),
  cells AS (SELECT a.pair_id, a.i, b.i AS j, CASE WHEN a.code IS NULL OR b.code IS NULL THEN 0
                   ELSE levenshtein(a.code, b.code) END AS d
            FROM coded a JOIN coded b ON b.pair_id = a.pair_id)
"""
)


def code_arrays(spark: SparkSession, sf: str) -> DataFrame:
    text = join_text(F.col("candidate"), F.col("reference"))
    marked = similarity.marked_tokens(word_tokens(text), 128)
    return dealt(fx.text_pairs(spark, sf), "pair_id").select("pair_id", similarity.codes(marked).alias("codes"))


def distance_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Matrices by their different rows."""
    return code_arrays(spark, sf).select("pair_id", similarity.distance_matrix(F.col("codes"), 128, whole=False).alias("m"))


def row_digest(row: Column, matrix: Column) -> Column:
    """As :func:`digest` of the whole row."""
    return F.md5(F.array_join(similarity.whole_row(row, matrix).cast("array<string>"), " "))


def with_cells(m: str, change: Callable[[Column], Column]) -> Column:
    """The matrix with other cells in their places."""
    return bind(F.col(m), lambda x: F.when(x.isNotNull(), F.struct(change(x).alias("cells"), x["slots"].alias("slots"), x["often"].alias("often")))).alias(m)


@query(
    "pho_pair_distance",
    CELLS_SQL + "SELECT pair_id, d AS distance, count(*) AS n FROM cells GROUP BY pair_id, d",
    ["text_pairs"],
)
def pho_pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    """How often each distance occurs between the tokens of a text."""
    rows = distance_matrices(spark, sf).select("pair_id", F.col("m.often").alias("often"), F.posexplode_outer("m.cells").alias("i", "row"))
    own = F.get("often", F.col("i")).alias("k")
    cells = rows.select("pair_id", own, F.inline_outer(F.arrays_zip("row", "often")).alias("distance", "often"))
    # a text that is null has no cells, and one row
    n = F.sum(F.coalesce((F.col("k") * F.col("often")).cast("long"), F.lit(1).cast("long")))
    return cells.groupBy("pair_id", F.col("distance").cast("long").alias("distance")).agg(n.alias("n"))


@query(
    "pho_matrix",
    CELLS_SQL
    + """SELECT pair_id, (i - 1)::INTEGER AS i, md5(string_agg(d::VARCHAR, ' ' ORDER BY j)) AS distances FROM cells GROUP BY pair_id, i""",
    ["text_pairs"],
)
def pho_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = similarity.matrix_rows(distance_matrices(spark, sf), "pair_id", "m", row_digest)
    return rows.select("pair_id", "i", F.col("row").alias("distances"))


@query(
    "pho_invert",
    CELLS_SQL
    + """, s AS (SELECT *, max(d) OVER (PARTITION BY pair_id) - d + 1 AS s FROM cells)
        SELECT pair_id, (i - 1)::INTEGER AS i, md5(string_agg(s::VARCHAR, ' ' ORDER BY j)) AS scores FROM s GROUP BY pair_id, i""",
    ["text_pairs"],
)
def pho_invert(spark: SparkSession, sf: str) -> DataFrame:
    inverted = distance_matrices(spark, sf).select("pair_id", with_cells("m", lambda m: similarity.inverted(m["cells"])))
    rows = similarity.matrix_rows(inverted, "pair_id", "m", row_digest)
    return rows.select("pair_id", "i", F.col("row").alias("scores"))


SOFTMAX_SQL = (
    CELLS_SQL
    + """, s AS (SELECT *, max(d) OVER (PARTITION BY pair_id) - d + 1 AS s FROM cells),
     e AS (SELECT pair_id, i, exp((s - max(s) OVER (PARTITION BY pair_id))::DOUBLE) AS e FROM s),
     p AS (SELECT pair_id, i, e / sum(e) OVER (PARTITION BY pair_id) AS p FROM e)
"""
)
SOFTMAX_ROWS_SQL = SOFTMAX_SQL + """SELECT pair_id, (i - 1)::INTEGER AS i, round(sum(p) * 1000, 6) AS p_sum,
       round(max(p) * 1000, 6) AS p_max, round(min(p) * 1000, 6) AS p_min FROM p GROUP BY pair_id, i"""


def _row_summary(df: DataFrame, key: str, matrix: str) -> DataFrame:
    """Per matrix row: sum, largest and smallest probability, in thousandths."""

    def summary(row: Column, m: Column) -> Column:
        row_sum = similarity.weighted_sum(row, m["often"])
        found = (row_sum.alias("p_sum"), F.array_max(row).alias("p_max"), F.array_min(row).alias("p_min"))
        return F.struct(*found)

    rows = similarity.matrix_rows(df, key, matrix, summary)
    return rows.select(key, "i", *[r6(F.col(f"row.{c}") * 1000).alias(c) for c in ("p_sum", "p_max", "p_min")])


@query("pho_softmax", SOFTMAX_ROWS_SQL, ["text_pairs"])
def pho_softmax(spark: SparkSession, sf: str) -> DataFrame:
    matrices = distance_matrices(spark, sf).select(
        "pair_id", with_cells("m", lambda m: similarity.matrix_softmax(similarity.inverted(m["cells"]), m["often"]))
    )
    return _row_summary(matrices, "pair_id", "m")


@query(
    "pho_pair_similarity",
    SOFTMAX_SQL + """SELECT pair_id, round(sum(p), 6) AS total, round(max(p) * 1000, 6) AS p_max,
       round(min(p) * 1000, 6) AS p_min, round(sum(p * p) * 1000, 6) AS p_square FROM p GROUP BY pair_id""",
    ["text_pairs"],
)
def pho_pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    featured = similarity.pair_similarity(dealt(fx.text_pairs(spark, sf), "pair_id"), "candidate", "reference", whole=False)

    def summary(m: Column) -> Column:
        def over_cells(value: Callable[[Column], Column]) -> Column:
            sums = F.transform(m["cells"], lambda row: similarity.weighted_sum(value(row), m["often"]))
            return similarity.weighted_sum(sums, m["often"])

        return F.struct(
            over_cells(lambda row: row).alias("total"),
            F.array_max(F.transform(m["cells"], lambda row: F.array_max(row))).alias("p_max"),
            F.array_min(F.transform(m["cells"], lambda row: F.array_min(row))).alias("p_min"),
            over_cells(lambda row: F.transform(row, lambda x: x * x)).alias("p_square"),
        )

    found = featured.select("pair_id", bind(F.col("similarity"), summary).alias("p"))
    return found.select("pair_id", r6("p.total").alias("total"), *[r6(F.col(f"p.{c}") * 1000).alias(c) for c in ("p_max", "p_min", "p_square")])


# ---------------------------------------------------------------- generated-text metrics


def _mt_sql(text: str) -> str:
    e = text
    for pattern, replacement in (
        ("<skipped>", ""), ("-\\n", ""), ("\\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ):
        e = f"regexp_replace({e}, '{pattern}', '{replacement}', 'g')"
    e = f"(' ' || {e} || ' ')"
    for pattern, replacement in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        e = f"regexp_replace({e}, '{pattern}', '{replacement}', 'g')"
    return fx.sql_ws_tokens(e)


BLEU_SQL = f"""
WITH t AS (SELECT pair_id, {_mt_sql('candidate')} AS c, {_mt_sql('reference')} AS r FROM text_pairs),
 cg AS (SELECT pair_id, n, array_to_string(c[i:i + n - 1], ' ') AS g, count(*) AS k
        FROM t, unnest([1, 2, 3, 4]) AS o(n), unnest(range(1, len(c) - n + 2)) AS u(i) GROUP BY ALL),
 rg AS (SELECT pair_id, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS k
        FROM t, unnest([1, 2, 3, 4]) AS o(n), unnest(range(1, len(r) - n + 2)) AS u(i) GROUP BY ALL),
 o AS (SELECT cg.n, sum(least(cg.k, coalesce(rg.k, 0)))::DOUBLE AS m, sum(cg.k)::DOUBLE AS t
       FROM cg LEFT JOIN rg ON rg.pair_id = cg.pair_id AND rg.n = cg.n AND rg.g = cg.g GROUP BY cg.n),
 z AS (SELECT n, CASE WHEN m > 0 THEN 100 * m / t
                      ELSE 100 / (pow(2, (SELECT count(*) FROM o b WHERE b.n <= o.n AND b.m = 0)) * t) END AS p FROM o),
 len AS (SELECT sum(len(c))::DOUBLE AS c, sum(len(r))::DOUBLE AS r FROM t)
SELECT round((CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END) * (SELECT exp(avg(ln(p))) FROM z), 6) AS bleu,
       c::BIGINT AS candidate_tokens, r::BIGINT AS reference_tokens FROM len
"""


@query("txt_bleu", BLEU_SQL, ["text_pairs"])
def txt_bleu(spark: SparkSession, sf: str) -> DataFrame:
    pairs = fx.text_pairs(spark, sf).select(
        "pair_id",
        textmetrics.mt_tokens(F.col("candidate")).alias("c"),
        textmetrics.mt_tokens(F.col("reference")).alias("r"),
    )
    return textmetrics.bleu(pairs, "pair_id", "c", "r").withColumn("bleu", r6("bleu"))


LCS_SQL = """RECURSIVE
WITH t AS (SELECT pair_id, regexp_extract_all(lower(candidate), '[a-z0-9]+') AS a,
                  regexp_extract_all(lower(reference), '[a-z0-9]+') AS b FROM text_pairs),
 l AS (SELECT pair_id, 0::BIGINT AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS best FROM t
       UNION ALL
       SELECT pair_id, i, list_transform(range(1, len(step) + 1), lambda j: list_max(step[1:j])) AS best
       FROM (SELECT l.pair_id, l.i + 1 AS i,
                    list_transform(range(1, len(t.b) + 2), lambda j: CASE WHEN j = 1 THEN 0::BIGINT
                      ELSE greatest(l.best[j], l.best[j - 1] + (t.b[j - 1] = t.a[l.i + 1])::BIGINT) END) AS step
             FROM l JOIN t ON t.pair_id = l.pair_id WHERE l.i < len(t.a))),
 f AS (SELECT t.pair_id, best[len(b) + 1] AS lcs, len(a) AS na, len(b) AS nb FROM l JOIN t ON t.pair_id = l.pair_id AND l.i = len(t.a)),
 s AS (SELECT pair_id, lcs, CASE WHEN lcs = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * lcs / (na + nb) END AS rouge FROM f)
"""


def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.text_pairs(spark, sf).select(
        "pair_id",
        textmetrics.overlap_tokens(F.col("candidate")).alias("c"),
        textmetrics.overlap_tokens(F.col("reference")).alias("r"),
    )


@query("txt_rouge_l", LCS_SQL + "SELECT round(avg(rouge), 6) AS rouge FROM s", ["text_pairs"])
def txt_rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    return textmetrics.rouge_l(overlap_pairs(spark, sf), "pair_id", "c", "r").select(r6("rouge").alias("rouge"))


@query(
    "txt_rouge_l_rows",
    LCS_SQL + "SELECT pair_id, lcs::INTEGER AS lcs, round(rouge, 6) AS rouge_l FROM s",
    ["text_pairs"],
)
def txt_rouge_l_rows(spark: SparkSession, sf: str) -> DataFrame:
    return textmetrics.rouge_l_rows(overlap_pairs(spark, sf), "pair_id", "c", "r").withColumn("rouge_l", r6("rouge_l"))


def _bootstrap_sql(replicates: int = 1000) -> str:
    drawn = "('0x' || substr(h, (3 * j + 1)::INTEGER, 3))::INTEGER"
    weight = " + ".join(f"({drawn} >= {cut})::INTEGER" for cut in textmetrics.resample_cuts())
    return f""", hashed AS (SELECT rouge, b, md5('690-' || pair_id || '-' || b) AS h FROM s, unnest(range({-(-replicates // 10)})) AS u(b)),
 drawn AS (SELECT rouge, b * 10 + j AS replicate, {weight} AS w FROM hashed, unnest(range(10)) AS u(j)),
 means AS (SELECT replicate, sum(w * rouge) / sum(w) AS mean FROM drawn GROUP BY replicate HAVING sum(w) > 0)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS mid, round(quantile_cont(mean, 0.975), 6) AS high
FROM means"""


@query("txt_rouge_bootstrap", LCS_SQL + _bootstrap_sql(), ["text_pairs"])
def txt_rouge_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval and middle of the mean ROUGE-L over 1,000 resamples."""
    rows = textmetrics.rouge_l_rows(overlap_pairs(spark, sf), "pair_id", "c", "r")
    return textmetrics.bootstrap(rows, "pair_id", "rouge_l").select(*[r6(c).alias(c) for c in ("low", "mid", "high")])


METEOR_SQL = f"""
WITH t AS (SELECT pair_id, {fx.sql_ws_tokens('lower(candidate)')} AS c, {fx.sql_ws_tokens('lower(reference)')} AS r FROM text_pairs),
 cw AS (SELECT pair_id, i, c[i] AS w, row_number() OVER (PARTITION BY pair_id, c[i] ORDER BY i DESC) AS k
        FROM t, unnest(range(1, len(c) + 1)) AS u(i)),
 rw AS (SELECT pair_id, i, r[i] AS w, row_number() OVER (PARTITION BY pair_id, r[i] ORDER BY i DESC) AS k
        FROM t, unnest(range(1, len(r) + 1)) AS u(i)),
 hit AS (SELECT cw.pair_id, cw.i AS ci, rw.i AS ri FROM cw JOIN rw ON rw.pair_id = cw.pair_id AND rw.w = cw.w AND rw.k = cw.k),
 ch AS (SELECT pair_id, count(*)::DOUBLE AS m, count(*) - count(*) FILTER (WHERE EXISTS (
               SELECT 1 FROM hit h WHERE h.pair_id = hit.pair_id AND h.ci = hit.ci - 1 AND h.ri = hit.ri - 1)) AS chunks
        FROM hit GROUP BY pair_id),
 s AS (SELECT t.pair_id, coalesce(m, 0)::BIGINT AS m, coalesce(chunks, 0)::BIGINT AS chunks,
              CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE
                (m / len(c)) * (m / len(r)) / (0.9::DOUBLE * (m / len(c)) + 0.1::DOUBLE * (m / len(r)))
                * (1 - 0.5::DOUBLE * pow(chunks / m, 3)) END AS meteor
       FROM t LEFT JOIN ch ON ch.pair_id = t.pair_id)
"""


def word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.text_pairs(spark, sf).select(
        "pair_id",
        textmetrics.lower_words(F.col("candidate")).alias("c"),
        textmetrics.lower_words(F.col("reference")).alias("r"),
    )


@query("txt_meteor", METEOR_SQL + "SELECT round(avg(meteor), 6) AS meteor FROM s", ["text_pairs"])
def txt_meteor(spark: SparkSession, sf: str) -> DataFrame:
    return textmetrics.meteor(word_pairs(spark, sf), "pair_id", "c", "r").select(r6("meteor").alias("meteor"))


@query(
    "txt_meteor_rows",
    METEOR_SQL + "SELECT pair_id, m, chunks, round(meteor, 6) AS meteor FROM s",
    ["text_pairs"],
)
def txt_meteor_rows(spark: SparkSession, sf: str) -> DataFrame:
    return textmetrics.meteor_rows(word_pairs(spark, sf), "pair_id", "c", "r").withColumn("meteor", r6("meteor"))


def _stem_sql() -> str:
    """``stems`` (w, stem): the steps of the stemmer one after the other, each as one CASE over the words so far."""

    def less(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def like(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def table(rules: list[tuple[str, str]]) -> str:
        whens = " ".join(f"WHEN w LIKE '%{s}' THEN CASE WHEN {like(less(len(s)), stemmer.POSITIVE)} THEN {less(len(s))} || '{r}' ELSE w END"
                         for s, r in sorted(rules, key=lambda r: -len(r[0])))
        return f"CASE {whens} ELSE w END"

    def removed(s: str) -> str:
        fits = like(less(len(s)), stemmer.MANY) + (f" AND {like(less(len(s)), '[st]$')}" if s == "ion" else "")
        return f"WHEN w LIKE '%{s}' THEN CASE WHEN {fits} THEN {less(len(s))} ELSE w END"

    vowel = [f"WHEN w LIKE '%{s}' THEN {like(less(len(s)), stemmer.VOWEL)}" for s in ("ed", "ing")]
    steps = [
        f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {less(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {less(1)} ELSE w END",
        # a word that lost ed or ing carries a mark into the next step
        f"""CASE WHEN w LIKE '%eed' THEN CASE WHEN {like(less(3), stemmer.POSITIVE)} THEN {less(1)} ELSE w END
             WHEN CASE {' '.join(vowel)} ELSE false END THEN left(w, length(w) - CASE WHEN w LIKE '%ed' THEN 2 ELSE 3 END) || '\x01' ELSE w END""",
        f"""CASE WHEN w LIKE '%at\x01' OR w LIKE '%bl\x01' OR w LIKE '%iz\x01' THEN {less(1)} || 'e'
             WHEN w LIKE '%\x01' AND {like(less(1), stemmer.DOUBLE)} THEN {less(2)}
             WHEN w LIKE '%\x01' AND {like(less(1), stemmer.ONE)} AND {like(less(1), stemmer.SHORT)} THEN {less(1)} || 'e'
             WHEN w LIKE '%\x01' THEN {less(1)} ELSE w END""",
        f"CASE WHEN w LIKE '%y' AND {like(less(1), stemmer.VOWEL)} THEN {less(1)} || 'i' ELSE w END",
        table(list(stemmer.STEP_2)),
        table(list(stemmer.STEP_3)),
        f"CASE {' '.join(removed(s) for s in sorted(stemmer.STEP_4, key=lambda s: -len(s)))} ELSE w END",
        f"""CASE WHEN w LIKE '%e' AND ({like(less(1), stemmer.MANY)} OR {like(less(1), stemmer.ONE)} AND NOT {like(less(1), stemmer.SHORT)})
             THEN {less(1)} ELSE w END""",
        f"CASE WHEN w LIKE '%ll' AND {like(less(1), stemmer.MANY)} THEN {less(1)} ELSE w END",
    ]
    sql = "SELECT w AS word, w FROM (SELECT DISTINCT unnest(c || r) AS w FROM t) WHERE length(w) > 2 AND w NOT LIKE '%\x01%'"
    for step in steps:
        sql = f"SELECT word, {step} AS w FROM ({sql})"
    return f", stems AS MATERIALIZED (SELECT word, w AS stem FROM ({sql}))"


STEM_METEOR_SQL = (
    METEOR_SQL[: METEOR_SQL.index(" ch AS")].rstrip().rstrip(",")
    + _stem_sql()
    + """,
 lc AS (SELECT cw.pair_id, cw.i, coalesce(stem, cw.w) AS w FROM cw LEFT JOIN stems ON word = cw.w
        WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.pair_id = cw.pair_id AND h.ci = cw.i)),
 lr AS (SELECT rw.pair_id, rw.i, coalesce(stem, rw.w) AS w FROM rw LEFT JOIN stems ON word = rw.w
        WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.pair_id = rw.pair_id AND h.ri = rw.i)),
 kc AS (SELECT *, row_number() OVER (PARTITION BY pair_id, w ORDER BY i DESC) AS k FROM lc),
 kr AS (SELECT *, row_number() OVER (PARTITION BY pair_id, w ORDER BY i DESC) AS k FROM lr),
 every AS (SELECT * FROM hit UNION ALL
           SELECT kc.pair_id, kc.i, kr.i FROM kc JOIN kr ON kr.pair_id = kc.pair_id AND kr.w = kc.w AND kr.k = kc.k),
"""
    + METEOR_SQL[METEOR_SQL.index(" ch AS") :].replace("FROM hit", "FROM every").replace("hit.", "every.")
)


@query("txt_meteor_stem", STEM_METEOR_SQL + "SELECT pair_id, m, chunks, round(meteor, 6) AS meteor FROM s", ["text_pairs"])
def txt_meteor_stem(spark: SparkSession, sf: str) -> DataFrame:
    """METEOR with a second stage: words with equal stems are matched where equal words were not."""
    rows = textmetrics.meteor_rows(word_pairs(spark, sf), "pair_id", "c", "r", stems=True)
    return rows.withColumn("meteor", r6("meteor"))


def _alone(sql: str, column: str) -> str:
    """One value of a query that has views of its own."""
    body = sql.strip()
    if body.startswith("RECURSIVE"):
        body = body.removeprefix("RECURSIVE").strip().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"(SELECT {column} FROM ({body}))"


BUNDLE_SQL = ", ".join(
    f"{_alone(sql, name)} AS {name}"
    for name, sql in (
        ("bleu", BLEU_SQL),
        ("rouge", LCS_SQL + "SELECT round(avg(rouge), 6) AS rouge FROM s"),
        ("meteor", METEOR_SQL + "SELECT round(avg(meteor), 6) AS meteor FROM s"),
    )
)


@query("txt_metric_bundle", f"SELECT {BUNDLE_SQL}", ["text_pairs"])
def txt_metric_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """bleu, rouge and meteor in one row; each has its own SQL check above."""
    return textmetrics.metric_bundle(fx.text_pairs(spark, sf), "pair_id", "candidate", "reference").select(
        *[r6(c).alias(c) for c in ("bleu", "rouge", "meteor")]
    )


@query("udf_metric_state", f"SELECT {BUNDLE_SQL}, (SELECT count(*) FROM text_pairs) AS texts", ["text_pairs"])
def udf_metric_state(spark: SparkSession, sf: str) -> DataFrame:
    """bleu, rouge and meteor of three batches added to two states, one of them twice, and merged."""
    pairs = hand_over(fx.text_pairs(spark, sf), "pairs")
    left, right, whole = (scratch_path(spark, "state") for _ in range(3))
    part = F.pmod(F.crc32(F.col("pair_id").cast("binary")), F.lit(3))
    for path, batch in ((left, 0), (left, 1), (right, 2), (right, 1), (left, 0)):
        sums = metricstate.text_sums(pairs.filter(part == batch), "pair_id", "candidate", "reference")
        metricstate.add(path, f"part-{batch}", sums)
    metricstate.merge(spark, [left, right], whole)
    state = metricstate.read(spark, whole)
    rows = state.filter("metric = 'rouge' and part = 'rows'").agg(F.sum("value").cast("long").alias("texts"))
    report = metricstate.compute_texts(state).select(*[r6(c).alias(c) for c in ("bleu", "rouge", "meteor")])
    return report.select("*", rows.scalar().alias("texts"))
