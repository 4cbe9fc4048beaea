"""The registered queries over the document tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from taleweave.llm.codes import compress
from taleweave.llm.common import held_out, table
from taleweave.llm.exact import exact_groups
from taleweave.llm.extraction import extract, train_extraction
from taleweave.llm.fingerprint import compare_with_edit
from taleweave.llm.jaccard import jaccard_groups
from taleweave.llm.mixing import mix
from taleweave.llm.packing import pack
from taleweave.llm.pii import find_pii, train_pii
from taleweave.llm.quality import THRESHOLD as QUALITY_THRESHOLD, quality_score, train_quality
from taleweave.llm.repair import repair_report
from taleweave.llm.sharding import shards
from taleweave.llm.simhash import near_groups
from taleweave.llm.toxicity import THRESHOLD as TOXICITY_THRESHOLD, toxicity_score, train_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    scored = docs.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(docs, quality_score(train_quality(docs, table(spark, sf_dir, "labels"))), QUALITY_THRESHOLD)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(docs, toxicity_score(train_toxicity(docs, table(spark, sf_dir, "labels"))), TOXICITY_THRESHOLD)


@query
def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edit(table(spark, sf_dir, "documents"))


@query
def op4_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train_extraction(pages))


@query
def op7_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("row")


@query
def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), hash_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


ORACLES["op8_exact"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
WINDOW same AS (PARTITION BY t)
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), report=True)


ORACLES["op9_mixing"] = """
WITH d AS (
    SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
           concat_ws('-', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, ''))) AS name
    FROM documents),
b AS (SELECT source, sum(size) AS bytes, sqrt(CAST(sum(size) AS DOUBLE)) AS goal FROM d GROUP BY source),
r AS (SELECT source, round(goal / (SELECT sum(goal) FROM b) * (SELECT sum(bytes) FROM b) / bytes, 6) AS rate FROM b),
p AS (
    SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
    FROM r, LATERAL (SELECT unnest(range(CAST(floor(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM p),
n AS (
    SELECT d.doc_id, d.source, d.name, CAST(count(*) AS INTEGER) AS copies
    FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source
     AND c.upto <= CAST('0x' || substr(md5('mix-' || d.name), 1, 12) AS BIGINT) / 281474976710656.0
    GROUP BY ALL)
SELECT doc_id, source, copies, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('mix-order-' || name || '-' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n)
"""


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, train_pii(docs))


@query
def op11_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


ORACLES["op11_token_groups"] = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT k, array_to_string(w[i:i + 2], ' ') AS s
    FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT k, count(*) AS n FROM shingles GROUP BY k),
links AS MATERIALIZED (
    SELECT a.k AS a, b.k AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.k <> b.k
    JOIN sizes x ON x.k = a.k JOIN sizes y ON y.k = b.k
    GROUP BY a.k, b.k, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (
    SELECT k AS a, k AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM words w JOIN reach r ON r.a = w.k JOIN words o ON o.k = r.b LEFT JOIN sizes z ON z.k = w.k
GROUP BY w.k, w.doc_id
"""


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


# The edits of one row after each state of the output so far (0 nothing, S, U or A last): rows inserted before it, then
# what becomes of it. ``need`` is the initial of a row that is kept.
ORACLES["op12_repair"] = r"""
WITH RECURSIVE bit AS (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS x
    FROM range(256) r(i)),
crc AS (SELECT list(x ORDER BY i) AS t FROM bit),
named AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name,
           coalesce(role, ' ') AS r, coalesce(text, ' ') AS x
    FROM conversations),
faulty AS (
    SELECT conv_id, turn, r, x, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT),
                               lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS fault
    FROM named, crc),
broken AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE r END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text,
           unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM faulty WHERE fault <> 0),
placed AS (
    SELECT *, row_number() OVER w AS n, left(role, 1) AS initial, left(lag(role) OVER w, 1) AS before,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
           regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
    FROM broken WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
marked AS (
    SELECT *, ending = '' AS blank, ending <> '' AND seen AS duplicate,
           ending <> '' AND NOT seen AND NOT regexp_matches(ending, '[.!?]') AS cut
    FROM placed),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows
    FROM marked GROUP BY conv_id),
ins(state, after, audit) AS (
    VALUES ('0', '0', ''), ('S', 'S', ''), ('U', 'U', ''), ('A', 'A', ''), ('0', 'U', 'I'), ('S', 'U', 'I'), ('A', 'U', 'I'),
           ('U', 'A', 'I'), ('0', 'A', 'II'), ('S', 'A', 'II')),
act(state, after, edit, cost, need) AS (
    VALUES ('0', 'S', 'K', 0, 's'), ('0', 'U', 'K', 0, 'u'), ('S', 'U', 'K', 0, 'u'), ('A', 'U', 'K', 0, 'u'), ('U', 'A', 'K', 0, 'a'),
           ('0', 'U', 'R', 2, NULL), ('S', 'U', 'R', 2, NULL), ('A', 'U', 'R', 2, NULL), ('U', 'A', 'R', 2, NULL),
           ('0', '0', 'D', 3, NULL), ('S', 'S', 'D', 3, NULL), ('U', 'U', 'D', 3, NULL), ('A', 'A', 'D', 3, NULL)),
moves AS (
    SELECT i.state, a.after, i.audit || a.edit AS audit, 2 * length(i.audit) + a.cost AS cost, a.edit, a.need
    FROM ins i JOIN act a ON a.state = i.after),
best AS (
    SELECT conv_id, 0::BIGINT AS n, '0' AS state, {'cost': 0::BIGINT, 'audit': ''} AS least FROM counts
    UNION ALL
    SELECT b.conv_id, b.n + 1, m.after,
           min({'cost': b.least.cost + m.cost + CASE WHEN m.edit <> 'D' AND r.cut THEN 1 ELSE 0 END, 'audit': b.least.audit || m.audit})
    FROM best b JOIN marked r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.n = b.n + 1
    JOIN moves m ON m.state = b.state AND (m.edit = 'D' OR NOT (r.blank OR r.duplicate)) AND (m.need IS NULL OR m.need = r.initial)
    GROUP BY b.conv_id, b.n, m.after),
plan AS (
    SELECT c.conv_id, min({'cost': b.least.cost + 2 * length(i.audit), 'audit': b.least.audit || i.audit}) AS least
    FROM counts c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.n = c.rows
    JOIN ins i ON i.state = b.state AND i.after IN ('0', 'A') GROUP BY c.conv_id),
steps AS (
    SELECT conv_id, least.audit AS audit, unnest(range(1, length(least.audit) + 1)) AS k,
           length(replace(least.audit, 'D', '')) % 2 AS system
    FROM plan),
lines AS (
    SELECT conv_id, k, audit[k] AS edit, length(replace(audit[1:k], 'D', '')) - 1 AS place, system,
           length(replace(audit[1:k], 'I', '')) AS n
    FROM steps),
written AS (
    SELECT l.conv_id, sha256(string_agg(
               CASE WHEN l.edit = 'K' THEN r.role WHEN (l.place - l.system) % 2 = 0 THEN 'user' ELSE 'assistant' END
               || ':' || CASE WHEN l.edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY l.k)) AS hash
    FROM lines l LEFT JOIN marked r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.n = l.n
    WHERE l.edit <> 'D' GROUP BY l.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(p.least.cost, 0) AS cost,
       coalesce(p.least.audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query
def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = 6) -> str:
    """Assignment and floored means, written out for each round."""

    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
    SELECT k, p, min({{'d': list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i]))), 'e': e}}) AS near
    FROM q JOIN c{r} c USING (p) GROUP BY k, p)"""

    steps = []
    for r in range(rounds):
        steps.append(assigned(r))
        steps.append(f"""c{r + 1} AS MATERIALIZED (
    SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
        SELECT p, e, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS x FROM (
            SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (
                SELECT p, near.e AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM q JOIN a{r} USING (k, p))
            GROUP BY p, e, i) GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)""")
    steps.append(assigned(rounds))
    return f"""
WITH whole AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (
    SELECT k, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM whole, range(8) parts(p)),
c0 AS MATERIALIZED (SELECT p, k - 1 AS e, x FROM q WHERE k <= 16),
{", ".join(steps)},
coded AS (
    SELECT k, string_agg(lower(lpad(to_hex(near.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error
    FROM a{rounds} GROUP BY k),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS hash FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, hash AS codebooks_sha256
FROM whole JOIN coded USING (k), book
"""


ORACLES["op13_codes"] = _codes_sql()
