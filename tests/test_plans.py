"""Physical plans: no cartesian product, no row-level single partition, no Python in expression operators."""

import pytest

from taleweave.plans import fixtures as fx
from taleweave.plans.catalog import QUERIES

PYTHON = {
    "txt_rouge_l",
    "txt_rouge_l_rows",
    "txt_rouge_bootstrap",
    "txt_metric_bundle",
    "txt_generated_report",
    "udf_batched_map",
    "udf_grouped_apply",
    "udf_metric_state",
}
PLANNED = sorted(n for n in QUERIES if not n.startswith(("mlj_", "dec_generate", "txt_generated")))
# Global aggregates end in one row; limits and class tables are a few rows; a row index adds up one size per partition.
FEW_ROWS = (
    "prj_row_index",
    "evl_",
    "los_",
    "agg_",
    "txt_",
    "smp_",
    "tok_overlength",
    "tok_vocab",
    "lm_perplexity",
    "udf_metric_state",
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_plan(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if not name.startswith(FEW_ROWS):
        assert "SinglePartition" not in text
    if name not in PYTHON:
        assert "Python" not in text and "ArrowEval" not in text


def test_split_is_a_constant_comparison(spark, sf):
    from taleweave.operators.splits import split3

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    text = plan(split3(docs, "doc_id").filter("split = 'train'"))
    assert "Exchange" not in text and "Subquery" not in text and "Join" not in text


def test_scan_reads_only_what_is_used(spark, sf):
    text = plan(QUERIES["agg_label_histogram"](spark, sf))
    assert "source" not in text and "lang" not in text


def test_packing_shuffles_once(spark, sf):
    text = plan(QUERIES["tok_pack_blocks"](spark, sf))
    # One exchange spreads the single-file test table, one brings a batch together.
    assert text.count("Exchange hashpartitioning") == 2


def test_top_k_limits_groups_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES["smp_topk_tokens"](spark, sf))


def test_counting_rows_shuffles_no_text(spark, sf):
    """Documents are read as they are: only work on whole texts deals rows out, and only where files are few."""
    docs = fx.table(spark, sf, "documents")
    assert "Exchange" not in plan(docs.select("doc_id", "lang"))
    wide = docs.repartition(spark.sparkContext.defaultParallelism)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["pho_pair_similarity", "pho_matrix", "txt_rouge_l_rows"])
def test_work_on_pairs_is_spread(spark, sf, name):
    """Their bytes are few, so that adaptive execution would make one partition of them."""
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, sf))
