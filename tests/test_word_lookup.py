"""Word tables met in two parts, frequent entries where rows lie and the others by a shuffle: nothing lost, nothing twice."""

import pytest
from pyspark.sql import functions as F

from taleweave import session
from taleweave.operators import bayes, tokens

TEXTS = [(1, ["a", "b", "a", "c"]), (2, []), (3, ["d", "a", "x"]), (3, ["e", "b"]), (None, ["a", "e"]), (4, None)]


def test_encode_looks_up_frequent_and_other_tokens(spark, monkeypatch):
    monkeypatch.setattr(tokens, "COMMON", 2)
    texts = spark.createDataFrame(TEXTS, "id int, t array<string>")
    words = [("a", 2), ("b", 3), ("c", 4), ("d", 5), ("e", 6)]
    encoded = tokens.encode(texts, "id", "t", spark.createDataFrame(words, "token string, token_id int"))
    rows = {r["id"]: r["input_ids"] for r in encoded.collect()}
    # texts of one key are one text, in order of place, then id
    assert rows == {1: [2, 3, 2, 4], 2: [], 3: [5, 6, 2, 3, 1], None: [2, 6], 4: []}


@pytest.mark.parametrize("common", [1, 2, 3, 4, 100])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_entries_in_two_parts(spark, monkeypatch, common, how):
    monkeypatch.setattr(session, "COMMON", common)
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "z"), (4, None)], "k int, token string")
    table = spark.createDataFrame([("a", 9, 0.5), ("b", 5, 1.5), ("c", 5, 2.5), ("d", 1, 3.5)], "token string, n int, v double")
    joined = session.with_entries(rows, table, ["token"], F.col("n"), how).select("k", "token", "n", "v")
    plain = rows.join(table, "token", how).select("k", "token", "n", "v")
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_labels_of_one_text_are_counted_and_scored_together(spark, monkeypatch):
    monkeypatch.setattr(session, "COMMON", 2)
    rows = [(1, ["a", "b"], [0, 1]), (2, ["a", "c", "c"], [1, 1]), (3, ["d"], [0, 0]), (4, ["zz"], [1, 0])]
    texts = spark.createDataFrame(rows, "row_id int, t array<string>, label array<int>")
    labels = [F.get("label", F.lit(i)) for i in range(2)]
    models = bayes.fit_bayes_each(texts, ["t"], 2, labels)
    together = bayes.score_bayes_each(models, texts, "row_id", ["z0", "z1"]).collect()
    for i in range(2):
        alone = bayes.fit_bayes(texts.withColumn("label", labels[i]), ["t"], 2)
        z = {r["row_id"]: r["z"] for r in bayes.score_bayes(alone, texts, "row_id").collect()}
        assert {r["row_id"]: pytest.approx(r[f"z{i}"]) for r in together} == z
