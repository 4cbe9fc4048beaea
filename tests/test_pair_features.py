"""Features of text pairs are made once."""

from taleweave.operators import bayes


def rows(spark):
    texts = [(f"r{i}", [f"w{i % 3}", "night", "knight"], [f"v{i % 4}", "right"] if i % 5 else [], float(i % 7)) for i in range(30)]
    return spark.createDataFrame(texts, "row_id string, a array<string>, b array<string>, label double")


def test_learning_reads_features_at_rest(spark, monkeypatch):
    plans, fit = [], bayes.LinearRegression.fit

    def caught(learner, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(learner, df)

    monkeypatch.setattr(bayes.LinearRegression, "fit", caught)
    model = bayes.fit_word_regression(rows(spark), ["a", "b"], "row_id", length=4)
    assert len(plans) == 1 and "levenshtein" not in plans[0]
    assert bayes.predict_word_regression(model, rows(spark), "row_id").count() == 30


def test_codes_are_compared_once_for_both_texts(spark):
    terms = spark.createDataFrame([("a", "night", 1.0), ("b", "right", 2.0)], "field string, token string, value double")
    means = bayes._attended_means(rows(spark), ["a", "b"], terms, 3.0, "row_id", 4)
    assert means._jdf.queryExecution().optimizedPlan().toString().count("levenshtein") == 1
    got = {r["row_id"]: (r["_to_b"], r["_to_a"]) for r in means.collect()}
    assert len(got) == 30 and got["r0"] == (None, None) and 2 < got["r1"][0] <= 3 and 1 < got["r1"][1] <= 3
