"""Models over all words of one or several token columns: naive Bayes classes, and a regression on words' mean labels.

The model is a table: for every word of every column, its log share in each class. Nothing is hashed, no word is left out,
and fitting is one count. Scores are sums over a text's words, so fitting and scoring are joins and groupings only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel

from taleweave.functions.phonetic import phonetic_code
from taleweave.operators.similarity import attended_both
from taleweave.session import dealt, hand_over, with_entries


@dataclass
class BayesModel:
    """``terms`` (field, token, scores) with a log share for each class, and the classes' log priors."""

    fields: Sequence[str]
    terms: DataFrame
    priors: list[float]

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.terms.sparkSession
        rows = [(list(self.fields), self.priors)]
        spark.createDataFrame(rows, "fields array<string>, priors array<double>").write.mode("overwrite").parquet(f"{path}/priors")

    @classmethod
    def load(cls, path: str) -> BayesModel:
        spark = SparkSession.active()
        head = spark.read.parquet(f"{path}/priors").first()
        return cls(head.fields, spark.read.parquet(f"{path}/terms"), list(head.priors))


def _words(df: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each word of each column."""

    def of(field: str) -> Column:
        return F.transform(field, lambda t: F.struct(F.lit(field).alias("field"), t.alias("token")))

    named = [of(field) for field in fields]
    return df.select(*keep, F.explode_outer(F.concat(*named)).alias("_w")).filter("_w is not null").select(*keep, "_w.*")


def fit_bayes(train: DataFrame, fields: Sequence[str], n_labels: int, weighted: bool = False) -> BayesModel:
    """Counts plus one; ``weighted`` gives every class present the same weight (rows / (classes * rows of the class))."""
    return fit_bayes_each(train, fields, n_labels, [F.col("label")], weighted)[0]


def fit_bayes_each(
    train: DataFrame, fields: Sequence[str], n_labels: int, labels: Sequence[Column], weighted: bool = False
) -> list[BayesModel]:
    """A model for each label of the same texts; the words are counted once for all of them."""
    owns = [f"_label{k}" for k in range(len(labels))]
    texts = train.select(*fields, *[label.alias(own) for label, own in zip(labels, owns, strict=True)])
    known = [F.count_if(F.col(own) == c) for own in owns for c in range(n_labels)]
    counted = texts.agg(F.count(F.lit(1)).alias("rows"), *[n.alias(f"n{i}") for i, n in enumerate(known)]).first()
    weights, priors = [], []
    for k in range(len(owns)):
        rows = [counted[f"n{k * n_labels + c}"] for c in range(n_labels)]
        if sum(rows) < counted["rows"]:
            raise ValueError(f"{counted['rows'] - sum(rows)} labels are missing or not within 0 to {n_labels - 1}")
        whole, present = sum(rows), sum(n > 0 for n in rows)
        weights.append([(whole / (present * n) if n else 0.0) if weighted else 1.0 for n in rows])
        mass = [n * w for n, w in zip(rows, weights[k], strict=True)]
        total = 0.0
        for m in mass:
            total += m
        priors.append([math.log((m + 1) / (total + n_labels)) for m in mass])
    cells = [
        F.array(*[F.count_if(F.col(own) == c) * F.lit(w) for c, w in enumerate(weights[k])]).alias(f"n{k}") for k, own in enumerate(owns)
    ]
    counts = hand_over(_words(texts, fields, owns).groupBy("field", "token").agg(*cells), "word-counts")
    sums = counts.groupBy("field").agg(
        F.count(F.lit(1)).alias("v"),
        *[F.array(*[F.sum(F.get(f"n{k}", F.lit(c))) for c in range(n_labels)]).alias(f"all{k}") for k in range(len(owns))],
    )
    scores = [
        F.zip_with(f"n{k}", f"all{k}", lambda n, a: F.log((n + 1) / (a + F.col("v")))).alias(f"scores{k}") for k in range(len(owns))
    ]
    terms = hand_over(counts.join(hand_over(sums, "field-sums"), "field").select("field", "token", *scores), "terms")
    return [
        BayesModel(fields, terms.select("field", "token", F.col(f"scores{k}").alias("scores")), priors[k]) for k in range(len(owns))
    ]


def score_bayes(model: BayesModel, df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``z``, the log score of each class; words that learning did not see say nothing."""
    return score_bayes_each([model], df, key, ["z"])


def score_bayes_each(models: Sequence[BayesModel], df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """``df`` with the scores of each model (of the same columns) under its name; the words are looked up once for all."""
    fields, sizes = models[0].fields, [len(model.priors) for model in models]
    terms = models[0].terms.withColumnRenamed("scores", "scores0")
    if len(models) > 1:
        every = None
        for k, model in enumerate(models):
            own = model.terms.select("field", "token", F.lit(k).alias("_k"), "scores")
            every = own if every is None else every.unionByName(own)
        of = [F.max(F.when(F.col("_k") == k, F.col("scores"))).alias(f"scores{k}") for k in range(len(models))]
        terms = hand_over(every.groupBy("field", "token").agg(*of), "terms")
    # the larger a word's share in any class, the more frequent it is
    weight = F.array_max(F.array_compact(F.array(*[F.array_max(f"scores{k}") for k in range(len(models))])))
    found = with_entries(_words(df, fields, [key]), terms, ["field", "token"], weight)
    sums = [F.array(*[F.sum(F.get(f"scores{k}", F.lit(c))) for c in range(n)]).alias(f"_sums{k}") for k, n in enumerate(sizes)]
    scored = df.join(found.groupBy(key).agg(*sums), key, "left")
    for k, (model, name) in enumerate(zip(models, names, strict=True)):
        prior = F.array(*[F.lit(p) for p in model.priors])
        said = F.get(f"_sums{k}", F.lit(0)).isNotNull()
        scored = scored.withColumn(name, F.when(said, F.zip_with(prior, f"_sums{k}", lambda a, b: a + b)).otherwise(prior))
    return scored.drop(*[f"_sums{k}" for k in range(len(models))])


# Texts of the mean label that each word's own mean is drawn towards.
PRIOR_TEXTS = 5


@dataclass
class WordRegression:
    """Each word's mean label (field, token, value), the mean of all, and a line through the texts' means.

    ``attended`` words of each of two fields also take the values of the other field's words, by phonetic similarity.
    """

    fields: Sequence[str]
    extra: Sequence[str]
    terms: DataFrame
    mean: float
    line: LinearRegressionModel
    attended: int = 0

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        head = self.terms.sparkSession.createDataFrame(
            [(list(self.fields), list(self.extra), self.mean, self.attended)],
            "fields array<string>, extra array<string>, mean double, attended int",
        )
        head.write.mode("overwrite").parquet(f"{path}/head")
        self.line.write().overwrite().save(f"{path}/line")

    @classmethod
    def load(cls, path: str) -> WordRegression:
        spark = SparkSession.active()
        head = spark.read.parquet(f"{path}/head").first()
        line = LinearRegressionModel.load(f"{path}/line")
        return cls(head.fields, head.extra, spark.read.parquet(f"{path}/terms"), head.mean, line, head.attended)


def _different(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.withColumns({name: F.array_distinct(name) for name in fields})


def _with_values(words: DataFrame, terms: DataFrame, how: str = "inner") -> DataFrame:
    """Words with their entries; saved tables of earlier versions don't say in how many texts a word is."""
    on = ["field", "token"]
    return with_entries(words, terms, on, F.col("texts"), how) if "texts" in terms.columns else words.join(terms, on, how)


def _attended_means(df: DataFrame, fields: Sequence[str], terms: DataFrame, mean: float, key: str, length: int) -> DataFrame:
    """For each of two fields the mean over its words of what they attend to in the other field (see ``attended``)."""
    first = df.select(key, *[F.array_distinct(F.slice(F.col(name), 1, length)).alias(name) for name in fields])
    words = _with_values(_words(first, fields, [key]), terms, "left")
    # a word that learning saw was coded with its entry
    known = [F.col("code")] if "code" in terms.columns else []
    code = F.coalesce(*known, phonetic_code(F.col("token"))).alias("code")
    coded = words.select(key, "field", code, F.coalesce("value", F.lit(mean)).alias("value"))
    codes = coded.groupBy(key, "field", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    entry = F.struct("code", "n", "v")
    sides = dealt(codes, key).groupBy(key).agg(*[F.collect_list(F.when(F.col("field") == name, entry)).alias(name) for name in fields])
    a, b = (F.col(name) for name in fields)
    both = sides.select(key, F.explode(F.array(attended_both(a, b))).alias("_both"))  # made once, not once for each field
    return both.select(key, F.col("_both.own").alias(f"_to_{fields[1]}"), F.col("_both.other").alias(f"_to_{fields[0]}"))


def _mean_features(
    df: DataFrame, fields: Sequence[str], extra: Sequence[str], terms: DataFrame, mean: float, key: str, length: int = 0
) -> DataFrame:
    """``features``: for each column the mean value of a text's different words (``mean`` if none is known), then ``extra``,
    then what the first ``length`` words of each of two columns attend to in the other one."""
    found = _with_values(_words(_different(df, fields), fields, [key]), terms)
    each = found.groupBy(key).agg(*[F.avg(F.when(F.col("field") == name, F.col("value"))).alias(f"_mean_{name}") for name in fields])
    names = [f"_mean_{name}" for name in fields]
    joined = df.join(each, key, "left")
    if length:
        joined = joined.join(_attended_means(df, fields, terms, mean, key, length), key, "left")
        names += [f"_to_{name}" for name in reversed(fields)]
    joined = joined.fillna(mean, names)
    return VectorAssembler(inputCols=[*names, *extra], outputCol="features").transform(joined).drop(*names)


def fit_word_regression(
    train: DataFrame, fields: Sequence[str], key: str, extra: Sequence[str] = (), length: int = 0
) -> WordRegression:
    """One count for the words' means, then least squares over as many features as there are columns."""
    mean = float(train.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0])
    words = _words(_different(train, fields), fields, ["label"])
    value = (F.sum("label") + PRIOR_TEXTS * F.lit(mean)) / (F.count(F.lit(1)) + PRIOR_TEXTS)
    terms = words.groupBy("field", "token").agg(value.alias("value"), F.count(F.lit(1)).alias("texts"))
    terms = hand_over(terms.withColumn("code", phonetic_code(F.col("token"))) if length else terms, "word-means")
    learner = LinearRegression(featuresCol="features", labelCol="label", predictionCol="pred", solver="normal")
    # learning reads its rows more than once
    line = learner.fit(hand_over(_mean_features(train, fields, extra, terms, mean, key, length).select("features", "label"), "features"))
    return WordRegression(fields, extra, terms, mean, line, length)


def predict_word_regression(model: WordRegression, df: DataFrame, key: str) -> DataFrame:
    features = _mean_features(df, model.fields, model.extra, model.terms, model.mean, key, model.attended)
    return model.line.transform(features).drop("features")
