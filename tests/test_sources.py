"""Readers and writers: round trips, quarantine, guards and declared schemas."""

import pytest
from pyspark.sql import functions as F, types as T

from taleweave.operators import shaping
from taleweave.sources import readers, schemas, writers

GOOD = "s1 | A b. | C d. | E f. | G h. | I j. | 2"


def lines(spark, path, rows):
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


def test_delimited_fails_on_a_wrong_field_count(spark, tmp_path):
    path = lines(spark, f"{tmp_path}/in", [GOOD, "too | short"])
    with pytest.raises(Exception, match="expected 7 fields"):
        readers.read_delimited(spark, path).collect()


def test_delimited_quarantine(spark, tmp_path):
    path = lines(spark, f"{tmp_path}/in", [GOOD, "too | short", GOOD + " | more"])
    good, bad = readers.read_delimited(spark, path, bad="quarantine")
    assert [r.label for r in good.collect()] == ["2"] and bad.count() == 2
    typed = schemas.cast_to(good, schemas.CATEGORY)
    assert typed.schema["label"].metadata["names"] == schemas.CATEGORY_NAMES and typed.first().label == 2


def test_class_domain_is_enforced(spark):
    df = spark.createDataFrame([("1", 0), ("2", 9), ("3", None)], "k string, label int")
    schema = T.StructType([T.StructField("k", T.StringType()), schemas.class_label("label", ["a", "b"])])
    assert [r.bad for r in schemas.cast_to(df, schema, on_bad="flag").orderBy("k").collect()] == [False, True, True]
    with pytest.raises(Exception, match="outside its class domain"):
        schemas.cast_to(df, schema).collect()


def test_cloze_csv_with_commas_quotes_and_newlines(spark, tmp_path):
    row = ("id,1", 'he said "no"', "two\nlines", "c", "d", "e, f", "g", 2)
    df = spark.createDataFrame([row], schemas.CLOZE_CSV)
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{tmp_path}/csv")
    back = readers.read_cloze_csv(spark, f"{tmp_path}/csv")
    assert tuple(back.first()) == row
    shifted = shaping.zero_based_label(shaping.rename_target(back, "AnswerRightEnding"))
    assert shifted.first().label == 1


def test_split_files_are_validated(spark, tmp_path):
    schema = T.StructType([T.StructField("x", T.LongType())])
    with pytest.raises(ValueError, match="csv or json"):
        readers.read_split_files(spark, {"train": "a.txt", "validation": "b.txt"}, schema)
    with pytest.raises(ValueError, match="extension"):
        readers.read_split_files(spark, {"train": "a.csv", "validation": "b.json"}, schema)
    with pytest.raises(ValueError, match="validation"):
        readers.read_split_files(spark, {"train": "a.csv"}, schema)
    files = {}
    for name, n in (("train", 3), ("validation", 2), ("test", 1)):
        files[name] = f"{tmp_path}/{name}.csv"
        spark.range(n).select(F.col("id").alias("x")).write.option("header", True).csv(files[name])
    got = readers.read_split_files(spark, files, schema)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 3, "validation": 2, "test": 1}


def test_output_guard(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(3)
    writers.write_columnar(df, path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_columnar(df, path)
    writers.write_columnar(spark.range(2), path, overwrite=True)
    assert readers.read_columnar(spark, path).count() == 2


def test_split_directories_are_pruned(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 2, "test").otherwise("train"))
    writers.write_columnar(df, path)
    part = readers.read_columnar(spark, path, "test")
    assert part.count() == 2
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().executedPlan().toString()


def test_prediction_file_starts_with_its_header_and_keeps_order(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 4).cast("int").alias("p")).repartition(5)
    line = writers.single_label_line(F.col("id"), F.col("p"), F.col("p"), schemas.CATEGORY_NAMES)
    writers.write_lines(df, "id", line, f"{tmp_path}/pred")
    parts = sorted(p for p in (tmp_path / "pred").iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text[0] == readers.PREDICTION_HEADER
    assert [t.split(":")[0] for t in text[1:]] == [str(i) for i in range(200)]
    assert readers.read_prediction_lines(spark, f"{tmp_path}/pred").filter("prediction = label").count() == 200


def test_line_forms(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x])
    row = spark.range(1).select(
        writers.multi_label_line(F.lit(3), a(1, 0, 1, 0), a(0, 0, 0, 0), schemas.IMPORTANCE_NAMES),
        writers.regression_line(F.lit(0), F.lit(1.23456)),
        writers.class_line(F.lit(1), F.lit(0), schemas.ENDING_NAMES),
        writers.generated_line(F.lit(2), F.lit("p t\nx"), F.lit("r")),
    ).first()
    assert list(row) == ["3: ['sentence1', 'sentence3'] / []", "0\t1.235", "1\tending1", "2: p t x / r"]


def test_from_columns(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = readers.from_columns(spark, {"a": [1, 2], "b": ["x", "y"]}, schema)
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (2, "y")]
    assert readers.from_columns(spark, df.toPandas(), schema).count() == 2
    with pytest.raises(ValueError):
        readers.from_columns(spark, {"a": [1], "b": []}, schema)


def test_positional_pairing_rejects_unpaired_rows(spark):
    left = spark.range(3).select(F.col("id").alias("row_id"), F.lit(1).alias("pred"))
    right = spark.range(4).select(F.col("id").alias("row_id"), F.lit(1).alias("label"))
    assert shaping.pair_by_position(left, right.filter("row_id < 3")).count() == 3
    with pytest.raises(Exception, match="unpaired row"):
        shaping.pair_by_position(left, right).collect()


def test_model_input_types(spark):
    df = spark.createDataFrame([("t", [1, 0], [1, 2], None)], "text string, label array<int>, input_ids array<int>, x void")
    out = shaping.model_input(df)
    assert dict(out.dtypes) == {"labels": "array<bigint>", "input_ids": "array<int>"}
    real = spark.createDataFrame([(1.5, 2)], "label float, n int")
    assert dict(shaping.model_input(real).dtypes) == {"labels": "double", "n": "int"}


def test_text_columns_by_schema(spark):
    df = spark.createDataFrame([("a", "b", "c", 1)], "x string, sentence1 string, sentence2 string, label int")
    row = shaping.choose_text_columns(df).first()
    assert (row.text_a, row.text_b) == ("b", "c")
    single = shaping.choose_text_columns(df.select("x", "label"))
    assert "text_b" not in single.columns and single.first().text_a == "a"


def test_joined_text_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(shaping.join_text(F.col("x"), F.col("y"))).first()[0] is None


def test_stories_and_rests_hold_every_sentence(spark, sf):
    from collections import defaultdict

    from taleweave.functions.text import sentences
    from taleweave.plans import fixtures as fx

    want = {r.doc_id: list(r.p) for r in fx.table(spark, sf, "documents").select("doc_id", sentences(F.col("text")).alias("p")).collect()}
    got = defaultdict(dict)
    for r in fx.stories(spark, sf).collect():
        doc, part = (int(x) for x in r.story_id.split("-"))
        for i, c in enumerate(fx.STORY_COLUMNS):
            got[doc][5 * part + i] = r[c]
    for r in fx.story_rests(spark, sf).collect():
        base = len(got[r.doc_id])
        assert len(r.rest) < 5
        got[r.doc_id].update({base + i: s for i, s in enumerate(r.rest)})
    assert {d: [p[i] for i in range(len(p))] for d, p in got.items()} == {d: p for d, p in want.items() if p}


def test_every_story_has_a_wrong_ending_from_the_next_one(spark, sf):
    from taleweave.plans import fixtures as fx

    stories = {r.story_id: r.fifth_sentence for r in fx.stories(spark, sf).collect()}
    order = sorted(stories)
    after = dict(zip(order, order[1:] + order[:1]))
    rows = fx.cloze(spark, sf).collect()
    assert len(rows) == len(stories)
    for r in rows:
        ends = [r.RandomFifthSentenceQuiz1, r.RandomFifthSentenceQuiz2]
        assert ends[r.label] == stories[r.InputStoryid] and ends[1 - r.label] == stories[after[r.InputStoryid]]
