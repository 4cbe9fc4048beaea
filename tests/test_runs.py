"""Guarded writes, resumable runs, metric states, grouped maps, attended features and the joint model."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from taleweave.__main__ import main
from taleweave.operators import jobs, joint, metricstate, similarity, textmetrics
from taleweave.operators.batched import map_groups
from taleweave.operators.runs import Run, fingerprint
from taleweave.plans import fixtures as fx
from taleweave.sources import writers


def test_failed_write_leaves_the_target_and_no_rests(spark, tmp_path):
    good = spark.range(10)
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    path = f"{tmp_path}/out"
    with pytest.raises(Exception, match="no"):
        writers.write_columnar(bad, path)
    assert not (tmp_path / "out").exists()
    writers.write_columnar(good, path)
    with pytest.raises(FileExistsError):
        writers.write_columnar(good, path)
    with pytest.raises(Exception, match="no"):
        writers.write_columnar(bad, path, overwrite=True)
    assert spark.read.parquet(path).count() == 10
    writers.write_columnar(spark.read.parquet(path).filter("id < 3"), path, overwrite=True)  # reads what it replaces
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    (tmp_path / "empty").mkdir()
    writers.write_metrics(good.limit(1), f"{tmp_path}/empty")
    assert spark.read.json(f"{tmp_path}/empty").count() == 1


def test_fingerprint_is_of_the_rows(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", [1.0, float(i)]) for i in range(50)], "a long, b string, c array<double>")
    assert fingerprint(df) == fingerprint(df.repartition(5).select("c", "a", "b"))
    assert fingerprint(df) != fingerprint(df.filter("a > 0")) != fingerprint(df.withColumn("b", F.lit("x")))


def test_a_run_cut_off_after_the_fit_goes_on_without_another_one(spark, sf, tmp_path, monkeypatch):
    fx.story_labels(spark, sf).write.parquet(f"{tmp_path}/data")
    args = ["classify", "category", f"{tmp_path}/data", f"{tmp_path}/out", "--resume", f"{tmp_path}/run"]
    with monkeypatch.context() as m:
        m.setattr(jobs, "score_classes", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError, match="cut off"):
            main(args)
    stages = sorted(p.name.split("-")[0] for p in (tmp_path / "run").iterdir())
    assert stages == ["input", "model"] and not (tmp_path / "out").exists()
    with monkeypatch.context() as m:
        m.setattr(jobs, "fit_classes", lambda *a, **k: pytest.fail("fitted again"))
        main(args)
    report = {r.split: r.accuracy for r in spark.read.json(f"{tmp_path}/out/eval_results").collect()}
    main(["classify", "category", f"{tmp_path}/data", f"{tmp_path}/plain"])
    assert report == {r.split: r.accuracy for r in spark.read.json(f"{tmp_path}/plain/eval_results").collect()}
    assert {r.split for r in spark.read.json(f"{tmp_path}/out/samples").collect()} == {"train", "validation", "test"}


def test_a_stage_half_written_is_made_again(spark, tmp_path):
    run = Run(spark, str(tmp_path), "x", k=1)
    made = []

    def build(fail):
        made.append(fail)
        return spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id")) if fail else spark.range(3)

    with pytest.raises(Exception, match="broken"):
        run.table("t", lambda: build(True))
    assert run.table("t", lambda: build(False)).count() == 3 and run.table("t", lambda: build(True)).count() == 3
    assert made == [True, False]
    assert Run(spark, str(tmp_path), "x", k=2).path("t") != run.path("t") != Run(spark, str(tmp_path), "y", k=1).path("t")


def test_saved_importance_and_regressions_are_scored(spark, sf, tmp_path):
    stories = fx.story_importance(spark, sf)
    from taleweave.sources.readers import multihot

    stories.withColumn("label", multihot(F.col("index_list"))).drop("index_list").write.parquet(f"{tmp_path}/imp")
    main(["classify", "importance", f"{tmp_path}/imp", f"{tmp_path}/a", "--save", f"{tmp_path}/m"])
    main(["score", "importance", f"{tmp_path}/imp", f"{tmp_path}/b", "--model", f"{tmp_path}/m"])
    assert spark.read.text(f"{tmp_path}/b/predict_results").count() == stories.count() + 1
    fx.edit_pairs(spark, sf).write.parquet(f"{tmp_path}/pairs")
    main(["regress", "pair", f"{tmp_path}/pairs", f"{tmp_path}/c", "--save", f"{tmp_path}/r"])
    main(["score", "pair", f"{tmp_path}/pairs", f"{tmp_path}/d", "--model", f"{tmp_path}/r"])
    assert spark.read.text(f"{tmp_path}/d/predict_results").count() == fx.edit_pairs(spark, sf).count() + 1


def test_state_counts_a_batch_once(spark, tmp_path):
    rows = [(1, "a cat sat on the mat", "the cat sat on a mat"), (2, "x", "y"), (3, "one two three four five", "one two three four six"), (4, "", "z")]
    df = spark.createDataFrame(rows, "id int, c string, r string")
    one, two, all_ = (f"{tmp_path}/{n}" for n in ("one", "two", "all"))
    assert metricstate.add(one, "x", metricstate.text_sums(df.filter("id < 3"), "id", "c", "r"))
    assert not metricstate.add(one, "x", metricstate.text_sums(df, "id", "c", "r"))
    metricstate.add(two, "y", metricstate.text_sums(df.filter("id >= 3"), "id", "c", "r"))
    metricstate.merge(spark, [one, two, one], all_)
    metricstate.merge(spark, [one], all_)
    got = metricstate.compute_texts(metricstate.read(spark, all_)).first()
    want = textmetrics.metric_bundle(df, "id", "c", "r").first()
    assert [got[n] for n in want.asDict()] == pytest.approx(list(want))
    with pytest.raises(ValueError):
        metricstate.add(one, "../z", df)
    preds = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "label int, pred int")
    for k in ("a", "b", "a"):
        metricstate.add(f"{tmp_path}/cls", k, metricstate.class_sums(preds))
    state = metricstate.read(spark, f"{tmp_path}/cls")
    assert {tuple(r) for r in metricstate.confusion(state).collect()} == {(0, 0, 2), (1, 0, 2), (1, 1, 2)}
    assert metricstate.accuracy(state).first().accuracy == pytest.approx(2 / 3)


def test_hot_groups_are_split_and_merged(spark):
    df = spark.range(5_000).select(F.when(F.col("id") % 10 > 3, "hot").when(F.col("id") % 10 < 3, (F.col("id") % 3).cast("string")).alias("g"), "id")

    def part(rows: pa.Table) -> pa.Table:
        assert len(rows) < 500
        return pa.table({"g": rows.column("g").slice(0, 1), "n": [len(rows)], "s": [pc.sum(rows.column("id")).as_py()], "parts": [1]})

    def merged(rows: pa.Table) -> pa.Table:
        return pa.table({"g": rows.column("g").slice(0, 1), **{n: [pc.sum(rows.column(n)).as_py()] for n in ("n", "s", "parts")}})

    schema = "g string, n long, s long, parts long"
    got = {r.g: r for r in map_groups(df, ["g"], part, schema, merged, schema, ["id"], most=250).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()}
    assert {g: (r.n, r.s) for g, r in got.items()} == {g: (r.n, r.s) for g, r in want.items()}
    assert got["hot"].parts == 12 and got[None].parts == 2


def test_attended_values_are_the_plain_ones(spark):
    import itertools

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(0)
    words = ["".join(p) for p in itertools.product("KT", "AB", "SM")]
    sides = [[(str(w), int(rng.integers(1, 4)), float(rng.normal())) for w in rng.choice(words, n, replace=False)] for n in (5, 3, 0)]
    rows = [(i, j, sides[i], sides[j]) for i in range(3) for j in range(3)]
    kind = "array<struct<code:string,n:bigint,v:double>>"
    df = spark.createDataFrame(rows, f"i int, j int, a {kind}, b {kind}")
    for r in df.select("i", "j", similarity.attended(F.col("a"), F.col("b")).alias("x")).collect():
        own, other = sides[r.i], sides[r.j]
        if not own or not other:
            assert r.x is None
            continue
        taken = []
        for code, n, _ in own:
            w = [math.exp(-distance(code, c)) for c, _, _ in other]
            taken.append(n * sum(x * v for x, (_, _, v) in zip(w, other)) / sum(x * k for x, (_, k, _) in zip(w, other)))
        assert r.x == pytest.approx(sum(taken) / sum(n for _, n, _ in own))


def test_joint_gradient_equals_differences():
    rng = np.random.default_rng(2)
    model = joint.JointModel(*[rng.normal(size=s) for s in ((6, 3), (3, 4), (3, 6))])
    buckets, shares, row = np.array([0, 2, 5, 1, 2]), np.array([0.5, 0.25, 0.25, 0.7, 0.3]), np.array([0, 0, 0, 1, 1])
    label = np.array([3, 1])
    before, after, at, count = np.array([0, 4]), np.array([1, 2, 5]), np.array([0, 0, 1]), np.array([2.0, 1.0, 3.0])

    def loss(m):
        return m.class_gradient(buckets, shares, row, label)[0] + m.next_gradient(before, after, at, count)[0]

    own = [a + b for a, b in zip(model.class_gradient(buckets, shares, row, label)[1], model.next_gradient(before, after, at, count)[1])]
    for k, w in enumerate(model.arrays()):
        for place in np.ndindex(w.shape):
            moved = [x.copy() for x in model.arrays()]
            moved[k][place] += 1e-6
            assert (loss(joint.JointModel(*moved)) - loss(model)) / 1e-6 == pytest.approx(own[k][place], abs=1e-4)


def test_joint_model_learns_both_tasks(spark, tmp_path):
    rows = [(i, "test" if i % 5 == 0 else "train", (["sun", "shines", "now"] if i % 2 else ["rain", "falls", "now"]) if i else [], i % 2) for i in range(100)]
    texts = spark.createDataFrame(rows, "row_id long, split string, tokens array<string>, label int")
    model, history = joint.fit_joint(texts.filter("split = 'train'"), 2, buckets=64, width=8, steps=30, rate=2.0)
    losses = [r.loss for r in history.orderBy("step").collect()]
    assert all(b < a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.5 * losses[0]
    model.save(spark, f"{tmp_path}/m")
    again = joint.JointModel.load(spark, f"{tmp_path}/m")
    assert all((a == b).all() for a, b in zip(model.arrays(), again.arrays()))
    scored = joint.score_joint(again, texts.filter("split = 'test' and row_id > 0"), "row_id")
    assert scored.filter("pred <> label").count() == 0
    none, history = joint.fit_joint(texts.limit(0), 2, buckets=8, width=2, steps=1)
    assert [r.loss for r in history.collect()] == [0.0, 0.0]
