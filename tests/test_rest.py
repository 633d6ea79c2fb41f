import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelrank.functions import embedders as E
from modelrank.functions import identity as I
from modelrank.functions import labels as L
from modelrank.functions import vectors as V
from modelrank.operators import jobs, ranking, similarity, strategies, tasks
from modelrank.operators.neighbours import nearest
from modelrank.sources import catalog as C
from modelrank.streaming.refresh import EDITS, watch_label_edits


def test_canonical_json_does_not_depend_on_order():
    config = {"b": 1, "a": {"y": [1, {"q": 2, "p": None}], "x": ""}, "c": None}
    want = I.canonical(config)
    assert want == '{"a":{"y":[1,{"q":2}]},"b":1}'
    for seed in range(10):
        keys = list(config)
        random.Random(seed).shuffle(keys)
        assert I.canonical({k: config[k] for k in keys}) == want


def test_hash_laws():
    model, reader = {"name": "m", "batch_size": 3}, {"r": 1}
    assert I.inference_hash(reader, model) == I.inference_hash(reader, {**model, "batch_size": 4, "id": 9, "info": 1})
    one = I.mutable_hash(reader, model, [({"c": 1}, [1], [2])])
    assert one != I.mutable_hash(reader, model, [({"c": 2}, [1], [2])]) and one != I.mutable_hash(reader, model, [])
    assert I.classifier_hash("x", ["a"], ["b"]) != I.classifier_hash("x", ["a", "b"], [])


def test_masked_mean(spark):
    data = [([[0.0], [1.0]], [1, 1]), ([[2.0], [3.0]], [0, 1]), ([[4.0], [5.0]], [1, 0]), ([[4.0]], [0])]
    df = spark.createDataFrame(data, "v array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(V.masked_mean(F.col("v"), F.col("m"), 1)).collect()] == [[0.5], [3.0], [4.0], [0.0]]


def test_views_of_a_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0, 1.0],)], "embed array<double>")
    out = {r.model: r.embed for r in E.embed(df, ["prefix8", "stride2", "suffix32", "stride4_l2"]).collect()}
    assert out == {"prefix8": [3, 4, 0, 1], "stride2": [3, 0], "suffix32": [3, 4, 0, 1], "stride4_l2": [1.0]}
    with pytest.raises(ValueError):
        E.check_types(E.TEXT, E.IMAGE)


def test_text_embedder_and_tokens(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string")
    out = {r.id: r.embed for r in E.embed_batches(df, E.HashedText(8), "text", E.TEXT).collect()}
    assert sum(x * x for x in out[1]) == pytest.approx(1) and sum(out[2]) == 0
    assert E.tokenise("One two", 4)[1].tolist() == [1, 1, 0, 0] and E.tokenise("a b c", 2).shape == (3, 2)


def test_labels_and_images(spark):
    df = spark.createDataFrame([([9.2, 30.0], [2, 2, 1]), ([0.0], [])], "d array<double>, k array<int>")
    rows = df.select(L.closest_object(F.col("d")).alias("a"), L.object_count(F.col("k")).alias("b"), L.count_of_kind(F.col("k"), 2).alias("c"), L.grey_to_rgb(F.col("k")).alias("g")).collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(3, 0, 2), (None, -3, 0)] and rows[0].g == [2] * 6 + [1] * 3
    image = np.arange(16, dtype=float).reshape(4, 4)
    assert L.centre_crop(image, 2).tolist() == [[5, 6], [9, 10]]
    assert L.resize(L.three_channels(image), 2, 2)[:, :, 0].tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert L.preprocess_image(image, 2, first=True, flat=True).shape == (12,)


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "s", ["finetuned"]), ("b", 2, "s", None)], "json_model string, batch_size long, source string, tag array<string>")
    new = spark.createDataFrame([("a", None, "t"), ("c", 5, "t")], "json_model string, batch_size long, source string")
    out = {r.json_model: (r.batch_size, r.source, r.tag) for r in C.register_models(old, new, finetuned=True).collect()}
    assert out == {"a": (1, "t", ["finetuned"]), "b": (2, "s", None), "c": (5, "t", ["finetuned"])}
    assert C.insert_or_ignore(old, new.withColumn("tag", F.lit(None).cast("array<string>")), "json_model").count() == 3
    with pytest.raises(ValueError):
        C.finetuned_model(old, "x", "y")
    assert C.finetuned_model(old.withColumn("date_added", F.current_date()), "b", "b2").first().tag == ["finetuned"]


def test_jobs(spark):
    known = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "job_hash string, value double")
    with pytest.raises(ValueError):
        jobs.with_known(spark.createDataFrame([("x",)], "job_hash string"), known)
    deps = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a"), ("s", "z")], "request string, dependency string")
    status = spark.createDataFrame([("a", "finished"), ("b", "failed")], "dependency string, status string")
    out = {r.request: (r.ready, r.failed) for r in jobs.dependency_status(deps, status).collect()}
    assert out == {"q": (False, True), "r": (True, False), "s": (False, False)}
    for bad in ((True, []), (False, ["x"]), (True, ["x", "x"])):
        with pytest.raises(ValueError):
            jobs.check_question(*bad)


def test_ranking_helpers(spark):
    df = spark.createDataFrame([("x", "b", 2.0), ("y", "a", 1.0)], "q string, s string, v double")
    assert [r.q for r in ranking.in_order(df, "q", ["y", "x"]).collect()] == ["y", "x"]
    both = ranking.union_of_keys([df, spark.createDataFrame([(3,)], "w int")]).collect()
    assert sorted((r.q, r.w) for r in both) == [("", "3"), ("x", ""), ("y", "")]


def test_distances_by_hand(spark):
    t = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 1.0]), (1, [2.0, 2.0], [1.0, 1.0]), (2, None, None)], "task int, hessian array<double>, scale array<double>")
    kl = {(r.task_from, r.task_to): r.distance for r in similarity.pdist(t, "asymmetric_kl").collect()}
    assert kl[0, 1] == pytest.approx(0.5 * (2 - 1 - np.log(2))) and kl[0, 0] == 0
    for name in similarity.DISTANCES:
        assert similarity.cdist(t, t, name).filter("task_from = 2").agg(F.sum("distance")).first()[0] == 0
        assert similarity.pdist(t, name).count() == 4
    out = {r.task: r.hessian for r in similarity.normalised_embeddings(t).collect()}
    assert out[2] == [0, 0] and out[0][1] == pytest.approx(2 / np.sqrt(8 / 3))


def test_fisher_embedding(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(t, [float(x) for x in rng.normal(size=3)], int(i % 2)) for t in (0, 1) for i in range(20)], "task int, embed array<double>, label int")
    out = similarity.fisher_embedding(df).collect()
    assert len(out) == 2 and all(len(r.hessian) == 3 and min(r.hessian) > 0 for r in out)


def test_strategies(spark):
    rec = spark.createDataFrame([("a", "t", 0.9, 1.0), ("b", "t", 0.5, 2.0), ("a", "u", 0.1, 3.0), ("b", "u", 0.2, 4.0)], "model string, task string, accuracy double, elapsed_time double")
    dist = spark.createDataFrame([("u", "t", 0.1), ("u", "u", 0.0)], "task_from string, task_to string, distance double")
    assert strategies.nearest_task(dist, rec, "u").first().model == "a"
    out = strategies.compare([strategies.nearest_task(dist, rec, "u"), strategies.enumeration(rec.select("model").distinct())], rec, "u")
    assert {r.strategy: (r.models, r.finetune_time, r.best_accuracy, r.search_time) for r in out.collect()} == {"nearest_task": (1, 3.0, 0.1, 70.0), "enumeration": (2, 7.0, 0.2, 0.0)}


def test_label_spaces(spark):
    t = spark.createDataFrame([(0, 1, [0]), (0, 2, [1]), (1, 1, [1]), (1, 3, [-1])], "task_id int, image int, labels array<int>")
    names = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 1, "x"), (1, -1, "z")], "task_id int, label int, name string")
    assert {r.image: r.labels for r in tasks.union(t, names, tasks.LABEL_NAMES).collect()} == {1: [0, 0], 2: [1], 3: [2]}
    assert tasks.intersection(t, names, tasks.LABEL_NAMES).count() == 2
    assert tasks.drop_label(t).count() == 3
    with pytest.raises(ValueError):
        tasks.align(t.filter("image = 3"), t.filter("image = 2"))
    with pytest.raises(ValueError):
        tasks.label_map(t, names, "other")


def test_label_edits_as_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(6)], "row_idx long, embed array<double>, label long")
    nearest(df, df).write.parquet(str(tmp_path / "nearest"))
    edits = str(tmp_path / "edits")
    spark.createDataFrame([(0, 0, 1, 9)], EDITS).write.parquet(edits)
    for n, want in ((0, 1), (1, 2)):
        watch_label_edits(spark, edits, str(tmp_path / "nearest"), str(tmp_path / "answers"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "answers" / f"batch={n}")).first().raw_error == want
        spark.createDataFrame([(1, 0, 2, 9)], EDITS).write.mode("append").parquet(edits)


def test_registered_queries_have_sql():
    from modelrank.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) - set(ORACLES) == {"linear_probe"}
    assert json.dumps(sorted(QUERIES))


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 3 and rows == sorted(rows, key=lambda r: (r.err, r.json_model))
