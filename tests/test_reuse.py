"""What a session keeps: answers and neighbours by content, label edits without a search, catalogs that grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelrank.operators import filters
from modelrank.plans import nodes as X
from modelrank.plans.parser import parse
from modelrank.plans.session import Session
from modelrank.sources.catalog import Catalog, register_models

ASK = "SELECT * FROM models ORDER BY err TRAINED ON {} TESTED ON {} CLASSIFIED BY ['Euclidean NN'];"


def dataset(spark, seed, n=40, embed=True):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(0, 3))) for i in range(n)]
    df = spark.createDataFrame(rows, "row_idx long, embed array<double>, label long")
    return df if embed else df.drop("embed")


@pytest.fixture
def session(spark):
    s = Session(spark)
    s.add_models("models", spark.createDataFrame([('{"name":"prefix8"}', "prefix8"), ('{"name":"stride2"}', "stride2")], "json_model string, name string"))
    s.add_reader("train", dataset(spark, 1))
    s.add_reader("test", dataset(spark, 2, 15))
    s.add_reader("labels", dataset(spark, 3, 10, False))
    s.add_reader("rows", dataset(spark, 4, 10))
    return s


def errs(df):
    return {r.json_model: r.err for r in df.collect()}


def fresh(session, **readers):
    """The answer of a session that knows nothing."""
    s = Session(session.spark)
    s.tables, s.readers = dict(session.tables), {**session.readers, **readers}
    return s


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_replaced_dataset_is_asked_anew(session):
    first = errs(session.sql(ASK.format("train", "test")))
    session.add_reader("train", dataset(session.spark, 9))
    again = errs(session.sql(ASK.format("train", "test")))
    assert again == errs(fresh(session).sql(ASK.format("train", "test"))) and again != first


def test_a_second_question_is_no_search(session):
    session.sql(ASK.format("train", "test"))
    again = session.sql(ASK.format("train", "test"))
    assert "MapInPandas" not in plan(again) and "parquet" in plan(again)
    assert "MapInPandas" not in plan(session.sql(ASK.format("train", "test")))


def test_label_edits_go_over_stored_neighbours(session, monkeypatch):
    from modelrank.plans import session as module

    session.sql(ASK.format("train", "test"))
    before = dict(session._nearest)
    monkeypatch.setattr(module.neighbours, "nearest", None)  # any search would fail
    edited = errs(session.sql(ASK.format("(train CHANGE [1, 5, 9, 20] TO labels [0, 1, 2, 3], CHANGE [5] TO labels [7])", "(test CHANGE [0, 3] TO labels [4, 5])")))
    assert dict(session._nearest).keys() == before.keys()
    monkeypatch.undo()
    labels = {r.row_idx: r.label for r in session.readers["labels"].collect()}

    def put(df, edits):
        out = F.col("label")
        for at, to in edits:
            out = F.when(F.col("row_idx") == at, labels[to]).otherwise(out)
        return df.withColumn("label", out)

    want = fresh(session, train=put(session.readers["train"], [(1, 0), (5, 1), (9, 2), (20, 3), (5, 7)]), test=put(session.readers["test"], [(0, 4), (3, 5)]))
    assert edited == errs(want.sql(ASK.format("train", "test")))


def test_edits_of_features_are_searched(session):
    """A feature edit between label edits: only those that close the list are put over neighbours."""
    text = "(train CHANGE [2] TO labels [1], CHANGE [2, 4] TO rows [0, 1], CHANGE [4, 6] TO labels [2, 3])"
    got = errs(session.sql(ASK.format(text, "test")))
    held = {r.row_idx: [r.embed, r.label] for r in session.readers["train"].collect()}
    labels, rows = ({r.row_idx: r for r in session.readers[n].collect()} for n in ("labels", "rows"))
    for at, to in ((2, 0), (4, 1)):
        held[at] = [rows[to].embed, rows[to].label]
    for at, to in ((4, 2), (6, 3)):
        held[at][1] = labels[to].label
    train = session.spark.createDataFrame([(i, *x) for i, x in held.items()], "row_idx long, embed array<double>, label long")
    assert got == errs(fresh(session, train=train).sql(ASK.format("train", "test")))


def test_contents_tell_datasets_apart_across_sessions(session, tmp_path):
    session.use(f"file://{tmp_path}/catalog")
    first = errs(session.sql(ASK.format("train", "test")))
    other = fresh(session, train=dataset(session.spark, 9))
    other.use(f"file://{tmp_path}/catalog")
    assert errs(other.sql(ASK.format("train", "test"))) == errs(fresh(other).sql(ASK.format("train", "test"))) != first
    same = fresh(session)
    same.use(f"file://{tmp_path}/catalog")
    assert errs(same.sql(ASK.format("train", "test"))) == first and not same._nearest
    assert session.content("train") == same.content("train") != other.content("train")


def test_a_finetuned_model_joins_the_catalog(session):
    session.tables["image_models"] = session.spark.createDataFrame([("base", 3, None, "TF")], "json_model string, batch_size long, tag array<string>, source string")
    session.sql("FINETUNE base WITH train;")
    assert session.relation("image_models").count() == 1  # nothing was trained
    session.trainer = lambda *a: {"accuracy": 1}
    session.sql("FINETUNE base WITH train;")
    rows = {r.json_model: r for r in session.relation("image_models").collect()}
    assert len(rows) == 2 and [(r.tag, r.batch_size) for k, r in rows.items() if k != "base"] == [(["finetuned"], 3)]


def test_appends_and_clean_up(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    for i in range(3):
        c.append("tasks", spark.createDataFrame([(f"h{i}", i)], "job_hash string, status int"))
    assert c.table("tasks").count() == 3 and c._versions("tasks") == [1]
    c.compact("tasks")
    assert c.table("tasks").count() == 3 and c._versions("tasks") == [2]


def test_one_row_for_each_new_key(spark):
    old = spark.createDataFrame([("a", 1)], "json_model string, batch_size long")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("a", 4), ("a", 4)], "json_model string, batch_size long")
    for df in (new, new.repartition(4)):
        assert sorted(tuple(r) for r in register_models(old, df).collect()) == [("a", 4), ("b", 3)]
    assert sorted(r[0] for r in register_models(old, new.select("json_model")).collect()) == ["a", "b"]


def test_membership_and_stated_counts(spark):
    assert parse("SELECT * FROM m WHERE a IN (1, 2) AND b NOT IN ['x']").where == X.Both((X.In("a", (1, 2)), X.In("b", ("x",), True)))
    df = spark.createDataFrame([(0, 1), (1, None), (2, 3)], "row_idx long, a long")
    assert [r.row_idx for r in df.filter(filters.is_in(F.col("a"), [1, 9])).collect()] == [0]
    assert [r.row_idx for r in filters.at_indices(df, [0, 2], keep=False).collect()] == [1]
    assert filters.counted(df, F.col("a") > 0, 2).count() == 2
    with pytest.raises(ValueError):
        filters.counted(df, F.col("a") > 0, 3)
