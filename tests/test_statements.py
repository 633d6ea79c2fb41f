import pytest
from pyspark.sql import functions as F

from modelrank.operators import halving as H
from modelrank.plans import nodes as X
from modelrank.plans.lexer import StatementError
from modelrank.plans.parser import parse, statements
from modelrank.plans.session import Session
from modelrank.sources.catalog import Catalog


@pytest.mark.parametrize(
    "text, want",
    [
        ("select * from image_models where source = TF;", X.Select((X.Output("*"),), "image_models", X.Compare("source", "=", "TF"))),
        ("SELECT a AS b, DISTINCT c d FROM m WHERE x > 10M AND y == 'q'", X.Select((X.Output("a", "b"), X.Output("c", "d", True)), "m", X.Both((X.Compare("x", ">", 10_000_000), X.Compare("y", "=", "q"))))),
        ("SELECT * FROM m WHERE a = 1 OR (b <> 2 AND NOT FINETUNED)", X.Select((X.Output("*"),), "m", X.Either((X.Compare("a", "=", 1), X.Both((X.Compare("b", "!=", 2), X.Finetuned(True))))))),
        ("SELECT * FROM m WHERE a BETWEEN 1 AND 2 ORDER BY up_acc DESC LIMIT 3", X.Select((X.Output("*"),), "m", X.Between("a", 1, 2), X.Order("up_acc", True), limit=3)),
        ("DECLARE pool AS SELECT * FROM m WHERE a IS NOT NULL", X.Declare("pool", X.Select((X.Output("*"),), "m", X.IsNull("a", True)))),
        ("PRINT *", X.Print("*")),
        ("PURGE;", X.Purge()),
        ("USE 'file:///x'", X.Use("file:///x")),
        ("REGISTER dataset 'd' (tf_name, size) VALUES ('x', 10)", X.Register("d", ("tf_name", "size"), ("x", 10))),
        ("FINETUNE a, b WITH [c, d] wait", X.Finetune(("a", "b"), ("c", "d"))),
        ("SELECT * FROM m ORDER BY err TRAINED ON a, b TESTED ON c CLASSIFIED BY ['Euclidean NN'] LIMIT 3 OTHER THAN v CHUNK AUTO BUDGET 12 wait", X.Select((X.Output("*"),), "m", None, X.Order("err"), X.Readers((X.Reader("a"), X.Reader("b"))), X.Readers((X.Reader("c"),)), (X.Classifier("Euclidean NN"),), 3, "v", "auto", 12, wait=True)),
        ("EXPLAIN JSON RANK * FROM m TRAINED ON a TESTED ON b BY 'random(seed=42)' LIMIT 2", X.Explain(X.Select((X.Output("*"),), "m", trained=X.Readers((X.Reader("a"),)), tested=X.Readers((X.Reader("b"),)), limit=2, by="random", params={"seed": 42}), True)),
        ("SELECT vec FROM readers_var WHERE probe = p", X.Select((X.Output("vec"),), "readers_var", X.Compare("probe", "=", "p"))),
    ],
)
def test_statements(text, want):
    assert parse(text) == want


def test_edits_and_parameters():
    q = parse("SELECT * FROM m ORDER BY avg(err) TRAINED ON (d CHANGE [1, 2] TO e [0, 3], CHANGE [4] TO f [0]) TESTED ON BENCHMARK [x, y] CLASSIFIED BY [Linear(learning_rate=0.1, num_epochs=10), 'Cosine NN']")
    assert q.trained.readers[0] == X.Reader("d", (X.Change((1, 2), "e", (0, 3)), X.Change((4,), "f", (0,))))
    assert q.tested == X.Readers((X.Reader("x"), X.Reader("y")), True) and q.order == X.Order("err", False, "avg")
    assert [c.value for c in q.classifiers] == ["Linear(learning_rate=0.1 num_epochs=10)", "Cosine NN"]


@pytest.mark.parametrize("text", ["SELECT FROM m", "SELECT * FROM", "SELECT * FROM m LIMIT x", "SELECT * FROM m TRAINED ON (d CHANGE [1] TO e)", "DROP m", "SELECT * FROM m ORDER BY med(err)", "DECLARE readers AS SELECT * FROM m", "SELECT * FROM m CLASSIFIED BY ['a', 'a']", "SELECT * FROM m; SELECT", "REGISTER dataset d (a, b) VALUES (1)", "SELECT ? FROM m"])
def test_what_is_no_statement(text):
    with pytest.raises(StatementError):
        parse(text)


def test_remarks_are_passed_over():
    assert len(statements("# first\nPURGE;\n\nPRINT *;\n")) == 2


@pytest.fixture()
def session(spark):
    s = Session(spark)
    names = ["prefix8", "stride4", "suffix32", "prefix16_l2"]
    s.add_models("models", spark.createDataFrame([(f'{{"name":"{n}"}}', n, i * 10 if i else None) for i, n in enumerate(names)], "json_model string, name string, num_params long"))
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("embed"), F.col("label").cast("long").alias("label"))
    s.add_reader("train", e.filter("row_idx % 5 <> 0"))
    s.add_reader("test", e.filter("row_idx % 5 = 0"))
    s.add_reader("part", e.filter("row_idx % 10 = 0"))
    return s


RANK = 'SELECT * FROM models ORDER BY err TRAINED ON "train" TESTED ON {} CLASSIFIED BY ["Euclidean NN"{}]{};'


def test_nulls_sort_last_and_missing_bounds(session):
    assert [r.num_params for r in session.sql("SELECT * FROM models ORDER BY num_params;").collect()] == [10, 20, 30, None]
    assert session.sql("SELECT * FROM models WHERE num_params > 10;").count() == 3  # the bound is taken in
    assert Session(session.spark, strict=True).strict


def test_ranking_and_limits(session):
    rows = session.sql(RANK.format("test", ', "Cosine NN"', " LIMIT 2")).collect()
    assert [r.classifier for r in rows] == ["Cosine NN"] * 2 + ["Euclidean NN"] * 2
    assert all(r.acc == 1 - r.err for r in rows)


def test_benchmark_defaults_to_the_mean(session):
    a, b = ({r.json_model: r.err for r in session.sql(RANK.format(t, "", "")).collect()} for t in ("test", "part"))
    both = {r.json_model: r.err for r in session.sql(RANK.format("BENCHMARK [test, part]", "", "")).collect()}
    assert both == {m: pytest.approx((a[m] + b[m]) / 2) for m in a}


def test_edited_datasets(session):
    plain = session.sql(RANK.format("test", "", "")).collect()
    same = session.sql(RANK.replace('"train"', "(train CHANGE [1, 2] TO train [1, 2])").format("test", "", "")).collect()
    assert [(r.json_model, r.err) for r in plain] == [(r.json_model, r.err) for r in same]


def test_variables(session):
    session.sql("DECLARE pool AS SELECT * FROM models WHERE num_params > 20;")
    assert session.sql("SELECT * FROM models OTHER THAN pool;").count() == 2
    assert session.sql("PRINT pool;").count() == 2 and list(session.sql("PRINT *;")) == ["pool"]
    assert session.spark.table("pool").count() == 2


def test_explain_and_extensions(session, tmp_path):
    told = session.sql("EXPLAIN JSON RANK * FROM models TRAINED ON train TESTED ON test BY 'random(seed=3)' LIMIT 2;")
    assert told["rows"] == 2 and len(told["models"]) == 2 and told["models"][0]["err"] == -1
    session.add_extension("named", lambda models, train, test, last=False: models.select("json_model", F.length("json_model").cast("double").alias("err")))
    assert session.sql("RANK json_model FROM models ORDER BY err DESC BY named LIMIT 1;").first().json_model == '{"name":"prefix16_l2"}'
    session.write_explained("EXPLAIN SELECT * FROM models;", str(tmp_path / "o"))
    assert list((tmp_path / "o").glob("*.txt"))
    with pytest.raises(StatementError):
        session.sql("RANK * FROM models BY nothing;")


def test_halving_statement(session):
    out = session.sql(RANK.format("test", "", "").replace(";", " CHUNK AUTO BUDGET AUTO;")).collect()
    full = {r.json_model: r.err for r in session.sql(RANK.format("test", "", "")).collect()}
    last = max(out, key=lambda r: r.round)
    assert len(out) == 4 and last.stop == 500 and last.err == full[last.json_model]


def test_answers_are_kept_and_forgotten(spark, session, tmp_path, monkeypatch):
    session.use(f"file://{tmp_path}/catalog")
    first = session.sql(RANK.format("test", "", "")).collect()
    assert session.known_results().count() == 4
    again = Session(spark, f"file://{tmp_path}/catalog")
    again.tables, again.readers = session.tables, session.readers
    monkeypatch.setattr(again, "compute", lambda *a: pytest.fail("it was known"))
    assert [(r.json_model, r.err) for r in again.sql(RANK.format("test", "", "")).collect()] == [(r.json_model, r.err) for r in first]
    again.sql("PURGE;")
    assert again.known_results().count() == 0
    again.sql("REGISTER dataset 'd' (tf_name, size) VALUES ('x', 10);")
    again.sql("REGISTER dataset 'd' (tf_name, size) VALUES ('x', 11);")
    assert [(r.json_dataset, r["size"]) for r in again.sql("SELECT * FROM readers;").collect()] == [('{"tf_name":"x"}', 11)]
    assert again.sql("FINETUNE a, b WITH d;").count() == 2


def test_asking_without_statements(session, tmp_path):
    session.use(f"file://{tmp_path}/catalog")
    text = RANK.format("test", ', "Cosine NN"', "")
    assert session.progress(text) == (8, 8)
    a = session.rank("models", ["train"], ["test"], ["Euclidean NN"]).collect()
    assert session.progress(text) == (8, 4)
    assert [(r.json_model, r.err) for r in a] == [(r.json_model, r.err) for r in session.sql(RANK.format("test", "", "")).collect()]
    found = session.neighbours("prefix8", ["train"], ["test"])
    assert found.filter("test_label <> train_label").count() / found.count() == {r.json_model: r.err for r in a}['{"name":"prefix8"}']
    session.register_models("text_models", session.spark.createDataFrame([("x", "s")], "json_model string, source string"), finetuned=True)
    assert session.models("text_models", ["finetuned"]).count() == 1 and session.model("x", "text_models").count() == 1
    session.sql("REGISTER dataset 'd' (tf_name, size) VALUES ('x', 10);")
    assert session.reader("d").first()["size"] == 10


def test_catalog_versions(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert c.table("tasks").count() == 0
    c.append("tasks", spark.createDataFrame([("x", 1)], "job_hash string, status int"))
    old = c.table("tasks")
    c.append("tasks", spark.createDataFrame([("y", 1)], "job_hash string, status int"))
    assert (old.count(), c.table("tasks").count()) == (1, 2)


def test_halving_numbers():
    cases = [(50000, 235, 1880, 112), (65550, 235, 1880, 147), (1020, 235, 1880, 3), (35126, 235, 1880, 79), (8551, 65, 455, 51), (67349, 65, 455, 399)]
    assert [H.bounds(n, m) for n, m, *_ in cases] == [(b, c) for *_, b, c in cases]
    assert [(left, r) for _, left, r, _ in H.schedule(32, 8)] == [(8, 1), (4, 2), (2, 5)]
    assert [left for _, left, _, _ in H.schedule(1880, 235)] == [235, 118, 59, 30, 15, 8, 4, 2]
    assert [r for _, _, r, _ in H.schedule(1880, 235)] == [1, 1, 3, 7, 15, 29, 58, 117]
    with pytest.raises(ValueError):
        H.bounds(10, 1)
