import numpy as np
import pytest
from pyspark.sql import functions as F

from modelrank.operators import neighbours as N
from modelrank.operators import overlay as O
from modelrank.operators.linear import fit, linear_probe


def rows(spark, vectors, labels=None, **more):
    data = [(i, [float(x) for x in np.atleast_1d(v)], int(labels[i]) if labels is not None else i) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "row_idx long, embed array<double>, label long")
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    return df


def places(found):
    return [r.train_idx for r in found.orderBy("test_idx").collect()]


def looped(test, train, metric):
    """The nearest training row of each test row, by a plain loop."""
    unit = (lambda v: v / np.sqrt((v * v).sum())) if metric == N.COSINE else (lambda v: v)
    return [min(range(len(train)), key=lambda j: (((unit(x) - unit(train[j])) ** 2).sum(), j)) for x in test]


@pytest.mark.parametrize("metric", [N.EUCLIDEAN, N.COSINE])
@pytest.mark.parametrize("block, width", [(2, 1), (5, 3), (100, 4)])
def test_nearest_in_any_blocks(spark, metric, block, width):
    rng = np.random.default_rng(block)
    test, train = rng.normal(size=(11, width)), rng.normal(size=(23, width)) + 0.1
    want = looped(test, train, metric) if metric == N.EUCLIDEAN or width > 1 else None
    found = places(N.nearest(rows(spark, test), rows(spark, train), metric, rows=block))
    assert found == (want or places(N.nearest_sql(rows(spark, test), rows(spark, train), metric)))


def test_ties_go_to_the_first_reader_and_row(spark):
    train = rows(spark, [[1.0], [1.0]], reader_idx=1).unionByName(rows(spark, [[3.0], [1.0]], reader_idx=0))
    r = N.nearest(rows(spark, [[1.0]]), train, rows=1).first()
    assert (r.train_reader, r.train_idx) == (0, 1)


def test_a_zero_vector_is_farthest(spark):
    test, train = rows(spark, [[1.0, 0.0]]), rows(spark, [[0.0, 0.0], [-1.0, 0.1]])
    assert places(N.nearest(test, train, N.COSINE)) == [1]


def test_empty_sides(spark):
    some, none = rows(spark, [[1.0]]), rows(spark, [[1.0]]).limit(0)
    assert N.nearest(some, none).count() == 0
    assert N.nearest(none, some).count() == 0


def test_both_ways_agree(spark):
    rng = np.random.default_rng(3)
    test, train = rows(spark, rng.normal(size=(20, 5))), rows(spark, rng.normal(size=(60, 5)))
    for metric in (N.EUCLIDEAN, N.COSINE):
        assert places(N.nearest(test, train, metric, rows=7)) == places(N.nearest_sql(test, train, metric))


def test_readers_are_merged(spark):
    """Results of several readers, and what wins, by a plain loop."""
    rng = np.random.default_rng(21)
    data = [("", 0, t, t % 4, float(rng.integers(0, 6)), r, int(rng.integers(0, 9)), int(rng.integers(0, 4))) for r in range(3) for t in range(25)]
    found = N.merged(spark.createDataFrame(data, "model string, test_reader int, test_idx long, test_label long, distance double, train_reader int, train_idx long, train_label long"))
    want = {t: min((x for x in data if x[2] == t), key=lambda x: x[4:7]) for t in range(25)}
    assert {r.test_idx: (r.distance, r.train_reader, r.train_idx, r.train_label) for r in found.collect()} == {t: x[4:] for t, x in want.items()}
    assert N.errors(found, "model").first().err == pytest.approx(sum(x[3] != x[7] for x in want.values()) / 25)


def test_relabelling_needs_no_distances(spark):
    rng = np.random.default_rng(22)
    found = [(t, int(rng.integers(0, 3)), int(rng.integers(0, 12)), int(rng.integers(0, 5))) for t in range(40)]
    edits = [(seq, int(rng.integers(0, 4)), int(i), int(rng.integers(5, 9))) for seq in range(3) for i in rng.choice(15, 8, replace=False)]
    last = {(r, i): v for _, r, i, v in edits}  # later edits come later in the list
    held = spark.createDataFrame(found, "test_idx long, train_reader int, train_idx long, train_label long")
    out = O.relabel(held, spark.createDataFrame(edits, "seq int, reader_idx int, idx long, label long").dropDuplicates(["seq", "reader_idx", "idx"]))
    assert {r.test_idx: r.train_label for r in out.collect()} == {t: last.get((r, i), v) for t, r, i, v in found}


def test_overlay_then_search_is_relabelling(spark):
    rng = np.random.default_rng(5)
    test, train = rows(spark, rng.normal(size=(15, 3)), rng.integers(0, 3, 15)), rows(spark, rng.normal(size=(30, 3)), rng.integers(0, 3, 30))
    edits = spark.createDataFrame([(0, i, None, 2) for i in range(0, 30, 2)], "seq int, base_idx long, embed array<double>, label long")
    new = N.nearest(test, O.apply_overlay(train, edits))
    old = O.relabel(N.nearest(test, train), edits.select("seq", F.lit(0).alias("reader_idx"), F.col("base_idx").alias("idx"), "label"))
    assert [r.train_label for r in new.orderBy("test_idx").collect()] == [r.train_label for r in old.orderBy("test_idx").collect()]


def test_linear_probe_in_one_task_and_in_many(spark):
    rng = np.random.default_rng(7)
    y = np.arange(80) % 3
    x = rng.normal(size=(80, 4)) + np.eye(4)[y] * 3
    df = rows(spark, x, y * 10).repartition(3)
    test, train = df.filter("row_idx % 4 = 0"), df.filter("row_idx % 4 <> 0")
    a, b = linear_probe(train, test, epochs=15).first(), linear_probe(train, test, epochs=15, small=0).first()
    part = np.arange(80) % 4 != 0
    w = fit(x[part], y[part], 3, 0.1, 15)
    want = int((np.hstack([x[~part], np.ones((20, 1))]) @ w).argmax(1).__ne__(y[~part]).sum())
    assert a.raw_error == b.raw_error == want and a.n == 20
