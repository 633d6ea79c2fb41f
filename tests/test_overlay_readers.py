import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from modelrank.operators import overlay as O
from modelrank.sources import readers as R


def table(spark, n, embed, label):
    return spark.range(n).select(F.col("id").alias("row_idx"), F.lit(embed).cast("double").alias("embed"), F.lit(label).cast("long").alias("label"))


def test_overlays_one_after_another(spark):
    """The last edit of the features and the last of the label count, each on its own."""
    rng = np.random.default_rng(23)
    for _ in range(3):
        n, want, held = 14, [[0.0, 0] for _ in range(14)], None
        for seq in range(4):
            at = sorted(rng.choice(n, rng.integers(1, 7), replace=False).tolist())
            features, labels = ((True, False), (False, True), (True, True))[rng.integers(0, 3)]
            some = O.edits(seq, table(spark, len(at), seq + 1, seq + 1), at, list(range(len(at))), features, labels)
            held = some if held is None else held.unionByName(some)
            for i in at:
                want[i] = [seq + 1.0 if features else want[i][0], seq + 1 if labels else want[i][1]]
        out = O.apply_overlay(table(spark, n, 0, 0), held).orderBy("row_idx").collect()
        assert [[r.embed, r.label] for r in out] == want


def test_edits_beyond_the_changes_are_refused(spark):
    with pytest.raises(ValueError):
        O.edits(0, table(spark, 3, 1, 1), [0, 1], [0, 3], True, True)


def test_changes_may_lack_features(spark):
    labels = table(spark, 4, 1, 7).drop("embed")
    out = O.edits(0, labels, [5, 6], [0, 3], False, True, like=table(spark, 1, 1, 1)).orderBy("base_idx").collect()
    assert [(r.base_idx, r.embed, r.label) for r in out] == [(5, None, 7), (6, None, 7)]


@pytest.mark.parametrize("indices", [[-1, 2], [3, 2], [2, 2]])
def test_indices_are_checked(indices):
    with pytest.raises(ValueError):
        R.check_indices(indices)


def test_as_many_rows_come_as_go(spark):
    with pytest.raises(ValueError):
        O.edits(0, table(spark, 3, 1, 1), [0, 1], [0], True, True)


def test_closing_label_edits():
    assert O.closing_label_edits([False, True]) == (1, 1)
    assert O.closing_label_edits([True, True]) == (0, 2)
    assert O.closing_label_edits([True, False]) == (2, 0)
    assert O.closing_label_edits([]) == (0, 0)


def test_edits_of_a_slice_begin_with_its_first_row(spark):
    e = spark.createDataFrame([(0, i) for i in (1, 4, 6, 9)], "seq int, base_idx long")
    assert sorted(r.base_idx for r in O.slice_edits(e, 4, 9).collect()) == [0, 2]


def test_readers_one_after_another(spark):
    out = R.concat_readers([table(spark, 5, 2, 2)] * 2)
    assert out.count() == 10 and {r.reader_idx for r in out.collect()} == {0, 1}
    with pytest.raises(ValueError):
        R.concat_readers([])


def test_slice_and_batches(spark):
    df = R.with_row_idx(R.slice_rows(spark.range(10).withColumnRenamed("id", "row_idx"), 2, 5).withColumnRenamed("row_idx", "x"), "x")
    out = R.batch_numbers(df, 2).orderBy("x").collect()
    assert [(r.batch, r.x) for r in out] == [(0, 2), (0, 3), (1, 4)]
    assert R.batch_numbers(df, 2, drop_remainder=True).count() == 2


def test_rows_are_numbered_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    out = R.with_row_idx(df, "x").orderBy("x").collect()
    assert [r.row_idx for r in out] == list(range(1000))
    assert R.with_row_idx(df.limit(0), "x").count() == 0


def test_ranges(spark):
    df = spark.range(10).withColumnRenamed("id", "row_idx")
    assert sorted(r.row_idx for r in R.sample_range(df, 5, 8).collect()) == [5, 6, 7]
    assert sorted(r.row_idx for r in R.sample_range(df, 5, 10).collect()) == [5, 6, 7, 8, 9]
    for bad in ((8, 2), (5, 20), (-5, 10)):
        with pytest.raises(ValueError):
            R.sample_range(df, *bad)
    whole = [r.row_idx for r in R.permuted(df, 3).orderBy("place").collect()]
    assert sorted(whole) == list(range(10)) and sorted(whole[2:6]) == sorted(r.row_idx for r in R.sample_range(df, 2, 6, seed=3).collect())


def test_proportional_slices():
    assert R.proportional_slices([100, 40], [0, 1, 2], 10) == [[(0, 10), (10, 40)], [(0, 4), (4, 16)]]
    assert R.proportional_slices([12, 40], [0, 1, 2], 10) == [[(0, 10), (10, 12)], [(0, 34), (34, 40)]]


def test_splits(spark):
    s = R.split_parts("train", 1000, 60, 20)
    assert s["val"] == [R.Part("train", 600, 800)] and s["test"] == [R.Part("train", 800)] and s["train800val200"] == [R.Part("train", 0, 800), R.Part("train", 600, 800)]
    halved = R.split_parts("halved_test")
    df = spark.range(10).withColumnRenamed("id", "row_idx")
    held = {"train": df, "test": df}
    assert [R.read_split(held, halved[k]).count() for k in ("val", "trainval", "test")] == [5, 15, 5]
    with pytest.raises(ValueError):
        R.split_parts("other")


def test_nested_paths():
    schema = StructType.fromDDL("a struct<b: struct<c: string, d: binary>, e: array<string>, n: int>, f: long")
    assert R.data_type(schema, ["a", "b", "c"]) == "TEXT"
    assert R.data_type(schema, ["a", "b", "d"]) == "IMAGE"
    assert R.data_type(schema, ["f"]) == "OTHER"
    for path, error in ((["x"], KeyError), (["a", "n", "z"], KeyError), (["a", "e", "z"], ValueError), (["a", "e"], ValueError), (["a", "b"], ValueError)):
        with pytest.raises(error):
            R.field_at(schema, path)


def test_extract(spark):
    df = spark.createDataFrame([(((1, 2),), 3)], "a struct<b: struct<c: int, d: int>>, e int")
    assert R.extract(df, ["a", "b", "c"], ["e"], {"x": ["a", "b", "d"]}).first().asDict() == {"embed": 1, "label": 3, "x": 2}
    with pytest.raises(ValueError):
        R.extract(df, None, None)
    with pytest.raises(ValueError):
        R.extract(df, ["e"], None, {"label": ["e"]})


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1;a\n2;b\n")
    assert [tuple(r) for r in R.read_csv(spark, str(tmp_path / "x.csv"), {"n": "int", "s": "string"}, sep=";").collect()] == [(1, "a"), (2, "b")]
    np.savez(tmp_path / "1.npz", embed=np.ones((3, 2), np.float32), label=np.arange(3))
    got = R.read_npz(spark, str(tmp_path), {"embed": "array<float>", "label": "long"}).collect()
    assert sorted((r.label, tuple(r.embed)) for r in got) == [(i, (1.0, 1.0)) for i in range(3)]
    for d in ("a", "c"):
        (tmp_path / "img" / d).mkdir(parents=True)
        (tmp_path / "img" / d / "1.png").write_bytes(b"x")
    got = R.read_image_folder(spark, str(tmp_path / "img"), ["c", "b", "a"])
    assert sorted(r.label for r in got.collect()) == [0, 2]


def test_row_cap(spark, tmp_path):
    assert R.rows_per_file(10, 100, 20) == 5 and R.rows_per_file(None, None, 3) == 0
    R.write_rows(spark.range(20).coalesce(1), str(tmp_path / "o"), max_rows=7)
    assert len(list((tmp_path / "o").glob("*.parquet"))) == 3


def test_classes_weigh_the_same(spark):
    df = spark.createDataFrame([(i, int(i < 8)) for i in range(10)], "row_idx long, label int")
    w = {r.label: r.s for r in R.class_weights(df).groupBy("label").agg(F.sum("weight").alias("s")).collect()}
    assert w[0] == pytest.approx(0.5) and w[1] == pytest.approx(0.5)
    out = {r.label: r["count"] for r in R.balanced_sample(df, 400, "row_idx").groupBy("label").count().collect()}
    assert out[0] == 200 and abs(out[1] - 200) <= 8
