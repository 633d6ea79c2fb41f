import pytest
from pyspark.sql import functions as F

from modelrank.sources import named as N
from modelrank.sources.catalog import Catalog, insert_or_ignore
from modelrank.sources.readers import Part


def test_splits_of_names():
    assert len(N.names()) == 32
    assert N.splits_of("Caltech101")["train"] == [Part("train", 0, 2754)]
    assert N.splits_of("EuroSAT")["val"] == [Part("train", 16200, 21600)]
    assert N.splits_of("Diabetic Rethinopathy Splitted")["validation_3"] == [Part("validation_3", 0, 237)]
    assert N.splits_of("Small NORB azimuth prediction")["test"] == [Part("test", 0.5)]
    with pytest.raises(ValueError):
        N.splits_of("nothing")


def test_derived_labels(spark, tmp_path):
    rows = spark.range(900).select(F.col("id").alias("row_idx"), F.array(F.struct(F.array(F.lit(0.0), F.lit(0.0), F.col("id") / 50).alias("pixel_coords"))).alias("objects"))
    rows.write.parquet(str(tmp_path / "clevr" / "train"))
    out = N.read_named(spark, str(tmp_path), "CLEVR distance prediction", "train800")
    assert out.count() == 800 and out.filter("row_idx = 420").first().label == 1
    with pytest.raises(ValueError):
        N.read_named(spark, str(tmp_path), "CLEVR counting", "other")


def test_predefined_models_come_once(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    for _ in range(2):
        c.save("image_models", insert_or_ignore(c.table("image_models"), N.image_models(spark), "json_model"))
    assert c.table("image_models").count() == 12 and N.text_models(spark).count() == 7


def test_whole_datasets_and_attributes(spark, tmp_path):
    rows = spark.createDataFrame([(0, "b", "x"), (1, "a", None), (2, "b", "y")], "row_idx long, family string, genus string")
    rows.write.parquet(str(tmp_path / "inat2018" / "val"))
    df = N.read_whole(spark, str(tmp_path), "iNaturalist 2018", "val")
    out = sorted((r.level, r.image, r.labels[0]) for r in N.attribute_tasks(df, ["family", "genus"]).collect())
    assert out == [("family", 0, 1), ("family", 1, 0), ("family", 2, 1), ("genus", 0, 0), ("genus", 2, 1)]
    for name, split in (("USPS", "val"), ("nothing", "test")):
        with pytest.raises(ValueError):
            N.read_whole(spark, str(tmp_path), name, split)
    with pytest.raises(ValueError):
        N.attribute_tasks(df, [])


def test_tokens_of_a_library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from modelrank.functions.embedders import library_tokeniser

    out = library_tokeniser(public_tokenizers.path("byte_bpe_50k.json"), 6)("two words")
    assert out.shape == (3, 6) and out[1].tolist() == [1] * int(out[1].sum()) + [0] * (6 - int(out[1].sum())) and out[2].sum() == 0
    assert library_tokeniser(public_tokenizers.path("byte_bpe_50k.json"), 2)("a b c d e").shape == (3, 2)
