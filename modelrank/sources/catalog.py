"""Catalogs of models, datasets, results and finished work.

A catalog is a folder of tables.  Each change writes a new version beside the
old one and readers take the last complete version, so a change is seen whole
or not at all, and no table format is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MODELS = "json_model string, batch_size long, {size} long, date_added date, num_params long, dimension long, source string, tag array<string>, up_acc double"
SCHEMAS: dict[str, str] = {
    "image_models": MODELS.format(size="image_size"),
    "text_models": MODELS.format(size="token_length"),
    "readers": "json_dataset string, date_added date, size long, name string, path string",
    "known_results": "job_type string, classifier_type string, model_json string, train_readers_json array<string>, test_readers_json array<string>, classifier_job_hash string, value double",
    "image_jobs": "job_hash string, json_reader string, json_model string, slice_start long, slice_stop long",
    "text_jobs": "job_hash string, json_reader string, json_model string, slice_start long, slice_stop long",
    "classifier_jobs": "job_hash string, test_reader long, test_idx long, test_label long, train_reader long, train_idx long, train_label long, error double, raw_error long",
    "task2vec_jobs": "job_hash string, json_reader string, json_model string, hessian array<double>, scale array<double>",
    "finetune_jobs": "job_hash string, json_model string, json_readers array<string>, learning_rate double, epochs long",
    "tasks": "job_hash string, status int",
}
RESULT_TABLES = ("known_results", "image_jobs", "text_jobs", "classifier_jobs", "task2vec_jobs", "finetune_jobs", "tasks")
FINETUNED = "finetuned"


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, added."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: tuple[str, ...] = (), insert_only: tuple[str, ...] = ()) -> DataFrame:
    """New values win where they are given.  ``overwrite`` columns take the new
    value even if it is null; ``insert_only`` columns stay as they are for keys
    that exist.  Of several new rows of one key the last in order of their
    values' JSON counts, so the outcome doesn't depend on partitions."""
    if rest := [c for c in new.columns if c != key]:
        new = new.groupBy(key).agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("__r")).select(key, "__r.*")
    else:
        new = new.distinct()
    columns = [c for c in old.columns if c != key]
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    there, came = F.col("a.__old").isNotNull(), F.col("b.__new").isNotNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"a.{c}")
        if c in overwrite:
            return F.when(came, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        if c in insert_only:
            return F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        return F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))

    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), *[value(c).alias(c) for c in columns]).select(*old.columns)


def register_models(old: DataFrame, new: DataFrame, finetuned: bool = False) -> DataFrame:
    """The source always becomes the new one; a tag is given on insertion only."""
    if finetuned:
        new = new.withColumn("tag", F.array(F.lit(FINETUNED)))
    elif "tag" in new.columns:
        new = new.drop("tag")
    return upsert(old, new, "json_model", overwrite=("source",), insert_only=("tag",))


def register_readers(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, "json_dataset")


def finetuned_model(models: DataFrame, base: str, json_model: str) -> DataFrame:
    """The catalog row of a fine-tuned model: sizes from its base, which must exist."""
    row = models.filter(F.col("json_model") == base)
    if not row.limit(1).count():
        raise ValueError(f"no such model: {base}")
    out = row.withColumn("json_model", F.lit(json_model)).withColumn("tag", F.array(F.lit(FINETUNED)))
    return out.withColumn("date_added", F.current_date()) if "date_added" in models.columns else out


def readers_of_model(jobs: DataFrame, json_model: str) -> DataFrame:
    return jobs.filter(F.col("json_model") == json_model).select("json_reader").distinct()


def readers_by_model(jobs: DataFrame) -> DataFrame:
    """(json_model, readers): the datasets that each model has read, in order."""
    return jobs.groupBy("json_model").agg(F.array_sort(F.collect_set("json_reader")).alias("readers"))


def models_of_reader(image_jobs: DataFrame, text_jobs: DataFrame, json_reader: str) -> DataFrame:
    both = [j.filter(F.col("json_reader") == json_reader).select("json_model") for j in (image_jobs, text_jobs)]
    return both[0].unionByName(both[1]).distinct()


def job_of_hash(hashes: DataFrame, text_jobs: DataFrame, image_jobs: DataFrame) -> DataFrame:
    """(job_hash, modality, json_reader, json_model); text first, then image."""
    held = [j.select("job_hash", *[F.col(c).alias(f"{p}_{c}") for c in ("json_reader", "json_model")]) for p, j in (("t", text_jobs), ("i", image_jobs))]
    out = hashes.join(held[0], "job_hash", "left").join(held[1], "job_hash", "left")
    kind = F.when(F.col("t_json_model").isNotNull(), "text").when(F.col("i_json_model").isNotNull(), "image")
    return out.select("job_hash", kind.alias("modality"), *[F.coalesce(f"t_{c}", f"i_{c}").alias(c) for c in ("json_reader", "json_model")])


def known_value(known: DataFrame, classifier: str, model: str, train: list[str], test: list[str]) -> DataFrame:
    """Known results of one question: four keys, the lists compared whole and in order."""
    lists = [F.array(*map(F.lit, x)).cast("array<string>") for x in (train, test)]
    return known.filter((F.col("classifier_type") == classifier) & (F.col("model_json") == model) & (F.col("train_readers_json") == lists[0]) & (F.col("test_readers_json") == lists[1]))


class Catalog:
    """Versioned tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        held = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in held if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        versions = self._versions(name)
        schema = StructType.fromDDL(SCHEMAS[name])
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{versions[-1]:08d}")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """A new version; the one before stays for readers that still use it."""
        version = (self._versions(name) or [0])[-1] + 1
        df.select(*self._columns(name, df)).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{version:08d}")
        return self.table(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """New files beside those of the present version; what is there isn't read.  Spark
        commits them together, and several writers may append at a time."""
        versions = self._versions(name)
        if not versions:
            return self.save(name, df)
        df.select(*self._columns(name, df)).write.mode("append").parquet(f"{self.folder}/{name}/v{versions[-1]:08d}")
        return self.table(name)

    def compact(self, name: str, files: int = 1) -> DataFrame:
        """The present version in few files, as a new one; older versions go."""
        out = self.save(name, self.table(name).coalesce(files))
        self.clean(name)
        return out

    def clean(self, name: str) -> None:
        """Delete all versions but the last; nobody may still read them."""
        for version in self._versions(name)[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/v{version:08d}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _columns(self, name: str, df: DataFrame) -> list[Column]:
        return [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])]

    def purge(self) -> None:
        """Forget all results; models and datasets stay."""
        for name in RESULT_TABLES:
            self.save(name, self.spark.createDataFrame([], SCHEMAS[name]))
