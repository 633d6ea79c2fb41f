"""From raw documents to token ids: five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelrank.llm.bpe import bpe
from modelrank.llm.common import dropped, scratch_scope, stored
from modelrank.llm.decontaminate import decontaminate
from modelrank.llm.language_id import language_id
from modelrank.llm.line_dedup import line_dedup
from modelrank.llm.simhash import drop_near_duplicates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; a missing language becomes the predicted one, "und" if none could be learnt."""
    found = language_id(docs, keep=tuple(docs.columns), letters="__letters").filter("__letters")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays with the rest of its text."""
    kept = line_dedup(docs, keep=tuple(c for c in docs.columns if c not in ("text", "n_chars")))
    return kept.select(*[F.length("kept_text").cast("long").alias(c) if c == "n_chars" else F.col("kept_text").alias(c) if c == "text" else c for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id stays."""
    return drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule marks go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text that they decode to."""
    import public_tokenizers

    out = bpe(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]
#: Language ID and SimHash have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as made:  # what the stage itself needed goes once its result is written
            docs = stored(stage(spark, before, sf_dir), f"stage-{name}")
            made.remove(docs.scratch)
        dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
