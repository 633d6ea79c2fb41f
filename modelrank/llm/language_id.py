"""Language ID by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; each n-gram of code points, n from 1 to 3, falls in one
of ``BUCKETS`` buckets of its n.  Counting runs in Spark over a sample of
different labelled rows that a hash of their values picks (``MAX_TRAIN_DOCS``
rows at most; the learned tables have a fixed size for each language).  The
matrix of log probabilities and the log priors are broadcast.  A block of
whole texts becomes sparse counts (text, bucket, count), and these times the
matrix, summed by text, are the log likelihoods.  A long text is counted in
stretches whose grams reach into the next one, so every text is scored as a
whole.

A null text, or one without any letter (Unicode category L), is ``und`` with
score 0.  Rows that repeat are scored alike, and learnt from once; equal
scores go to the first language in order of name.  Without any row to learn
from, every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, held_out, map_text, text_blocks

MAX_TRAIN_DOCS = 8000
#: Languages beyond this many are refused: the matrix would grow past its bound.
MAX_LANGUAGES = 400
GRAMS = (1, 2, 3)
BUCKETS = 1 << 14
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
SMOOTHING = 0.5
LETTER = regex.compile(r"\p{L}")
#: Code points that are scored together, and grams that are counted at once.
BLOCK_CHARS, STRETCH = 1 << 19, 1 << 19


def buckets_of(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place; the last n - 1 places have none."""
    with np.errstate(over="ignore"):
        h = points[: len(points) - n + 1] * MULTIPLIERS[0]
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) + points[k : len(points) - n + 1 + k] * MULTIPLIERS[k]
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (h >> np.uint32(18)).astype(np.intp) + (n - 1) * BUCKETS


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, with a blank at both ends of each, and where each begins."""
    texts = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def sparse_counts(texts: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, count) of the n-grams of each text, a stretch of grams at a time."""
    points, begins = points_of(texts)
    of = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(begins))
    for a in range(0, len(points) - n + 1, STRETCH):
        some = points[a : a + STRETCH + n - 1]
        text = of[a : a + len(some) - n + 1]
        inside = text == of[a + n - 1 : a + len(some)]  # grams that would cross into the next text aren't counted
        first = int(text[0])
        key = ((text - first) * BUCKETS + buckets_of(some, n) - (n - 1) * BUCKETS)[inside]
        key, count = np.unique(key.astype(np.uint32) if (int(text[-1]) - first + 1) * BUCKETS < 1 << 32 else key, return_counts=True)
        yield (key // BUCKETS).astype(np.int64) + first, (key % BUCKETS).astype(np.intp) + (n - 1) * BUCKETS, count


def counts_of(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(GRAMS) * BUCKETS)
    for n in GRAMS:
        for _, bucket, count in sparse_counts(texts, n):
            out += np.bincount(bucket, count, len(out))
    return out


def score_block(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log likelihood of each text in each language: its sparse counts times the matrix."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for n in GRAMS:
        for text, bucket, count in sparse_counts(texts, n):
            if len(text):
                starts = np.flatnonzero(np.diff(text, prepend=-1))
                out[text[starts]] += np.add.reduceat(matrix[bucket] * count[:, None], starts, axis=0)
    return out


def learn(df: DataFrame, text: str, lang: str, key: str, max_docs: int = MAX_TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order of name, for each the log probability of every bucket, and its log prior."""
    held = df.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull())
    sample = hash_sample(held.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")), max_docs)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in text_blocks(batches, "t"):
            for lang_of, value in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist()):
                held[lang_of] = held.get(lang_of, 0) + counts_of([value])
                docs[lang_of] = docs.get(lang_of, 0) + 1
        names = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([docs[x] for x in names], pa.int64()), pa.array([held[x].astype("<f8").tobytes() for x in names], pa.binary())], names=["l", "n", "c"])

    def add(key, table):
        c = sum(np.frombuffer(x, "<f8") for x in table.column("c").to_pylist())
        return pa.table({"l": pa.array([key[0].as_py()], pa.string()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "c": pa.array([c.tobytes()], pa.binary())})

    counted = sample.repartition(8).mapInArrow(run, "l string, n long, c binary").groupBy("l").applyInArrow(add, "l string, n long, c binary")
    rows = sorted(counted.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r.l)
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    columns = []
    for r in rows:
        c = np.frombuffer(bytes(r.c), "<f8").reshape(len(GRAMS), BUCKETS) + SMOOTHING
        columns.append(np.log(c / c.sum(1, keepdims=True)).ravel())
    total = sum(r.n for r in rows)
    return [r.l for r in rows], np.stack(columns, 1) if rows else np.zeros((len(GRAMS) * BUCKETS, 0)), np.log([r.n / total for r in rows])


def language_id(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), train: DataFrame | None = None, letters: str | None = None) -> DataFrame:
    """Predict the language of every text from the text alone.

    ``train`` (by default the rows of ``df`` that aren't held out) has the
    columns text, lang and key.  Returns the ``keep`` columns with lang_pred
    and score, the posterior probability of the prediction; ``letters`` names
    a further column, whether the text has a letter.
    """
    model = learn(df.filter(~held_out(F.col(f"`{key}`"))) if train is None else train, text, lang, key)
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        names, matrix, prior = held.value

        def work(texts):
            preds, scores = ["und"] * len(texts), [0.0] * len(texts)
            written = [bool(t and LETTER.search(t)) for t in texts] if names or letters else []
            rows = [i for i, w in enumerate(written) if w] if names else []
            at = 0
            while at < len(rows):
                end, size = at, 0
                while end < len(rows) and (end == at or size + len(texts[rows[end]]) <= BLOCK_CHARS):
                    size += len(texts[rows[end]])
                    end += 1
                block, at = rows[at:end], end
                likely = score_block([texts[i] for i in block], matrix) + prior
                best = likely.argmax(1)
                share = 1 / np.exp(likely - likely.max(1, keepdims=True)).sum(1)
                for i, b, s in zip(block, best.tolist(), share.tolist()):
                    preds[i], scores[i] = names[b], s
            return [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), *([pa.array(written, pa.bool_())] if letters else [])]

        return work

    return map_text(df, text, list(keep), "lang_pred string, score double" + (f", `{letters}` boolean" if letters else ""), make)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
