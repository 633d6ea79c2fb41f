"""Line dedup by a sharded minimal perfect hash.

Lines are counted by 128-bit hash, the number of documents that hold each.
All distinct hashes are dealt to shards of bounded size, and each shard
becomes one file in the shared folder: a minimal perfect hash (levels of bit
arrays with ranks), then compact arrays of 32-bit fingerprints and 32-bit
counts (which stop at their greatest value) in the order that the hash gives,
about nine bytes for a line.  Documents are then read once more and probe
those arrays, and the counts decide which lines go; no line is joined to
anything.

Address and fingerprint come from different halves of the hash.  Every line
that is probed is in the index, so a fingerprint never has to tell a stranger
from a member here; an index that is asked for other lines takes one for a
member with a chance of 2**-32.

A null text is one empty line.  Empty keys are never counted.  Rows with the
same id, or without one, count as documents of their own.  Memory: a shard
holds ``SHARD_KEYS`` keys on average; a worker maps the files of up to
``OPEN_SHARDS`` of them, and reads them whole (9 MB each) where the shared
folder is no mounted file system.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_text, open_file, put_file, scratch_path, stored, text_blocks

SHARD_KEYS = 1 << 20
OPEN_SHARDS = 64
#: Bytes of text whose lines are probed at once, so that a shard is opened once for many.
PROBE_BYTES = 8 << 20
TOP = (1 << 32) - 1
#: Bits of a level per key that is still to be placed.
GAMMA = 2
STRIPPED = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(STRIPPED).lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    """16-byte digests as their two halves."""
    both = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of both halves, another for each level."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xD1B54A32D192ED03) & (2**64 - 1)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def build_shard(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The file of a shard: header, per level its length, ranks and bits, then fingerprints and counts."""
    n, levels, left, slot, placed = len(a), [], np.arange(len(a)), np.zeros(len(a), np.int64), 0
    while len(left):
        size = (GAMMA * len(left) + 63) // 64 * 64
        at = (mixed(a[left], b[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        bits = np.packbits(alone, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))[:-1]]).astype("<u8") + np.uint64(placed)
        fits = alone[at]
        slot[left[fits]] = placed + (np.cumsum(alone) - 1)[at[fits]]
        placed += int(fits.sum())
        left = left[~fits]
        levels.append((size, ranks, bits))
    prints, held = np.zeros(n, "<u4"), np.zeros(n, "<u4")
    prints[slot], held[slot] = b & np.uint64(TOP), np.minimum(counts, np.uint64(TOP))
    head = np.array([n, len(levels), *(size for size, _, _ in levels)], "<u8")
    return [head.tobytes(), *(x.tobytes() for _, ranks, bits in levels for x in (ranks, bits)), prints.tobytes(), held.tobytes()]


class Shard:
    """A shard file, mapped."""

    def __init__(self, uri: str):
        with open_file(uri) as f:
            held = f.read_buffer()
        data = np.frombuffer(held, "<u8", held.size // 8)
        self.n, depth = int(data[0]), int(data[1])
        at, self.levels = 2 + depth, []
        for size in data[2:at].tolist():
            words = size // 64
            self.levels.append((size, data[at : at + words], data[at + words : at + 2 * words]))
            at += 2 * words
        self.prints, self.counts = np.frombuffer(held, "<u4", 2 * self.n, 8 * at).reshape(2, self.n)

    def counts_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where it isn't indexed."""
        out, left = np.zeros(len(a), np.uint64), np.arange(len(a))
        for depth, (size, ranks, bits) in enumerate(self.levels):
            at = mixed(a[left], b[left], depth) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (bits[word] >> bit) & np.uint64(1) == 1
            w, k = word[found], bit[found]
            slot = (ranks[w] + np.bitwise_count(bits[w] & ((np.uint64(1) << k) - np.uint64(1)))).astype(np.int64)
            rows = left[found]
            out[rows] = np.where(self.prints[slot] == b[rows] & np.uint64(TOP), self.counts[slot], 0)
            left = left[~found]
        return out


@lru_cache(maxsize=OPEN_SHARDS)
def shard_at(uri: str) -> Shard:
    return Shard(uri)


def count_lines(df: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(a, b, n): the hash of each key, and how many documents hold it."""

    def run(batches):
        for batch in text_blocks(batches, "__text", 16 << 20):
            seen: Counter = Counter()
            for value in batch.column("__text").to_pylist():
                keys = {line_key(x) for x in (value or "").encode().split(b"\n")}
                seen.update(k for k in keys if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars))
            a, b = halves(b"".join(map(key_hash, seen)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["a", "b", "n"])

    held = df.select(F.col(f"`{text}`").cast("string").alias("__text"))
    return held.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def build_index(lines: DataFrame, shards: int) -> list[str]:
    """Shard files of the (a, b, n) rows; as many paths as shards, in order."""
    folder = scratch_path(lines.sparkSession, "line-index")

    def run(key, table):
        shard = key[0].as_py()
        a, b, n = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in "abn")
        uri = put_file(f"{folder}/{shard}", build_shard(a, b, n))
        return pa.table({"shard": pa.array([shard], pa.int64()), "uri": pa.array([uri])})

    made = lines.withColumn("shard", F.pmod("a", F.lit(shards))).groupBy("shard").applyInArrow(run, "shard long, uri string").collect()
    uris = {r.shard: r.uri for r in made}
    return [uris.get(i, "") for i in range(shards)]


def line_dedup(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key has ``min_chars`` code points or more and is in ``min_docs`` documents or more.

    Returns the ``keep`` columns with n_lines (before dropping), n_dropped
    and kept_text (the lines that stay, joined by newline; empty if none
    does or the text is null).
    """
    lines = stored(count_lines(df, text, min_chars), "lines")
    shards = max(1, -(-lines.count() // SHARD_KEYS))
    paths = build_index(lines, shards)
    dropped(lines)

    def make():
        def work(texts):
            lines = [(t or "").encode().split(b"\n") for t in texts]
            keys = [line_key(x) for doc in lines for x in doc]
            a, b = halves(b"".join(map(key_hash, keys)))
            counts = np.zeros(len(a), np.uint64)
            of = (a.view(np.int64) % np.int64(shards)).astype(np.int64)
            for shard in np.unique(of):
                if paths[shard]:
                    rows = np.nonzero(of == shard)[0]
                    counts[rows] = shard_at(paths[shard]).counts_of(a[rows], b[rows])
            gone = counts >= np.uint64(min_docs)
            gone &= np.fromiter(map(bool, keys), bool, len(keys))
            n_lines, n_dropped, kept, at = [], [], [], 0
            for doc, whole in zip(lines, texts):
                out = gone[at : at + len(doc)]
                at += len(doc)
                n_lines.append(len(doc))
                n_dropped.append(int(out.sum()))
                kept.append(b"\n".join(x for x, o in zip(doc, out.tolist()) if not o).decode() if out.any() else whole or "")
            return [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]

        return work

    return map_text(df, text, list(keep), "n_lines long, n_dropped long, kept_text string", make, PROBE_BYTES)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, row, pos, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, row_number() OVER () AS row, 0 AS pos, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
), marked AS (
  SELECT k.*, h.key IS NOT NULL AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row
"""
