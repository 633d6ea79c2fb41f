"""Benchmark decontamination by Aho-Corasick automata, one where the benchmark is small.

Words are runs of letters a-z (A-Z lower-cased), digits and everything beyond
ASCII.  A pattern is a window of consecutive item words, with a blank at each
end; a document's words, joined the same way, are scanned once.  Bytes keep
their place when a text is normalised, so hits map back to code points of the
original text.

An automaton is the one thing that every task holds; it takes about 40 bytes
for each byte of its patterns, ``PATTERN_BYTES`` at most.  A benchmark of more
windows is scanned for in several passes, each with an automaton of its own:
the documents are stored with a row number, each pass keeps the rows that it
hits, and hit words and items are merged by row.  Benchmarks are collected in
groups of about ``GROUP_BYTES``; only a single item of over
``MAX_BENCHMARK_BYTES`` is refused.

Null and empty texts have no words and no hits.  Items
without words are passed over; rows of the benchmark that repeat count once;
an item without id makes its words hit, and is listed as no item.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dropped, map_text, stored

MAX_BENCHMARK_BYTES = 32 << 20
#: Bytes of items that the driver collects at once, and of patterns that an automaton is built from.
GROUP_BYTES, PATTERN_BYTES = 1 << 20, 8 << 20
#: Byte by byte: A-Z to a-z, the rest of ASCII that is no letter or digit to a blank.
NORMAL = bytes(c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RUN = pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
FOUND = "n_words long, n_hit long, hit_spans array<struct<start:long,end:long>>, items array<string>, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def windows(words: list[bytes], size: int) -> Iterator[bytes]:
    """Every window of ``size`` words, or the one of all words if they are fewer."""
    return (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1) if words else 0))


def code_points(data: bytes) -> np.ndarray:
    """For each byte offset, the end included, how many code points begin before it."""
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(starts)])


class Scanner:
    """The automaton; ``scan`` gives word count, runs of hit words and items of a text."""

    def __init__(self, patterns: dict[bytes, list[str]]):
        self.automaton = ahocorasick.Automaton()
        for pattern, items in patterns.items():
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", (len(pattern) + 1, pattern.count(b" ") + 1, items))
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """A run: first word and the one after the last, start and end in code points."""
        data = (text or "").encode()
        normal = data.translate(NORMAL)
        words = normal.split()
        if self.empty or not words:
            return len(words), [], []
        line = b" %b " % b" ".join(words)
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(words), [], []
        begins = list(accumulate((len(w) + 1 for w in words), initial=1))  # of words in the line
        hit, items = np.zeros(len(words), bool), set()
        for end, (length, n, of) in found:
            first = bisect_left(begins, end - length + 1)
            hit[first : first + n] = True
            items.update(of)
        at, points = [m.span() for m in re.finditer(rb"[^ ]+", normal)], code_points(data)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        runs = [(a, b, int(points[at[a][0]]), int(points[at[b - 1][1]])) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        return len(words), runs, sorted(items)


#: Of a Python worker: the patterns it was last asked for, and their automaton.
_held: list = []


def scanner(key: tuple) -> Scanner:
    if not _held or _held[0] != key:
        _held.clear()  # before the next one is built
        _held[:] = key, Scanner({p: list(items) for p, items in key})
    return _held[1]


def patterns_of(items: DataFrame, groups: int, size: int) -> Iterator[tuple]:
    """The windows of all items with the ids of theirs, in parts of about
    ``PATTERN_BYTES``; a window may come again in another part."""
    for group in range(groups):
        some = items.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == group) if groups > 1 else items
        patterns: dict[bytes, set[str]] = {}
        total = 0
        for row in some.distinct().collect():
            for window in windows(words_of(row.text), size):
                if window not in patterns:
                    if total > PATTERN_BYTES:
                        yield tuple((p, tuple(sorted(ids))) for p, ids in sorted(patterns.items()))
                        patterns, total = {}, 0
                    patterns[window] = set()
                    total += len(window)
                patterns[window].update([row.id] if row.id is not None else [])
        if patterns:
            yield tuple((p, tuple(sorted(ids))) for p, ids in sorted(patterns.items()))


def columns_of(n_words: list[int], runs: list[list[tuple]], items: list[list[str]]) -> list[pa.Array]:
    """The columns of ``FOUND``."""
    n_hit = [sum(r[1] - r[0] for r in of) for of in runs]
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([[{"start": r[2], "end": r[3]} for r in of] for of in runs], pa.list_(SPAN)),
        pa.array(items, pa.list_(pa.string())),
        pa.array([h > 0 and 20 * h >= w for w, h in zip(n_words, n_hit)], pa.bool_()),
    ]


def joined(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of several passes as runs of their union."""
    out: list[tuple[int, int, int, int]] = []
    for first, stop, start, end in sorted(runs):
        if out and first <= out[-1][1]:
            a, b, at, to = out[-1]
            out[-1] = (a, max(b, stop), at, max(to, end))
        else:
            out.append((first, stop, start, end))
    return out


def in_passes(df: DataFrame, parts: Iterator[tuple], text: str, keep: tuple[str, ...]) -> DataFrame:
    """As ``decontaminate``, by one pass for each part of the patterns."""
    spark, new = df.sparkSession, [f.split()[0] for f in FOUND.split(", ")]
    carry = [c for c in keep if c not in new]
    body = text if text in carry else "__body"
    rows = df.select(*[F.col(f"`{c}`") for c in carry], *([F.col(f"`{text}`").alias(body)] if body not in carry else []), F.monotonically_increasing_id().alias("__row"))
    rows = stored(rows, "contaminated-rows")
    run = "array<struct<first:long,stop:long,start:long,end:long>>"
    found = []
    for part in parts:
        key = spark.sparkContext.broadcast(part)

        def make(key=key):
            scan = scanner(key.value).scan

            def work(texts):
                _, runs, items = zip(*map(scan, texts))
                return [pa.array([[dict(zip(("first", "stop", "start", "end"), r)) for r in of] for of in runs], pa.list_(RUN)), pa.array(items, pa.list_(pa.string()))]

            return work

        found.append(stored(map_text(rows, body, ["__row"], f"__runs {run}, __items array<string>", make).filter(F.size("__runs") > 0), "contaminated-hits"))
        key.destroy()
    every = found[0]
    for one in found[1:]:
        every = every.unionAll(one)
    merged = every.groupBy("__row").agg(F.flatten(F.collect_list("__runs")).alias("__runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
    merged = stored(merged, "contaminated-merged")
    for one in found:
        dropped(one)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [joined([tuple(r.values()) for r in of or []]) for of in batch.column("__runs").to_pylist()]
            made = columns_of([len(words_of(t)) for t in batch.column("__text").to_pylist()], runs, [of or [] for of in batch.column("__items").to_pylist()])
            kept = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*carry, *new])

    back = rows.join(merged, "__row", "left").select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{body}`").cast("string").alias("__text"), "__runs", "__items")
    return back.mapInArrow(finish, StructType(back.schema.fields[: len(carry)] + StructType.fromDDL(FOUND).fields))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", size: int = 13) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Returns the ``keep`` columns with n_words, n_hit, hit_spans (start and
    end, exclusive, in code points of the original text; neighbours joined),
    items (ids of the items whose windows occur, as strings, sorted) and
    contaminated (a hit word at all, and one in twenty words or more).
    """
    held = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("text is not null")
    length = F.octet_length("text") + F.octet_length(F.coalesce("id", F.lit(""))) + 64
    total, most = (x or 0 for x in held.agg(F.sum(length), F.max(length)).first())
    if most > MAX_BENCHMARK_BYTES:
        raise ValueError(f"an item of the benchmark has {most} bytes; up to {MAX_BENCHMARK_BYTES} are taken")
    parts = patterns_of(held, max(1, -(-total // GROUP_BYTES)), size)
    first, second = next(parts, ()), next(parts, None)
    if second is not None:
        return in_passes(df, chain([first, second], parts), text, keep)
    key = df.sparkSession.sparkContext.broadcast(first)

    def make():
        scan = scanner(key.value).scan

        def work(texts):
            return columns_of(*zip(*map(scan, texts)))

        return work

    return map_text(df, text, list(keep), FOUND, make)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=13)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(13, len(words)) AS k, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM items WHERE len(words) > 0)
), grams AS (
  SELECT row, k, i, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT row, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins))
), found AS (
  SELECT g.row, g.i, g.k, w.item_id FROM grams g JOIN wins w ON g.k = w.k AND g.gram = w.gram
), hit AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS place FROM found) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY row
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""
