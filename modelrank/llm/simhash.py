"""SimHash near-dedup through a byte-position inverted index with count filtering.

A fingerprint has eight bytes.  Two that differ in at most ``bits`` = 2 bits
differ in two byte positions at most, so each pair that is due shares six
positions or more (the guaranteed minimum, ``8 - bits``).

* Prefix: positions are taken in order of rarity, that is by how seldom two
  fingerprints share a byte there.  Of any ``k + bits`` positions a due pair
  shares ``k`` at least, so it meets in a posting list of ``k`` of the first
  ``k + bits`` positions.  ``k`` is the least for which a list of the ``k``
  rarest holds about one fingerprint, by the histogram of bytes.
* Hot lists: a list of over ``LIST_LIMIT`` fingerprints is split by one more
  position.  Its pairs share one of the next ``bits + 1`` positions at least,
  so each of its fingerprints goes to as many longer keys, and so on until
  ``8 - bits`` positions are fixed.  A list that is long even then is paired
  block by block, every pair of blocks on its own.
* Tally: each meeting of a pair in a list gives the positions of that list.
  They are gathered for each pair, positions that no list had are added by
  comparing their bytes, and pairs below the minimum go.
* Verification: the bits that differ are counted.

Equal fingerprints are merged before anything is indexed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_text, stored
from .components import connected_components

SEED = 42
BYTES = 8
#: Fingerprints of a list that are paired at once; longer lists are split.
LIST_LIMIT = 64
#: Hot lists whose keys (13 bytes each) are broadcast; beyond, they are joined in salted pieces.
HOT_KEYS, SALTS = 100_000, 16
#: A long text's shingles are counted so many at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits, each set if it is in over half the hashes of the text's shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        grams = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - size + 1].tolist()
        grams = [line[a:b] for a, b in zip(begins, (ends[size - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, len(grams), CHUNK):
        hashes = np.array([digest(g, SEED) for g in grams[i : i + CHUNK]], np.uint64).astype(">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(grams)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 3, name: str = "fp") -> DataFrame:
    """The ``keep`` columns and the fingerprint as a signed long."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))]

    return map_text(df, text, list(keep), f"{name} long", make)


def byte_at(fp: str, position: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 8 * position).bitwiseAND(F.lit(255))


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def bits_of(mask: int) -> int:
    """The fingerprint bits of the byte positions in a mask."""
    return signed(sum(255 << 8 * p for p in range(BYTES) if mask >> p & 1))


def mask_of(positions: tuple[int, ...]) -> int:
    return sum(1 << p for p in positions)


def rarity(fps: DataFrame) -> tuple[list[int], list[float], int]:
    """Positions, the rarest first; for each how likely two fingerprints share its byte; and how many there are."""
    bytes_of = F.posexplode(F.array(*[byte_at("fp", p) for p in range(BYTES)])).alias("p", "b")
    rows = fps.select(bytes_of).groupBy("p", "b").count().collect()  # 256 for each position at most
    n = sum(r["count"] for r in rows if r.p == 0)
    shared = [sum((r["count"] / n) ** 2 for r in rows if r.p == p) for p in range(BYTES)] if n else [1.0] * BYTES
    order = sorted(range(BYTES), key=lambda p: (shared[p], p))
    return order, [shared[p] for p in order], n


def _postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp): a fingerprint in the list of its bytes at the positions of each mask."""
    lists = [F.struct(F.lit(m).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(bits_of(m))).alias("key")) for m in masks]
    return fps.select("fp", F.inline(F.array(*lists)))


def _marked(postings: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    """Postings with the length ``n`` of their list where it is hot, else null."""
    if n_hot <= HOT_KEYS:
        return postings.join(F.broadcast(hot), ["mask", "key"], "left")
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = postings.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    return salted.join(hot, ["mask", "key", "salt"], "left").drop("salt")


def _met(lists: DataFrame, *more: str) -> DataFrame:
    """(u, v, mask): every pair of fingerprints that meet in a list."""
    a, b = (lists.select("mask", "key", *more, F.col("fp").alias(x)) for x in "uv")
    return a.join(b, ["mask", "key", *more]).filter("u < v").select("u", "v", "mask")


def _in_blocks(lists: DataFrame) -> DataFrame:
    """The same for lists of any length ``n``: blocks of about ``LIST_LIMIT``, every two of them met apart."""
    count = F.ceil(F.col("n") / F.lit(LIST_LIMIT)).cast("int")
    held = lists.withColumn("at", F.pmod(F.xxhash64("fp"), count).cast("int")).withColumn("last", count - 1)
    a = held.select("mask", "key", F.col("fp").alias("x"), F.col("at").alias("i"), F.explode(F.sequence("at", "last")).alias("j"))
    b = held.select("mask", "key", F.col("fp").alias("y"), F.col("at").alias("j"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"))
    pairs = a.join(b, ["mask", "key", "i", "j"]).filter("i < j or x < y")
    return pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "mask")


def candidates(fps: DataFrame, bits: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables (u, v, mask) of all meetings in posting lists, and the stored tables that they read."""
    spark = fps.sparkSession
    order, shared, n = rarity(fps)
    need = BYTES - bits
    k = next((k for k in range(1, need) if n * float(np.prod(shared[:k])) <= 1), need)
    postings = stored(_postings(fps, [mask_of(c) for c in combinations(order[: k + bits], k)]), "postings")
    met, held = [], [postings]
    while True:
        hot = stored(postings.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > LIST_LIMIT), "hot-lists")
        held.append(hot)
        n_hot = hot.count()
        if not n_hot:
            return [*met, _met(postings)], held
        marked = _marked(postings, hot, n_hot)
        met.append(_met(marked.filter("n is null").select("mask", "key", "fp")))
        if k == need:
            return [*met, _in_blocks(marked.filter("n is not null"))], held
        steps = []
        for c in combinations(range(BYTES), k):
            rest = [p for p in order if p not in c]
            steps += [(mask_of(c), mask_of((*c, p)), bits_of(mask_of((*c, p)))) for p in rest[: bits + 1]]
        table = F.broadcast(spark.createDataFrame(steps, "mask short, longer short, bits long"))  # 210 rows at most
        split = marked.filter("n is not null").select("mask", "fp").join(table, "mask")
        postings = stored(split.select(F.col("longer").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp").distinct(), "postings")
        held.append(postings)
        k += 1


def tally(met: str, u: str, v: str) -> Column:
    """In how many positions two fingerprints agree: those of the lists they met in, and others whose bytes are equal."""
    x = F.col(u).bitwiseXOR(F.col(v))
    known = [F.shiftright(F.col(met), p).bitwiseAND(F.lit(1)) == 1 for p in range(BYTES)]
    return sum(F.when(known[p] | (F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0), 1).otherwise(0) for p in range(BYTES))


def fingerprint_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(u, v), u < v: all pairs of distinct fingerprints (column fp) that differ in ``bits`` bits or fewer."""
    if not 0 <= bits < BYTES:
        raise ValueError(f"from 0 to {BYTES - 1} bits may differ")
    met, held = candidates(fps, bits)
    every = met[0]
    for one in met[1:]:
        every = every.unionAll(one)
    pairs = every.groupBy("u", "v").agg(F.bit_or(F.col("mask").cast("int")).alias("met"))
    found = pairs.filter(tally("met", "u", "v") >= BYTES - bits).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    out = stored(found.select("u", "v"), "pairs")
    dropped(*held)
    return out


def _components(docs: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of docs (__key, fp)."""
    fps = stored(docs.groupBy("fp").agg(F.min("__key").alias("first")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(fps.select("fp")))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """One row per document: the key, fp (signed long) and component_id, the
    least key among all documents reachable over links of two bits or fewer.

    Null and empty texts have fingerprint zero and link like any other.
    Repeated rows stay, in the same component.  Rows without a key are in the
    component of their text; a component of only such rows has a null id.
    """
    held = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__words"))
    docs = stored(fingerprints(held, "__words", ("__key",), size), "fingerprints")
    return docs.join(_components(docs).drop("root"), "fp").select(F.col("__key").alias(key), "fp", "component_id")


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """One row of each component with all columns of ``df``: the one whose key
    is the component's id, or any one where no row of it has a key."""
    fp = "__fp"
    full = df.select("*", F.col(f"`{text}`").alias("__words"))
    full = stored(fingerprints(full, "__words", tuple(df.columns), size, fp), "fingerprinted")
    docs = full.select(F.col(f"`{key}`").alias("__key"), F.col(fp).alias("fp"))
    full = full.alias("full")
    chosen = docs.join(_components(docs), "fp").filter(F.col("__key").eqNullSafe(F.col("component_id")))
    chosen = stored(chosen.groupBy("root").agg(F.min("fp").alias("c_fp"), F.first("component_id").alias("c_key")).select("c_fp", "c_key"), "chosen")
    out = full.join(chosen, (F.col(f"full.{fp}") == F.col("c_fp")) & F.col(f"full.`{key}`").eqNullSafe(F.col("c_key")), "left_semi")
    held = docs.join(chosen, (F.col("fp") == F.col("c_fp")) & F.col("__key").eqNullSafe(F.col("c_key")), "left_semi")
    if held.groupBy("fp", "__key").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates([fp, key])  # rows that repeat key and text
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
