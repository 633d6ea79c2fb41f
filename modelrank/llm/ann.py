"""Approximate nearest neighbours by cosine through an inverted multi-index.

Unit vectors are cut in two halves, and each half is quantised on its own
(k-means over at most ``MAX_FIT`` rows, and ``MAX_FIT_VALUES`` values, that a
hash picks; every row is indexed).  A row's cell is its pair of centroids.  For a query, pairs of
centroids are taken in order of summed distance until their cells hold
``share`` of all rows; the entries of those cells are ranked again by their
exact cosine.

The index is a table in the shared folder: a row for each part of a cell, with
up to about ``PART_VALUES`` values, so a cell of any size spreads over as many
tasks as it needs.  A walk over the cells gives each query the summed distance
at which it stops.  Queries go in groups of ``QUERY_VALUES`` values, whose
vectors and distances are broadcast, and each task tells from them which
queries visit the part at hand: lists of cells, which grow as the queries times
the cells, are neither stored, shuffled nor sent to the driver.  A task keeps
the ``k`` best of each query over all its parts, and the least of them is what
later entries must reach.  Within a part equal vectors are scored once and keep
their least ids, as many as can matter.

Recall depends on the data: on vectors without structure only visiting a large
part of the rows finds the nearest ones, so ``share`` is a parameter.
Vectors that are null, of another length than most, zero, or that hold null
or non-finite components take no part, as query or candidate.  Rows that
share the query's id are not its candidates, however many they are.  Each row
of the queries has its own answers, also where an id comes again among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, hash_sample, stored

MAX_FIT, MAX_FIT_VALUES = 20_000, 2_000_000
MAX_CENTROIDS = 256
#: Values (rows by width) of a part of a cell, and of a group of queries.
PART_VALUES, QUERY_VALUES = 1 << 18, 1 << 22
SHARE = 0.7
BLOCK_SCORES, EXACT = 1 << 21, 1 << 15
#: Queries that a task walks at once, and holds against its parts at once.
WALKED, SCANNED = 64, 4096
#: Tasks that search, for each core: each returns up to k rows for a query.
SEARCH_TASKS = 4
#: Rows that are held against all centroids at once.
ASSIGNED = 2048


def usable(df: DataFrame, vec_id: str, vector: str, width: int | None = None) -> DataFrame:
    """(vec_id, vec): vectors that take part, of ``width`` or else of the most
    frequent one; floats stay floats, all else becomes doubles."""
    floats = df.select(F.col(f"`{vector}`")).dtypes[0][1] == "array<float>"
    v = F.col(f"`{vector}`").cast(f"array<{'float' if floats else 'double'}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    held = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(fine)
    if width is None:
        size = held.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
        width = size.d if size else 0
    return held.filter(F.size("vec") == width)


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def collected(df: DataFrame) -> pa.Table:
    """Rows as Arrow: a vector takes 4 or 8 bytes a value on the driver, not a Python float and a pointer."""
    return df.toArrow().combine_chunks()


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # neither tiny nor huge components vanish in the norm
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = max(1, v.shape[1] // 2)
    return v[:, :cut], v[:, cut:]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def closest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid nearest to each row."""
    return np.concatenate([np.zeros(0, np.int64), *(squared(v[i : i + ASSIGNED], c).argmin(1) for i in range(0, len(v), ASSIGNED))])


def kmeans(v: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    v = np.unique(v, axis=0)
    c = v[np.random.default_rng(seed).choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = closest(v, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, v[:, j], len(c)) for j in range(v.shape[1])], 1) if v.shape[1] else np.zeros((len(c), 0))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def stop(a: np.ndarray, b: np.ndarray, cells: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, enough: float) -> float:
    """The summed distance up to which cells, nearest first, hold ``enough`` rows; a and b: the distances to the centroids of each half."""
    d = a[cells[0]] + b[cells[1]]
    order = np.argsort(d)
    last = np.searchsorted(np.cumsum(sizes[order]), enough)
    return float(d[order[last]]) + 1e-9 if last < len(d) else np.inf  # the same sums may differ in their last bits elsewhere


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the row of b beside it, summed in one order whatever stands around."""
    dot = (a * b).sum(1)
    return dot / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def part_search(ids: np.ndarray, vecs: np.ndarray, k: int) -> Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A function of queries that gives (row of query, vec_id, score): for each
    the k best entries of a part at least, without those of its own id and
    those that don't reach ``floor``."""
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], vecs[order] + 0  # a negative zero equals zero
    _, first, group = np.unique(vecs.view(np.dtype((np.void, vecs.itemsize * vecs.shape[1]))).ravel(), return_index=True, return_inverse=True)
    distinct = vecs[first].astype(np.float64)
    by = np.argsort(group, kind="stable")  # ids ascend within a group
    counts = np.bincount(group)
    begins = np.concatenate([[0], np.cumsum(counts)])
    names, rank = np.unique(ids, return_inverse=True)
    places = group[by] * len(names) + rank[by]  # ascending
    scaled = unit(distinct).astype(np.float32).T.copy()
    step = max(1, BLOCK_SCORES // len(distinct))
    # single precision picks, double decides: a product of unit vectors is off by less than this
    error = (vecs.shape[1] + 8) * 2.0**-23

    def enter(scores: np.ndarray, of: np.ndarray) -> np.ndarray:
        """What an entry must reach to be among the k best of this part."""
        # vectors that only entries of the query's id have don't count among the best
        low, high = np.searchsorted(ids, of, "left"), np.searchsorted(ids, of, "right")
        n_own = high - low
        who = np.repeat(np.arange(len(of)), n_own)
        own = group[np.arange(len(who)) - np.repeat(np.cumsum(n_own) - n_own, n_own) + np.repeat(low, n_own)]
        pairs, times = np.unique(who * len(distinct) + own, return_counts=True)
        alone = pairs[times == counts[pairs % len(distinct)]]
        scores[alone // len(distinct), alone % len(distinct)] = -np.inf
        top = min(k, scores.shape[1])
        return -np.partition(-scores, top - 1, axis=1)[:, top - 1]

    def search(who: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, units: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for q0 in range(0, len(who), step):
            some = who[q0 : q0 + step]
            scores, least = units[some] @ scaled, floor[some]
            new = np.flatnonzero(least == -np.inf)
            if len(new):
                least[new] = enter(scores[new], query_ids[some[new]])
            hits = np.flatnonzero(scores >= (least - 2 * error).astype(np.float32)[:, None])
            for h0 in range(0, len(hits), EXACT):
                q, d = np.divmod(hits[h0 : h0 + EXACT], len(distinct))
                q = some[q]
                exact = cosines(queries[q], distinct[d])
                good = exact >= floor[q]
                q, d, exact = q[good], d[good], exact[good]
                key = d * len(names) + np.minimum(np.searchsorted(names, query_ids[q]), len(names) - 1)
                known = names[key - d * len(names)] == query_ids[q]
                low = np.searchsorted(places, key, "left")
                skip = np.where(known, np.searchsorted(places, key, "right") - low, 0)
                for n in range(k):  # of equal vectors the k least other ids can matter
                    at = begins[d] + n
                    at = at + np.where(at >= low, skip, 0)
                    there = at < begins[d + 1]
                    if not there.any():
                        break
                    yield q[there], ids[by[at[there]]], exact[there]

    return search


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each query."""
    order = np.lexsort((ids, -scores, q))
    begin = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - begin < k]


def nearest(df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, share: float = SHARE, key: str | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found of each row
    of ``queries`` among all rows of ``df``, ties to the smaller id; all
    candidates if there are fewer.  ``key``: the id column of queries."""
    spark = df.sparkSession
    rows = stored(usable(df, vec_id, vector), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    width, kind = len(rows.first().vec), rows.schema["vec"].dataType.simpleString()
    dtype = "<f4" if kind == "array<float>" else "<f8"
    fit = collected(hash_sample(rows, min(MAX_FIT, max(256, MAX_FIT_VALUES // width))).select("vec"))
    fit = unit(matrix_of(fit.column("vec").combine_chunks()) if len(fit) else np.array([rows.first().vec], np.float64))
    centroids = [kmeans(h, max(1, min(MAX_CENTROIDS, int((n / 50) ** 0.5))), seed=s) for s, h in enumerate(halves(fit))]
    low = len(centroids[1])

    def assign(batches):
        for batch in batches:
            v = halves(unit(matrix_of(batch.column("vec"))))
            cell = closest(v[0], centroids[0]) * low + closest(v[1], centroids[1])
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("vec_id"), batch.column("vec")], names=["cell", "vec_id", "vec"])

    celled = stored(rows.mapInArrow(assign, f"cell int, vec_id long, vec {kind}").withColumn("row", F.monotonically_increasing_id()), "celled")
    dropped(rows)
    parts = F.ceil(F.col("n") * width / F.lit(PART_VALUES)).cast("int")
    cells = stored(celled.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", parts), "cells")  # MAX_CENTROIDS squared rows at most
    held = collected(cells.select("cell", "n"))
    full, sizes = held.column("cell").to_numpy(), held.column("n").to_numpy()
    dealt = celled.join(F.broadcast(cells), "cell").select("cell", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"), "vec_id", "vec")

    def pack(key, table):
        table = table.combine_chunks()
        ids, v = table.column("vec_id").to_numpy(), pa.concat_arrays(table.column("vec").chunks).flatten().to_numpy()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vecs": pa.array([v.astype(dtype).tobytes()], pa.binary())})

    index = stored(dealt.groupBy("cell", "part").applyInArrow(pack, "cell int, ids binary, vecs binary"), "multi-index")
    dropped(celled)

    def walk(batches):
        of = full // low, full % low
        for batch in batches:
            v, stops = unit(matrix_of(batch.column("vec"))), []
            for i in range(0, len(v), WALKED):
                both = [squared(h, c) for h, c in zip(halves(v[i : i + WALKED]), centroids)]
                stops += [stop(a, b, of, sizes, share * n) for a, b in zip(*both)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stops, pa.float64())], names=[*batch.schema.names, "stop"])

    asked = usable(queries, key or vec_id, vector, width).withColumn("query", F.monotonically_increasing_id())
    vec = asked.schema["vec"].dataType.simpleString()
    asked = stored(asked.mapInArrow(walk, f"vec_id long, vec {vec}, query long, stop double"), "queries")
    n_asked = asked.count()
    groups = -(-n_asked * width // QUERY_VALUES)
    found = [_search(spark, asked.filter(F.pmod(F.xxhash64("query"), F.lit(groups)) == g) if groups > 1 else asked, index, centroids, dtype, k) for g in range(groups)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for one in found[1:]:
        every = every.unionAll(one)
    return every


def _search(spark, some: DataFrame, index: DataFrame, centroids: list[np.ndarray], dtype: str, k: int) -> DataFrame | None:
    """(query_id, rank, vec_id, score): the k best of each query of a group."""
    held = collected(some)  # QUERY_VALUES values, about
    if not len(held):
        return None
    group = spark.sparkContext.broadcast((*(held.column(c).to_numpy() for c in ("query", "vec_id", "stop")), held.column("vec").combine_chunks().flatten().to_numpy()))
    del held
    low = len(centroids[1])

    def search(batches):
        numbers, query_ids, stops, flat = group.value
        vecs = flat.reshape(len(numbers), -1).astype(np.float64)
        units = unit(vecs).astype(np.float32)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        best_of = {q0: nothing for q0 in range(0, len(numbers), SCANNED)}
        floor = np.full(len(numbers), -np.inf)

        def merged(parts, least):
            """The k best of each query of a block; ``least`` learns the last of them, where there are k."""
            q, i, s = (np.concatenate(x) for x in zip(*parts))
            keep = best(q, i, s, k)
            q, i, s = q[keep], i[keep], s[keep]
            counts = np.bincount(q, minlength=len(least))
            least[counts == k] = s[np.cumsum(counts)[counts == k] - 1]
            return q, i, s

        for batch in batches:
            parts = []
            for cell, ids, data in zip(*(batch.column(c).to_pylist() for c in ("cell", "ids", "vecs"))):
                ids = np.frombuffer(ids, "<i8")
                parts.append((cell, part_search(ids, np.frombuffer(data, dtype).reshape(len(ids), -1), k)))
            for q0 in best_of:
                here = slice(q0, q0 + SCANNED)
                of, v, u, reach, least = query_ids[here], vecs[here], units[here], stops[here], floor[here]
                a, b = (squared(c, h) for c, h in zip(centroids, halves(unit(v))))
                pending, size = [best_of[q0]], 0
                for cell, found_in in parts:
                    who = np.flatnonzero(a[cell // low] + b[cell % low] <= reach)
                    if not len(who):
                        continue
                    for one in found_in(who, of, v, u, least):
                        pending.append(one)
                        size += len(one[0])
                        if size > k * len(of):
                            pending, size = [merged(pending, least)], 0
                best_of[q0] = merged(pending, least)
        for q0, (q, i, s) in best_of.items():
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[q0 + q]), pa.array(query_ids[q0 + q]), pa.array(i), pa.array(s)], names=["query", "query_id", "vec_id", "score"])

    tasks = SEARCH_TASKS * spark.sparkContext.defaultParallelism
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = index.coalesce(tasks).mapInArrow(search, "query long, query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = stored(ranked.select("query_id", "rank", "vec_id", "score"), "found")
    group.destroy()
    return out


def op3_multi_index(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 50 = 0"), k=5)
