"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned, and a lookup table gives every bin a number;
a few pairs of features have two-dimensional tables.  Tables are learnt by
boosting shallow trees on one feature (or pair) after another, round after
round.  A score is the logistic function of a sum of looked-up numbers.

Learning takes labelled rows that aren't held out, ``MAX_TRAIN_ROWS`` at most,
which a hash picks: first so many different labels, then, since ids may
repeat among documents, so many different rows of features.  These (not the
texts) go to the driver.  Features come from the text alone, over the whole
of it.  Null and empty texts have the features of an empty text.  Rows that
repeat score alike, and count once in learning; an id with two different
labels is learnt from with both.  Without any label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, hash_sample, held_out, map_text, stored

MAX_TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST_ROWS = 120, 40, 0.15, 1.0, 10
THRESHOLD = 0.7
FEATURES = ["bytes", "words", "word_length", "distinct_words", "distinct_lines", "line_length", "full_stops", "commas", "bars", "marks", "exclamations", "digits", "upper", "longest_word", "repeats"]
DIGITS, UPPER, MARKS = b"0123456789", bytes(range(65, 91)), b"#$%&*@~^<>{}[]=+_\\/"


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    words, lines = data.split(), data.split(b"\n")
    n, nw = max(1, len(data)), max(1, len(words))
    kinds = lambda chars: len(data) - len(data.translate(None, chars))
    return [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / nw, len(set(words)) / nw, len(set(lines)) / len(lines), np.log1p(nw / len(lines)),
        data.count(b".") / nw, data.count(b",") / nw, data.count(b"|") / nw, kinds(MARKS) / nw, data.count(b"!") / nw, kinds(DIGITS) / n, kinds(UPPER) / n,
        max(map(len, words), default=0), sum(map(bytes.__eq__, words, words[1:])) / nw,
    ]


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
    gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 4) -> np.ndarray:
    """The value of each bin by a tree of up to ``leaves`` leaves, cut best first."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        cuts = [(*_split(g[a:b], h[a:b], n[a:b]), a, b) for a, b in runs]
        gain, at, a, b = max(cuts)
        if gain <= 1e-12:
            break
        runs.remove((a, b))
        runs += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid in four by one cut of each feature: its gain and the value of each cell."""
    total = [np.cumsum(np.cumsum(x, 0), 1) for x in (g, h, n)]
    best_gain, out = 0.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + RIDGE)

    def four(x):
        a = x[:-1, :-1]
        top, side, whole = x[:-1, -1:], x[-1:, :-1], x[-1, -1]
        return np.stack([a, top - a, side - a, whole - top - side + a])

    if min(g.shape) > 1:
        gs, hs, ns = map(four, total)
        gain = np.where((ns >= LEAST_ROWS) | (ns == 0), gs**2 / (hs + RIDGE), -np.inf).sum(0) - base
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] > 1e-12:
            best_gain = float(gain[i, j])
            value = gs[:, i, j] / (hs[:, i, j] + RIDGE)
            out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return best_gain, out


class Model:
    """Lookup tables; ``score`` adds them up."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [edges_of(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
        self.coarse = [edges_of(x[:, j], PAIR_BINS) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if len(y):
            self._learn(x, y)

    def _learn(self, x: np.ndarray, y: np.ndarray) -> None:
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables)]
        f = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for b, c, t in zip(bins, counts, self.tables):
                g, h = slopes()
                step = RATE * tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), c)
                t += step
                f += step[b]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
        grids = []
        g, h = slopes()
        for i in range(len(coarse)):
            for j in range(i + 1, len(coarse)):
                shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
                cell = coarse[i] * shape[1] + coarse[j]
                size = shape[0] * shape[1]
                n = np.bincount(cell, minlength=size).reshape(shape)
                gain, _ = quadrants(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape), n)
                grids.append((-gain, i, j, cell, n))
        grids = sorted(grids, key=lambda x: x[:3])[:PAIRS]
        self.pairs = [(i, j, np.zeros(n.shape)) for _, i, j, _, n in grids]
        for _ in range(PAIR_ROUNDS):
            for (_, _, _, cell, n), (_, _, t) in zip(grids, self.pairs):
                g, h = slopes()
                _, step = quadrants(np.bincount(cell, g, n.size).reshape(n.shape), np.bincount(cell, h, n.size).reshape(n.shape), n)
                t += RATE * step
                f += RATE * step.ravel()[cell]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            f += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, t in self.pairs:
            f += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-f))


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def train(df: DataFrame, labels: DataFrame, text: str, key: str, label: str, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from the documents of ``df`` that ``labels`` marks 0 or 1 and that aren't held out."""
    marked = labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("__label"))
    marked = hash_sample(marked.filter(F.col("__key").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__key"))), max_rows)
    texts = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__words"))
    held = texts.join(F.broadcast(marked), "__key")  # max_rows rows of two numbers at most

    def make():
        return lambda batch: [pa.array(feature_rows(batch).tolist(), pa.list_(pa.float64()))]

    seen = stored(map_text(held, "__words", ["__key", "__label"], "x array<double>", make), "features")
    rows = sorted(hash_sample(seen, max_rows).collect())
    dropped(seen)
    return Model(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r["__label"] for r in rows], np.float64))


def quality(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Returns the ``keep`` columns with score (0 to 1) and predicted (1 from ``THRESHOLD`` on)."""
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, text, key, label))

    def make():
        held = model.value

        def work(texts):
            score = held.score(feature_rows(texts))
            return [pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())]

        return work

    return map_text(df, text, list(keep), "score double, predicted int", make)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
