"""Substring dedup by recompression.

Words get 64-bit names.  Rounds then name runs of equal symbols and pairs of
symbols: a pair is joined where the left symbol falls in one half of the
alphabet and the right one in the other, by a bit of their names.  A new name
is a hash of what it stands for, so equal runs and pairs get equal names in
every task and round without any exchange, and equal substrings get equal
symbols inside.

Low symbols (runs of two and two rounds of pairs) span at most ``SPAN`` = 8
words, and whether one begins at a place depends on the 8 words before and
after it alone.  Longer runs keep a symbol for each word, so that this bound
holds.  Every window of 35 words so has, 8 or more words from both its ends,
places where a low symbol begins; it is represented by the one whose name in
context (16 words) is least, and equal windows choose the same place.

High symbols are what further rounds make of low ones, runs of any length
included, up to one symbol for a stretch.  Those of 35 words or more are
repeats as they stand.

Three Spark rounds exchange symbols between all documents:

1. the low symbols in context that represent windows, about one for ten words:
   windows whose symbol occurs once are done with, and what the others cover
   are the stretches that go on,
2. high symbols of these stretches, each with 128 bits that depend on its
   words: those that occur again reveal and verify repeats of any length, and
   the first occurrence of each is its owner,
3. 128 bits for each window that isn't inside an occurrence of a shared high
   symbol other than the owner: windows across the bounds of symbols, and each
   window of a long repeat once.  Of all equal windows the first is always
   among them, so no repeat is missed.

Texts are read once and kept in the shared folder in chunks (words of the
chunk, then codes).  A name goes out once for a chunk, in sorted lists dealt
by the name's leading bits, and a bit for every name comes back, so a passage
that a third of all documents share costs one name a chunk.  A list's receiver
sorts the names of about ``LIST_BYTES`` of text.  A task's attempt writes a
file of its own, and chunks are known by it.

Null and empty texts have no words.  Rows with the same id, or without one,
are documents of their own.  A document is worked on whole; a chunk holds at
least one.  A kept column with the name of a result is replaced by it.
"""

from __future__ import annotations

from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BLOCK_BYTES, dropped, new_file, open_file, scratch_path, stored, text_blocks

SPAN = 8
U = np.uint64
#: Bytes of text whose names one receiver compares.
LIST_BYTES = 32 << 20
#: Bytes of text of a chunk.
CHUNK_BYTES = BLOCK_BYTES
#: Bytes of text whose chunks one task takes up again; the masks that call for
#: them are so small that Spark would put them all in one task by their size.
TASK_BYTES = 16 << 20
#: Rounds after which a stretch that is still no single symbol is left as it is.
ROUNDS = 64
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # bases of the two hashes of a window


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _joined(symbols: np.ndarray, at: np.ndarray, left: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each symbol in ``left`` and the one after it by the name given."""
    symbols = symbols.copy()
    symbols[left] = names
    stay = np.ones(len(symbols), bool)
    stay[left + 1] = False
    return symbols[stay], at[stay]


def name_runs(symbols: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name the runs of exactly two equal symbols."""
    same = np.zeros(len(symbols) + 1, bool)  # whether symbol i equals the one before it
    same[1:-1] = (symbols[1:] == symbols[:-1]) & ~first[at[1:]]
    left = np.flatnonzero(same[1:-1] & ~same[:-2] & ~same[2:]) if len(symbols) > 1 else np.zeros(0, np.int64)
    return _joined(symbols, at, left, mix(symbols[left] + U(0x632BE59BD9B4E019)))


def name_pairs(symbols: np.ndarray, at: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Name the pairs whose left symbol is in one half of the alphabet and whose right one is in the other."""
    half = mix(symbols + U(level * 0xA0761D6478BD642F % 2**64)) >> U(63) == 1
    left = np.flatnonzero(~half[:-1] & half[1:] & ~first[at[1:]])
    return _joined(symbols, at, left, mix(symbols[left] * U(0x2545F4914F6CDD1D) + mix(symbols[left + 1])))


def low_symbols(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after the rounds of bounded reach, and where each begins."""
    symbols, at = name_runs(words, np.arange(len(words)), first)
    for level in (1, 2):
        symbols, at = name_pairs(symbols, at, first, level)
    return symbols, at


def high_symbols(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, fresh: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, start and end of all symbols of ``size`` words or more that further
    rounds form; ``fresh`` marks symbols that aren't joined to the one before."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(3, 3 + ROUNDS):
        if not len(symbols) or fresh.all():
            break
        new = np.ones(len(symbols), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | fresh[1:]
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(symbols)))
        names = np.where(count > 1, mix(symbols[heads] + mix(count.astype(U) * U(0x9FB21C651E98DF25))), symbols[heads])
        symbols, start, end, fresh = names, start[heads], end[heads + count - 1], fresh[heads]
        formed = count > 1
        half = mix(symbols + U(level * 0xA0761D6478BD642F % 2**64)) >> U(63) == 1
        left = np.flatnonzero(~half[:-1] & half[1:] & ~fresh[1:])
        long = formed & (end - start >= size)
        found.append((symbols[long], start[long], end[long]))
        stay = np.ones(len(symbols), bool)
        stay[left + 1] = False
        symbols, end = symbols.copy(), end.copy()
        symbols[left], end[left] = mix(symbols[left] * U(0x2545F4914F6CDD1D) + mix(symbols[left + 1])), end[left + 1]
        long = left[end[left] - start[left] >= size]
        found.append((symbols[long], start[long], end[long]))
        symbols, start, end, fresh = symbols[stay], start[stay], end[stay], fresh[stay]
    none = (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(none, *found))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


class Chunk:
    """Documents of a chunk as one array of word codes."""

    def __init__(self, vocabulary: list[bytes], codes: np.ndarray, lengths: np.ndarray, size: int):
        self.vocabulary, self.codes, self.lengths, self.size = vocabulary, codes, lengths, size
        self.n = len(codes)
        self.begins = np.cumsum(lengths) - lengths
        self.first = np.zeros(self.n, bool)
        self.first[self.begins[self.lengths > 0]] = True
        names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, vocabulary)), "<u8").reshape(-1, 2).astype(U)
        self.sums, self.undo = [], []
        with np.errstate(over="ignore"):
            for k, base in enumerate(ODD):
                words = mix(names[:, k])[codes] if self.n else np.zeros(0, U)
                if not k:
                    self.words = words
                self.sums.append(np.concatenate([np.zeros(1, U), np.cumsum(words * np.cumprod(np.full(self.n, base, U)), dtype=U)]))
                self.undo.append(np.cumprod(np.full(self.n, pow(base, -1, 2**64), U)))

    def hashes(self, starts: np.ndarray, size: int | np.ndarray, family: int) -> np.ndarray:
        """A hash of the ``size`` words from each start on."""
        with np.errstate(over="ignore"):
            s = self.sums[family]
            return mix((s[starts + size] - s[starts]) * self.undo[family][starts])

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The starts of all windows, and the place of the low symbol that represents each."""
        size, none = self.size, np.zeros(0, np.int64)
        self.low = none.astype(U), none
        if self.n < size:
            return none, none
        ends = np.repeat(self.begins + self.lengths, self.lengths)
        starts = np.flatnonzero(np.arange(self.n) + size <= ends)
        if not len(starts):
            return none, none
        with np.errstate(over="ignore"):
            self.low = low_symbols(self.words, self.first)
        at = self.low[1]
        at = at[(at >= SPAN) & (at + SPAN <= self.n)]
        bits = U(max(1, int(self.n).bit_length()))
        order = np.full(self.n + size, np.iinfo(np.uint64).max, np.uint64)
        order[at] = (self.hashes(at - SPAN, 2 * SPAN, 0) >> bits << bits) | at.astype(np.uint64)
        least, span, width = order[SPAN:], 1, size - 2 * SPAN + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        return starts, (least[starts] & ((U(1) << bits) - U(1))).astype(np.int64)

    def represent(self) -> "Exchange":
        """What round 1 exchanges."""
        self.starts, place = self.places()
        places, self.row = np.unique(place, return_inverse=True)
        return Exchange([self.hashes(places - SPAN, 2 * SPAN, 0) if len(places) else np.zeros(0, U)])

    def reveal(self, shared: np.ndarray) -> "Exchange":
        """What round 2 exchanges, given which of round 1's names are shared."""
        self.alive = self.starts[shared[self.row]]
        going = covered(self.n, self.alive, self.alive + self.size)
        symbols, start = self.low
        end = np.append(start[1:], self.n)[: len(start)]
        kept = np.cumsum(np.append(0, going))
        whole = kept[end] - kept[start] == end - start  # all of its words go on
        fresh = self.first[start] | ~np.append(False, whole[:-1])[: len(start)]
        with np.errstate(over="ignore"):
            names, self.start, self.end = high_symbols(symbols[whole], start[whole], end[whole], fresh[whole], self.size)
        return Exchange([names, self.hashes(self.start, self.end - self.start, 1) if len(names) else names], self.start)

    def compare(self, exchange: "Exchange", shared: np.ndarray, owned: np.ndarray) -> "Exchange":
        """What round 3 exchanges, given which of round 2's names are shared, and of which the owner is here."""
        start, end = self.start[shared], self.end[shared] - self.size + 1
        self.known = covered(self.n, start, end)
        away = ~(owned & exchange.earliest)[shared]
        elsewhere = covered(self.n, start[away], end[away])
        self.sent = self.alive[~elsewhere[self.alive]]
        return Exchange([self.hashes(self.sent, self.size, k) for k in (0, 1)] if len(self.sent) else [np.zeros(0, U)] * 2)

    def repeated(self, shared: np.ndarray) -> np.ndarray:
        """The words in windows that occur elsewhere, given which of round 3's names are shared."""
        starts = np.concatenate([np.flatnonzero(self.known), self.sent[shared]])
        return covered(self.n, starts, starts + self.size)

    def text_parts(self) -> np.ndarray:
        return np.array(self.vocabulary, object)


def pack(texts: list[str | None], size: int) -> tuple[Chunk, bytes]:
    """The chunk of some texts, and its bytes."""
    codes_of: dict[bytes, int] = {}
    code = codes_of.setdefault
    docs = [(t or "").encode().split() for t in texts]
    codes = np.array([code(w, len(codes_of)) for words in docs for w in words], np.uint32)
    lengths = np.array([len(words) for words in docs], np.int64)
    vocabulary = list(codes_of)
    words = b" ".join(vocabulary)
    data = b"".join([np.array([len(words), len(codes), len(lengths)], "<i8").tobytes(), lengths.astype("<i8").tobytes(), words, codes.astype("<u4").tobytes()])
    return Chunk(vocabulary, codes.astype(np.int64), lengths, size), zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes, size: int) -> Chunk:
    data = zstandard.ZstdDecompressor().decompress(data)
    n_bytes, n, docs = np.frombuffer(data, "<i8", 3).tolist()
    lengths = np.frombuffer(data, "<i8", docs, 24)
    at = 24 + 8 * docs
    return Chunk(data[at : at + n_bytes].split(b" ") if n_bytes else [], np.frombuffer(data, "<u4", n, at + n_bytes).astype(np.int64), lengths, size)


class ChunkFile:
    """The chunks of a task's attempt: parts, then their ends, then how many."""

    @staticmethod
    def read(uri: str, k: int) -> bytes:
        with open_file(uri) as f:
            f.seek(f.size() - 8)
            n = int(np.frombuffer(f.read(8), "<i8")[0])
            f.seek(f.size() - 8 - 8 * n)
            ends = np.concatenate([[0], np.frombuffer(f.read(8 * n), "<i8")])
            f.seek(int(ends[k]))
            return f.read(int(ends[k + 1] - ends[k]))


LIST_SCHEMA = "list int, chunk long, n long, names binary, often binary"
MASK_SCHEMA = "list int, chunk long, phase int, n long, mask binary, own binary"


class Exchange:
    """Names of one round in a chunk, sorted, each once; answers come back for these."""

    def __init__(self, columns: list[np.ndarray], at: np.ndarray | None = None):
        self.order, self.group, self.columns, self.sizes = distinct(columns, at)
        self.earliest = np.zeros(len(self.order), bool)  # whether a row is the first of its name in the chunk
        self.earliest[self.order] = np.diff(self.group, prepend=-1) > 0

    def rows(self, answer: np.ndarray) -> np.ndarray:
        """An answer for each name as one for each row."""
        out = np.zeros(len(self.order), bool)
        out[self.order] = answer[self.group]
        return out

    def lists(self, chunk: int, bits: int, mark: bool = False) -> pa.RecordBatch:
        """The names cut by their leading bits; with ``mark`` a chunk without names sends an empty list -1."""
        names = self.columns[0]
        cuts = np.searchsorted(names >> U(64 - bits) if bits else np.zeros(len(names), U), np.arange((1 << bits) + 1).astype(U))
        rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
        if mark and not rows:
            rows = [(-1, 0, 0)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in rows], pa.int32()),
                pa.array([chunk] * len(rows), pa.int64()),
                pa.array([b - a for _, a, b in rows], pa.int64()),
                pa.array([b"".join(c[a:b].tobytes() for c in self.columns) for _, a, b in rows], pa.binary()),
                pa.array([np.packbits(self.sizes[a:b] > 1).tobytes() for _, a, b in rows], pa.binary()),
            ],
            names=["list", "chunk", "n", "names", "often"],
        )


def distinct(columns: list[np.ndarray], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Sort rows of equal columns, by ``at`` within them: the order, the group of each sorted row, the columns of each group, and its size."""
    keys = columns if at is None else [*columns, at]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    held = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in held], axis=0)
    group = np.cumsum(new) - 1
    return order, group, [c[new] for c in held], np.bincount(group, minlength=int(new.sum()))


def shared(lists: DataFrame, width: int, phase: int) -> DataFrame:
    """For every list of names, a bit for each name: whether it occurs in another
    list or was often in its own; and one whether this chunk is its owner, the
    first of all that have it."""

    def run(key, table):
        sizes = table.column("n").to_pylist()
        held = [np.frombuffer(x, "<u8").reshape(width, -1) for x in table.column("names").to_pylist()]
        columns = [np.concatenate([x[j] for x in held]) for j in range(width)]
        often = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("often").to_pylist(), sizes)])
        chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
        order, group, _, count = distinct(columns, chunk)
        found, own = np.zeros(len(order), bool), np.zeros(len(order), bool)
        found[order] = (count[group] > 1) | (np.bincount(group, often[order], minlength=len(count))[group] > 0)
        own[order] = np.diff(group, prepend=-1) > 0
        ends = np.cumsum(sizes)
        masks = [[np.packbits(x[e - n : e]).tobytes() for n, e in zip(sizes, ends.tolist())] for x in (found, own)]
        return pa.table({"list": table.column("list"), "chunk": table.column("chunk"), "phase": pa.array([phase] * len(sizes), pa.int32()), "n": table.column("n"), "mask": pa.array(masks[0], pa.binary()), "own": pa.array(masks[1], pa.binary())})

    return lists.groupBy("list").applyInArrow(run, MASK_SCHEMA)


def answers(table: pa.Table, phase: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each name of a round in a chunk is shared, and whether the chunk owns it."""
    rows = sorted((r["list"], r["n"], r["mask"], r["own"]) for r in table.to_pylist() if r["phase"] == phase)
    bits = [[np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r[k], np.uint8), count=r[1]).astype(bool) for r in rows)] for k in (2, 3)]
    return np.concatenate(bits[0]), np.concatenate(bits[1])


def replayed(chunk: Chunk, table: pa.Table, rounds: int) -> Exchange:
    """What the round after ``rounds`` answered ones exchanges; the chunk is left as it then is."""
    out = chunk.represent()
    if rounds > 0:
        out = chunk.reveal(out.rows(answers(table, 1)[0]))
    if rounds > 1:
        found, own = answers(table, 2)
        out = chunk.compare(out, out.rows(found), out.rows(own))
    return out


def substring_dedup(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 35) -> DataFrame:
    """Remove every word in a window of ``size`` words that also starts anywhere else.

    Returns the ``keep`` columns (but for those with a result's name) with
    n_words, n_removed and kept_text, the words that stay joined by one blank.  Windows are judged on the input.
    ``size`` is 24 at least: below that a window may have no symbol inside.
    """
    if size < 3 * SPAN:
        raise ValueError(f"a window has {3 * SPAN} words at least")
    spark, new = df.sparkSession, StructType.fromDDL("n_words long, n_removed long, kept_text string")
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    bits = max(0, (total // LIST_BYTES).bit_length())
    tasks, chunk_bytes = max(spark.sparkContext.defaultParallelism, total // TASK_BYTES), CHUNK_BYTES
    folder = scratch_path(spark, "chunks")
    held = df.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep if c not in new.names])
    kept_schema = StructType([f for f in held.schema.fields if f.name != "__text"])

    def uri_of(chunk: int) -> tuple[str, int]:
        return f"{folder}/part-{chunk >> 24}", 2 * (chunk & 0xFFFFFF)

    def send(batches):
        begin, n, ends, out = TaskContext.get().taskAttemptId() << 24, 0, [0], None
        with ExitStack() as stack:
            for batch in text_blocks(batches, "__text", chunk_bytes):
                chunk, data = pack(batch.column("__text").to_pylist(), size)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.drop_columns(["__text"]).schema) as ids:
                    ids.write_batch(batch.drop_columns(["__text"]))
                out = out or stack.enter_context(new_file(uri_of(begin)[0]))
                for part in (data, sink.getvalue().to_pybytes()):
                    out.write(part)
                    ends.append(ends[-1] + len(part))
                yield chunk.represent().lists(begin | n, bits, True)
                n += 1
            if out is not None:
                out.write(np.array([*ends[1:], len(ends) - 1], "<i8").tobytes())

    def go_on(rounds: int):
        def run(key, table):
            uri, k = uri_of(key[0].as_py())
            return pa.Table.from_batches([replayed(unpack(ChunkFile.read(uri, k), size), table, rounds).lists(key[0].as_py(), bits)])

        return run

    def finish(key, table):
        uri, k = uri_of(key[0].as_py())
        chunk = unpack(ChunkFile.read(uri, k), size)
        last = replayed(chunk, table, 2)
        gone = chunk.repeated(last.rows(answers(table, 3)[0]))
        parts, kept, removed = chunk.text_parts(), [], []
        for a, n in zip(chunk.begins.tolist(), chunk.lengths.tolist()):
            out = gone[a : a + n]
            codes = chunk.codes[a : a + n]
            removed.append(int(out.sum()))
            kept.append(b" ".join(parts[codes[~out] if removed[-1] else codes].tolist()).decode() if n else "")
        ids = pa.ipc.open_stream(ChunkFile.read(uri, k + 1)).read_all()
        return pa.table([*ids.columns, pa.array(chunk.lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*ids.column_names, *new.names])

    def by_chunk(masks: DataFrame, run, schema) -> DataFrame:
        return masks.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(run, schema)

    lists = stored(held.mapInArrow(send, LIST_SCHEMA), "names")
    masks = stored(shared(lists, 1, 1), "masks")
    for rounds in (1, 2):
        dropped(lists)
        lists, before = stored(by_chunk(masks, go_on(rounds), LIST_SCHEMA), "names"), masks
        masks = stored(before.unionByName(shared(lists, 2, rounds + 1)), "masks")
        dropped(before)
    dropped(lists)
    return by_chunk(masks, finish, StructType([*kept_schema.fields, *new.fields]))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), wins AS (
  SELECT r, i, array_to_string(words[i:i + 34], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35)
), again AS (
  SELECT r, i FROM wins WHERE win IN (SELECT win FROM wins GROUP BY win HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS w FROM again
), each_word AS (
  SELECT r, unnest(range(1, len(words) + 1)) AS w, unnest(words) AS word FROM docs
), kept AS (
  SELECT e.r, count(*) AS n, string_agg(word, ' ' ORDER BY e.w) AS line FROM each_word e ANTI JOIN gone g ON e.r = g.r AND e.w = g.w GROUP BY e.r
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
