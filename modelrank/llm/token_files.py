"""Token ids in files of independent zstandard frames with a seek table.

Documents are dealt by range of their id, sorted, encoded and written, one
file for each range, so files in order of name hold documents in order of id.

A file is a run of frames that any zstandard reader takes as one stream:

* data frames: count of documents (uint32), then for each whether it has an
  id (uint8), its id (int64) and its number of token ids (uint64), then all
  token ids (uint32); everything little-endian,
* a skippable frame, the directory: for each data frame the number of
  documents, how many of them have no id, the first id, the last id (int64)
  and the number of token ids,
* a skippable frame, the seek table of the seekable format: compressed size,
  decompressed size and a checksum (low half of XXH64) for each frame before
  it, then the count, a descriptor and the format's closing number.

``TokenFile.document`` decompresses only frames whose ids may match.  A null
text is empty; a null id sorts first, so frames without any id come before
all others and are asked for by ``document(None)`` alone; equal ids follow
each other in order of their text.  Frames go out as they fill up.  Each
attempt of a task writes a file of its own, and ``files.json``, written last,
lists those that count.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt, new_file, open_file, scratch_path, text_blocks
from .pieces import SPACED, UNCOMMON

END_ID = 2
FRAME_TOKENS = 1 << 16
DIRECTORY_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
DIRECTORY = np.dtype([("docs", "<i8"), ("nulls", "<i8"), ("first", "<i8"), ("last", "<i8"), ("tokens", "<i8")])
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
#: Pieces that a worker remembers before it forgets those met only once.
MEMO = 600_000
#: New pieces that the library gets in one text.
TOGETHER = 1000


class Encoder:
    """Whole texts to ids.

    The tokenizer cuts a text in pieces that don't influence each other, and
    the library encodes each distinct piece once, as long as the worker
    remembers it.  Texts with a special token's string, or with characters
    whose class may differ between versions of Unicode, go to the library
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.again: set[str] = set()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """A blank and letters are a piece whatever stands before or after, if that
        is another such piece; many of them make one text."""
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        for a in range(0, len(words), 20 * TOGETHER):
            groups = [words[i : i + TOGETHER] for i in range(a, min(a + 20 * TOGETHER, len(words)), TOGETHER)]
            for group, e in zip(groups, self.library.encode_batch(["".join(g) for g in groups], add_special_tokens=False)):
                ids, of = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
                cuts = np.flatnonzero(np.diff(of, prepend=-1)) * 4
                ends = [*cuts[1:].tolist(), len(ids)]
                assert len(ends) == len(group)
                self.memo.update((p, ids[i:j]) for p, i, j in zip(group, cuts.tolist(), ends))
        rest = [p for p in new if p not in self.memo]
        self.memo.update(zip(rest, self._whole(rest)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        cut = [None if UNCOMMON.search(t) or any(s in t for s in self.special) else SPACED.findall(t) for t in texts]
        distinct: set[str] = set().union(*filter(None, cut))
        if len(self.memo) + len(distinct) > MEMO:
            self.memo = {p: self.memo[p] for p in self.again if p in self.memo} if len(self.again) < MEMO // 2 else {}
            self.again = set()
        new = [p for p in distinct if p not in self.memo]
        self.again.update(distinct.difference(new))
        self._learn(new)
        get = self.memo.__getitem__
        return [self._whole([t])[0] if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def frame(ids: list[int | None], tokens: list[bytes]) -> bytes:
    valid = np.array([i is not None for i in ids], np.uint8)
    return b"".join([np.uint32(len(ids)).tobytes(), valid.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([len(t) // 4 for t in tokens], "<u8").tobytes(), *tokens])


def unframe(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    at = 4
    valid = np.frombuffer(data, np.uint8, n, at)
    ids = np.frombuffer(data, "<i8", n, at + n)
    lengths = np.frombuffer(data, "<u8", n, at + 9 * n)
    at += 17 * n
    for v, i, length in zip(valid.tolist(), ids.tolist(), lengths.tolist()):
        yield (i if v else None), np.frombuffer(data, "<u4", length, at)
        at += 4 * length


class FileWriter:
    """Takes documents in order of their id and writes frames to a stream."""

    def __init__(self, out) -> None:
        self.out = out
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.directory: list[tuple[int, int, int, int, int]] = []
        self.ids: list[int | None] = []
        self.tokens: list[bytes] = []
        self.size = self.docs = self.total = 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.size += len(tokens) // 4
        if self.size >= FRAME_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.ids:
            return
        data = frame(self.ids, self.tokens)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        known = [i for i in self.ids if i is not None]
        self.directory.append((len(self.ids), len(self.ids) - len(known), *((known[0], known[-1]) if known else (0, 0)), self.size))
        self.docs += len(self.ids)
        self.total += self.size
        self.ids, self.tokens, self.size = [], [], 0

    def finish(self) -> None:
        self.flush()
        directory = np.array(self.directory, DIRECTORY).tobytes()
        directory = np.array([DIRECTORY_MAGIC, len(directory)], "<u4").tobytes() + directory
        entries = np.array([*self.entries, (len(directory), 0, 0)], ENTRY)
        table = entries.tobytes() + np.uint32(len(entries)).tobytes() + b"\x80" + np.uint32(SEEKABLE).tobytes()
        for part in (directory, np.array([SEEK_MAGIC, len(table)], "<u4").tobytes(), table):
            self.out.write(part)


class TokenFile:
    """Reads a file by its seek table."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        size = self.file.size()
        tail = self._at(size - 9, 9)
        count, magic = int(np.frombuffer(tail, "<u4", 1)[0]), int(np.frombuffer(tail, "<u4", 1, 5)[0])
        if magic != SEEKABLE or tail[4] != 0x80:
            raise ValueError(f"{uri} has no seek table")
        self.entries = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), ENTRY)
        self.begins = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.directory = np.frombuffer(self._at(int(self.begins[-2]) + 8, int(self.entries["packed"][-1]) - 8), DIRECTORY)
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        data = self.unpacker.decompress(self._at(int(self.begins[k]), int(self.entries["packed"][k])), max_output_size=int(self.entries["plain"][k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.entries["check"][k]):
            raise ValueError(f"frame {k} is damaged")
        return list(unframe(data))

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.directory)):
            yield from self.frame(k)

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that id; only frames that may hold it are read."""
        named = int(np.count_nonzero(self.directory["nulls"] == self.directory["docs"]))  # the first frame with an id
        if doc_id is None:
            rows = range(int(np.count_nonzero(self.directory["nulls"])))
        else:
            first = named + int(np.searchsorted(self.directory["last"][named:], doc_id))
            rows = range(first, named + int(np.searchsorted(self.directory["first"][named:], doc_id, "right")))
        return [ids for k in rows for i, ids in self.frame(k) if i == doc_id]

    def close(self) -> None:
        self.file.close()


def write_tokens(df: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Encode every text and write the files; (path, documents, token ids) of each, in order.

    ``key`` is an integer column.  What the driver gets is a row for each file.
    """
    held = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    held = held.withColumn("h", F.xxhash64("t"))
    dealt = held.repartitionByRange(max(1, df.rdd.getNumPartitions()), "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    end = np.uint32(end_id).tobytes()

    def run(batches):
        part, out, work, uri = TaskContext.get().partitionId(), None, encoder(tokenizer), ""
        with ExitStack() as stack:
            for batch in text_blocks(batches, "t"):
                if out is None:
                    uri = f"{folder}/tokens-{part:06d}-{attempt()}.zst"
                    out = FileWriter(stack.enter_context(new_file(uri)))
                for i, ids in zip(batch.column("k").to_pylist(), work.encode(batch.column("t").to_pylist())):
                    out.add(i, ids + end)
            if out is not None:
                out.finish()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), pa.array([out.docs], pa.int64()), pa.array([out.total], pa.int64())], names=["part", "uri", "docs", "tokens"])

    rows = dealt.mapInArrow(run, "part long, uri string, docs long, tokens long").collect()
    files = [(r.uri, r.docs, r.tokens) for r in sorted(rows)]
    with new_file(f"{folder}/files.json") as out:
        out.write(json.dumps([{"uri": u, "docs": d, "tokens": t} for u, d, t in files]).encode())
    return files


def files_of(folder: str) -> list[tuple[str, int, int]]:
    """What write_tokens wrote to a folder."""
    with open_file(f"{folder}/files.json") as f:
        return [(x["uri"], x["docs"], x["tokens"]) for x in json.loads(f.read())]


def read_tokens(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    rows, start = [], 0
    for uri, _, tokens in files:
        rows.append((uri, start))
        start += tokens

    def run(batches):
        for batch in batches:
            for uri, at in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                ids, starts, lengths, checks = [], [], [], []
                held = TokenFile(uri)
                for doc_id, tokens in held:
                    ids.append(doc_id)
                    starts.append(at)
                    lengths.append(len(tokens))
                    checks.append(zlib.crc32(tokens.tobytes()))
                    at += len(tokens)
                held.close()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, checks)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(rows, "uri string, start long").repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(spark, write_tokens(docs, scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")))
