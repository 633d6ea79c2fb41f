"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the whole corpus are counted, and the most frequent (up to
``LEXICON_WORDS``) are compiled, with their token ids, into an automaton
whose states share suffixes: a word's place in order of all words falls out
of the walk (each edge knows how many words come before those behind it), and
that place finds its ids.  The automaton is one file in the shared folder,
mapped by every worker and walked for many words at a time in numpy.  Words
that it doesn't have are merged exactly, pair by pair in order of rank.

The file of the tokenizer (vocabulary, merges, word-end suffix) is a
parameter.  A null text is empty: no ids, empty decoded text.  Strings of
special tokens in a text become those tokens, as in the library.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collector_paused, dropped, map_text, open_file, put_file, scratch_path, stored, text_blocks
from .pieces import BARE, UNCOMMON

LEXICON_WORDS = 100_000
#: Stretches, and words, whose ids a worker remembers before it forgets those met only once.
MEMO = 250_000
NONE = 1 << 60
NO_RANK = (1 << 31) - 1
#: Words of up to this many bytes are merged many at a time, this many of them.
WIDEST, ROWS = 64, 16_384
#: Fixed value: the words of the tokenizer's pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, else the next code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Merger:
    """Vocabulary and merges; ``merge`` gives the ids of a word's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        end = model["end_of_word_suffix"] or ""
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], object)
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[vocab[a] << 24 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        # the same for many words at once: sorted pairs, and ranks of pairs of single bytes by place
        self.pairs = np.array([*sorted(self.ranks), NONE], np.int64)
        self.pair_ranks = np.array([*map(self.ranks.__getitem__, self.pairs[:-1].tolist()), NO_RANK], np.int32)
        self.made_ids = np.array([*self.made, 0], np.int32)
        self.single = np.array([self.inner, self.last], np.int32)  # inside a word, at its end
        first = self.single[0].astype(np.int64)[:, None] << 24
        self.first_ranks = np.stack([self._ranks(first | ids[None, :]) for ids in self.single])

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers: as ``merge``, one
        merge in every word of about the same length at a time."""
        out = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w)
            if n > WIDEST:
                ids = self.merge(w)
                out[i] = pack(f"<{len(ids)}i", *ids)
            elif n:
                groups.setdefault(-(-n // 4) * 4, []).append(i)
        for width, held in groups.items():
            for at in range(0, len(held), ROWS):
                self._merge_group(words, held[at : at + ROWS], width, out)
        return out

    def _merge_group(self, words: list[bytes], held: list[int], width: int, out: list[bytes]) -> None:
        rows = np.array(held)
        data = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in held]), np.uint8).reshape(-1, width)
        lengths = np.fromiter((len(words[i]) for i in held), np.int64, len(held))[:, None]
        ends = (np.arange(width) == lengths - 1).astype(np.intp)
        ids = np.where(np.arange(width) < lengths, self.single[ends, data], -1)
        ranks = np.where(np.arange(1, width) < lengths, self.first_ranks[ends[:, 1:], data[:, :-1], data[:, 1:]], NO_RANK)
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.intp)
            rank = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            more = rank < NO_RANK
            if not more.all():
                done = ids[~more]
                there = done >= 0
                flat, ends = done[there].astype("<i4").tobytes(), (4 * np.cumsum(there.sum(1))).tolist()
                for i, a, b in zip(rows[~more].tolist(), [0, *ends], ends):
                    out[i] = flat[a:b]
                rows, ids, ranks, best, rank = rows[more], ids[more], ranks[more], best[more], rank[more]
            if not len(rows):
                return
            n, each = len(rows), np.arange(len(rows))
            ids[each, best] = self.made_ids[rank]
            left = np.ones(ids.shape, bool)
            left[each, best + 1] = False
            ids = ids[left].reshape(n, -1)
            ranks = ranks[left[:, 1:]].reshape(n, -1)
            for i, here in ((best - 1, best > 0), (best, best < ranks.shape[1])):
                r, i = each[here], i[here]
                ranks[r, i] = self._ranks(ids[r, i].astype(np.int64) << 24 | ids[r, i + 1])

    def merge(self, word: bytes) -> list[int]:
        inner, get, made = self.inner, self.ranks.get, self.made
        ids = [inner[c] for c in word[:-1]]
        ids.append(self.last[word[-1]])
        if len(ids) > 256:
            return self._merge_long(ids)
        ranks = [get(a << 24 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 24 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in order n log n: a heap of pairs over a linked list."""
        n, get, made = len(ids), self.ranks.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 24 | ids[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(ids[x] << 24 | ids[y], NONE)) < NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def lowered(text: str) -> str:
    """NFC and lower case, code point by code point (no rule looks at neighbours)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def cut(text: str, special: re.Pattern) -> list[str]:
    """Stretches of a text whose words don't depend on what stands around: those
    between blanks, or words where a character is uncommon.  A special token's
    string stands for itself, marked by a leading blank."""
    out: list[str] = []
    for i, part in enumerate(special.split(text) if special.search(text) else [text]):
        if i % 2:
            out.append(" " + part)
        else:
            part = lowered(part)
            out += WORDS.findall(part) if UNCOMMON.search(part) else part.split()
    return out


def words_in(stretch: str) -> list[str]:
    if stretch.isascii() and stretch.isalpha():
        return [stretch]
    return WORDS.findall(stretch) if UNCOMMON.search(stretch) else BARE.findall(stretch)


def special_pattern(special: dict[str, int]) -> re.Pattern:
    return re.compile("(" + ("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)") + ")")


def compile_lexicon(words: dict[bytes, list[int]]) -> list[bytes]:
    """The automaton's file: header, final flags, edge keys (state * 256 + byte),
    targets, words before each edge, then offsets and ids by place of the word."""
    known: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        at = known.get(key)
        if at is None:
            at = known[key] = len(finals)
            finals.append(state[0])
            edges.append(key[1])
        return at

    path: list[list] = [[False, []]]  # states of the word before that may still grow: final flag, settled edges
    old = b""
    for word in [*sorted(words), None]:
        same = 0
        if word is not None:
            while same < min(len(old), len(word)) and old[same] == word[same]:
                same += 1
        for i in range(len(old), same, -1):
            done = settle(path.pop())
            path[-1][1].append((old[i - 1], done))
        if word is None:
            break
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        old = word
    start = settle(path[0])
    below = [0] * len(finals)  # words accepted from a state on; states are settled after those they lead to
    keys, targets, skips = [], [], []
    for state, (final, out) in enumerate(zip(finals, edges)):
        n = int(final)
        for byte, to in out:
            keys.append(state << 8 | byte)
            targets.append(to)
            skips.append(n)
            n += below[to]
        below[state] = n
    ids = [words[w] for w in sorted(words)]
    offsets = np.cumsum([0, *map(len, ids)])
    head = [start, len(finals), len(keys), len(ids), int(offsets[-1])]
    flat = [x for one in ids for x in one]
    return [np.array(x, "<i8").tobytes() for x in (head, finals, keys, targets, skips, offsets, flat)]


class Lexicon:
    """The mapped automaton."""

    def __init__(self, uri: str):
        with open_file(uri) as f:
            data = np.frombuffer(f.read_buffer(), "<i8")
        self.start, states, edges, words, total = data[:5].tolist()
        at, held = 5, []
        for size in (states, edges, edges, edges, words + 1, total):
            held.append(data[at : at + size])
            at += size
        self.finals, self.keys, self.targets, self.skips, self.offsets, self.ids = held

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the lexicon's, -1 for others."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths) - lengths
        rows, state, place, depth = np.arange(len(words)), np.full(len(words), self.start), np.zeros(len(words), np.int64), 0
        while len(rows):
            ended = lengths[rows] == depth
            accepted = ended & (self.finals[state] == 1)
            out[rows[accepted]] = place[accepted]
            rows, state, place = rows[~ended], state[~ended], place[~ended]
            key = state << 8 | data[begins[rows] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            rows, edge = rows[there], edge[there]
            state, place = self.targets[edge], place[there] + self.skips[edge]
            depth += 1
        return out


@lru_cache(maxsize=1)
def lexicon(uri: str) -> Lexicon:
    return Lexicon(uri)


class Coder:
    """Texts to ids, through memory, lexicon and merges in this order."""

    def __init__(self, path: str, uri: str):
        self.merger, self.lexicon = merger(path), lexicon(uri)
        self.held = self.lexicon.ids.astype("<i4").tobytes()  # LEXICON_WORDS words' ids, converted once
        self.special = special_pattern(self.merger.special)
        self.words: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.again: set[str] = set()

    def _look_up(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        held, places = self.held, self.lexicon.places(coded)
        known = np.flatnonzero(places >= 0)
        begins, ends = (4 * self.lexicon.offsets[places[known]]).tolist(), (4 * self.lexicon.offsets[places[known] + 1]).tolist()
        self.words.update((words[i], held[a:b]) for i, a, b in zip(known.tolist(), begins, ends))
        others = np.flatnonzero(places < 0).tolist()
        self.words.update(zip([words[i] for i in others], self.merger.merge_all([coded[i] for i in others])))

    def _learn(self, stretches: list[str]) -> None:
        alone, others = [], []
        for s in stretches:
            if s.isascii() and s.isalpha():
                alone.append(s)
            elif s[0] == " ":
                self.memo[s] = pack("<i", self.merger.special[s[1:]])
            else:
                others.append((s, words_in(s)))
        if len(self.words) > MEMO:
            self.words = {}
        new = {w for w in alone if w not in self.words}
        new.update(w for _, held in others for w in held if w not in self.words)
        self._look_up(list(new))
        get = self.words.__getitem__
        self.memo.update(zip(alone, map(get, alone)))
        self.memo.update((s, b"".join(map(get, held))) for s, held in others)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        with collector_paused():
            return self._encode(texts)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        docs = [cut(t or "", self.special) for t in texts]
        distinct: set[str] = set().union(*docs)
        if len(self.memo) + len(distinct) > MEMO:
            self.memo = {s: self.memo[s] for s in self.again if s in self.memo} if len(self.again) < MEMO // 2 else {}
            self.again = set()
        new = [s for s in distinct if s not in self.memo]
        self.again.update(distinct.difference(new))
        self._learn(new)
        get = self.memo.__getitem__
        return [b"".join(map(get, held)) for held in docs]


@lru_cache(maxsize=1)  # what another corpus left in a worker's memory goes
def coder(path: str, uri: str) -> Coder:
    return Coder(path, uri)


def word_counts(df: DataFrame, text: str, tokenizer: str) -> DataFrame:
    """(word, n) over every whole text."""

    def run(batches):
        special = special_pattern(merger(tokenizer).special)
        for batch in text_blocks(batches, "__text", 8 << 20):
            with collector_paused():
                seen: Counter = Counter()
                for t in batch.column("__text").to_pylist():
                    seen.update(cut(t or "", special))
                words: dict[str, int] = {}
                for stretch, n in seen.items():
                    if stretch[0] != " ":
                        for w in words_in(stretch):
                            words[w] = words.get(w, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    return df.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, text: str, tokenizer: str, words: int = LEXICON_WORDS) -> str:
    """The file of the most frequent words that occur twice or more, up to
    ``words`` of them: all words from some count on, by a histogram of counts
    whose bins are a 16th of a doubling wide, so the driver never gets more."""
    counts = word_counts(df, text, tokenizer).filter((F.col("n") > 1) & (F.length("word") <= 64))
    counts = stored(counts.withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "words")
    least, total = None, 0
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r.bin):
        total += r["count"]
        if total > words:
            break
        least = r.bin
    top = counts.filter(F.col("bin") >= least).select("word").collect() if least is not None else []
    coded = [r.word.encode() for r in top]
    ids = [np.frombuffer(x, "<i4").tolist() for x in merger(tokenizer).merge_all(coded)]
    uri = put_file(scratch_path(df.sparkSession, "lexicon") + "/words.bin", compile_lexicon(dict(zip(coded, ids))))
    dropped(counts)
    return uri


def bpe(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = LEXICON_WORDS) -> DataFrame:
    """Returns the ``keep`` columns with ids (array of int) and decoded, the text of decoding them."""
    uri = build_lexicon(df, text, tokenizer, words)

    def make():
        work = coder(tokenizer, uri)
        names = work.merger.names

        def run(texts):
            coded = work.encode(texts)
            flat = np.frombuffer(b"".join(coded), "<i4")
            offsets = np.cumsum([0, *(len(c) // 4 for c in coded)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            decoded = [" ".join(names[flat[a:b]].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return [ids, pa.array(decoded, pa.string())]

        return run

    return map_text(df, text, list(keep), "ids array<int>, decoded string", make)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return digests(out)


def digests(out: DataFrame) -> DataFrame:
    """The ids and decoded texts of bpe() as counts and digests."""
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
