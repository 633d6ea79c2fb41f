"""Every operator against a plain version, on awkward inputs."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from modelrank.llm import ann, bpe, components, decontaminate, language_id, line_dedup, pii, quality, simhash, substring_dedup, token_files
from modelrank.llm.common import scratch_path

BYTE_BPE, WORD_BPE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
#: Null, empty, blank, one word, repeated rows, ties, other scripts, very long.
TEXTS = [None, "", " \n\t", "one", "Same line\nother\n", "Same line\nother\n", "Ünïcode Ελληνικά 中文 text\r\nsame LINE ", "a a a a a a a a", LONG, LONG + " tail", "the cat sat on the mat " * 30, "the cat sat on the mat " * 30 + "end"]


def docs(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", 1) for i, t in enumerate(texts)]
    # extra columns have the names of results
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long").withColumns({c: F.lit(7) for c in ("fp", "n_lines", "ids", "spans", "score", "component_id", "kept_text", "items")}).repartition(3)


def none(spark):
    return docs(spark).limit(0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(grams))


def plain_components(fps, bits=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_simhash(spark):
    fps = [plain_fingerprint(t) for t in TEXTS]
    want = plain_components(fps)
    out = {r.doc_id: r for r in simhash.near_duplicates(docs(spark)).collect()}
    assert [out[i].fp % 2**64 for i in range(len(TEXTS))] == fps
    assert [out[i].component_id for i in range(len(TEXTS))] == want
    assert simhash.near_duplicates(none(spark)).count() == 0


@pytest.mark.parametrize("limit, keys, bits", [(2, 0, 2), (64, 100_000, 2), (4, 3, 1)])
def test_links_of_lists_of_any_length(spark, limit, keys, bits, monkeypatch):
    """Lists are split by one position after another and at last paired in blocks; every link is found, and no other."""
    monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
    monkeypatch.setattr(simhash, "HOT_KEYS", keys)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for base in list(fps[:8]):
        for _ in range(6):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    links = sorted((r.u % 2**64, r.v % 2**64) for r in simhash.fingerprint_links(df, bits).collect())
    assert sorted(map(sorted, links)) == [[x, y] for x in fps for y in fps if x < y and (x ^ y).bit_count() <= bits]
    if limit != 64:
        return
    found = {r.node % 2**64: r.root % 2**64 for r in components.connected_components(simhash.fingerprint_links(df)).collect()}
    want = plain_components(fps)
    groups = {}
    for x, w in zip(fps, want):
        groups.setdefault(w, set()).add(found.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_hot_lists_stay_short_enough_to_pair(spark, monkeypatch):
    """Fingerprints that share all but two bytes: no list is paired as a whole, and all links are there."""
    monkeypatch.setattr(simhash, "LIST_LIMIT", 8)
    rng = random.Random(11)
    fps = sorted({0x1234567800000000 | rng.getrandbits(16) for _ in range(500)} | {rng.getrandbits(48) << 16 for _ in range(200)})
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    met, _ = simhash.candidates(df, 2)
    assert len(met) > 2 and sum(x.count() for x in met) < 30 * len(fps) ** 2 / 2
    links = {tuple(sorted((r.u % 2**64, r.v % 2**64))) for r in simhash.fingerprint_links(df).collect()}
    assert links == {(x, y) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 2}


def test_fingerprints_of_very_long_texts(monkeypatch):
    rng = random.Random(12)
    text = " ".join(f"W{rng.randrange(3000)}" for _ in range(70_000)) + " tail"
    assert len(text.split()) > simhash.CHUNK and simhash.fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert [simhash.fingerprint(t) for t in TEXTS[:8]] == [plain_fingerprint(t) for t in TEXTS[:8]]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    out = {r.node: r.root for r in components.connected_components(links).collect()}
    assert out == dict.fromkeys(range(61), 0) | {100: 100, 101: 100} | {} or {k: v for k, v in out.items() if k != v} == dict.fromkeys(range(1, 61), 0) | {101: 100}
    assert components.connected_components(links.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    same = "alpha beta gamma delta " * 40
    ids = [None, None, 5, 5, 3, 9]
    out = simhash.drop_near_duplicates(docs(spark, ["lonely words here", "lonely words here", same, same, same.upper(), "other text entirely"], ids))
    assert sorted((r.doc_id, r.text[:5]) for r in out.fillna(-1, ["doc_id"]).collect()) == [(-1, "lonel"), (3, "ALPHA"), (9, "other")]
    assert out.columns == docs(spark).columns


# -------------------------------------------------------------- token files


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = [*TEXTS, "x<|endoftext|>y", "it's  two   blanks \n \n end　​"]
    ids = [*range(10, 10 + len(texts) - 2), 3, 3]
    files = token_files.write_tokens(docs(spark, texts, ids), scratch_path(spark, "t"), BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    want, start = [], 0
    for i, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        if i == 3 and want:
            continue
        some = [library.encode(t or "", add_special_tokens=False).ids + [2]]
        if i == 3:  # two documents of one id, in an order of their texts
            some = sorted((library.encode(t, add_special_tokens=False).ids + [2] for t in texts[-2:]), key=len)
        for x in some:
            want.append((i, x))
    got = []
    for uri, _, _ in files:
        f = token_files.TokenFile(uri)
        got += [(i, x.tolist()) for i, x in f]
        f.close()
    assert sorted(got) == sorted(want) and [i for i, _ in got] == sorted(ids)
    rows = sorted(token_files.read_tokens(spark, files).collect(), key=lambda r: r.start)
    for r, (i, x) in zip(rows, got):
        assert tuple(r) == (i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    assert len(rows) == len(texts)
    assert token_files.read_tokens(spark, token_files.write_tokens(none(spark), scratch_path(spark, "t"), BYTE_BPE)).count() == 0


def test_only_frames_that_may_hold_a_document_are_read(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME_TOKENS", 50)
    path = tmp_path / "f.zst"
    out = path.open("wb")
    w = token_files.FileWriter(out)
    for i in range(100):
        w.add(i // 2, np.arange(i, i + 7, dtype="<u4").tobytes())
    w.finish()
    out.close()
    f = token_files.TokenFile(str(path))
    read = []
    monkeypatch.setattr(token_files.TokenFile, "frame", lambda self, k, old=token_files.TokenFile.frame: read.append(k) or old(self, k))
    assert [x.tolist()[0] for x in f.document(30)] == [60, 61] and len(read) <= 2 and len(f.directory) > 5
    assert f.document(1000) == [] and f.document(-1) == []
    assert len(zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()) == int(f.entries["plain"].sum())
    broken = bytearray(path.read_bytes())
    broken[int(f.begins[1]) - 6] ^= 1
    path.write_bytes(bytes(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.TokenFile(str(path)))


def test_documents_without_an_id(tmp_path, monkeypatch):
    """Frames of null ids come first and hide no other, negative ids included."""
    monkeypatch.setattr(token_files, "FRAME_TOKENS", 3)
    for ids in ([None, None, None, -5, -5, -3, 4], [None, -5, 0, 0], [None, None], [-2, 7]):
        path = tmp_path / "f"
        with path.open("wb") as out:
            w = token_files.FileWriter(out)
            for n, i in enumerate(ids):
                w.add(i, np.array([n, n], "<u4").tobytes())
            w.finish()
        f = token_files.TokenFile(str(path))
        for i in (*ids, 99, -99, None):
            assert [x.tolist() for x in f.document(i)] == [[n, n] for n, j in enumerate(ids) if j == i], (ids, i)


def test_files_are_listed(spark):
    folder = scratch_path(spark, "t")
    files = token_files.write_tokens(docs(spark), folder, BYTE_BPE)
    assert token_files.files_of(folder) == files and sum(d for _, d, _ in files) == len(TEXTS)


ALPHABET = ["a", "b ", " ", "\n", "\t", "\r", "1", "é", "É", "!", "'s", "'", "<|endoftext|>", "<|startoftext|>", "\x85", "　", "中", "Ж", "ΑΣ", " \n", "word", "​", "\x1c", "İ", "²", "😀", "\0"]


def test_encoding_is_the_librarys():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(BYTE_BPE), token_files.Encoder(BYTE_BPE)
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 12))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


# ----------------------------------------------------------------------- BPE


def test_coding_is_the_librarys(tmp_path):
    from tokenizers import Tokenizer

    library, merger = Tokenizer.from_file(WORD_BPE), bpe.merger(WORD_BPE)
    words = ["the", "word", "wo", "é", "a", "ba"]
    from modelrank.llm.common import put_file

    uri = str(tmp_path / "lexicon")
    uri = put_file(uri, bpe.compile_lexicon({w.encode(): merger.merge(w.encode()) for w in words}))
    coder = bpe.Coder(WORD_BPE, uri)
    rng = random.Random(2)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 12))) for _ in range(4000)] + ["ab" * 700 + "the" * 30]
    got = [np.frombuffer(x, "<i4").tolist() for x in coder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for ids in got[:500]:
        assert " ".join(merger.names[ids].tolist()) == library.decode(ids, skip_special_tokens=False)


def test_lexicon_is_minimal_and_finds_its_words():
    rng = random.Random(3)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 6))): [i] for i in range(300)}
    for held in (words, {b"x": [1]}, {}):
        import tempfile

        with tempfile.NamedTemporaryFile() as f:
            f.write(b"".join(bpe.compile_lexicon(held)))
            f.flush()
            lexicon = bpe.Lexicon(f.name)
        asked = sorted(held) + [b"zzz", b"a" * 40]
        assert lexicon.places(asked).tolist() == [*range(len(held)), -1, -1]
    suffixes = {w + s: [0] for w in (b"walk", b"talk", b"jump") for s in (b"", b"s", b"ed", b"ing")}
    with tempfile.NamedTemporaryFile() as f:
        f.write(b"".join(bpe.compile_lexicon(suffixes)))
        f.flush()
        assert len(bpe.Lexicon(f.name).finals) <= 13  # endings are shared


def test_bpe_merges_many_words_as_it_merges_one():
    merger, rng = bpe.merger(WORD_BPE), random.Random(8)
    words = [bytes([b]) * n for b in range(256) for n in (1, 2, 3, 4, 5, bpe.WIDEST, bpe.WIDEST + 1)]
    words += [bytes(rng.choice(b"aabcdeehilnorst'0.\xc3\xa9\x00\xff") for _ in range(rng.randint(1, 80))) for _ in range(20_000)]
    words += words[-50:] + [b""]  # repeats, and a word without bytes
    assert [np.frombuffer(x, "<i4").tolist() for x in merger.merge_all(words)] == [merger.merge(w) if w else [] for w in words]
    assert merger.merge_all([]) == []


def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    out = {r.doc_id: r for r in bpe.bpe(docs(spark), WORD_BPE).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.bpe(none(spark), WORD_BPE).count() == 0


# ------------------------------------------------------ nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cell": F.lit(1), "score": F.lit(2)})


def plain_nearest(rows, k=5, every=50):
    held = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in held:
        if q % every == 0:
            scores = sorted((-float(x @ y / np.sqrt((x * x).sum() * (y * y).sum())), i) for i, y in held if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(600, None), (650, [0.0] * 8), (700, [float("nan")] + [1.0] * 7), (750, [float("inf")] * 8), (800, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = vectors(spark, rows)
    want = plain_nearest(rows)
    out = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(out) == set(want) and all(len(x) == 5 for x in out.values())
    found = sum(i in {j for j, _ in want[q]} for q in want for i, _ in out[q])
    assert found >= 0.9 * 5 * len(want)
    exact = ann.nearest(df, df.filter("vec_id % 50 = 0"), share=2.0).orderBy("query_id", "rank").collect()
    for r in exact:
        i, s = want[r.query_id][r["rank"] - 1]
        assert r.vec_id == i and r.score == pytest.approx(s, abs=1e-12)


def test_parts_and_groups(spark, monkeypatch):
    """Cells in many parts and queries in many groups give the same neighbours."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(400)]
    df = vectors(spark, rows)
    ask = df.filter("vec_id % 20 = 0")
    want = sorted(map(tuple, ann.nearest(df, ask, share=2.0).collect()))
    monkeypatch.setattr(ann, "PART_VALUES", 60)
    monkeypatch.setattr(ann, "QUERY_VALUES", 50)
    monkeypatch.setattr(ann, "WALKED", 2)
    assert sorted(map(tuple, ann.nearest(df, ask, share=2.0).collect())) == want
    assert {(q, i) for q, _, i, _ in want} == {(q, i) for q, x in plain_nearest(rows, every=20).items() for i, _ in x}


def test_equal_vectors_tie_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000, [3.0, 1.0, 0.5])]
    df = vectors(spark, rows)
    out = ann.nearest(df, df.filter("vec_id in (0, 350)"), share=2.0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in out] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4] and {r.score for r in out} == {out[0].score}
    few = df.filter("vec_id in (0, 1, 1000)")
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_repeated_query_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)]
    df = vectors(spark, rows)
    twice = vectors(spark, [rows[0], rows[0], (7, [3.0, 1.0, 0.5]), (7, [1.0, 2.0, 3.0])])
    out = ann.nearest(df, twice, share=2.0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == sorted([(0, n + 1, n + 1) for n in range(5)] * 2 + [(7, n + 1, n) for n in range(5)] * 2)
    # the query's own id fills the least entries of its vector, and the nearest vectors
    own = [(0, [1.0, 2.0, 3.0])] * 8 + [(0, [1.0, 2.0, 3.0 + i / 1000]) for i in range(1, 9)]
    rng = np.random.default_rng(2)
    rows = [*own, *((i, [1.0, 2.0, 3.0]) for i in (5, 6)), *((i, [float(np.float32(x)) for x in rng.normal(size=3)]) for i in range(10, 40))]
    df = vectors(spark, rows)
    out = ann.nearest(df, df.filter("vec_id = 0").limit(1), share=2.0).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [i for i, _ in plain_nearest(rows)[0]] and [r.vec_id for r in out][:2] == [5, 6]


SMALL_DRIVER = """
import numpy as np
from pyspark.sql import SparkSession
from modelrank.llm import ann

spark = SparkSession.builder.master("local[2]").config("spark.driver.maxResultSize", "4m").config("spark.sql.autoBroadcastJoinThreshold", "256k").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
flat = np.random.default_rng(3).normal(size=(12_000, 4))
df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(flat)], "vec_id long, embedding array<double>")
print("rows", ann.nearest(df, df).count())
"""


def test_visited_cells_stay_off_the_driver():
    """12 000 queries visit most of 225 cells: a list of them would take over 7 MB, the driver may get 4 MB."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-B", "-c", SMALL_DRIVER], cwd=repo, capture_output=True, text=True, timeout=300)
    assert "rows 60000" in said.stdout, said.stderr[-2000:]


def test_floats_near_ties_and_odd_widths(spark):
    """Float columns keep to exact doubles; vectors that single precision can't tell apart are ranked by double; queries of another width take no part."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    rows = [(i, (base + 1e-9 * rng.normal(size=8)).tolist()) for i in range(120)] + [(i, rng.normal(size=8).tolist()) for i in range(120, 200)]
    rows += [(200, [0.0, 1.0] + [0.0] * 6), (201, [-0.0, 1.0] + [-0.0] * 6), (202, [0.0, 2.0] + [0.0] * 6)]
    df, out = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
    for r in ann.nearest(df, df, share=2.0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = plain_nearest(rows, every=1)
    assert set(out) == set(want)
    for q, x in want.items():
        assert [s for _, s in out[q]] == pytest.approx([s for _, s in x[:5]], abs=1e-15)
    assert [i for i, _ in out[200]][:2] == [201, 202] and [i for i, _ in out[202]][:2] == [200, 201]
    floats = vectors(spark, rows)
    doubles = floats.withColumn("embedding", F.col("embedding").cast("array<double>"))
    a, b = (ann.nearest(x, x, share=2.0).orderBy("query_id", "rank").collect() for x in (floats, doubles))
    assert a == b
    odd = vectors(spark, [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), rows[150]])
    assert {r.query_id for r in ann.nearest(floats, odd, share=2.0).collect()} == {150}


# ------------------------------------------------------------ substring dedup


def plain_dedup(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] = seen.get(tuple(w[i : i + size]), 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repetitive(rng, vocabulary, n):
    """Texts of copied stretches, runs and periods."""
    texts, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.randrange(5)
            if kind == 0:
                a = rng.randrange(20)
                words += passage[a : a + rng.randint(20, 50)]
            elif kind == 1:
                words += [rng.choice(vocabulary)] * rng.randint(1, 90)
            elif kind == 2:
                words += [rng.choice(vocabulary), rng.choice(vocabulary)] * rng.randint(1, 40)
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed, words, size", [(1, 3, 35), (2, 40, 35), (3, 500, 35), (4, 6, 24), (5, 500, 50)])
def test_substring_dedup(spark, seed, words, size, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LIST_BYTES", 2000)  # many lists
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 3000)  # and chunks
    texts = [*TEXTS, *repetitive(random.Random(seed), [f"v{i}" for i in range(words)], 60)]
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(docs(spark, texts), size=size).collect()}
    assert [(out[i].n_words, out[i].n_removed, out[i].kept_text) for i in range(len(texts))] == plain_dedup(texts, size)


def test_substring_dedup_at_the_edges(spark):
    assert substring_dedup.substring_dedup(none(spark)).count() == 0
    r = substring_dedup.substring_dedup(docs(spark, ["x " * 35 + "y", None])).orderBy("doc_id").collect()
    assert [(x.n_removed, x.kept_text) for x in r] == [(0, "x " * 35 + "y"), (0, "")]
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs(spark), size=10)


def test_symbols_depend_on_eight_words_around():
    """Whether a symbol begins at a place is settled by SPAN words on each side."""
    rng = np.random.default_rng(9)
    for vocabulary in (2, 3, 50):
        names = rng.integers(0, 2**63, vocabulary, dtype=np.uint64)
        middle = names[rng.integers(0, vocabulary, 35)]
        seen = set()
        for _ in range(40):
            words = np.concatenate([names[rng.integers(0, vocabulary, 30)], middle, names[rng.integers(0, vocabulary, 30)]])
            first = np.zeros(len(words), bool)
            first[0] = True
            with np.errstate(over="ignore"):
                at = substring_dedup.low_symbols(words, first)[1]
            assert np.diff(at).max() <= substring_dedup.SPAN
            seen.add(tuple(x - 30 for x in at if 30 + substring_dedup.SPAN <= x <= 65 - substring_dedup.SPAN))
        assert len(seen) == 1


def test_high_symbols_are_shared_by_long_repeats():
    """Two copies of a passage in other surroundings have high symbols in common; each stands for equal words."""
    rng = np.random.default_rng(10)
    names = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    passage = rng.integers(0, 5000, 600)
    found = []
    for _ in range(2):
        codes = np.concatenate([rng.integers(0, 5000, 300), passage, rng.integers(0, 5000, 200)])
        words = names[codes]
        first = np.zeros(len(words), bool)
        first[0] = True
        with np.errstate(over="ignore"):
            symbols, start = substring_dedup.low_symbols(words, first)
            got = substring_dedup.high_symbols(symbols, start, np.append(start[1:], len(words)), first[start], 35)
        assert (got[2] - got[1] >= 35).all()
        found.append({int(n): tuple(codes[a:b].tolist()) for n, a, b in zip(*got)})
    both = found[0].keys() & found[1].keys()
    assert len(both) > 3 and all(found[0][n] == found[1][n] for n in both) and max(len(found[0][n]) for n in both) > 100


def test_a_passage_of_copies_is_found_elsewhere(spark, monkeypatch):
    """Windows inside long copies go out once, and windows of other documents still meet them."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2500)
    rng = random.Random(13)
    whole = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(whole)] * 7
    for _ in range(30):
        a, n = rng.randrange(360), rng.randint(30, 120)
        texts.append(" ".join([*(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))), *whole[a : a + n], *(f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60)))]))
    rng.shuffle(texts)
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(docs(spark, texts)).collect()}
    assert [(out[i].n_words, out[i].n_removed, out[i].kept_text) for i in range(len(texts))] == plain_dedup(texts, 35)


def test_results_replace_kept_columns(spark):
    out = substring_dedup.substring_dedup(docs(spark), keep=("doc_id", "n_words", "kept_text", "score"))
    assert out.columns == ["doc_id", "score", "n_words", "n_removed", "kept_text"]


# ------------------------------------------------------------ decontamination


def plain_contamination(texts, items, size=13):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = norm(t), set(), set()
        for item_id, text in items:
            b = norm(text)
            k = min(size, len(b))
            wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
            for i in range(len(w) - k + 1):
                if b and tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    if item_id is not None:
                        found.add(str(item_id))
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    words = [f"q{i}" for i in range(6)] + ["é", "ß1"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(12)] + [(3, "one"), (11, None), (None, "cat sat"), (10, " , ."), (2, "Ελληνικά 中文")]
    texts = [*TEXTS, *(" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)), "..Cat--SAT!! on", "x" * 50 + " " + items[1][1].upper().replace(" ", " - ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert [(out[i].n_words, out[i].n_hit, out[i]["items"], out[i].contaminated) for i in range(len(texts))] == plain_contamination(texts, items)
    r = out[len(texts) - 2]
    assert [texts[-2][s.start : s.end] for s in r.hit_spans] == ["Cat--SAT"]
    assert decontaminate.decontaminate(none(spark), bench).count() == 0
    assert {x.n_hit for x in decontaminate.decontaminate(docs(spark), bench.limit(0)).collect()} == {0}


def test_several_automata(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"q{i}" for i in range(5)] + ["é"]
    items = [(i % 30, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(40)] + [(None, "cat sat"), (2, "Ελληνικά 中文")]
    texts = [*TEXTS, *(" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)), "..Cat--SAT!! on"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    keep, some = ("doc_id", "text", "items"), docs(spark, texts)
    whole = sorted(map(str, decontaminate.decontaminate(some, bench, keep=keep).collect()))
    for group, most in ((1 << 20, 300), (500, 300), (500, 1 << 20)):
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", group)
        monkeypatch.setattr(decontaminate, "PATTERN_BYTES", most)
        monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 500)
        out = decontaminate.decontaminate(some, bench, keep=keep).collect()
        assert sorted(map(str, out)) == whole, (group, most)
        by = {r.doc_id: r for r in out}
        assert [(by[i].n_words, by[i].n_hit, by[i]["items"], by[i].contaminated) for i in range(len(texts))] == plain_contamination(texts, items)
    assert decontaminate.decontaminate(none(spark), bench).count() == 0 and decontaminate.decontaminate(some, bench, keep=()).count() == len(texts)


def test_large_benchmarks_are_refused(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 10)
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs(spark), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))


# ----------------------------------------------------------------------- PII

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_plain_finds():
    rng = random.Random(6)
    for _ in range(30_000):
        text = "".join(rng.choices("a@.1-+ (2@.b0é", k=rng.randint(0, 30)))
        assert pii.plain(text) == plain_pii(text), text
    assert pii.plain("1" * 200_000 + "." + "a" * 200_000) == []


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail bob.lee (at) example (dot) com now", "email", "bob.lee (at) example (dot) com"),
        ("write to bob at example dot com please", "email", "bob at example dot com"),
        ("bob[@]mail.example[.]org!", "email", "bob[@]mail.example[.]org"),
        ("call plus one five five five oh one two three four five six", "phone", "plus one five five five oh one two three four five six"),
        ("see ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email", "ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("see bоb@exаmple.com", "email", "bоb@exаmple.com"),
        ("é b​ob@exam​ple.org", "email", "b​ob@exam​ple.org"),
        ("é four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one"),
        ("at 10 dot 0 dot 0 dot 1 there", "ip", "10 dot 0 dot 0 dot 1"),
        ("at ١٠.0.0.1 there", "ip", "١٠.0.0.1"),
    ],
)
def test_disguised_finds(text, kind, part):
    base, every = pii.find(text)
    added = [x for x in every if x not in base]
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, part)]


@pytest.mark.parametrize(
    "text, kind, fragment, part",
    [
        ("see jоhn@example.com!", "email", "hn@example.com", "jоhn@example.com"),
        ("to bob dot lee@example.com now", "email", "lee@example.com", "bob dot lee@example.com"),
        ("mail me at bob dot lee@example.com", "email", "lee@example.com", "bob dot lee@example.com"),
        ("to bob@mail.example dot com now", "email", "bob@mail.example", "bob@mail.example dot com"),
        ("call +1 555 123 456７ now", "phone", "+1 555 123 456", "+1 555 123 456７"),
        ("at ٣1.2.3.4 there", "ip", "1.2.3.4", "٣1.2.3.4"),
        ("ask me (at) bob.lee@example.com", "email", "bob.lee@example.com", None),
        ("inside a word: bob@example.com, п", "email", "bob@example.com", None),
    ],
)
def test_disguised_beyond_a_plain_find(text, kind, fragment, part):
    base, every = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in base] == [(kind, fragment)]
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == ([(kind, part)] if part else [])


SIGNS_FOR = {"@": [" (at) ", "[at]", " at ", "{ AT }", "[@]", "＠", "@"], ".": [" (dot) ", "[dot]", " dot ", "[.]", "．", "."]}
LETTERS_FOR = {"a": "аａ", "e": "еｅ", "o": "оοｏ", "c": "сｃ", "x": "х", "p": "р", "i": "і", "1": "１١", "7": "７٧", "0": "０٠", "4": "４"}
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def disguise(rng, kind):
    """An identifier, disguised somewhere."""
    if kind == "phone":
        digits = [rng.randrange(10) for _ in range(rng.randint(10, 13))]
        if rng.random() < 0.5:
            return "plus " + rng.choice([" ", "-", "  "]).join(NUMBER_WORDS[d] for d in digits)
        plain = "+" + "".join(map(str, digits))
        k = rng.randrange(2, len(plain))
        return plain[:k] + chr(0xFF10 + int(plain[k])) + plain[k + 1 :]
    if kind == "ip":
        sign = rng.choice([" dot ", "[.]", "(dot)", "．"])
        return sign.join(str(rng.randrange(256)) for _ in range(4))
    plain = f"{rng.choice(['bob', 'ana.lee', 'x_7', 'poe-41'])}@{rng.choice(['example', 'mail-7.example'])}.{rng.choice(['com', 'org', 'co.uk'])}"
    if rng.random() < 0.5:
        k = rng.choice([i for i, c in enumerate(plain) if c in LETTERS_FOR])
        return plain[:k] + rng.choice(LETTERS_FOR[plain[k]]) + rng.choice(["", "\u200b"]) + plain[k + 1 :]
    at, dot = rng.choice(SIGNS_FOR["@"][:4] + SIGNS_FOR["@"][4:6]), rng.choice(SIGNS_FOR["."][:5])
    if at == " at ":
        dot = " dot "  # words for signs throughout
    return plain.replace("@", at).replace(".", dot)


def test_random_disguises_map_back():
    """The source span of a disguised identifier is exactly what was put in, whatever stands around and came before."""
    rng = random.Random(17)
    around = ["see: ", "ё text, ", "\n", "(no) ", "😀 ", "it costs 5; ", "‘quoted’ "]
    for _ in range(1500):
        text, want = "", []
        for _ in range(rng.randint(1, 4)):
            text += "".join(rng.choices(around, k=rng.randint(1, 3))) + "| "
            kind = rng.choice(["email", "ip", "phone"])
            part = disguise(rng, kind)
            want.append((kind, len(text), len(text) + len(part)))
            text += part + " |"
        base, every = pii.find(text)
        assert set(want) <= set(every), (text, [(k, text[a:b]) for k, a, b in want], [(k, text[a:b]) for k, a, b in every])
        assert {k for k in every if k not in base} <= set(want), text
        assert base == plain_pii(text) and every == sorted(every, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))


def test_addresses_are_those_of_one_pattern():
    """Walking every label once finds what trying the whole pattern at every label does."""
    held, dot, at, label, ends = pii._HELD, pii._DOT, pii._AT, pii._LABEL, pii._ENDS
    whole = re.compile(rf"(?<![A-Za-z0-9_%+-])(?:{held}(?:(?:{dot}|\.){held})*+(?:{pii.REST.pattern})|{pii.NUMBERS.pattern})", re.IGNORECASE)
    rng = random.Random(18)
    tokens = ["a", "b1", " ", "dot", "at", " dot ", " at ", " (at) ", "[dot]", "@", ".", "1", "23", "255", "-", "_", "( . )", "\n", "x", "  "]
    for _ in range(20_000):
        text = "".join(rng.choices(tokens, k=rng.randint(1, 16)))
        assert list(pii.addresses(text)) == [m.span() for m in whole.finditer(text)], text


@pytest.mark.parametrize("part", ["a.", "a dot ", "one dot ", "1 dot ", "a@a dot ", "a dot dot ", "a (at) ", "+1 ", "1 ", "а", "( at ", "(dot "])
def test_long_texts_take_time_in_proportion(part):
    import time

    took = []
    for size in (250_000, 1_000_000):
        began = time.process_time()
        pii.find("dot " + part * (size // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.1), took


@pytest.mark.parametrize("text", ["look at example.com, or at the dot", "one two three at home", "привет, как дела", "naïve café at 5 dot", "", "the house at the lake (at last)"])
def test_clean_texts(text):
    assert pii.find(text) == ([], [])


def test_pii(spark):
    texts = [*TEXTS, "a@b.cd 1.2.3.4 +1 (017) 555-7713 or 4111 1111 1111 1111", "bob (at) example (dot) com a@b.cd"]
    out = {r.doc_id: r for r in pii.pii(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in out[i].base] == plain_pii(t or "")
    assert [x.kind for x in out[len(texts) - 2].spans] == ["email", "ip", "phone", "card"] and len(out[len(texts) - 1].spans) == 2
    assert pii.pii(none(spark)).count() == 0


# ------------------------------------------------------------------ line dedup


def test_line_dedup(spark):
    texts = [*TEXTS, *(f"  Common LINE\t\nown {i}\n\n x" for i in range(12)), *("nine times" for _ in range(9)), "COMMON line"]
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < 10]
        assert (out[i].n_lines, out[i].n_dropped, out[i].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept)), i
    assert line_dedup.line_dedup(none(spark)).count() == 0


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    texts = [f"line {i % 30}\nother {i}" for i in range(90)]
    out = line_dedup.line_dedup(docs(spark, texts), min_docs=3).collect()
    assert {(r.n_dropped, r.kept_text == f"other {r.doc_id}") for r in out} == {(1, True)}


def test_minimal_perfect_hash(tmp_path):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(2))
    path = tmp_path / "shard"
    counts = np.arange(1, 5001, dtype=np.uint64)
    counts[7] = 1 << 40
    path.write_bytes(b"".join(line_dedup.build_shard(a, b, counts)))
    shard = line_dedup.Shard(str(path))
    assert shard.counts_of(a, b).tolist() == [line_dedup.TOP if i == 7 else i + 1 for i in range(5000)]
    assert path.stat().st_size < 10 * 5000
    assert not shard.counts_of(a, b ^ np.uint64(1)).any() and not shard.counts_of(a[::-1], b).any()


# ------------------------------------------------------- language and quality


def test_language_id(spark):
    rng = random.Random(8)
    sound = {"en": ["the", "and", "thing", "over", "wash"], "de": ["der", "und", "über", "schön", "nicht"], "fr": ["le", "été", "que", "vous", "où"]}
    rows = [(i, " ".join(rng.choices(sound[x], k=30)), x) for i, x in enumerate(rng.choices(list(sound), k=300))]
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "123 !?", "en"), (1002, "", None), (None, "the over and wash", None), (1003, "und über " * 200_000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    out = {r.doc_id: r for r in language_id.language_id(df).collect()}
    assert all(out[i].lang_pred == x for i, _, x in rows)
    assert {out[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and out[None].lang_pred == "en" and out[1003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language_id.language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_language(rows, texts):
    """Gram counts in dictionaries, log sums term by term."""
    import math

    def grams(t):
        t = f" {t.lower()} "
        for n in language_id.GRAMS:
            for i in range(len(t) - n + 1):
                points = np.array([ord(c) for c in t[i : i + n]], np.uint32)
                yield n, int(language_id.buckets_of(points, n)[0])

    count, docs, total = {}, {}, {}
    for t, lang in rows:
        docs[lang] = docs.get(lang, 0) + 1
        for n, g in grams(t):
            count[lang, g] = count.get((lang, g), 0) + 1
            total[lang, n] = total.get((lang, n), 0) + 1
    out = []
    for t in texts:
        held = {}
        for lang in docs:
            p = math.log(docs[lang] / len(rows))
            for n, g in grams(t):
                p += math.log((count.get((lang, g), 0) + language_id.SMOOTHING) / (total.get((lang, n), 0) + language_id.SMOOTHING * language_id.BUCKETS))
            held[lang] = p
        best = max(sorted(held), key=held.get)
        out.append((best, 1 / sum(math.exp(v - held[best]) for v in held.values())))
    return out


def test_language_id_is_the_plain_one(spark, monkeypatch):
    """Prior, counts and sums as a loop gives them, on short texts and in stretches."""
    rng = random.Random(14)
    letters = "abcdeé ßдж"
    rows = [("".join(rng.choices(letters[k : k + 5], k=rng.randint(1, 40))) + "a", x) for k, x in ((0, "en"), (2, "de"), (5, "ru")) for _ in range({"en": 25, "de": 6, "ru": 3}[x])]
    texts = ["a", "éß", "ab ab", *("".join(rng.choices(letters, k=rng.randint(1, 60))) + "d" for _ in range(30))]
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string").dropDuplicates(["text", "lang"])
    rows = [(r.text, r.lang) for r in train.collect()]
    want = plain_language(rows, texts)
    got = {r.doc_id: r for r in language_id.language_id(docs(spark, texts), train=train).collect()}
    assert [got[i].lang_pred for i in range(len(texts))] == [x for x, _ in want]
    assert [got[i].score for i in range(len(texts))] == pytest.approx([p for _, p in want], abs=1e-9)
    names, matrix, prior = language_id.learn(train, "text", "lang", "doc_id")
    whole = language_id.score_block(texts, matrix)
    monkeypatch.setattr(language_id, "STRETCH", 5)
    assert np.allclose(language_id.score_block(texts, matrix), whole, atol=1e-9)


def test_a_very_long_text_is_scored_whole(spark):
    train = spark.createDataFrame([(1, "the thing and over", "en"), (2, "der und nicht über", "de")], "doc_id long, text string, lang string")
    _, matrix, _ = language_id.learn(train, "text", "lang", "doc_id")
    rng = random.Random(15)
    text = "".join(rng.choices("theundr éü", k=3_000_000))
    points, _ = language_id.points_of([text])
    want = sum(np.bincount(language_id.buckets_of(points, n), minlength=len(matrix)) @ matrix for n in language_id.GRAMS)
    assert np.allclose(language_id.score_block([text], matrix)[0], want, rtol=1e-12)


def test_signs_that_are_no_letters(spark):
    train = spark.createDataFrame([(1, "the thing", "en")], "doc_id long, text string, lang string")
    texts = ["½", "²³", "Ⅷ", "٣", "_", "㊀", "ª", "x½", "é", "中"]
    out = {r.doc_id: r for r in language_id.language_id(docs(spark, texts), train=train).collect()}
    assert [out[i].lang_pred for i in range(len(texts))] == ["und"] * 6 + ["en"] * 4
    assert all(out[i].score == 0 for i in range(6))


@pytest.mark.parametrize("keys", [[1, 2, 3, 7], [11], list(range(500))])
def test_samples_are_bounded(spark, keys):
    """Whatever repeats, a sample has different rows, as many as may be and no more."""
    from modelrank.llm.common import hash_sample

    df = spark.range(3000).select(F.element_at(F.array(*map(F.lit, keys)), (F.col("id") % len(keys) + 1).cast("int")).cast("long").alias("k"), (F.col("id") % 40).alias("t"))
    n = df.distinct().count()
    for limit in (1, 20, 100, 10_000):
        held = [tuple(r) for r in hash_sample(df, limit).collect()]
        assert len(held) == len(set(held)) == min(n, limit)
    assert sorted(hash_sample(df, 20).collect()) == sorted(hash_sample(df.repartition(7), 20).collect())
    assert hash_sample(df.limit(0), 5).count() == 0


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op9_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) > 0.98 * len(out)


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.op7_quality(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id").collect()
    assert len(out) > 60 and sum(r.quality == r.predicted for r in out) > 0.93 * len(out)


def test_quality_is_the_plain_sum_of_tables(spark):
    rng = random.Random(16)
    texts = [*TEXTS, *(" ".join(rng.choices(["aa", "b.", "C1", "|", "dd,"], k=rng.randint(1, 80))) for _ in range(200))]
    labels = spark.createDataFrame([(i, int("|" in (t or "") and len(t) > 60)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.train(docs(spark, texts), labels, "text", "doc_id", "quality")
    out = {r.doc_id: r for r in quality.quality(docs(spark, texts), labels).collect()}
    for i, t in enumerate(texts):
        x, total = quality.features(t), model.base
        bin_of = lambda edges, v: sum(e <= v for e in edges)
        for j, table in enumerate(model.tables):
            total += table[bin_of(model.edges[j], x[j])]
        for a, b, table in model.pairs:
            total += table[bin_of(model.coarse[a], x[a]), bin_of(model.coarse[b], x[b])]
        assert out[i].score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12) and out[i].predicted == (out[i].score >= 0.7)


def test_quality_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    """Documents that repeat a labelled id don't add up at the driver."""
    seen = []
    monkeypatch.setattr(quality, "Model", lambda x, y: seen.append((x, y)))
    rows = spark.range(4000).select((F.col("id") % 3 + 1).alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 500).cast("int")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    quality.train(rows, labels, "text", "doc_id", "quality", 50)
    assert [len(x) for x, _ in seen] == [50]


def test_quality_at_the_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    out = quality.quality(docs(spark), labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.quality(docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.quality(none(spark), labels).count() == 0


def test_interactions_are_learnt():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.Model(x, y)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9 and (0, 3) in [(i, j) for i, j, _ in model.pairs]


# ------------------------------------------------------------------ everything


def test_queries_are_registered():
    from modelrank.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    same, line = "alpha beta gamma delta " * 40, "a line that many share"
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(i, f"{line}\nown words of {i} " + " ".join(f"u{i}x{j}" for j in range(60)), "en") for i in range(12)]
    rows += [(20, same, "en"), (21, same.upper() + "\n", "de"), (22, passage, "en"), (23, None, "en"), (24, "12 34", "en"), (25, "lone ünïque words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for n, (name, stage) in enumerate(C.STAGES):
        held = stage(spark, held, str(tmp_path))
        kept[name] = {r.doc_id: r for r in held.collect()}
        assert n == 4 or held.columns == df.columns
    every = set(range(12))
    assert set(kept["language_id"]) == every | {20, 21, 22, 25} and kept["language_id"][25].lang in ("en", "de")
    assert line not in kept["line_dedup"][3].text and kept["line_dedup"][3].n_chars == len(kept["line_dedup"][3].text)
    assert set(kept["simhash"]) == every | {20, 22, 25}
    assert set(kept["decontaminate"]) == every | {20, 25}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    for i, r in kept["bpe"].items():
        ids = library.encode(kept["decontaminate"][i].text, add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded_sha256) == (ids, len(ids), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id for r in C.run(spark, str(tmp_path)).collect()} == set(kept["bpe"])


def test_pipeline_without_a_known_language(spark, tmp_path):
    import corpus_pipeline as C

    rows = [(1, "own words here", None), (2, "Ελληνικά", None), (3, "12 34", None), (4, None, None), (5, "", None), (6, "_", None), (7, "ࡰ", None)]
    for lang in (None, "und"):
        df = spark.createDataFrame([(i, t, lang) for i, t, _ in rows], "doc_id long, text string, lang string").withColumn("n_chars", F.length("text").cast("long"))
        out = C.identify_language(spark, df, str(tmp_path))
        assert out.columns == df.columns and sorted((r.doc_id, r.lang) for r in out.collect()) == [(1, "und"), (2, "und"), (7, "und")]
