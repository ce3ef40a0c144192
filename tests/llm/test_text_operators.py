"""Word BPE, spelling variants and ranked search against the library, brute force and edge cases."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_operators import EDGES, SCHEMA
from tokenizers import Tokenizer

from shelfspark.llm import block_max_search, common, queries, spelling_variants, word_bpe_codec

ODD = ["a", "b", "the", "ing", "''s", "'S", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "İ", "Σ", "ς", "é", "́", "  ", "\n", "\x1c", "\x85", " ", "٣", "²", "Ⅷ", "漢字", "🙂", "👩‍👩", "Ᲊ", "ſ", "K", "\x00", "_", "...", "aaaaaaaaaaaaaaaa", "hahahahaha", "ß", "\U0001df90"]


@pytest.fixture
def edges(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    for c in ("i", "t", "term", "word", "n", "h", "query", "score", "rank", "item_id", "a.b"):
        docs = docs.withColumn(c, F.lit("x"))
    common.configure(spark)
    return docs


@pytest.fixture
def none(spark):
    common.configure(spark)
    return spark.createDataFrame([], SCHEMA)


# Word BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORD_MODEL)


@pytest.fixture(scope="module")
def codec():
    return word_bpe_codec.Codec(queries.WORD_MODEL)


def test_word_codec_is_the_library(codec, library):
    r = random.Random(7)
    texts = ["", " ", "x" * 3000, "The   quick\nbrown fox's 123", *("".join(r.choice(ODD) if r.random() < 0.4 else chr(r.choice([r.randrange(97, 123), r.randrange(32, 0x250), r.randrange(0x370, 0xD7FF)])) for _ in range(r.randrange(40))) for _ in range(3000))]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        for text, found, want in zip(part, codec.encoded(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            ids = [int(i) for words in found for _, s, _ in words for i in s.split()]
            assert ids == want.ids, text
            assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_failing_words_are_merged(codec, library):
    r = random.Random(8)
    words = ["".join(r.choice("abcehinorst"[: r.randrange(1, 12)]) for _ in range(r.randrange(1, 90))) for _ in range(2000)]
    found = codec.encode_words([w.encode() for w in words])
    assert found == [library.encode(w, add_special_tokens=False).ids for w in words]
    word, token = codec.speculated([w.encode() for w in words])
    holds = codec.compatible(token[:-1], token[1:])[word[1:] == word[:-1]]
    assert 0 < (~holds).sum() < len(holds)  # both ways are taken


def test_pair_check_is_merging(codec):
    r = random.Random(9)
    tokens = [t for t in codec.merge.values()]
    usable = [m for _, m in r.sample(tokens, 3000)]
    import numpy as np

    left, right = np.array(usable[:1500]), np.array(usable[1500:])
    text = lambda t: codec.name[t]
    inner = [i for i, t in enumerate(left.tolist()) if not text(t).endswith("</w>")]
    left, right = left[inner], right[inner]
    letters = {c: b for b, c in enumerate(word_bpe_codec.byte_letters())}
    for a, b, holds in zip(left.tolist(), right.tolist(), codec.compatible(left, right).tolist(), strict=True):
        end = text(b).endswith("</w>")
        raw = bytes(letters[c] for c in text(a) + text(b).removesuffix("</w>"))
        if not end:
            continue
        alone = [codec.merged(bytes(letters[c] for c in text(b).removesuffix("</w>")))]
        if alone == [[b]]:
            assert holds == (codec.merged(raw) == [a, b]) or codec.merged(raw)[0] != a


def test_word_documents(spark, edges, none, library):
    got = word_bpe_codec.encode_documents(edges, queries.WORD_MODEL)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in EDGES), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got.collect())
    digests = {r.doc_id: r for r in word_bpe_codec.encode_digests(edges, queries.WORD_MODEL).collect()}
    import hashlib

    for i, t in EDGES:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert word_bpe_codec.encode_digests(none, queries.WORD_MODEL).count() == 0


def test_long_text_in_stretches(codec, library):
    r = random.Random(10)
    text = " ".join("".join(r.choice(["ab", "é", "the", "<|endoftext|>", "1"]) for _ in range(r.randrange(1, 4))) for _ in range(60_000)) + "\n\n tail"
    assert len(text) > 2 * word_bpe_codec.STRETCH
    found = [int(i) for words in next(codec.encoded([text])) for _, s, _ in words for i in s.split()]
    assert found == library.encode(text, add_special_tokens=False).ids


# Spelling variants


def plain_variants(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    form, count = {}, {}
    for w in words:
        beside = [x for x in words if near(w, x)]
        count[w] = len(beside)
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], count[w], words[form[w]] if form[w] else None))
    return out


def some_words(r, n):
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(7, 12))) for _ in range(12)]
    rows = []
    for i in range(n):
        some = []
        for _ in range(40):
            w = r.choice(base[: r.choice([1, 3, 12])])
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcdÿ") + w[k:], w[:k] + r.choice("abcdÿ") + w[k + 1 :]])
            some.append(w.title() if r.random() < 0.2 else w)
        rows.append((i, " ".join(some)))
    return rows


@pytest.mark.parametrize("crowd", [4096, 3])
def test_variants_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling_variants, "CROWD", crowd)
    monkeypatch.setattr(spelling_variants, "ROWS", 64)
    monkeypatch.setattr(spelling_variants, "TILE", 8)
    rows = some_words(random.Random(crowd), 120) + [(None, "abcabcabc abcabcabc"), (5000, None), (5001, "")] + [(6000 + i, "x" * 300 + "abcdefg"[i % 7] * (i % 3)) for i in range(20)]
    common.configure(spark)
    got = spelling_variants.variants(spark.createDataFrame(rows, SCHEMA))
    assert set(map(tuple, got.collect())) == plain_variants(rows) and got.count() == len(plain_variants(rows))


def test_variant_edges(spark, edges, none):
    found = spelling_variants.variants(edges)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, found.collect())) == plain_variants(EDGES)
    assert spelling_variants.variants(none).count() == 0


def test_roots_follow_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w3")]
    found = spelling_variants.roots(spark.createDataFrame(links, "word string, form string"))
    assert {r.word: r.root for r in found.collect()} == {w: "w9" for w, _ in links}


# Ranked search


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k=10):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("segment", [8 << 20, 2000])
def test_search_against_all_scores(spark, monkeypatch, segment):
    monkeypatch.setattr(block_max_search, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(block_max_search, "BLOCK", 4)
    monkeypatch.setattr(block_max_search, "TERMS_AT_ONCE", 40)
    common.configure(spark)
    r = random.Random(segment)
    word = lambda: f"w{min(int(r.expovariate(0.05)), 300)}"
    docs = [(i, " ".join(word() for _ in range(r.randrange(60)))) for i in range(400)] + [(1000 + i, "w1 w2 W3, é") for i in range(15)] + [(None, "w1 w2 w3 É é"), (7, None), (8, "")]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 12)))) for i in range(25)] + [(100, "w1 w2 w3 é"), (101, None), (102, "nowhere"), (3, "w250 w1")]
    got = block_max_search.ranked(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_search(docs, items), key=str)


def test_blocks_stay_packed(spark):
    """Bounds keep most blocks of frequent terms packed."""
    r = random.Random(4)
    common.configure(spark)
    docs = [(i, f"common often rare{i % 50} " + "common " * (i % 7) + f"only{i}" + " filler" * r.randrange(30)) for i in range(6000)]
    index = block_max_search.build_index(spark.createDataFrame(docs, SCHEMA).coalesce(1))
    n, total = index.agg(F.sum("documents"), F.sum("terms_total")).first()
    row = index.collect()[0].asDict()
    row = {k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.items()}
    query = [(b"common", 30), (b"often", 30), (b"rare7", 3000), (b"only57", 9000)]
    part = block_max_search.Segment(row, {t for t, _ in query}, n, total)
    import numpy as np

    scores, ids = part.search(query, 3, np.zeros(0, np.int64), np.zeros(0, np.int64))
    lists = sum(int(part.x["list_at"][part.place_of[t] + 1] - part.x["list_at"][part.place_of[t]]) for t, _ in query)
    assert ids[0] == 57
    part.read = 0
    again, _ = part.search(query, 3, scores, ids)  # as a segment of the same kind after the first
    assert again[0] == again[1] == scores[0] and 0 < part.read < lists / 2


def test_segments_are_row_groups(spark, monkeypatch):
    """However many segments a task makes, writer and reader hold one of them at a time."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(block_max_search, "SEGMENT_BYTES", 2000)
    common.configure(spark)
    index = block_max_search.build_index(spark.createDataFrame([(i, f"word{i} " * 50) for i in range(300)], SCHEMA).coalesce(1))
    parts = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert index.count() > 10 and max(m.row_group(i).num_rows for m in parts for i in range(m.num_row_groups)) == 1


def test_search_edges(spark, edges, none):
    items = spark.createDataFrame([(1, "one two nobody"), (None, "word")], "item_id long, text string").withColumn("a.b", F.lit(1))
    got = block_max_search.ranked(edges, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_search(EDGES, [(1, "one two nobody"), (None, "word")]), key=str)
    assert block_max_search.ranked(none, items).count() == 0
    assert block_max_search.ranked(edges, items.limit(0)).count() == 0
