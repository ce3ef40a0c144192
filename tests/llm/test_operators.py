"""The training-data operators against brute force, round trips and edge cases."""

import base64
import binascii
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import attention_quality, chunk_dedup, common, decontamination, feistel_pii, golay_simhash, language_mixture, queries, sentencepiece_codec, slot_sharding, toxicity, warc

EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "One two  three"), (7, "one two three"), (8, "é ñ 你好 😀 ▁ \x00"), (9, "word " * 30000), (9, "word " * 30000), (None, "nobody's text"), (11, "12345 !!! ###")]
SCHEMA = "doc_id long, text string"


@pytest.fixture
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names the operators use inside."""
    docs = spark.createDataFrame(EDGES, SCHEMA)
    for c in ("i", "t", "fp", "key", "label", "n", "component", "recipe", "lang", "source", "shard", "slot"):
        docs = docs.withColumn(c, F.lit("x"))
    common.configure(spark)
    return docs


@pytest.fixture
def none(spark):
    common.configure(spark)
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def noise(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


# SentencePiece


def test_codec_is_the_library(spark, edges):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    codec = sentencepiece_codec.Codec(queries.PIECE_MODEL)
    r = random.Random(5)
    texts = ["", " ", "  a", "a  ", "\n\n", "the" * 200, "x" * 3000, " " * 70 + "y", "<s><0x0A> ▁▁", *("".join(r.choice("abcdefghinorst  ▁\n.,éñ你1 0😀AB'-") for _ in range(r.randrange(80))) for _ in range(400))]
    for text in texts:
        ids = [1, *model.encode(text), 2]
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert codec.decode(packed).decode() == model.decode(ids), text
    for _ in range(300):
        ids = [r.randrange(32000) if r.random() < 0.6 else r.randrange(259) for _ in range(r.randrange(12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == model.decode(ids), ids
    got = sentencepiece_codec.encode_digests(edges, queries.PIECE_MODEL).collect()
    want = []
    for i, t in EDGES:
        ids = [1, *model.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    texts = {x.doc_id: x for x in sentencepiece_codec.encode_documents(edges, queries.PIECE_MODEL).collect()}
    assert texts[6].decoded == "One two  three" and np.frombuffer(texts[2].ids, "<u4").tolist() == [1, 2]


# Exact deduplication


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(v)[1], len(v)) for v in groups.values() for _, i in v}


@pytest.mark.parametrize("digest_size", [16, 1])
def test_exact_dedup(spark, digest_size):
    common.configure(spark)
    r = random.Random(3)
    base = [noise(r, r.randrange(1, 900)) for _ in range(40)]
    rows = [(i, r.choice(base) if i % 3 else base[0].replace(" ", r.choice([" ", "\n", "  "]))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, base[1] + "x"), (1004, base[2] * 60), (1005, base[2] * 60)]
    got = {x.doc_id: (x.keep_id, x.group_size) for x in chunk_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), digest_size).collect()}
    assert got == brute_dedup(rows)


def test_chunks_join_to_the_text_and_resist_insertions():
    data = noise(random.Random(1), 20000).encode()
    parts = chunk_dedup.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= chunk_dedup.LARGEST
    assert len(set(parts) & set(chunk_dedup.chunks(b"new start " + data))) > 0.8 * len(parts)
    assert chunk_dedup.chunks(b"") == []


# SimHash


def test_golay_code_is_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000).astype(np.int32)
    tables, errors = golay_simhash.golay()
    assert sorted(collections.Counter(int(e).bit_count() for e in errors).items()) == [(0, 1), (1, 23), (2, 253), (3, 1771)]
    near = golay_simhash.near_codewords(words)
    assert set((near >= 0).sum(1).tolist()) <= {1, 6}
    r = random.Random(2)
    for w in words[:300].tolist():
        v = w
        for b in r.sample(range(23), r.randrange(3)):
            v ^= 1 << b
        a, b = (set(x[x >= 0].tolist()) for x in golay_simhash.near_codewords(np.array([w, v], np.int32)))
        assert a & b
        if (w ^ v).bit_count() <= 1:
            assert int(golay_simhash.decode(np.array([v], np.int32))[0]) in a


def brute_components(prints):
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    low = {}
    for i, v in prints.items():
        low[find(v)] = min(low.get(find(v), i), i)
    return {i: (v, low[find(v)]) for i, v in prints.items()}


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts)) if parts else 0


@pytest.mark.parametrize("heavy", [48, 1])
def test_near_duplicates(spark, heavy):
    common.configure(spark)
    r = random.Random(9)
    rows = [(i, noise(r, r.randrange(1, 60))) for i in range(60)]
    long = [f"w{r.randrange(400)}" for _ in range(400)]
    for i in range(60, 140):
        copy = list(long)
        for _ in range(r.randrange(3)):
            copy[r.randrange(400)] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE")]
    got = {x.doc_id: (x.fp % (1 << 64), x.component_id) for x in golay_simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), heavy=heavy).collect()}
    assert got == brute_components({i: plain_fingerprint(t) for i, t in rows})


def test_links_at_every_distance(spark):
    common.configure(spark)
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(50)]
    values += [v ^ 1 << r.randrange(64) for v in values] + [v ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for v in values] + [0, 3, (1 << 63) | 1, 1 << 63]
    values = sorted(set(values))
    for heavy in (48, 1):
        edges = golay_simhash.links(spark.createDataFrame([(golay_simhash.signed(v),) for v in values], "fp long"), heavy).collect()
        assert all(((e.a ^ e.b) % (1 << 64)).bit_count() <= 2 for e in edges)
        if heavy == 48:
            want = {frozenset(map(golay_simhash.signed, p)) for p in itertools.combinations(values, 2) if (p[0] ^ p[1]).bit_count() <= 2}
            assert {frozenset((e.a, e.b)) for e in edges} == want


def word_shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def test_near_copies_by_words(spark):
    common.configure(spark)
    r = random.Random(8)
    base = [[f"w{r.randrange(3000)}" for _ in range(300)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for k in range(4):
            copy = list(b)
            copy[r.randrange(300)] = f"other{k}"
            rows.append((100 + 10 * i + k, " ".join(copy)))
    kept = {x.doc_id for x in golay_simhash.deduplicated(spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit(1))).collect()}
    assert set(range(12)) <= kept and len(kept) <= 14


def test_block_edits_and_short_texts_are_linked(spark):
    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], 0
    for _ in range(40):
        w = some(300)
        k, ks = some(300), some(r.randint(8, 15))
        for x, y in ((w, w + some(40)), (k, k[:-30] + some(30)), (ks, ks + some(1))):
            rows += [(2 * pairs, " ".join(x)), (2 * pairs + 1, " ".join(y))]
            pairs += 1
    # two texts of one doc_id, the second a near copy
    rows += [(10_000, " ".join(some(50))), (10_000, rows[0][1] + " end")]
    sets = [word_shingles(t, 5) for _, t in rows]
    close = {2 * p for p in range(pairs) if len(sets[2 * p] & sets[2 * p + 1]) >= 0.8 * len(sets[2 * p] | sets[2 * p + 1])}
    assert len(close) > 100
    kept = {x.doc_id for x in golay_simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {i for i, _ in rows} - {i + 1 for i in close} - {10_000}


def test_crowded_pairs_against_brute_force(spark):
    common.configure(spark)
    r = random.Random(13)
    base = [[f"w{r.randrange(500)}" for _ in range(90)] for _ in range(4)]
    texts = {i: None if i == 0 else "" if i == 1 else "two words" if i < 4 else None for i in range(5)}
    for i in range(5, 90):
        words = list(base[i % 4])
        for _ in range(r.randrange(5)):
            words[r.randrange(90)] = f"w{r.randrange(500)}"
        texts[i] = " ".join(words[r.randrange(6) :])
    docs = spark.createDataFrame(list(texts.items()), "i long, t string")
    sets = {i: word_shingles(t, 5) for i, t in texts.items()}
    want = {(a, b) for a in texts for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    alike = {(a, b) for a, b in want if a >= 5}
    assert 50 < len(alike) < 1500
    for groups in ({}, {i: 5 + i % 3 for i in range(5, 60)}):
        grouped = spark.createDataFrame(list(groups.items()), "node long, component long")
        pairs = golay_simhash.crowded_pairs(docs, grouped, 5, 0.8)
        got = {(x.a, x.b) for x in golay_simhash.verified(pairs, docs, 5, 0.8).collect()}
        assert got == {(a, b) for a, b in want if groups.get(a, a) != groups.get(b, b)}
        assert pairs.count() == pairs.distinct().count()
    assert golay_simhash.crowded_pairs(docs.limit(0), grouped, 5, 0.8).count() == 0


def test_many_small_groups_behind_one_shingle(spark):
    """Texts around one base with more edits than a link allows share its shingles but few links; their candidates stay few."""
    common.configure(spark)
    r = random.Random(21)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(r.choice((1, 4, 5, 6, 7))):
            words[r.randrange(150)] = f"w{r.randrange(4000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "i long, t string")
    sets = [word_shingles(t, 5) for _, t in rows]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = [(a, b) for a, b in itertools.combinations(range(600), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in linked:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {i: root(i) for i in range(600)}
    assert 100 < len(set(groups.values())) < 500
    found = golay_simhash.components(golay_simhash.similar_links(docs, id_col="i", text_col="t")).collect()
    assert {i: dict((x.node, x.component) for x in found).get(i, i) for i in range(600)} == groups
    grouped = spark.createDataFrame([(i, g) for i, g in groups.items() if list(groups.values()).count(g) > 1], "node long, component long")
    crossing = len(list(itertools.combinations(range(600), 2)))
    assert golay_simhash.crowded_pairs(docs, grouped, 5, 0.8).count() < crossing / 20


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (5, 5), (300, 301), (300, 302)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Decontamination


def test_edited_items_are_found():
    r = random.Random(12)
    items = [(i, noise(r, r.choice((16, 24, 32, 48, r.randrange(13, 60)))).split()) for i in range(60)]
    index, texts, want = decontamination.Index(items), [], set()
    for k, (i, words) in enumerate(index.items):
        for at in (0, 1, len(words) // 2, len(words) - 2, len(words) - 1):
            for edited in (words[:at] + ["edited"] + words[at + 1 :], words[:at] + words[at + 1 :], words[:at] + ["added"] + words[at:]):
                text = noise(r, 40).split() + edited + noise(r, 40).split()
                if max(index.similarity(text[p : p + len(words)], k) for p in range(36, 46)) >= 0.8:
                    want.add((len(texts), i))
                    texts.append(" ".join(text))
    found = {(t, i) for t, i, _, _ in index.search(texts)}
    assert want <= found and len(want) > 100


def test_items_edited_at_both_ends_are_found():
    r = random.Random(33)
    some = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([24, 40, 60, 62, 64, 100, 126, 190] * 120)]
    index, texts, want = decontamination.Index(items), [], set()
    for k, (i, words) in enumerate(items):
        m = (len(words) - 4) // 9 // 2
        text = some(30) + some(m) + words[m:-m] + some(m) + some(30)
        if index.similarity(text[30 : 30 + len(words)], k) >= 0.8:
            want.add((len(texts), i))
            texts.append(" ".join(text))
    assert len(want) > 700 and want <= {(t, i) for t, i, _, _ in index.search(texts)}


def test_weights_hold_for_the_whole_benchmark(spark):
    common.configure(spark)
    r = random.Random(22)
    shared = noise(r, 12)
    bench = spark.createDataFrame([(i, f"{shared} {noise(r, 12 + i % 5)}") for i in range(40)] + [(50, "")], "item_id long, text string")
    rows = [(x.item_id, f"{noise(r, 9)} {x.text[: -2 * (x.item_id % 9)] if x.item_id % 9 else x.text} {noise(r, 5)}") for x in bench.collect()]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, many = (sorted(map(tuple, decontamination.leaks(docs, bench, items_at_once=n).collect())) for n in (100, 9))
    assert one == many and any(x[3] < 1 for x in one)


def test_windows_are_majorities():
    h = decontamination.hashed([str(i) for i in range(150)])
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).astype(int)
    for size in decontamination.window_sizes(100):
        prints = decontamination.window_prints(h, {size, 16})[size]
        for at in (0, 7, 150 - size):
            want = np.packbits(2 * bits[at : at + size].sum(0) > size, bitorder="little").view("<u8")[0]
            assert int(prints[at]) == int(want)


def test_leaks_against_brute_force(spark):
    common.configure(spark)
    r = random.Random(6)
    items = [(i, noise(r, r.randrange(1, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "!!!")]
    rows = []
    for i in range(120):
        words = noise(r, r.randrange(5, 300)).split()
        if i % 2:
            item = items[r.randrange(40)][1].split()
            if len(item) > 45 and i % 4 == 1:
                item[len(item) // 2] = "edited"
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in item]
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, "")]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.Index([(i, decontamination.words_of(t)) for i, t in items])
    want = set()
    for i, t in rows:
        words = decontamination.words_of(t)
        for k, (item, own) in enumerate(index.items):
            if len(own) <= len(words) and max(index.similarity(words[a : a + len(own)], k) for a in range(len(words) - len(own) + 1)) >= 0.8:
                want.add((i, item))
    for at_once in (1000, 7):
        found = decontamination.leaks(docs, bench, items_at_once=at_once).collect()
        if at_once == 1000:
            got = {(x.doc_id, x.item_id) for x in found}
            assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 50
        assert {(x.doc_id, x.item_id) for x in found if x.similarity >= 0.99} == {(i, j) for i, j in want if f" {' '.join(index.items[[m for m, _ in index.items].index(j)][1])} " in f" {' '.join(decontamination.words_of(dict(rows)[i]))} "}
    clean = decontamination.decontaminated(docs, bench)
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in rows} - {x.doc_id for x in decontamination.leaks(docs, bench).collect()}


# WARC


@pytest.mark.parametrize("split_bytes", [1 << 22, 997])
def test_warc_round_trip(spark, split_bytes):
    common.configure(spark)
    r = random.Random(2)
    fake = warc.member(b"WARC/1.1\r\n\r\n").decode("latin-1")
    rows = [(i, f"http://h/{i}", r.choice(["<p>a</p>", "", None, f"<b>{noise(r, r.randrange(1, 3000))}</b>", "é" * 40, fake])) for i in range(80)]
    rows += [(-5, None, "<p>a</p>"), (7_000_000_000, "x\ny", "<i>long</i>" * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)).withColumn("sha", F.lit("x"))
    for smallest in (0, 100):
        payload = {i: (h or "").encode() for i, _, h in rows}
        last = {}
        for i, p in payload.items():
            last[p] = max(last.get(p, i), i)
        want = {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if len(p) < smallest or last[p] == i else ("revisit", last[p]))) for i, p in payload.items()}
        got = warc.round_trip(spark, pages, smallest, split_bytes=split_bytes).collect()
        assert {x.page_id: tuple(x)[1:] for x in got} == want and len(got) == len(rows)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    assert [x.page_id for x in warc.round_trip(spark, pages.limit(1).withColumn("page_id", F.lit(None).cast("long"))).collect()] == [None]


def test_one_page_with_different_payloads(spark):
    common.configure(spark)
    rows = [(1, None, "<p>A</p>"), (5, None, "<p>A</p>"), (1, None, "<p>UNIQUE</p>"), (None, None, "<p>A</p>"), (5, None, "<p>A</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(pages, common.shared_path(spark, "warc-test"))
    got = warc.read(spark, manifest, payloads=True).collect()
    want = [(1, 8, "revisit", 5, None), (5, 8, "response", None, b"<p>A</p>"), (5, 8, "response", None, b"<p>A</p>"), (1, 13, "response", None, b"<p>UNIQUE</p>"), (None, 8, "response", None, b"<p>A</p>")]
    assert sorted(map(str, ((x.page_id, x.payload_bytes, x.record_type, x.refers_to, x.payload and bytes(x.payload)) for x in got))) == sorted(map(str, want))
    digests = {x.payload_digest for x in got if x.record_type == "response"}
    assert all(x.payload_digest in digests for x in got) and warc.base32_sha1(b"<p>UNIQUE</p>") in digests


def test_warc_members_are_gzip(spark, tmp_path):
    import gzip

    common.configure(spark)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>")], "page_id long, url string, html string").coalesce(1), folder)
    text = b"".join(gzip.decompress(open(m.path.removeprefix("file://"), "rb").read()) for m in manifest.collect()).decode()
    assert text.count("WARC/1.1") == 2 and "WARC-Type: revisit" in text and "WARC-Refers-To: <urn:x-page:2>" in text
    found = {x.page_id: x for x in warc.read(spark, manifest, payloads=True).collect()}
    assert found[2].payload == b"<p>x</p>" and found[1].payload is None and found[1].url == "http://a"


# Sharding


def test_sharding(spark, edges):
    r = random.Random(1)
    rows = [(i, noise(r, r.randrange(200))) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = slot_sharding.shard_documents(docs, 8).collect()
    size, places, crc = collections.Counter(), collections.defaultdict(list), dict(rows)
    for x in got:
        assert x.size == len(crc[x.doc_id].encode()) + 1 and x.text_crc32 == binascii.crc32(crc[x.doc_id].encode()) and x.law == "bytes" and x.grown_shard is None
        size[x.shard] += x.size
        places[x.shard].append(x.slot)
    assert len(got) == 2000 and set(size) == set(range(8)) and max(size.values()) < 1.01 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    same = collections.defaultdict(set)
    for x in slot_sharding.shard_documents(docs.unionByName(spark.createDataFrame([(i, rows[i % 50][1]) for i in range(5000, 5200)] + [(None, rows[3][1])], SCHEMA)), 8).collect():
        same[x.text_crc32].add(x.shard)
    assert len(same) > 1000 and all(len(v) == 1 for v in same.values())
    assert len(slot_sharding.shard_documents(edges, 2).collect()) == len(EDGES)


def test_shards_by_the_plain_recipe(spark):
    """Sizes, slots, map and places against a rebuild in plain Python from the slots' bytes."""
    r = random.Random(19)
    rows = [(i, noise(r, r.randrange(60))) for i in range(700)] + [(None, "x"), (None, "y"), (3, "again"), (3, "again")]
    got = slot_sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 5, n_slots=64).collect()
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted((str(i), len(t.encode()) + 1, binascii.crc32(t.encode())) for i, t in rows)
    slots = collections.defaultdict(int)
    for x in got:
        slots[x.virtual_slot] += x.size
    assert max(slots.values()) <= sum(slots.values()) / 5 / slot_sharding.SPLIT_SHARE  # no slot is split
    load, home = [0] * 5, {}
    for slot in sorted(slots, key=lambda s: (-slots[s], s)):
        home[slot] = min(range(5), key=lambda s: (load[s], s))
        load[home[slot]] += slots[slot]
    assert all(x.shard == home[x.virtual_slot] for x in got)
    for shard in range(5):
        mine = sorted((x for x in got if x.shard == shard), key=lambda x: x.slot)
        assert [x.slot for x in mine] == list(range(len(mine)))
        assert [x.virtual_slot for x in mine] == sorted(x.virtual_slot for x in mine)


def test_shards_are_written_whole(spark, tmp_path):
    """Null and repeated identifiers, repeated rows and a column called shard: each row is written once."""
    rows = [(None, "a"), (None, "a"), (7, "b"), (7, "c"), (9, None)] + [(i, "hot") for i in [None] * 40 + [5] * 40]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(4))
    common.configure(spark)
    placed = slot_sharding.write_shards(docs, f"file://{tmp_path}/out", 3)
    back = spark.read.parquet(f"file://{tmp_path}/out/data")
    assert sorted(map(str, ((x.doc_id, x.text, x.shard, x.slot) for x in back.collect()))) == sorted(str((i, t, "mine", 4)) for i, t in rows)
    assert set(back.columns) == {*docs.columns, "_shard"} and placed.count() == len(rows)
    assert {r._shard: r["count"] for r in back.groupBy("_shard").count().collect()} == {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert len({x.shard for x in placed.where("text_crc32 = crc32('hot')").collect()}) > 1
    assert len(slot_sharding.read_map(spark, f"file://{tmp_path}/out/map")) > 0


def test_hot_text_is_split_and_maps_are_versioned(spark, tmp_path):
    common.configure(spark)
    docs = spark.createDataFrame([(i, "hot text" if i % 3 else f"text {i}") for i in range(3000)], SCHEMA)
    rows = slot_sharding.records(docs)
    first = slot_sharding.build_map(rows, 4)
    load = collections.Counter()
    for p in first:
        load[p.shard] += p.bytes
    assert max(load.values()) < 1.05 * min(load.values())
    second = slot_sharding.grown(first)
    before = {(p.slot, p.part): p.shard for p in first}
    assert {p.shard for p in second if before[p.slot, p.part] != p.shard} == {4}
    load = collections.Counter()
    for p in second:
        load[p.shard] += p.bytes
    assert load[4] > 0.6 * sum(load.values()) / 5
    path = f"file://{tmp_path}/map"
    slot_sharding.write_map(spark, first, path)
    slot_sharding.write_map(spark, second, path)
    assert slot_sharding.read_map(spark, path) == sorted(second, key=lambda p: (p.slot, p.part)) and slot_sharding.read_map(spark, path, 1) == sorted(first, key=lambda p: (p.slot, p.part))


# Pseudonyms


def test_pseudonyms(spark, edges):
    names = feistel_pii.Pseudonyms(b"k" * 16)
    text = "call +1 (407) 555-7710 or mail jo.81@mail7.example.com, card 4111 1111 1111 1111 and 4111111111111111, from 169.122.221.182 on 2024-02-29, 02/29/2023, 31.12.1999; ssn 219-09-9999; GB82 WEST 1234 5698 7654 32"
    new, found = names.replaced(text)
    kinds = collections.Counter(k for k, _ in found)
    assert kinds == {"phone": 1, "email": 1, "card": 2, "ip": 1, "date": 2, "ssn": 1, "iban": 1}
    cards = [re.sub(r"\D", "", v) for k, v in found if k == "card"]
    assert cards[0] == cards[1] != "4111111111111111" and cards[0][0] == "4" and feistel_pii.luhn(cards[0]) == 0
    assert feistel_pii.mod97([v for k, v in found if k == "iban"][0].replace(" ", "")) == 1
    assert re.sub(r"[0-9A-Za-z]", "x", new) == re.sub(r"[0-9A-Za-z]", "x", text) or len(new) != len(text)
    assert "02/29/2023" in new and "jo.81@" not in new and "169.122.221.182" not in new
    assert feistel_pii.Pseudonyms(b"k" * 16, back=True).replaced(new)[0] == text
    for untouched in ("version 1.2.3.4.5", "9807915762804490", "300.1.1.1", "a 12 b", "2024-13-01", "000-12-3456", ""):
        assert names.replaced(untouched) == (untouched, [])
    f = feistel_pii.Feistel(b"q" * 16)
    assert sorted(f.below("t", x, 1000) for x in range(1000)) == list(range(1000))
    rows = feistel_pii.pseudonymised(edges, b"k" * 16).collect()
    assert sorted(map(str, ((x.doc_id, x.text) for x in rows))) == sorted(map(str, EDGES)) and all(x.n_found == 0 for x in rows)


def test_issuers_and_spacing_of_phone_numbers():
    names, back = feistel_pii.Pseudonyms(b"k" * 16), feistel_pii.Pseudonyms(b"k" * 16, back=True)
    for start, size in (("2221", 16), ("2720", 16), ("35", 16), ("300", 14), ("36", 14), ("38", 14), ("644", 16), ("649", 16), ("62", 19), ("6011", 16), ("4", 13), ("51", 16), ("37", 15)):
        body = start.ljust(size - 1, "7")
        card = body + str(-feistel_pii.luhn(body + "0") % 10)
        new, found = names.replaced(f"pay {card} now")
        assert [k for k, _ in found] == ["card"] and card not in new and len(found[0][1]) == size and found[0][1].startswith(start[:2] if start != "4" else "4")
        assert feistel_pii.luhn(found[0][1]) == 0 and back.replaced(new)[0] == f"pay {card} now"
    for forms in (("+49 30 12345678", "+493012345678", "+49-30-1234-5678", "+49 (0)30 12345678"), ("+1 (407) 555-7710", "+14075557710", "+1.407.555.7710"), ("+33 1 23 45 67 89", "+33123456789"), ("+358 40 1234567", "+358401234567")):
        got = [names.replaced(f"call {f}") for f in forms]
        assert len({re.sub(r"\D", "", new.replace("(0)", "")) for new, _ in got}) == 1 and all(len(found) == 1 for _, found in got)
        assert [back.replaced(new)[0] for new, _ in got] == [f"call {f}" for f in forms] and all(new != f"call {f}" for f, (new, _) in zip(forms, got))


def brute_found(text):
    """(kind, digits) of the values in a text of words, by splitting and checking instead of patterns."""

    def luhn_ok(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for word in text.split():
        digits = "".join(c for c in word if c in "0123456789")
        octets = word.split(".")
        if len(octets) == 4 and all(o.isdigit() and str(int(o)) == o and int(o) < 256 for o in octets):
            out.append("ip")
        elif len(word) == 10 and word[4] == word[7] == "-" and len(digits) == 8:
            y, m, d = map(int, word.split("-"))
            if 1900 <= y < 2100 and 1 <= m <= 12 and 1 <= d <= [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]:
                out.append("date")
        elif len(word) == 11 and word[3] == word[6] == "-" and len(digits) == 9:
            if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000":
                out.append("ssn")
        elif word == digits and len(word) == 16 and word[0] == "4" and luhn_ok(word):
            out.append("card")
        elif word.startswith("+") and word[1:] == digits and 8 <= len(digits) <= 15:
            out.append("phone")
    return out


def test_pseudonyms_against_a_plain_scanner(spark):
    r = random.Random(31)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    make = [
        lambda: "4" + d(15),
        lambda: ".".join(str(r.randrange(300)) for _ in range(4)),
        lambda: f"{r.randrange(1880, 2120)}-{r.randrange(14):02d}-{r.randrange(33):02d}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"+{r.choice('14')}{d(10)}",
        lambda: f"w{d(3)}",
        lambda: "word",
        lambda: d(r.randrange(1, 7)),
    ]
    rows = [(i, " ; ".join(r.choice(make)() for _ in range(r.randrange(40)))) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in feistel_pii.pseudonymised(docs, b"k" * 16).collect()}
    for i, text in rows:
        want = brute_found(text)
        assert [p.split(":")[0] for p in got[i].pseudonyms] == want and got[i].n_found == len(want), text
        assert brute_found(got[i].text) == want and len(got[i].text) == len(text) or "." in text
    back = feistel_pii.pseudonymised(spark.createDataFrame([(x.doc_id, x.text) for x in got.values()], SCHEMA), b"k" * 16, back=True).collect()
    assert {x.doc_id: x.text for x in back} == dict(rows)


def test_further_formats_of_personal_data():
    names, back = feistel_pii.Pseudonyms(b"k" * 16), feistel_pii.Pseudonyms(b"k" * 16, back=True)
    for text in ("at 1999-12-31T10:00:00Z sharp", "tel. 01 42 68 53 00 ou", "call (407) 555-7710 or", "call 407-555-7710.", "from 2001:db8:0:12::9:1 on", "from fe80:1:2:3:4:5:6:7"):
        new, found = names.replaced(text)
        assert len(found) == 1 and new != text and back.replaced(new)[0] == text, text
    for untouched in ("12:30:45", "std::vector a::b", "ratio 1:2:3:4:5", "10 20 30 40 50", "2001:db8:::1", "100-200-3000", "::"):
        assert names.replaced(untouched) == (untouched, [])
    for text, kinds in (("+12309516443 232.103.170.227", ["phone", "ip"]), ("531428 4111111111111111 232 5", ["card"]), ("GB82 WEST 1234 5698 7654 32 MORE TEXT", ["iban"])):
        new, found = names.replaced(text)
        assert [k for k, _ in found] == kinds and back.replaced(new)[0] == text
    tail = lambda s: re.sub(r"\D", "", names.replaced(s)[0])[-9:]
    assert tail("+33 1 42 68 53 00") == tail("01 42 68 53 00") and tail("+1 407 555 7710") == tail("(407) 555-7710")


# Language


def test_language(spark, edges, none):
    r = random.Random(7)
    stems = {"aa": "banana lemon rosa", "bb": "zwxqv krtsch pfnz", "cc": "ìlo eù uàe"}
    make = lambda k, n: " ".join(r.choice(stems[k].split()) + r.choice(stems[k].split()) for _ in range(n))
    rows = [(i, make(k, r.randrange(5, 80)), k) for i, k in enumerate(r.choice(["aa", "bb", "cc"]) for _ in range(300))]
    rows += [
        (900, make("aa", 60) + " " + make("bb", 40), None),
        (901, None, "aa"),
        (902, "", "aa"),
        (903, "12 34", "bb"),
        (904, "q", None),
        (905, "😀😀😀 🎉🎉", None),
        (906, "∑ 12 — !!!", None),
        (907, "😀 banana lemon rosabanana 😀", None),
        (908, "\U0001d4d0\U0001d4d1\U0001d4d2\U00020000", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_mixture.predict(docs).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows[:300]) >= 298
    assert set(got[900].languages) == {"aa", "bb"} and 0.45 < got[900].proportions[0] < 0.75 and got[900].lang_pred == "aa"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (901, 902, 903, 905, 906)) and all(got[i].lang_pred in stems for i in (904, 907, 908))
    assert all(got[i].held_out == (binascii.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert {x.lang_pred for x in language_mixture.predict(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_mixture.predict(none).count() == 0


def test_mixture_is_em_over_all_trigrams():
    """Proportions, likelihoods and the chosen set of languages against the plain recipe on small counts."""
    r = np.random.default_rng(6)
    names = ["aa", "bb", "cc", "dd", "ee", "ff"]
    counts = r.integers(0, 40, (6, language_mixture.BUCKETS)) * (r.random((6, language_mixture.BUCKETS)) < 0.2)
    mixture = language_mixture.Mixture(names, counts)
    p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    words = ["".join(r.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [" ".join(r.choice(words, n)) for n in (3, 40, 200)] + [None, "12"]
    got = mixture.infer(texts)
    assert got[3:] == [{}, {}]

    def em(grams, shares):
        for _ in range(language_mixture.ROUNDS):
            gained = np.zeros(6)
            for g in grams:
                parts = shares * p[:, g]
                gained += parts / parts.sum()
            shares = gained / len(grams)
        return shares, sum(np.log((shares * p[:, g]).sum()) for g in grams)

    for text, found in zip(texts[:3], got):
        grams = language_mixture.trigrams([text])[1].tolist()
        single = [sum(np.log(p[k, g]) for g in grams) for k in range(6)]
        order = np.argsort(-em(grams, np.full(6, 1 / 6))[0])
        chosen, score = [int(np.argmax(single))], max(single)
        shares = np.eye(6)[chosen[0]]
        while len(chosen) < 6:
            wider = [*chosen, next(int(k) for k in order if k not in chosen)]
            start = np.zeros(6)
            start[wider] = 1 / len(wider)
            new, likelihood = em(grams, start)
            if likelihood - score <= language_mixture.PENALTY * np.log(len(grams) + 1):
                break
            chosen, score, shares = wider, likelihood, new
        assert set(found) == {names[k] for k in chosen}
        assert all(abs(found[names[k]] - shares[k]) < 1e-3 for k in chosen)


# Toxicity


def brute_segments(scores):
    """All maximal scoring segments by the recursive definition."""
    best, at = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best + 1e-12 or at and abs(s - best) < 1e-12 and s > 0 and j - i < at[1] - at[0]:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_segments_are_maximal():
    r = random.Random(0)
    for _ in range(300):
        scores = [r.choice([-3, -2, -1, 1, 2, 5]) + r.random() / 100 for _ in range(r.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == brute_segments(scores)
    assert toxicity.segments([]) == [] and toxicity.segments([-1.0]) == []


def test_toxicity(spark, edges, labels, none):
    common.configure(spark)
    r = random.Random(11)
    rows, marks = [], []
    for i in range(600):
        words = noise(r, r.randrange(20, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["slurone", "slurtwo", "slurword" + r.choice("abcdefgh")]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs, truth = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_documents(docs, truth).collect()
    wrong = [x for x in got if x.held_out and x.predicted != int(x.doc_id % 5 == 0)]
    assert len(got) == 600 and len(wrong) <= 3 and all(0 <= x.score <= 1 for x in got)
    hit = next(x for x in got if x.predicted)
    assert any(t.startswith("slur") for t in toxicity.tokens_of(dict(rows)[hit.doc_id])[hit.first_token : hit.last_token])
    out = toxicity.score_documents(edges, labels).collect()
    assert len(out) == len(EDGES) and all(x.score is not None and x.held_out is not None for x in out)
    assert toxicity.score_documents(none, labels).count() == 0 and toxicity.score_documents(edges, labels.limit(0)).count() == len(EDGES)


def test_late_passages_are_found():
    """A dense passage late in a text of 20,000 words counts although its words stood alone before."""
    scorer = toxicity.Scorer({"bad": 3.0, "worse": 4.0})
    words = ["calm"] * 20_000
    for at in (100, 3000, 6000, 9000):
        words[at] = "bad"
        words[at + 500] = "worse"
    words[19_000:19_004] = ["bad", "worse", "bad", "worse"]
    n, found = scorer.passages(" ".join(words))
    assert n == 20_000 and (19_000, 19_004) in {(a, b) for a, b, _ in found} and max(g for *_, g in found) == 14.0
    assert scorer.scores(["bad"] * 5) == [3.0, 3.0, 3.0, toxicity.NEUTRAL, toxicity.NEUTRAL]


def test_scores_of_whole_documents(spark):
    """Evidence, passages and score from the weights by the plain recipe."""
    common.configure(spark)
    r = random.Random(17)
    rows = [(i, " ".join(r.choice(["calm", "plain", "dull", "grey"] + ["slur", "vile"] * (i % 4 == 0)) for _ in range(r.randrange(1, 60)))) for i in range(240)] + [(900, None), (901, "")]
    marks = [(i, int(i % 4 == 0)) for i in range(0, 240, 2)] + [(1, 0), (3, 0), (5, 0)]
    docs, truth = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int")
    train = {i: y for i, y in marks if binascii.crc32(str(i).encode()) % 3 != 1}
    counts = {0: collections.Counter(), 1: collections.Counter()}
    for i, text in rows:
        if i in train:
            own = collections.Counter(toxicity.tokens_of(text))
            for t, n in list(own.items()):
                for f in toxicity.families(t):
                    own[f] += n
            for t, n in own.items():
                counts[train[i]][t] += min(n, 3)
    n1, n0 = (sum(n for t, n in counts[y].items() if not t.startswith("^")) for y in (1, 0))
    prior, weights = 0.02 * (n1 + n0), {}
    for t in set(counts[0]) | set(counts[1]):
        y1, y0 = counts[1][t], counts[0][t]
        a = 0.02 * (y1 + y0)
        odds = lambda y, n: np.log((y + a) / (n + prior - y - a))
        delta = odds(y1, n1) - odds(y0, n0)
        if abs(delta) >= 1 and abs(delta / np.sqrt(1 / (y1 + a) + 1 / (y0 + a))) >= 3:
            weights[t] = min(8.0, max(-1.0, delta)) + toxicity.NEUTRAL
    got_weights, spread = toxicity.weighted(toxicity.counted(docs.join(spark.createDataFrame(list(train.items()), "doc_id long, label int"), "doc_id").select("label", F.col("text").alias("t"))))
    assert got_weights.keys() == weights.keys() and all(abs(got_weights[t] - w) < 1e-9 for t, w in weights.items()) and {"slur", "vile"} <= set(weights)
    lam, scorer = toxicity.decay(spread), toxicity.Scorer(got_weights)
    tops = [(len(toxicity.tokens_of(t)), max([0.0, *(sum(scorer.scores(toxicity.tokens_of(t))[a:b]) for a, b in brute_segments(scorer.scores(toxicity.tokens_of(t))))])) for i, t in rows if train.get(i) == 0 and t]
    k = (len(tops) + 1) / (sum(n * np.exp(-lam * s) for n, s in tops) + 1)
    got = {x.doc_id: x for x in toxicity.score_documents(docs, truth).collect()}
    for i, text in rows:
        tokens = toxicity.tokens_of(text)
        scores = scorer.scores(tokens)
        gains = [lam * sum(scores[a:b]) - np.log(k * max(1, len(tokens))) for a, b in brute_segments(scores)]
        gains = [g for g in gains if g > -np.log(toxicity.SIGNIFICANT)]
        assert got[i].passages == len(gains) and abs(got[i].evidence - sum(gains)) < 1e-6
    by = sorted(got.values(), key=lambda x: x.evidence)
    assert all(x.score <= y.score for x, y in zip(by, by[1:])) and by[0].score < 0.5 < by[-1].score


# Quality


def test_forward_pass_in_plain_loops():
    r = np.random.default_rng(2)
    net = attention_quality.Network(5)
    x, starts = r.standard_normal((7, 5)).astype(np.float32), np.array([0, 1, 4])
    w, p = net.w, net.forward(x, starts)[-1]
    for bag, rows in enumerate((x[0:1], x[1:4], x[4:7])):
        hidden = [[max(0.0, sum(row[i] * w["W"][i, j] for i in range(5)) + w["b"][j]) for j in range(attention_quality.HIDDEN)] for row in rows]
        gate = lambda h, m, k: sum(h[j] * m[j, k] for j in range(attention_quality.HIDDEN))
        e = [sum(np.tanh(gate(h, w["V"], k)) / (1 + np.exp(-gate(h, w["U"], k))) * w["a"][k] for k in range(attention_quality.GATE)) for h in hidden]
        share = np.exp(e) / np.exp(e).sum()
        z = sum(s * sum(h[j] * w["c"][j] for j in range(attention_quality.HIDDEN)) for s, h in zip(share, hidden)) + w["d"][0]
        assert abs(1 / (1 + np.exp(-z)) - p[bag]) < 1e-5


def test_quality(spark, edges, labels, none):
    common.configure(spark)
    r = random.Random(12)
    rows, marks = [], []
    for i in range(300):
        text = noise(r, r.randrange(20, 300))
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
        marks.append((i, int(i % 4 != 0)))
    got = attention_quality.score_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert sum(x.held_out and x.predicted != int(x.doc_id % 4 != 0) for x in got) <= 2
    out = attention_quality.score_documents(edges, labels).collect()
    assert len(out) == len(EDGES) and all(0 <= x.score <= 1 for x in out)
    assert attention_quality.score_documents(none, labels).count() == 0 and attention_quality.score_documents(edges, labels.limit(0)).count() == len(EDGES)


def test_gradients():
    r = np.random.default_rng(0)
    net = attention_quality.Network(6)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, starts, y = r.standard_normal((9, 6)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.forward(x, starts)[-1]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = net.gradients(x, starts, y)
    for k, g in grads.items():
        flat = net.w[k].reshape(-1)
        for j in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[j]
            flat[j] = old + 1e-5
            up = loss()
            flat[j] = old - 1e-5
            down = loss()
            flat[j] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[j]) < 1e-5, (k, j)


# Edge cases of what has no test of its own above


def test_edges_and_empty_tables(spark, edges, none):
    dedup = {x.doc_id: x for x in chunk_dedup.exact_duplicates(edges).collect() if x.doc_id is not None}
    assert dedup[1].keep_id == 3 and dedup[1].group_size == 3 and dedup[4].keep_id == 4 and not dedup[5].kept and dedup[7].keep_id == 7
    assert len(golay_simhash.near_duplicates(edges).collect()) == len(EDGES)
    left = golay_simhash.deduplicated(edges)
    assert left.columns == edges.columns and left.where("doc_id is null").count() == 1
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {x.doc_id for x in decontamination.leaks(edges, bench).collect()} == {6, 7}
    assert decontamination.leaks(edges, bench.limit(0)).count() == 0
    for f in (chunk_dedup.exact_duplicates, golay_simhash.near_duplicates, golay_simhash.deduplicated, slot_sharding.shard_documents):
        assert f(none).count() == 0
    assert feistel_pii.pseudonymised(none, b"k").count() == 0 and sentencepiece_codec.encode_digests(none, queries.PIECE_MODEL).count() == 0
