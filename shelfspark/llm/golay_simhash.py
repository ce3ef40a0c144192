"""SimHash near-duplicate detection by Golay-code fuzzy hashing.

A fingerprint is cut into segments of at most 23 bits. The perfect binary Golay code puts every 23-bit word within three
bits of one codeword; the words next to a segment decode to one to six codewords, and two segments that differ in at most
two bits have one of them in common. Two fingerprints that differ in at most two bits have, by the pigeonhole principle,
a segment without an error whose successor has at most one; so equal values of a segment together with a shared codeword
of the next one find every such pair. A one-error neighbour's own codeword is always among the several codewords of the
other, so one side of the join needs one key for each segment and the other one to six.

A bucket that holds very many different fingerprints would pair them quadratically. Its fingerprints go another, exact
way: each emits the words within one bit, and those that meet at a word are within two bits of each other, so a star at
each word keeps the same components with a number of rows linear in the input.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import columns, components, map_rows, materialize, release, small_side

GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Different fingerprints under one key beyond which the bucket takes the linear way.
HEAVY = 48


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else (b" ".join(words),)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(seed)), dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words that have one byte set (3 tables), and the error pattern of each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [remainder(1 << b) for b in range(23)]
    tables = np.zeros((3, 256), np.int32)
    for t in range(3):
        for value in range(256):
            for b in range(8):
                if value >> b & 1 and 8 * t + b < 23:
                    tables[t, value] ^= single[8 * t + b]
    errors = np.zeros(2048, np.int32)
    for n in range(4):
        for bits in itertools.combinations(range(23), n):
            s = 0
            for b in bits:
                s ^= single[b]
            errors[s] = sum(1 << b for b in bits)
    return tables, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 data bits) of the codeword nearest to each 23-bit word."""
    tables, errors = golay()
    syndrome = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16]
    return (words ^ errors[syndrome]) >> 11


def near_codewords(words: np.ndarray) -> np.ndarray:
    """The indices of the codewords that a word and its 23 neighbours decode to, sorted, repeats as -1: shape (n, 24)."""
    flips = np.array([0, *(1 << b for b in range(23))], np.int32)
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def segment(fps: np.ndarray, i: int, segments=SEGMENTS) -> np.ndarray:
    start, size = segments[i]
    return (fps >> np.uint64(start) & np.uint64((1 << size) - 1)).astype(np.int32)


def keys(fps: np.ndarray, many: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each segment its value with the codewords of the next one; one codeword, or all near ones."""
    rows, out = [], []
    for i in range(len(SEGMENTS)):
        exact, follower = segment(fps, i).astype(np.int64), segment(fps, (i + 1) % len(SEGMENTS))
        codes = near_codewords(follower) if many else decode(follower)[:, None]
        r, c = np.nonzero(codes >= 0)
        rows.append(r)
        out.append(np.int64(i) << 36 | exact[r] << 12 | codes[r, c])
    return np.concatenate(rows), np.concatenate(out)


def key_table(fps: DataFrame, many: bool) -> DataFrame:
    """(fp, key) of a table of different fingerprints."""

    def run(batches):
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            r, k = keys(values.view(np.uint64), many)
            yield pa.RecordBatch.from_arrays([pa.array(values[r]), pa.array(k)], names=["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key long")


def near_words(fps: DataFrame) -> DataFrame:
    """(fp, word): every fingerprint with the 65 words within one bit of it."""

    def run(batches):
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = values.view(np.uint64)[:, None] ^ flips[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(values, 65)), pa.array(words.reshape(-1).view(np.int64))], names=["fp", "word"])

    return fps.select("fp").mapInArrow(run, "fp long, word long")


def links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp, each once) that differ in at most two bits.

    Gives every such pair from buckets of up to `heavy` fingerprints, and in larger ones a star that has the same
    components. No edge joins fingerprints that differ in more bits.
    """
    index, probe = key_table(fps, many=False), key_table(fps, many=True)
    sized = materialize(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("only")), "buckets")
    # a probe row under its own key meets itself: a bucket of one matters only to other fingerprints
    met = probe.join(sized, "key").where("n > 1 or only != fp")
    met = materialize(met.select("fp", "key", "n"), "probes")
    crowded = materialize(met.where(F.col("n") > heavy).select("key").distinct(), "crowded")
    few = met.where(F.col("n") <= heavy).select(F.col("fp").alias("a"), "key")
    pairs = few.join(index.select(F.col("fp").alias("b"), "key"), "key").where("a != b and bit_count(a ^ b) <= 2")
    edges = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    in_crowd = met.where(F.col("n") > heavy).select("fp").unionByName(index.join(crowded, "key", "left_semi").select("fp")).distinct()
    words = near_words(in_crowd)
    centres = words.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    star = words.join(centres, "word").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return edges.unionByName(star)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit number. Null counts as a text without words."""

    def work(b):
        return {"doc_id": b["i"], "fp": [signed(fingerprint(t, size)) for t in b["t"]]}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), lambda: work, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, size: int = 3, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents linked through fingerprints that differ in at most two bits.

    component_id is the smallest doc_id that can be reached, a document's own included. Null, empty and blank texts have
    fingerprint zero and are linked like any other; equal texts share a fingerprint; extra columns are ignored; an empty
    table gives no rows. A worker takes some twenty bytes for each byte of its longest text.
    """
    prints = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    grouped = components(links(own, heavy), "simhash-components").withColumnsRenamed({"node": "fp"})
    linked = grouped.join(own, "fp")
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = own.join(grouped, "fp", "left").join(smallest, "component", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# Near copies beyond two bits: an exact join of the texts' shingle sets by their rarest shingles.

SHINGLE, SIMILARITY = 5, 0.8
#: Shingles that a sample shows to be frequent come last in every text's order. One document in SAMPLE is counted; a shingle counts from twice on, and at most so many are known. Any order is exact; this one keeps buckets small.
SAMPLE, FREQUENT = 4, 1 << 20
#: Centres that a document is compared with in the first pass.
CENTRES = 3
#: Words, up to so many bytes long, whose hash a worker remembers: some ten megabytes.
REMEMBERED, SHORT = 1 << 16, 32


class WordHashes(dict):
    """Hash of each word, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_words = WordHashes()


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different n-word shingles; of its whole word sequence if it has fewer words."""
    words = text.encode().lower().split() if text else []
    n = min(n, max(1, len(words)))
    of_word = np.fromiter(map(_words.__getitem__, words or [b""]), np.uint64, max(1, len(words)))
    mixed = np.zeros(len(of_word) - n + 1, np.uint64)
    for k in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + of_word[k : k + len(mixed)]
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


def verified(pairs: DataFrame, docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets of n-word shingles have at least this Jaccard similarity. docs: (i, t)."""

    def work(b):
        keep = []
        for x, y in zip(b["ta"], b["tb"]):
            p, q = shingle_hashes(x, n), shingle_hashes(y, n)
            small, large = sorted((len(p), len(q)))
            shared = len(np.intersect1d(p, q, assume_unique=True)) if small >= similarity * large else 0
            keep.append(shared >= similarity * (len(p) + len(q) - shared) - 1e-9)
        return {"a": [x for x, k in zip(b["a"], keep) if k], "b": [x for x, k in zip(b["b"], keep) if k]}

    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct(), "pair-ids")
    texts = docs.join(small_side(needed), "i", "left_semi")
    both = pairs.join(texts.select(F.col("i").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("i").alias("b"), F.col("t").alias("tb")), "b")
    return map_rows(both.select("a", "b", "ta", "tb"), lambda: work, "a long, b long")


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted, and their counts) of the most frequent shingles of a sample of a table (i, t)."""

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t, n) for t in batch.column(0).to_pylist()]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int32))], names=["shingle", "n"])

    counted = docs.where(F.pmod(F.xxhash64("i", F.lit(29)), F.lit(SAMPLE)) == 0).select("t").mapInArrow(run, "shingle long, n int")
    several = materialize(counted.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").withColumn("level", F.floor(4 * F.log2("n"))), "several")
    # whole levels of frequency, the highest first, while they fit: no sort, and what comes to the driver is bounded
    least, total = None, 0
    for level, size in sorted(((r.level, r["count"]) for r in several.groupBy("level").count().collect()), reverse=True):
        total += size
        if total > FREQUENT:
            break
        least = level
    top = several.where(F.lit(False) if least is None else F.col("level") >= least).select("shingle", "n").toArrow()
    release(several)
    values, counts = top.column("shingle").to_numpy(), np.minimum(top.column("n").to_numpy(), (1 << 31) - 1).astype(np.int32)
    order = np.argsort(values)
    return values[order], counts[order]


def least_shared(size, other, similarity: float):
    """Shingles that sets of two sizes share if they have the similarity."""
    return similarity / (1 + similarity) * (size + other) - 1e-6


def prefixes(docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """(doc_id, mark, size, shingle, place, head) of a table (i, t): the rarest shingles of each text at which it may meet a similar one.

    Sets of this similarity have one of their rarest shingles in common, of as many as they may differ in and one more,
    by any order that holds for all texts. place counts in that order among all of a text's shingles, size is their
    number; mark tells different texts of one doc_id apart; head has these four of the smallest document at the shingle.
    At the first shingle that two sets share they share it and at most what comes after it in either, so a row whose
    text has too little left for the smallest set at its shingle is left out.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n))

    def run(batches):
        known, counts = frequent.value
        for batch in batches:
            ids, marks, sizes, found, places = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingle_hashes(t, n)
                size = len(hashes)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    hashes = hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")]
                kept = size - int(np.ceil(similarity * size - 1e-9)) + 1
                ids.append(np.full(kept, i, np.int64))
                marks.append(np.full(kept, signed(xxhash.xxh64_intdigest(t or "")), np.int64))
                sizes.append(np.full(kept, size, np.int32))
                found.append(hashes[:kept])
                places.append(np.arange(1, kept + 1, dtype=np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, marks, sizes, found, places)], names=["doc_id", "mark", "size", "shingle", "place"])

    rows = materialize(docs.select("i", "t").mapInArrow(run, "doc_id long, mark long, size int, shingle long, place int"), "prefixes")
    # most shingles are in one document: what the others have in common is worked out without these
    several = rows.groupBy("shingle").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last").select("shingle")
    shared = materialize(rows.join(several, "shingle", "left_semi"), "shared")
    release(rows)
    at = shared.groupBy("shingle").agg(F.min(F.struct("doc_id", "mark", "size", "place")).alias("head"), F.min("size").alias("smallest"))
    size, other = F.col("size"), F.greatest(F.ceil(F.col("size") * similarity - 1e-9), F.col("smallest"))
    met = shared.join(at, "shingle").where(1 + size - F.col("place") >= least_shared(size, other, similarity))
    out = materialize(met.drop("smallest"), "rarest")
    release(shared)
    return out


def may_be_similar(x: str, y: str, similarity: float):
    """Whether rows x and y (prefixes of column names) at one shingle, the first that they share, can have the similarity."""
    sizes, left = [F.col(f"{c}size") for c in (x, y)], [F.col(f"{c}size") - F.col(f"{c}place") for c in (x, y)]
    return (F.least(*sizes) >= similarity * F.greatest(*sizes)) & (1 + F.least(*left) >= least_shared(*sizes, similarity))


def nearest_heads(rarest: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each document of prefixes() with the few of its shingles' heads that it meets most often."""
    met = rarest.where((F.col("doc_id") != F.col("head.doc_id")) & may_be_similar("", "head.", similarity))
    pairs = met.groupBy(F.col("doc_id").alias("a"), F.col("head.doc_id").alias("b")).agg(F.count("*").alias("times"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("times"), "b"))
    return pairs.withColumn("k", best).where(F.col("k") <= CENTRES).select("a", "b")


def across(rarest: DataFrame, grouped: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a > b, of prefixes() in different groups (node, component) that may reach the similarity; none is missing.

    Documents that share a shingle are paired across groups only, and those of its largest group with the others, so a
    group of any number of copies gives rows in proportion to it.
    """
    rows = rarest.drop("head", "mark").join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("of", F.coalesce("component", "doc_id")).drop("component")
    largest = rows.groupBy("shingle", "of").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("of", F.struct("n", "of")).alias("main"), F.count("*").alias("groups"))
    mixed = rows.join(largest.where("groups > 1").select("shingle", "main"), "shingle")
    others = mixed.where("of != main").select("shingle", *(F.col(c).alias(f"other_{c}") for c in ("doc_id", "size", "place", "of")))
    met = mixed.join(others, "shingle").where("of != other_of and (of = main or doc_id > other_doc_id)").where(may_be_similar("", "other_", similarity))
    return met.select(F.greatest("doc_id", "other_doc_id").alias("a"), F.least("doc_id", "other_doc_id").alias("b")).distinct()


def crowded_pairs(docs: DataFrame, grouped: DataFrame, n: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of a table (i, t) in different groups (node, component) that may reach the similarity; none is missing."""
    return across(prefixes(docs, n, similarity), grouped, similarity)


def similar_links(docs: DataFrame, n: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges (a, b) of documents whose n-word shingles have at least this similarity; every such pair is connected by them.

    Candidates share one of their rarest shingles. First each document is compared with the smallest at its shingles, a
    few that it meets most often, so that large groups form from rows linear in the input; then all candidates in
    different groups are compared, which misses none. Rows without a doc_id have no edges; null and empty texts are alike.
    """
    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null")
    rarest = prefixes(source, n, similarity)
    nearest = materialize(nearest_heads(rarest, similarity), "nearest")
    found = materialize(verified(nearest, source, n, similarity), "verified")
    grouped = materialize(components(found, "similar-components"), "similar-groups")
    rest = materialize(across(rarest, grouped, similarity).join(nearest, ["a", "b"], "left_anti"), "rest")
    release(rarest)
    return found.unionByName(verified(rest, source, n, similarity))


def deduplicated(docs: DataFrame, size: int = 3, n: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, with one of each group of near copies: the one with the smallest doc_id.

    Linked are documents whose fingerprints differ in at most two bits, and those whose n-word shingles have at least
    the given similarity; a group is what links reach. Rows without a doc_id stay; rows with the same doc_id stay or go
    together.
    """
    own = near_duplicates(docs, size)
    edges = own.where("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    grouped = components(edges.unionByName(similar_links(docs, n, similarity)), "near-components")
    gone = materialize(grouped.where("node != component").select(F.col("node").alias("doc_id")), "near-copies")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(columns(docs))
