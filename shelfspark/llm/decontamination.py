"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every text is read in windows of about an item's length, one from each word on. A window's 64-bit fingerprint is the
majority over its words' hashes, kept as bit planes of counts, so that windows of twice the size come from adding two
planes. Window sizes are 1, 2, 3, 4, 6, 8, 12, 16, 24 ...: an item is looked for by its first, middle and last window of
the largest such size that it holds and, from eight words on, of the next smaller one, and by windows side by side, more
of them than edits that leave the similarity can touch, so that one of all these stays as it was wherever the edits are.
An edit before a window moves the item's place; the place is then shifted while the similarity grows. A fingerprint's four 16-bit blocks are indexed with all values at most one bit off;
fingerprints within seven bits have, by the pigeonhole principle, a block with at most one, so none is missed. What the
index gives is compared in all bits, and then by the weighted Jaccard similarity of the five-word shingles of the item
and of the text's words at its place.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import columns, held, map_rows, materialize, small_side

RADIUS, BLOCKS, BLOCK_BITS = 7, 4, 16
SHINGLE, SIMILARITY = 5, 0.8
#: Items and their characters in one pass over the documents; a larger benchmark takes several passes, so that what is broadcast
#: and a worker's index (some 16 kB an item of 40 words) are bounded.
ITEMS_AT_ONCE, CHARACTERS_AT_ONCE = 10_000, 3_000_000
#: Window starts that are worked on together.
STRETCH = 1 << 15

_word = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case."""
    return _word.findall(text.lower()) if text else []


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_sizes(longest: int) -> list[int]:
    sizes, n = [], 1
    while n <= longest:
        sizes.append(n)
        if n > 1 and 3 * n // 2 <= longest:
            sizes.append(3 * n // 2)
        n *= 2
    return sizes


def added(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two numbers of bit planes."""
    out, carry = [], None
    for i in range(max(len(x), len(y))):
        if i >= len(x) or i >= len(y):
            a = x[i] if i < len(x) else y[i]
            out.append(a if carry is None else a ^ carry)
            carry = None if carry is None else a & carry
            continue
        a, b = x[i], y[i]
        either = a ^ b
        if carry is None:
            out.append(either)
            carry = a & b
        else:
            out.append(either ^ carry)
            carry = a & b | either & carry
    return out if carry is None else [*out, carry]


def over(planes: list[np.ndarray], bound: int) -> np.ndarray:
    """Bits whose count is over the bound."""
    more, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for i in range(len(planes) - 1, -1, -1):
        if bound >> i & 1:
            equal &= planes[i]
        else:
            more |= equal & planes[i]
            equal &= ~planes[i]
    return more


def window_prints(hashes: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """Fingerprints of all windows of each size, by their start."""
    found, planes, n = {}, [hashes], 1
    while True:
        if n in sizes:
            found[n] = over(planes, n // 2)
        twice = len(hashes) - 2 * n + 1
        if twice < 1 or not any(s > n for s in sizes):
            half = None
        else:
            half = added([p[:twice] for p in planes], [p[n : n + twice] for p in planes])
        three = 3 * n
        if half is not None and three in sizes and len(hashes) >= three:
            m = len(hashes) - three + 1
            found[three] = over(added([p[:m] for p in half], [p[2 * n : 2 * n + m] for p in planes]), three // 2)
        if half is None:
            return found
        planes, n = half, 2 * n


def shingles(words: list[str], n: int = SHINGLE) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else Counter([tuple(words)] if words else [])


def anchors_of(length: int, sizes: list[int]) -> set[tuple[int, int]]:
    """(size, offset) of the windows by which an item of so many words is looked for; sizes: those that windows may have."""
    held = [s for s in sizes if s <= length]
    # below five words a window is no longer peculiar to an item, and such an item's one shingle bears no edit
    own = {held[-1], *(s for s in held[-2:] if s >= SHINGLE)}
    found = {(s, o) for s in own for o in (0, (length - s) // 2, length - s)}
    # both ends may be edited, and inside one place in twenty words touches two windows at most
    side = max((s for s in held if s * (length // 20 + 3) <= length), default=0)
    if side >= SHINGLE:
        found.update((side, o) for o in range(0, length - side + 1, side))
    return found


class Index:
    """Fingerprints of the items' windows in Hamming blocks; items as (item_id, words).

    whole is, where these items are a part of the benchmark, (its items with words, in how many of them each shingle is);
    a shingle it leaves out is in one item at most.
    """

    def __init__(self, items: list[tuple[int, list[str]]], threshold: float = SIMILARITY, whole: tuple[int, dict] | None = None):
        self.items = [(i, w) for i, w in items if w]
        self.threshold = threshold
        self.shingles = [shingles(w) for _, w in self.items]
        total, seen = whole or (len(self.items), Counter(s for c in self.shingles for s in c))
        self.weights = {s: 1 + math.log(total / n) for s, n in seen.items() if n > 1}
        self.rare = 1 + math.log(max(1, total))
        sizes = window_sizes(max((len(w) for _, w in self.items), default=0))
        anchors: dict[int, list[tuple[int, int, int]]] = {}  # by size: fingerprint, item, offset
        for at, (_, words) in enumerate(self.items):
            own = anchors_of(len(words), sizes)
            prints = window_prints(hashed(words), {size for size, _ in own})
            for size, offset in sorted(own):
                anchors.setdefault(size, []).append((int(prints[size][offset]), at, offset))
        self.by_size = {}
        off = [0, *(1 << b for b in range(BLOCK_BITS))]
        for size, rows in anchors.items():
            prints = np.array([r[0] for r in rows], np.uint64)
            blocks = []
            for b in range(BLOCKS):
                value = (prints >> np.uint64(BLOCK_BITS * b)).astype(np.int64) & (1 << BLOCK_BITS) - 1
                near = (value[:, None] ^ np.array(off)[None, :]).ravel()
                order = np.argsort(near, kind="stable")
                counts = np.bincount(near, minlength=1 << BLOCK_BITS)
                blocks.append((counts.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])[:-1], (order // len(off)).astype(np.int64)))
            self.by_size[size] = (prints, np.array([r[1:] for r in rows], np.int64), blocks)

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(place in the words, item) of all items that have a window within the radius."""
        found: set[tuple[int, int]] = set()
        sizes = set(self.by_size)
        reach = max(sizes, default=0)
        for begin in range(0, len(hashes), STRETCH):
            for size, prints in window_prints(hashes[begin : begin + STRETCH + reach - 1], sizes).items():
                mine, places, blocks = self.by_size[size]
                prints = prints[:STRETCH]
                for b, (counts, starts, rows) in enumerate(blocks):
                    value = (prints >> np.uint64(BLOCK_BITS * b) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
                    hit = np.flatnonzero(counts[value])
                    if not len(hit):
                        continue
                    n = counts[value[hit]]
                    window = np.repeat(hit, n)
                    inner = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
                    row = rows[np.repeat(starts[value[hit]], n) + inner]
                    near = np.bitwise_count(prints[window] ^ mine[row]) <= RADIUS
                    if near.any():
                        item, offset = places[row[near]].T
                        found.update(zip((begin + window[near] - offset).tolist(), item.tolist()))
        return found

    def similarity(self, words: list[str], item: int) -> float:
        """Weighted Jaccard similarity of an item's shingles and those of some words."""
        mine, theirs, weight = self.shingles[item], shingles(words), self.weights.get
        shared = sum(weight(s, self.rare) * min(n, theirs[s]) for s, n in mine.items() if s in theirs)
        total = sum(weight(s, self.rare) * n for s, n in mine.items()) + sum(weight(s, self.rare) * n for s, n in theirs.items())
        return shared / (total - shared) if total > shared else 1.0

    def placed(self, words: list[str], place: int, item: int) -> tuple[float, int]:
        """(similarity, first word) of an item at a place of a text, shifted while that brings it nearer to the threshold."""
        length = len(self.items[item][1])

        def at(p: int) -> float:
            return self.similarity(words[max(p, 0) : max(p + length, 0)], item)

        score = at(place)
        if self.threshold > score >= self.threshold / 2:
            for step in (-1, 1):
                p, s = place, score
                while s < self.threshold and (more := at(p + step)) > s:
                    p, s = p + step, more
                if s > score:
                    place, score = p, s
        return score, max(place, 0)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, float]]:
        """(number of the text, item_id, first word, similarity): the best place of each item in each text, at the threshold or over."""
        split = [words_of(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for place, item in self.candidates(hashed([w for x in split for w in x])):
            length = len(self.items[item][1])
            # the words of the text that the item would cover; a window over the end of a text is cut there
            middle = min(max(place + length // 2, 0), int(starts[-1]) - 1)
            text = int(np.searchsorted(starts, middle, "right")) - 1
            score, first = self.placed(split[text], place - int(starts[text]), item)
            if score >= self.threshold and (-score, first) < best.get((text, item), (1.0, 0)):
                best[text, item] = (-score, first)
        return [(text, self.items[item][0], first, -score) for (text, item), (score, first) in sorted(best.items())]


def shingles_of(benchmark: DataFrame) -> DataFrame:
    """(shingle): every item's different shingles."""

    def work(b):
        return {"shingle": [" ".join(s) for t in b["text"] for s in shingles(words_of(t))]}

    return map_rows(benchmark.select("text"), lambda: work, "shingle string")


def repeated_shingles(benchmark: DataFrame) -> tuple[int, DataFrame]:
    """(items with words, in how many items each shingle is that more than one holds), the latter as a table in the shared folder."""
    total = map_rows(benchmark.select("text"), lambda: lambda b: {"n": [sum(1 for t in b["text"] if words_of(t))]}, "n long").agg(F.sum("n")).first()[0]
    return total or 0, materialize(shingles_of(benchmark).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shingle-counts")


def counts_for(part: DataFrame, items: int, repeated: DataFrame) -> tuple[int, dict[tuple[str, ...], int]]:
    """What an index over a part of the benchmark needs of the whole: no more shingles than the part has."""
    found = shingles_of(part).distinct().join(repeated, "shingle").collect()
    return items, {tuple(r.shingle.split(" ")): r.n for r in found}


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): every item that a document holds, at its most similar place.

    A benchmark of more items or characters than a pass holds takes several passes; each broadcasts its own items and the counts
    of their shingles in the whole benchmark.
    An item of fewer than five words has one shingle, all its words; items without words are in no document. Null and
    empty texts hold nothing. Repeated rows of either table count as rows of their own; extra columns are ignored.
    """
    spark = docs.sparkSession
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-n // items_at_once), -(-size // CHARACTERS_AT_ONCE))
    # weights are those of the whole benchmark, however many passes it takes
    total, repeated = (0, None) if passes == 1 else repeated_shingles(benchmark)
    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    out = None
    for k in range(passes):
        part = benchmark if passes == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        items = spark.sparkContext.broadcast([(r.item_id, words_of(r.text)) for r in part.select("item_id", "text").collect()])
        whole = spark.sparkContext.broadcast(None if repeated is None else counts_for(part, total, repeated))

        def make(items=items, whole=whole, token=uuid.uuid4().hex):
            def work(b):
                found = held(token, lambda: Index(items.value, threshold, whole.value)).search(b["t"])
                return {"doc_id": [b["i"][r[0]] for r in found], "item_id": [r[1] for r in found], "first_word": [r[2] for r in found], "similarity": [round(r[3], 9) for r in found]}

            return work

        found = map_rows(source, make, "doc_id long, item_id long, first_word long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, that hold no benchmark item. Rows without a doc_id stay; rows of one doc_id stay or go together."""
    found = materialize(leaks(docs, benchmark, threshold).where("doc_id is not null").select("doc_id").distinct(), "leaking")
    return docs.join(small_side(found), "doc_id", "left_anti").select(columns(docs))
