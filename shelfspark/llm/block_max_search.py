"""Ranked lexical search: Block-Max MaxScore over an inverted index of segments.

Index. A task turns its documents into segments of a bounded number of text bytes. A segment is one row: the ids and term
counts of its documents, its terms in order, and for each term a list of postings in blocks of 64. A block is packed (gaps
of document places and term frequencies in as few bytes as its largest needs) and has, unpacked, its first and last place,
its highest frequency and its shortest document. Nothing is shuffled: a term or document that holds most of the corpus is
spread over the segments. The index holds every term of every document and is a table in the shared folder.

Search. Two numbers of the whole corpus and the document frequencies of the queries' terms are summed over the segments.
Then every task answers all queries on its segments and keeps a heap for each:

1. a list's bound is its weight times its best block's; lists in ascending order of bounds whose sum is below the heap's
   lowest score are non-essential: they alone can't bring a document in. Candidates come from the essential lists only,
   without the blocks that can't reach the score even with all other lists' bounds.
2. non-essential lists are taken from the highest bound down. A candidate is rejected as soon as its score and the bounds
   of the lists left don't reach the lowest score; before a block is unpacked, its own maximum takes the list's place in
   that sum, so blocks of rejected candidates stay packed.

The heaps of the shards are merged in two steps, first within buckets of shards, then by query. Scores are integers by the
contract of op13; bounds use the same formula on a block's highest frequency and shortest document, so none is too low.

Edge cases: null texts and queries have no terms; rows of one item are one query over all their terms; repeated documents
are ranked as rows of their own; a null doc_id ranks behind others of its score; empty tables give no rows; extra columns
are ignored. Queries are answered in as many passes as their terms need; a text is counted in stretches, so memory is a
small multiple of one text's bytes.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, release

#: Bytes of texts and documents of a segment, postings of a block, bytes of a text that are counted at once.
SEGMENT_BYTES, SEGMENT_DOCS, BLOCK, STRETCH = 8 << 20, 1 << 16, 64, 1 << 20
#: Terms of queries (each query's counted) that one pass holds; buckets of shards whose heaps meet first.
TERMS_AT_ONCE, BUCKETS = 250_000, 64
#: Everything but letters, digits and what lies above ASCII separates terms; A-Z are lower-cased.
TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
NO_ID = (1 << 63) - 1
#: A segment is a row group of its own: Parquet else looks at the size of a group and of its pages after a hundred rows, so
#: that writer and reader hold all segments of a task at once.
ONE_BY_ONE = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}

FIELDS = [("documents", pa.int64()), ("terms_total", pa.int64())] + [(n, pa.binary()) for n in ("ids", "lengths", "terms", "df", "list_at", "first", "last", "count", "top", "least", "gap_at", "gap_width", "tf_at", "tf_width", "gaps", "tfs")]
INDEX = pa.schema(FIELDS)
INDEX_DDL = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary'}" for n, t in FIELDS)
#: Types of the unpacked arrays.
KINDS = {"ids": "<i8", "lengths": "<i8", "df": "<i4", "list_at": "<i4", "first": "<i4", "last": "<i4", "count": "<i4", "top": "<i8", "least": "<i8", "gap_at": "<i4", "gap_width": "<i1", "tf_at": "<i4", "tf_width": "<i1", "gaps": "<u1", "tfs": "<u1"}


def counted(text: bytes | None) -> Counter:
    """The terms of a text (UTF-8) with their occurrences."""
    found: Counter = Counter()
    if not text:
        return found
    plain = text.translate(TERM_BYTES)
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + STRETCH)
        stop = len(plain) if stop < 0 else stop
        found.update((plain[start:stop] if start or stop < len(plain) else plain).split())
        start = stop
    return found


def packed(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, place of each block in them, and bytes a value of each block: as few as its largest needs."""
    width = np.digitize(np.maximum.reduceat(values, starts), [1 << 8, 1 << 16, 1 << 24]) + 1
    each = np.repeat(width, counts)
    at = np.cumsum(each) - each
    out = np.zeros(int(each.sum()), np.uint8)
    for k in range(int(width.max())):
        has = each > k
        out[at[has] + k] = values[has] >> (8 * k) & 255
    return out, at[starts], width


def segment(ids: array, lengths: array, places: array, local: array, tfs: array, names: dict[bytes, int], with_terms: int, total: int) -> dict:
    """One row of the index. places, local, tfs: document place, term by order of appearance and frequency of each posting."""
    terms = sorted(names)
    rank = np.empty(len(terms), np.int64)
    rank[[names[t] for t in terms]] = np.arange(len(terms))
    term = rank[np.frombuffer(local, np.int64)]
    order = np.argsort(term, kind="stable")
    place, tf, term = np.frombuffer(places, np.int64)[order], np.frombuffer(tfs, np.int64)[order], term[order]
    df = np.bincount(term, minlength=len(terms))
    ends = np.cumsum(df)
    blocks = -(-df // BLOCK)
    list_at = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.repeat(ends - df, blocks) + BLOCK * (np.arange(list_at[-1]) - np.repeat(list_at[:-1], blocks))
    counts = np.minimum(BLOCK, np.repeat(ends, blocks) - starts)
    gaps = np.diff(place, prepend=0)
    gaps[starts] = 0
    gap_bytes, gap_at, gap_width = packed(gaps, starts, counts)
    tf_bytes, tf_at, tf_width = packed(tf, starts, counts)
    columns = {
        "ids": ids, "lengths": lengths, "df": df, "list_at": list_at, "first": place[starts], "last": place[starts + counts - 1], "count": counts,
        "top": np.maximum.reduceat(tf, starts), "least": np.minimum.reduceat(np.frombuffer(lengths, np.int64)[place], starts),
        "gap_at": gap_at, "gap_width": gap_width, "tf_at": tf_at, "tf_width": tf_width, "gaps": gap_bytes, "tfs": tf_bytes,
    }
    return {"documents": with_terms, "terms_total": total, "terms": b" ".join(terms)} | {n: np.asarray(v).astype(KINDS[n]).tobytes() for n, v in columns.items()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents that have a term: one row per segment, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            return [array("q") for _ in range(5)], {}, 0

        def row():
            ids, lengths, places, local, tfs = columns
            made = segment(ids, lengths, places, local, tfs, names, len(ids), sum(lengths))
            return pa.RecordBatch.from_pylist([made], schema=INDEX)

        columns, names, size = fresh()
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = counted(text)
                if not found:
                    continue
                if columns[0] and (size + len(text) > SEGMENT_BYTES or len(columns[0]) >= SEGMENT_DOCS):
                    yield row()
                    columns, names, size = fresh()
                ids, lengths, places, local, tfs = columns
                places.extend([len(ids)] * len(found))
                ids.append(NO_ID if id_ is None else id_)
                lengths.append(found.total())
                local.extend([names.setdefault(t, len(names)) for t in found])
                tfs.extend(found.values())
                size += len(text)
        if columns[0]:
            yield row()

    return materialize(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, INDEX_DDL), "segments", **ONE_BY_ONE)


class Segment:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict, wanted: set[bytes] | dict, n: int, total: int):
        self.x = {name: np.frombuffer(row[name], kind) for name, kind in KINDS.items()}
        x = self.x
        self.place_of = {t: i for i, t in enumerate(row["terms"].split(b" ")) if t in wanted}
        self.norm = 10 + 90 * x["lengths"] * n // total
        self.best = self.saturated(x["top"], 10 + 90 * x["least"] * n // total)  # of each block
        self.best_of_list = np.maximum.reduceat(self.best, x["list_at"][:-1])
        self.acc = np.zeros(len(x["ids"]), np.int64)
        self.read = 0

    @staticmethod
    def saturated(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * norm)

    def unpacked(self, which: np.ndarray, bytes_: str, at: str, width: str) -> np.ndarray:
        counts, each = self.x["count"][which], self.x[width][which].astype(np.int64)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place, each = np.repeat(self.x[at][which], counts) + inside * np.repeat(each, counts), np.repeat(each, counts)
        out = self.x[bytes_][place].astype(np.int64)
        for k in range(1, int(each.max())):
            has = each > k
            out[has] |= self.x[bytes_][place[has] + k].astype(np.int64) << (8 * k)
        return out

    def postings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document places and saturated frequencies of blocks, and the postings of each."""
        self.read += len(which)
        counts = self.x["count"][which]
        run = np.cumsum(self.unpacked(which, "gaps", "gap_at", "gap_width"))
        starts = np.cumsum(counts) - counts
        places = run + np.repeat(self.x["first"][which] - run[starts], counts)
        return places, self.saturated(self.unpacked(which, "tfs", "tf_at", "tf_width"), self.norm[places]), counts

    def search(self, query: list[tuple[bytes, int]], k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The heap (scores, ids; the best first) with this segment's documents."""
        lists = [(self.place_of[t], w) for t, w in query if w and t in self.place_of]
        if not lists:
            return scores, ids
        x, acc = self.x, self.acc
        term, weight = np.array(lists, np.int64).T
        bound = weight * self.best_of_list[term]
        order = np.argsort(bound, kind="stable")
        term, weight, bound = term[order], weight[order], bound[order]
        below = np.concatenate([[0], np.cumsum(bound)])  # of the lists before each, and of all
        lowest = max(1, int(scores[k - 1])) if len(scores) >= k else 1
        essential = int(np.searchsorted(below[1:], lowest))
        if essential == len(term):
            return scores, ids
        # candidates
        begin, end = x["list_at"][term[essential:]], x["list_at"][term[essential:] + 1]
        sizes = end - begin
        which = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        of = np.repeat(np.arange(essential, len(term)), sizes)
        reach = weight[of] * self.best[which] + below[-1] - bound[of] >= lowest
        which, of = which[reach], of[reach]
        if not len(which):
            return scores, ids
        places, values, counts = self.postings(which)
        np.add.at(acc, places, np.repeat(weight[of], counts) * values)
        touched = [places]
        found = np.flatnonzero(acc) if len(places) > len(acc) // 8 else np.unique(places)
        if len(found) >= k:
            lowest = max(lowest, int(np.partition(acc[found], len(found) - k)[len(found) - k]))
        found = found[acc[found] + below[essential] >= lowest]
        for j in range(essential - 1, -1, -1):
            if not len(found):
                break
            begin, end = x["list_at"][term[j]], x["list_at"][term[j] + 1]
            block = begin + np.searchsorted(x["last"][begin:end], found)
            may = block < end
            block = np.minimum(block, end - 1)
            may &= x["first"][block] <= found
            reach = acc[found] + np.where(may, weight[j] * self.best[block], 0) + below[j] >= lowest
            found, block = found[reach], block[reach & may]
            if len(block):
                places, values, _ = self.postings(np.unique(block))
                acc[places] += weight[j] * values
                touched.append(places)
        found = found[acc[found] >= lowest]
        new_scores, new_ids = np.concatenate([scores, acc[found]]), np.concatenate([ids, x["ids"][found]])
        for places in touched:
            acc[places] = 0
        top = np.lexsort((new_ids, -new_scores))[:k]
        return new_scores[top], new_ids[top]


def frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the terms, summed over the segments."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                df = np.frombuffer(row["df"], KINDS["df"])
                hits = [(t, int(df[i])) for i, t in enumerate(row["terms"].split(b" ")) if t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in hits], pa.binary()), pa.array([n for _, n in hits], pa.int64())], names=["term", "df"])

    found = index.select("terms", "df").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in found.collect()}


def heaps(index: DataFrame, queries: list[list[tuple[bytes, int]]], n: int, total: int, k: int) -> DataFrame:
    """The best documents of each shard (task) for each query: (query, doc_id, score, bucket)."""
    wanted = {t for q in queries for t, _ in q}

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                part = Segment(batch.slice(i, 1).to_pylist()[0], wanted, n, total)
                best = [part.search(q, k, *found) for q, found in zip(queries, best, strict=True)]
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), sizes)), pa.array(np.concatenate([d for _, d in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long").withColumn("bucket", F.spark_partition_id() % BUCKETS)


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank, doc_id, score): the k best documents of each item, score over 0, equal scores by ascending doc_id."""
    spark = index.sparkSession
    n, total = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms_total"), F.lit(0))).first()
    low = F.translate(F.coalesce(text_col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(id_col), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1))).alias("term")).distinct()
    words = materialize(words, "query-terms")
    passes = max(1, -(-words.count() // TERMS_AT_ONCE))
    out = None
    for p in range(passes if total else 0):
        part = words.where(F.pmod(F.xxhash64(id_col), F.lit(passes)) == p).groupBy(id_col).agg(F.collect_list("term").alias("terms")).collect()
        df = frequencies(index, {t.encode() for r in part for t in r["terms"]})
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
        queries = [[(t.encode(), weight[t.encode()]) for t in sorted(r["terms"]) if t.encode() in weight] for r in part]
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(part)], f"query long, `{id_col}` {items.schema[id_col].dataType.simpleString()}")
        best = materialize(heaps(index, queries, n, total, k).join(F.broadcast(names), "query").drop("query"), "heaps")
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], f"doc_id long, score long, bucket int, `{id_col}` {items.schema[id_col].dataType.simpleString()}")
    order = [F.desc("score"), F.asc("doc_id")]
    near = out.withColumn("rank", F.row_number().over(Window.partitionBy(id_col, "bucket").orderBy(*order))).where(F.col("rank") <= k)
    merged = near.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col("rank") <= k)
    return merged.select(id_col, "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index, search, and drop the index."""
    index = build_index(docs)
    found = search(index, items, k)
    release(index)
    return found
