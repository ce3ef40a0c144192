"""Exact document deduplication by content-defined chunk recipes.

A rolling gear hash cuts each normalised text where its content says so; a chunk's identifier is a digest of its bytes.
A document's recipe is the ordered list of its chunks' identifiers: a few bytes for each thousand of text, and the only
thing that moves for a document without a twin. Documents with equal recipes are equal if equal identifiers mean equal
chunks. That is verified: the chunks of documents that share a recipe, each once for each task, are grouped by
identifier and compared byte by byte. If an identifier stands for different chunks, the documents that have it get
recipes from verified identifiers (digest and number of the chunk among those with that digest).
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, materialize, small_side

#: What normalisation deletes: [\x20\x09-\x0D].
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Mean chunk of 2^10 bytes behind a smallest one; a hash sees the 32 bytes before it.
MASK_BITS, SMALLEST, LARGEST, WINDOW = 10, 256, 8192, 32
#: Bytes of the recipes of texts with copies up to which they are broadcast.
KEY_BYTES = 64 << 20


@cache
def gear() -> np.ndarray:
    """A fixed random 32-bit number for each byte value."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def cuts(data: bytes) -> list[int]:
    """End positions of the chunks of data; the last is its length."""
    n = len(data)
    if n <= SMALLEST:
        return [n] if n else []
    h = gear()[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # the hash of twice as many bytes from that of two halves
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    places = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, at = [], 0
    for p in [*places.tolist(), n]:
        while p - at > LARGEST:
            at += LARGEST
            out.append(at)
        if p - at >= SMALLEST or p == n and p > at:
            at = p
            out.append(at)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def normalised(text: str | None) -> bytes:
    return text.encode().translate(None, BLANKS) if text else b""


def identifier(chunk: bytes, digest_size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=digest_size).digest()


def recipes(docs: DataFrame, digest_size: int = 16) -> DataFrame:
    """(doc_id, n_chars, text_sha256, recipe) of a table (i, t)."""

    def work(b):
        data = [normalised(t) for t in b["t"]]
        return {
            "doc_id": b["i"],
            "n_chars": [len(t) if t else 0 for t in b["t"]],
            "text_sha256": [hashlib.sha256(x).hexdigest() for x in data],
            "recipe": [b"".join(identifier(c, digest_size) for c in chunks(x)) for x in data],
        }

    return map_rows(docs, lambda: work, "doc_id long, n_chars long, text_sha256 string, recipe binary")


def chunk_store(docs: DataFrame, digest_size: int = 16) -> DataFrame:
    """(id, chunk): the chunks of a table (i, t), each once for each batch."""

    def work(b):
        found = {(identifier(c, digest_size), c) for t in b["t"] for c in chunks(normalised(t))}
        return {"id": [x for x, _ in found], "chunk": [c for _, c in found]}

    return map_rows(docs, lambda: work, "id binary, chunk binary")


def verified_recipes(docs: DataFrame, store: DataFrame, clashing: DataFrame, digest_size: int) -> DataFrame:
    """(text_sha256, exact) for the texts that have an identifier of several chunks: the recipe of verified identifiers."""

    def work(b):
        texts = [normalised(t) for t in b["t"]]
        rows = [(hashlib.sha256(x).hexdigest(), k, identifier(c, digest_size), c) for x in dict.fromkeys(texts) for k, c in enumerate(chunks(x))]
        return {"text_sha256": [r[0] for r in rows], "at": [r[1] for r in rows], "id": [r[2] for r in rows], "chunk": [r[3] for r in rows]}

    places = map_rows(docs, lambda: work, "text_sha256 string, at long, id binary, chunk binary").distinct()
    places = places.join(places.join(clashing, "id", "left_semi").select("text_sha256").distinct(), "text_sha256", "left_semi")
    numbered = store.distinct().join(clashing, "id", "left_semi").withColumn("number", F.dense_rank().over(Window.partitionBy("id").orderBy("chunk")))
    placed = places.join(numbered, ["id", "chunk"], "left").select("text_sha256", F.struct("at", F.hex("id").alias("id"), F.coalesce("number", F.lit(1)).alias("number")).alias("place"))
    return placed.groupBy("text_sha256").agg(F.array_sort(F.collect_list("place")).alias("places")).select("text_sha256", F.encode(F.to_json("places"), "UTF-8").alias("exact"))


def few_keys(keys: DataFrame, column: str) -> DataFrame:
    """A materialized table of recipes, marked for broadcast if its rows and bytes are few; a hot text then meets no shuffle."""
    size = keys.agg(F.sum(F.length(column))).first()[0] or 0
    return small_side(keys) if size <= KEY_BYTES else keys


def exact_duplicates(docs: DataFrame, digest_size: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; of equal texts the row with the
    most code points in the original text stays, then the smallest doc_id. Null counts as empty, and empty texts are
    equal to each other. Repeated rows are all kept or all dropped; a null doc_id comes last among equals, and rows with
    one doc_id and different texts are judged apart. Extra columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    made = materialize(recipes(source, digest_size), "recipes")
    shared = materialize(made.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1").select("recipe"), "shared-recipes")
    twins = materialize(made.join(few_keys(shared, "recipe"), "recipe", "left_semi").select(F.col("doc_id").alias("i")), "twins")
    again = source.join(twins, source["i"].eqNullSafe(twins["i"]), "left_semi")
    store = materialize(chunk_store(again, digest_size), "chunk-store")
    clashing = store.groupBy("id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low != high").select("id")
    clashing = materialize(clashing, "clashing")
    keyed = made.withColumn("key", F.col("recipe"))
    if not clashing.isEmpty():
        exact = verified_recipes(again, store, clashing, digest_size)
        keyed = made.join(exact, "text_sha256", "left").withColumn("key", F.when(F.col("exact").isNull(), F.concat(F.lit(b"\x00"), "recipe")).otherwise(F.concat(F.lit(b"\x01"), "exact")))
    # what all rows of a text have in common is worked out from partial aggregates; only keys of several rows are joined
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus")))
    groups = materialize(keyed.groupBy("key").agg(F.count("*").alias("rows"), best.alias("best")).where("rows > 1"), "groups")
    joined = keyed.join(few_keys(groups, "key"), "key", "left")
    out = joined.select("doc_id", F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(-F.col("best.minus")).alias("keep_id"), F.coalesce("rows", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
