"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record hashes, by its text, into one of thousands of slots that never change. Bytes and rows are aggregated per
slot; the map gives each slot to a shard so that shards' bytes are nearly equal, and rebalancing edits the map only.
Equal texts share a slot and so a shard, unless a slot alone outweighs a share of a shard (a text that a third of all
rows have): such a slot is split into parts by identifier and row, and its parts go to shards one by one.

The map has a row for each slot, plus parts of heavy slots and one more for each million rows of a slot, so its size is
bounded by the parameters and a millionth of the rows; it alone is collected and broadcast.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialize, shared_path

SLOTS, SPLIT_SHARE, PART_ROWS = 4096, 4, 1_000_000
MAP_SCHEMA = "version int, slot int, part int, parts int, shard int, bytes long, rows long, offset long"


@dataclass(frozen=True)
class Part:
    """A row of the map. offset: rows of the same shard in parts before it."""

    version: int
    slot: int
    part: int
    parts: int
    shard: int
    bytes: int
    rows: int
    offset: int = 0


def records(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, row), written and read again so that row, a number of each row, holds.

    Size: UTF-8 bytes of the text (null: none) plus one. With `whole`, the document's columns too, as a struct.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(n_slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")] * whole),
    )
    return materialize(made, "slot-records")


def with_parts(rows: DataFrame, per_slot: DataFrame) -> DataFrame:
    """Adds part, 0 where the slot isn't split. per_slot (virtual_slot, parts) is bounded by the number of slots."""
    return rows.join(F.broadcast(per_slot), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).cast("int"))


def placed(parts: list[Part], n_shards: int, limit: float) -> list[Part]:
    """Heaviest unit first to the lightest shard. A unit is a slot with all its parts, or one part of a slot over the limit."""
    units: dict[tuple[int, int], list[Part]] = {}
    weight: dict[int, int] = {}
    for p in parts:
        weight[p.slot] = weight.get(p.slot, 0) + p.bytes
    for p in parts:
        units.setdefault((p.slot, p.part if weight[p.slot] > limit else -1), []).append(p)
    load = [(0, s) for s in range(n_shards)]
    out = []
    for key in sorted(units, key=lambda k: (-sum(p.bytes for p in units[k]), k)):
        used, shard = heapq.heappop(load)
        heapq.heappush(load, (used + sum(p.bytes for p in units[key]), shard))
        out += [replace(p, shard=shard) for p in units[key]]
    return numbered(out)


def numbered(parts: list[Part]) -> list[Part]:
    """Sets the offsets: parts in the order of slot and part within a shard."""
    seen: dict[int, int] = {}
    out = []
    for p in sorted(parts, key=lambda p: (p.slot, p.part)):
        out.append(replace(p, offset=seen.get(p.shard, 0)))
        seen[p.shard] = seen.get(p.shard, 0) + p.rows
    return out


def grown(parts: list[Part]) -> list[Part]:
    """The next version of a map, with one more shard: slots move from the heaviest shards into the new one only, until it has its share."""
    new = max((p.shard for p in parts), default=-1) + 1
    share = sum(p.bytes for p in parts) / (new + 1)
    load: dict[int, int] = {}
    for p in parts:
        load[p.shard] = load.get(p.shard, 0) + p.bytes
    moved, got = set(), 0
    for p in sorted(parts, key=lambda p: (-p.bytes, p.slot, p.part)):
        if got + p.bytes <= share and load[p.shard] - p.bytes >= 0.98 * share - max(p.bytes, 0):
            if load[p.shard] > share:
                moved.add((p.slot, p.part))
                load[p.shard] -= p.bytes
                got += p.bytes
    return numbered([replace(p, version=p.version + 1, shard=new if (p.slot, p.part) in moved else p.shard) for p in parts])


def map_frame(spark: SparkSession, parts: list[Part]) -> DataFrame:
    return spark.createDataFrame([(p.version, p.slot, p.part, p.parts, p.shard, p.bytes, p.rows, p.offset) for p in parts], MAP_SCHEMA)


def write_map(spark: SparkSession, parts: list[Part], path: str) -> None:
    """Adds a version of the map to the table at path; versions before it stay readable."""
    map_frame(spark, parts).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[Part]:
    """A version of the map, the last if none is named."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    names = [f.split()[0] for f in MAP_SCHEMA.split(", ")]
    return sorted((Part(**r.asDict()) for r in table.where(F.col("version") == version).select(*names).collect()), key=lambda p: (p.slot, p.part))


def build_map(rows: DataFrame, n_shards: int, n_slots: int = SLOTS) -> list[Part]:
    """The first version of the map for the rows of records()."""
    per_slot = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most n_slots rows
    limit = max(1.0, sum(r.bytes for r in per_slot) / n_shards / SPLIT_SHARE)
    parts_of = [(r.virtual_slot, max(-(-r.bytes // int(limit)) if r.bytes > limit and r.rows > 1 else 1, -(-r.rows // PART_ROWS))) for r in per_slot]
    frame = rows.sparkSession.createDataFrame(parts_of, "virtual_slot int, parts int")
    stats = with_parts(rows, frame).groupBy("virtual_slot", "part", "parts").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # a row for each part
    return placed([Part(1, r.virtual_slot, r.part, r.parts, 0, r.bytes, r.rows) for r in stats], n_shards, limit)


def assigned(rows: DataFrame, parts: list[Part]) -> DataFrame:
    """rows with shard and slot, the row's place in its shard: gapless from 0."""
    frame = map_frame(rows.sparkSession, parts).withColumnRenamed("slot", "virtual_slot")
    of_slot = frame.select("virtual_slot", "parts").distinct()
    keyed = with_parts(rows, of_slot).drop("parts").join(F.broadcast(frame.select("virtual_slot", "part", "shard", "offset")), ["virtual_slot", "part"])
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "row"))
    return keyed.withColumn("slot", F.col("offset") + place - 1)


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, next_shard), one row per document.

    The law is `bytes`: shards' sizes are nearly equal. The map is stored in the shared folder and read from there: version 1
    places the rows, version 2 is its edit for one more shard, which next_shard has. grown_shard is null: which slots move
    depends on their sizes. Null and empty texts are equal and have size one; repeated rows are rows of their
    own; an empty table gives no rows; a shard may be empty if there are fewer slots in use than shards.
    """
    spark, rows = docs.sparkSession, records(docs, n_slots, id_col, text_col)
    path = shared_path(spark, "slot-map")
    write_map(spark, build_map(rows, n_shards, n_slots), path)
    write_map(spark, grown(read_map(spark, path, 1)), path)
    later = map_frame(spark, read_map(spark, path)).select(F.col("slot").alias("virtual_slot"), "part", F.col("shard").alias("next_shard"))
    out = assigned(rows, read_map(spark, path, 1)).join(F.broadcast(later), ["virtual_slot", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs under path/data, a folder for each shard, and the map under path/map; gives the assignment.

    Every row is written once, with all its columns, whether its identifier is null or repeated or not. The folders'
    column is `shard`, with underscores before it while docs have a column of that name.
    """
    rows = records(docs, SLOTS, id_col, text_col, whole=True)
    parts = build_map(rows, n_shards)
    placed_rows = assigned(rows, parts)
    folder = "shard"
    while folder.lower() in (c.lower() for c in docs.columns):
        folder = f"_{folder}"
    placed_rows.select("document.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(f"{path}/data")
    write_map(docs.sparkSession, parts, f"{path}/map")
    return placed_rows.select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot")
