"""What the training-data operators share: table access, the shared folder, Arrow settings and components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship, spread

#: Rows and bytes of one Arrow batch: bounds the memory of a Python worker whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Rows of a table of keys up to which it is broadcast.
BROADCAST_ROWS = 1 << 20


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and make the package importable in them."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master without one gets a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, remembered for clear()."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete what this session has written to the shared folder; results that still read it must be saved before."""
    while _written:
        delete(spark, _written.pop())


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet, with the writer's options, to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that was written under the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized table that no later step reads."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def small_side(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A materialized table of keys, marked for broadcast if it has few enough rows; else it is joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= limit else keys


_held: list[tuple[object, object]] = []


def held(key: object, make: Callable[[], object]):
    """make(), kept in this worker process until another key is asked for: a worker holds one operator's tables at a time."""
    if not _held or _held[0][0] != key:
        _held.clear()
        _held.append((key, make()))
    return _held[0][1]


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over columns as Python lists. make() runs once for each task and returns the function for a batch."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, target = make(), None
        for batch in batches:
            out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            if out and out[names[0]] is not None and len(out[names[0]]):
                target = target or arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=target.field(n).type) for n in names], schema=target)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


#: Arrow types of the column types that the operators' outputs use.
ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, ARROW[t]) for n, t in (f.strip().split(" ", 1) for f in schema.split(","))])


def crc_remainder(column: str, n: int):
    """crc32 of the identifier as text, modulo n: the fold of a row. A null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of an undirected edge list (a long, b long): (node, component), component the smallest node.

    Alternates the large-star and small-star rewirings, which keep connectivity and end with every node pointing at its
    component's minimum after about log(n) rounds. All rounds are joins and partial aggregates keyed by node; no
    neighbour list is gathered, so a star with millions of leaves is only a skewed join key. Each round's edges are
    written to the shared folder. Self loops, repeated edges and an empty table are allowed.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node moves to the node's minimum
        large = now.select(F.col("b").alias("u"), F.col("a").alias("v")).join(lowest.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: every smaller neighbour, and the node itself, move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        after = materialize(small, label)
        stamp = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(now)
        now = after
        if stamp == before or not stamp[0]:
            break
        before = stamp
    return now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component")).unionByName(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
