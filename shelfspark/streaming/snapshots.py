"""A keyed table as one compacted snapshot: a row for each key, in hash buckets, brought up to date by micro-batches.

Each batch rewrites the buckets that it touches and nothing else, as new files; a manifest of the batch names the version of every
bucket. Reading takes the last manifest and one folder for each bucket, however many batches there were. A batch that runs again
starts from the manifest before its own and replaces its files, so it changes nothing; rows are ordered by their own columns,
so batches may come in any order. Files that no kept manifest names are removed by vacuum().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Buckets of a new table; a table keeps the number it was made with.
BUCKETS = 32
MANIFEST = "bucket int, version long, buckets int"


def _entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, number) of the folders `name=number` under a path, by Hadoop's file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    names = [s.getPath().getName() for s in system.listStatus(target)]
    return [(n.partition("=")[0], int(n.partition("=")[2])) for n in names if "=" in n]


def manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[dict[int, int], int]:
    """(version of each bucket that has rows, number of buckets) after the last batch, or the last before a number."""
    numbers = [n for _, n in _entries(spark, f"{path}/manifests") if before is None or n < before]
    if not numbers:
        return {}, 0
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/batch={max(numbers)}").collect()  # a row for each bucket
    return {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}, max(r["buckets"] for r in rows)


def rows_of(spark: SparkSession, path: str, versions: dict[int, int], schema) -> DataFrame | None:
    folders = [f"{path}/rows/version={v}/bucket={b}" for b, v in versions.items()]
    return spark.read.schema(schema).parquet(*folders) if folders else None


def merge(batch: DataFrame, path: str, number: int, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Brings the table at path up to date with a batch: of each key the row that is last by the columns of `order` stays."""
    spark = batch.sparkSession
    versions, known = manifest(spark, path, number)
    buckets = known or buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    last = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    new = last(batch.select(*keys, *[c for c in batch.columns if c not in keys]))
    touched = {r[0] for r in new.select(bucket.alias("bucket")).distinct().collect()}  # at most one row for each bucket
    old = rows_of(spark, path, {b: v for b, v in versions.items() if b in touched}, new.schema)
    rows = (new if old is None else last(new.unionByName(old))).withColumn("bucket", bucket)
    rows.repartition(len(touched) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={number}")
    after = versions | {b: number for b in touched}
    entries = [(b, v, buckets) for b, v in after.items()] or [(-1, number, buckets)]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/batch={number}")
    if number == 0 or not _entries(spark, f"{path}/schema"):
        new.limit(0).write.mode("overwrite").parquet(f"{path}/schema/columns=0")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table: one row for each key. Reads one folder for each bucket."""
    schema = spark.read.parquet(f"{path}/schema/columns=0").schema
    versions, _ = manifest(spark, path)
    found = rows_of(spark, path, versions, schema)
    return spark.createDataFrame([], schema) if found is None else found


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes versions that none of the last `keep` manifests names, and older manifests; gives the versions removed.

    Batches up to the oldest kept manifest can't be run again after this.
    """
    numbers = sorted(n for _, n in _entries(spark, f"{path}/manifests"))
    kept = numbers[-keep:]
    used = {v for n in kept for v in manifest(spark, path, n + 1)[0].values()}
    gone = [v for _, v in _entries(spark, f"{path}/rows") if v not in used and v not in kept]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in [f"rows/version={v}" for v in gone] + [f"manifests/batch={n}" for n in numbers[:-keep]]:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        target.getFileSystem(conf).delete(target, True)
    return sorted(gone)


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
    """A stream whose micro-batches are merged into the table at path."""
    return stream.writeStream.foreachBatch(lambda batch, number: merge(batch, path, number, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
