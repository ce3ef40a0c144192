"""An inverted index as tables of posting blocks with their largest impacts, and BM25 top-k that skips blocks.

Documents are cut into slices of a bounded number, those of like length together, since length decides how much a term can weigh.
A block has the postings of one term in one slice, so it is bounded however frequent the term is, and the largest tf / (tf + K) that
a document of the slice reaches for it (K by BM25 from its length). Blocks lie in folders by the term's hash: a search reads
those of its terms. Normalised texts are kept beside them, for phrases; `docs` isn't read again.

A search first sums, for each query and slice, the terms' largest impacts: no document of the slice can score more. The few best
slices of each query give its k-th score to beat; of the others only those are unpacked whose sum reaches it. Both sides of every join
are keyed by term and slice; no query's documents meet in one task before they are few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx, text
from ..session import shared_path, written
from .retrieval import B, K1, PHRASE_BONUS, in_blocks, query_terms

#: Documents of a slice, folders of blocks at least and at most, documents a folder should have, and steps of length (a power of
#: two has so many) that slices are made by.
SLICE, LEAST_BUCKETS, MOST_BUCKETS, PER_BUCKET, STEPS = 256, 4, 256, 20_000, 2
#: Slices of a query that are read first, and parts in which they are found.
FIRST, PARTS = 8, 64
#: Tokens whose postings one task counts and packs.
TOKENS_A_TASK = 2_000_000
#: What rounding may take from a bound.
SLACK = 1e-9


@dataclass
class PostingIndex:
    """blocks (term, slice, n, impact, ids, tfs, lengths, bucket), texts (id, length, plain), documents and mean length."""

    blocks: DataFrame
    texts: DataFrame
    documents: int
    mean_length: float
    buckets: int


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def tokens_of(plain: Column) -> Column:
    """The lexical tokens of a text that is normalised already."""
    return F.filter(F.split(plain, " "), lambda t: (F.length(t) > 1) & ~t.isin(*lx.LEXICAL_NOISE))


def impact(tf: Column, length: Column, mean: float) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / mean))


def packed(texts: DataFrame, mean: float, tasks: int) -> DataFrame:
    """(term, slice, n, impact, p): the blocks of texts (id, length, plain, slice).

    A text goes to its slice's task once; its postings are counted and packed there, so that only packed blocks move again.
    """
    sliced = texts.repartition(tasks, "slice").select("id", "length", "slice", F.explode(tokens_of(F.col("plain"))).alias("term"))
    counted = sliced.groupBy("term", "slice", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    posting = F.array_sort(F.collect_list(F.struct("id", "tf", "length")))
    return counted.groupBy("term", "slice").agg(F.count("*").alias("n"), F.max(impact(F.col("tf"), F.col("length"), mean)).alias("impact"), posting.alias("p"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PostingIndex:
    """The index of all documents; rows with one id are one document, a null text is empty."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), text.normalize_search(F.coalesce(F.col(text_col), F.lit(""))).alias("plain"))
    texts = written(plain.select("id", F.size(tokens_of(F.col("plain"))).alias("length"), "plain"), "texts")
    level = F.floor(F.log2(F.col("length") + 1) * STEPS).cast("int")
    levels = texts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()  # a row for each step of length
    documents, total = sum(r["n"] for r in levels), sum(r["tokens"] for r in levels)
    mean = max(1.0, total / documents) if documents else 1.0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, documents // PER_BUCKET))
    parts = F.create_map(*(F.lit(x) for r in levels for x in (r["level"], -(-r["n"] // SLICE)))) if levels else F.create_map(F.lit(0), F.lit(1))
    placed = texts.select("id", "length", "plain", (level.cast("long") * (1 << 40) + F.pmod(F.xxhash64("id"), F.element_at(parts, level))).alias("slice"))
    blocks = packed(placed, mean, max(spark.sparkContext.defaultParallelism, -(-total // TOKENS_A_TASK)))
    made = blocks.select("term", "slice", "n", "impact", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"), bucket(F.col("term"), buckets).alias("bucket"))
    path = shared_path(spark, "postings")
    made.repartition("bucket", F.pmod(F.xxhash64("slice"), F.lit(8))).sortWithinPartitions("bucket", "term", "slice").write.partitionBy("bucket").parquet(path)
    return PostingIndex(spark.read.schema(made.schema).parquet(path), texts, documents, mean, buckets)


def wanted(index: PostingIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, form, bucket) of a block of queries, small enough to be broadcast."""
    return query_terms(queries).withColumn("bucket", bucket(F.col("form"), index.buckets))


def bounds(index: PostingIndex, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, idf) and (query_id, slice, bound): no document of the slice scores more for the query."""
    terms = F.broadcast(forms.select("term", "form", "bucket").distinct())
    met = index.blocks.select(F.col("term").alias("form"), "bucket", "slice", "n", "impact").join(terms, ["bucket", "form"])
    by_slice = written(met.groupBy("term", "slice").agg(F.sum("n").alias("n"), F.sum("impact").alias("impact"), F.count("*").alias("forms")), "slices")
    # a document with two forms of a term counts once: only there the ids are looked at
    twice = by_slice.where("forms > 1").select("term", "slice")
    ids = index.blocks.select(F.col("term").alias("form"), "bucket", "slice", "ids").join(terms, ["bucket", "form"]).join(twice, ["term", "slice"])
    exact = ids.groupBy("term", "slice").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("df"))
    df = by_slice.join(exact, ["term", "slice"], "left").groupBy("term").agg(F.sum(F.coalesce(F.col("df").cast("long"), F.col("n"))).alias("df"))
    idf = written(df.select("term", F.log(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")
    asked = forms.select("query_id", "term").distinct()
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("size"))
    most = F.col("idf") * F.least(F.col("impact"), F.lit(1.0)) * (K1 + 1)
    summed = by_slice.join(F.broadcast(idf), "term").join(F.broadcast(asked), "term").groupBy("query_id", "slice").agg(F.sum(most).alias("most"), F.count("*").alias("terms"))
    # a phrase in a text brings its words in, but for the first and last, which may be parts of words
    bonus = F.when(F.col("terms") >= F.col("size") - 2, PHRASE_BONUS).otherwise(0.0)
    return idf, written(summed.join(F.broadcast(sizes), "query_id").select("query_id", "slice", (F.col("most") + bonus + SLACK).alias("bound")), "bounds")


def scored(index: PostingIndex, forms: DataFrame, idf: DataFrame, slices: DataFrame) -> DataFrame:
    """(query_id, id, base, terms): BM25 of the documents of (query_id, slice), and how many of the query's terms each has."""
    met = index.blocks.withColumnRenamed("term", "form").join(F.broadcast(forms), ["bucket", "form"]).join(slices, ["query_id", "slice"])
    rows = met.select("query_id", "term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p")).select("query_id", "term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
    tf = rows.groupBy("query_id", "id", "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    part = F.col("idf") * impact(F.col("tf"), F.col("length"), index.mean_length) * (K1 + 1)
    return tf.join(F.broadcast(idf), "term").groupBy("query_id", "id").agg(F.sum(part).alias("base"), F.count("*").alias("terms"))


def kth(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th best base of the queries that have so many."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base")))
    return scores.withColumn("r", rank).where(F.col("r") == k).select("query_id", F.col("base").alias("least"))


def search_block(index: PostingIndex, queries: DataFrame, k: int, digits: int) -> tuple[DataFrame, DataFrame]:
    forms = written(wanted(index, queries), "forms")
    idf, bound = bounds(index, forms)
    best = [F.desc("bound"), F.asc("slice")]
    near = bound.withColumn("part", F.pmod("slice", F.lit(PARTS))).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))).where(F.col("r") <= FIRST)
    first = written(near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("r") <= FIRST).select("query_id", "slice"), "first")
    start = written(scored(index, forms, idf, first), "first-slices")
    least = written(kth(start, k), "least")
    rest = bound.join(F.broadcast(least), "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 10.0**-digits)
    rest = rest.join(F.broadcast(first), ["query_id", "slice"], "left_anti").select("query_id", "slice")
    found = written(start.unionByName(scored(index, forms, idf, rest)), "scores")
    near = found.join(F.broadcast(written(kth(found, k), "least")), "query_id", "left").where(F.col("base") + PHRASE_BONUS >= F.coalesce("least", F.lit(0.0)) - 10.0**-digits)
    asked = queries.select("query_id", text.normalize_search(F.col("query")).alias("phrase")).where("phrase != ''")
    sizes = forms.groupBy("query_id").agg(F.countDistinct("term").alias("size"))
    may = written(near.join(F.broadcast(sizes), "query_id").where("terms >= size - 2").select("query_id", "id"), "phrases")
    if may.isEmpty():
        whole = may.withColumn("bonus", F.lit(PHRASE_BONUS)).limit(0)
    else:
        whole = may.join(F.broadcast(asked), "query_id").join(index.texts.select("id", "plain"), "id").where(F.contains("plain", "phrase")).select("query_id", "id").distinct().withColumn("bonus", F.lit(PHRASE_BONUS))
    out = near.join(whole, ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("base") + F.coalesce("bonus", F.lit(0.0)), digits).alias("score")).where("score > 0")
    report = bound.groupBy("query_id").agg(F.count("*").alias("slices")).join(rest.unionByName(first.select("query_id", "slice")).groupBy("query_id").agg(F.count("*").alias("slices_read")), "query_id")
    return out, report


def search(index: PostingIndex, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each of a stated set of queries (query_id, query), score over 0, the smallest id among equals."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    found = in_blocks(queries, lambda part: search_block(index, part, k, digits)[0])
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def slices_read(index: PostingIndex, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, slices, slices_read): slices that have a term of each query, and those whose blocks a search unpacks."""
    return in_blocks(queries, lambda part: search_block(index, part, k, digits)[1])
