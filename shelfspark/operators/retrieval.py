"""Retrieval over many queries at once: terms of queries, corpus statistics, ranks, fusion and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as lx, scoring, text

K1, B, PHRASE_BONUS = 1.2, 0.75, 0.75
#: Queries that are broadcast together; a larger set takes several passes over the data.
BLOCK = 1000


def in_blocks(queries: DataFrame, one: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """Union of one(part) over parts of a stated query set (column query_id), so that a broadcast part is bounded."""
    passes = max(1, -(-queries.count() // block))
    if passes == 1:
        return one(queries)
    out = None
    for k in range(passes):
        part = one(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k))
        out = part if out is None else out.unionByName(part)
    return out


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, form) of a table (query_id, query): every term with the document tokens that match it."""
    terms = queries.select("query_id", F.explode(F.array_distinct(text.lexical_tokens(F.col("query")))).alias("term"))
    c = F.col("term")
    forms = F.array_distinct(F.array_compact(F.array(c, F.concat(c, F.lit("s")), F.when(c.endswith("s"), F.substring(c, F.lit(1), F.length(c) - 1)))))
    return terms.select("query_id", "term", F.explode(forms).alias("form"))


def lexical_evidence(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score): scoring.lexical_score of every document for each of a stated set of queries (query_id, query), 0 included.

    No text leaves its task: a document's words are met once with the forms of all terms of a block of queries, and each
    query then looks at the few that are there.
    """
    plain = docs.select(id_col, text.normalize_search(F.coalesce(F.col(text_col), F.lit(""))).alias("plain"))

    def one(part: DataFrame) -> DataFrame:
        terms = query_terms(part).groupBy("query_id", "term").agg(F.collect_list("form").alias("forms")).groupBy("query_id").agg(F.collect_list("forms").alias("terms"))
        noise = text.lit_array(lx.LEXICAL_NOISE)
        asked = part.select("query_id", text.normalize_search(F.coalesce("query", F.lit(""))).alias("q")).join(terms, "query_id", "left")
        word = F.filter(F.array_distinct(F.flatten(F.flatten(F.collect_list("terms")))), lambda t: (F.length(t) > 1) & ~F.array_contains(noise, t))
        every = asked.agg(word.alias("words"))
        met = plain.crossJoin(F.broadcast(every)).select(id_col, "plain", F.replace("plain", F.lit(" ")).alias("tight"), F.array_intersect("words", F.split("plain", " ")).alias("there"))
        rows = met.crossJoin(F.broadcast(asked.withColumn("q_tight", F.replace("q", F.lit(" ")))))
        share = 0.65 * F.size(F.filter("terms", lambda forms: F.arrays_overlap(forms, F.col("there")))) / F.size("terms")
        whole = F.when(F.contains("plain", "q"), 0.2).otherwise(0.0) + F.when((F.length("q_tight") >= 4) & F.contains("tight", "q_tight"), 0.15).otherwise(0.0)
        none = (F.col("q") == "") | (F.col("plain") == "") | F.col("terms").isNull()
        return rows.select("query_id", id_col, F.when(none, 0.0).otherwise(F.least(share + whole, F.lit(1.0))).alias("score"))

    return in_blocks(queries, one)


def corpus_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df, tf): documents with each token, and its uses in all of them.

    A document counts its own distinct tokens where it lies, so one aggregate, partial in each task, gives both.
    """
    tokens = docs.select(text.lexical_tokens(F.col(text_col)).alias("tokens"))
    use = lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("tf"))
    once = lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("tf"))
    rows = tokens.select(F.explode(F.concat(F.transform("tokens", use), F.transform(F.array_distinct("tokens"), once))).alias("x")).select("x.*")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def ranked(scores: DataFrame, partition: str = "query_id", id_col: str = "id", floor: float = 0.0, limit: int | None = None) -> DataFrame:
    """Rank 1, 2, ... of the scores over a floor, best first and by id among equals."""
    rank = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc("score"), F.asc(id_col)))
    out = scores.where(F.col("score") > floor).withColumn("rank", rank)
    return out if limit is None else out.where(F.col("rank") <= limit)


def ranked_in_buckets(rows: DataFrame, key: str, bucket: Column, *order: Column) -> DataFrame:
    """rows with rank, their place among all of a key's rows: by bucket, a number that never falls along the order, and then by it.

    Rows meet in one task only with those of their bucket; of a key all that meets is a count for each bucket.
    """
    cut = rows.withColumn("_bucket", bucket)
    sizes = cut.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    return cut.withColumn("_place", place).join(starts, [key, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_place")).drop("_bucket", "_place", "_before")


#: Added to a rank before it divides its channel's weight.
RANK_OFFSET = 60


def weighed(channels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows (query_id, id, channel, rank) of positive rank with their channel's weight w."""
    pairs = [x for c, w in weights.items() for x in (F.lit(c), F.lit(max(0.0, float(w))))]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("channel")), F.lit(1.0)) if pairs else F.lit(1.0)
    return channels.where("rank > 0").withColumn("w", weight)


def rank_sums(channels: DataFrame, weights: dict[str, float], k: int = RANK_OFFSET) -> DataFrame:
    """(query_id, id, s): the sum over channels of weight / (k + rank)."""
    return weighed(channels, weights).groupBy("query_id", "id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("s"))


def other_channels(channels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, others): channels without a stated weight that a query's rows are in."""
    good = weighed(channels, weights)
    extra = good.where(~F.col("channel").isin(*weights)) if weights else good
    return extra.select("query_id", "channel").distinct().groupBy("query_id").agg(F.count("*").alias("others"))


def rank_total(weights: dict[str, float], others: Column, k: int = RANK_OFFSET) -> Column:
    """What rank_sums() gives a row that is first in every channel."""
    return (F.lit(sum(max(0.0, float(w)) for w in weights.values())) + F.coalesce(others, F.lit(0))) / (k + 1)


def reciprocal_rank_fusion(channels: DataFrame, weights: dict[str, float], k: int = RANK_OFFSET) -> DataFrame:
    """(query_id, id, rrf) over rows (query_id, id, channel, rank).

    The denominator counts every channel that is configured or seen, also where a row isn't in it; channels without a
    weight weigh 1, negative weights 0, and ranks that aren't positive are ignored.
    """
    summed = rank_sums(channels, weights, k).join(other_channels(channels, weights), "query_id", "left")
    return summed.select("query_id", "id", scoring.clamp(F.col("s") / rank_total(weights, F.col("others"), k)).alias("rrf"))


HYBRID_WEIGHTS = {"rrf": 0.4, "semantic": 0.25, "lexical": 0.12, "relevance": 0.18, "quality": 0.05}


def hybrid(signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the signals that a row has."""
    weights = weights or HYBRID_WEIGHTS
    return scoring.weighted_mean([(c, weights[name]) for name, c in signals.items()])


def gated(df: DataFrame, base: Column, gate: float, least: float = 0.0, query: str = "query_id") -> DataFrame:
    """Rows whose base score reaches the floor, with eligible: whether it is within a share of the query's best.

    The best is a grouped maximum, partial in each task, and joined back: no query's rows meet in one task.
    """
    kept = df.withColumn("base", base).where(F.col("base") >= least)
    top = kept.groupBy(query).agg(F.max("base").alias("top"))
    return kept.join(top, query).withColumn("eligible", F.col("base") >= F.col("top") * gate).drop("top")
