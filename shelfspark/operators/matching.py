"""Matching of a batch of offers to products: candidates, verdicts of a judge, and claims in rounds.

Every source's batch is matched in its own order: an offer takes its best product that no earlier offer of its source has
taken and that has no offer of that source yet. The order of a batch is the same for all products, so the result is that of
rounds in which each offer proposes to the best product left to it and each (product, source) keeps the earliest proposer:
who loses proposes to its next product, also where that puts out a later offer. All sources go through the rounds together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring, text
from ..session import written
from . import entity

#: Similarity from which a product is taken without a judge, from which a judge is asked, and from which it is taken if the judge is silent.
SURE, POSSIBLE, SILENT = 0.86, 0.78, 0.82
#: Seconds that a verdict is good for.
VERDICT_SECONDS = 24 * 60 * 60
VERDICTS = "pair_key string, same boolean, judged_at timestamp"


def title_pair_key(a: Column, b: Column) -> Column:
    """The same key for a pair of titles in either order."""
    x, y = (F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")) for c in (a, b))
    return F.concat_ws("||", F.least(x, y), F.greatest(x, y))


def batched_judge(decide: Callable[[pd.DataFrame], list[bool | None]]) -> Callable[[DataFrame], DataFrame]:
    """A judge from a function that is given pairs in batches (title, price_minor, p_title, p_price): True, False or None for each.

    The function is called in the workers, once for each Arrow batch, so a model that is loaded in it can be kept by its module.
    """

    def judge(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"pair_key": batch["pair_key"], "same": pd.Series(decide(batch), dtype="boolean", index=batch.index)})

        return pairs.mapInPandas(run, "pair_key string, same boolean")

    return judge


def silent(pairs: DataFrame) -> DataFrame:
    """The judge that never answers."""
    return pairs.select("pair_key", F.lit(None).cast("boolean").alias("same"))


def candidates(batch: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """(listing_id, source, ord, place, product_id, step, score, pair_key, title, price_minor, p_title, p_price): the products of each offer, best first.

    batch and members: listing_id, source, url, hash, embedding (unit vector), title, price_minor; batch: ord, members:
    product_id; products: product_id, title. First products with an offer of the same number in its address, then those
    with an image within six bits at a fitting price of that offer, then by cosine to the centre of their offers, at a
    price that fits their median, among those with a compatible title and at least POSSIBLE.
    """
    taken = members.select("product_id", "source").distinct()
    number = lambda df, *more: df.select(text.extract_asin(F.col("url")).alias("number"), *more).where("number is not null").distinct()
    by_number = number(batch, "listing_id").join(number(members, "product_id"), "number").select("listing_id", "product_id", F.lit(1).alias("step"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("first"))
    hashes = lambda df: df.where("hash is not null").select(F.col("listing_id").alias("id"), "hash")
    theirs = members.select(F.col("listing_id").alias("right_id"), "product_id", F.col("price_minor").alias("other"))
    met = entity.hamming_pairs(hashes(batch), hashes(members)).join(theirs, "right_id").join(batch.select(F.col("listing_id").alias("left_id"), "price_minor"), "left_id")
    by_image = met.where(scoring.price_fit(F.col("price_minor"), F.col("other").cast("double"))).groupBy(F.col("left_id").alias("listing_id"), "product_id").agg(F.min("right_id").alias("first"))
    by_image = by_image.select("listing_id", "product_id", F.lit(2).alias("step"), F.lit(1.0).alias("score"), "first")
    medians = entity.price_medians(members, "product_id", "price_minor")
    known = entity.centroids(members.where("embedding is not null"), "product_id", "embedding").join(products.select("product_id", F.col("title").alias("p_title")), "product_id").join(medians, "product_id", "left")
    blocked = entity.title_candidates(batch.select(F.col("listing_id").alias("id"), "title"), products.select(F.col("product_id").alias("id"), "title"))
    full = blocked.withColumnsRenamed({"left_id": "listing_id", "right_id": "product_id"}).join(batch, "listing_id").join(known, "product_id")
    same = text.identity_compatible(*(f(F.col(c)) for c in ("title", "p_title") for f in (text.identity_tokens, text.identity_words)))
    score = F.round(scoring.dot(F.col("embedding"), F.col("centroid")), 9)
    by_centre = full.where(same & scoring.price_fit(F.col("price_minor"), F.col("median"))).select("listing_id", "product_id", F.lit(3).alias("step"), score.alias("score"), F.lit(0).cast("long").alias("first")).where(F.col("score") >= POSSIBLE)
    # a product is met once, by the first step that finds it
    best = by_number.unionByName(by_image).unionByName(by_centre).groupBy("listing_id", "product_id").agg(F.min_by(F.struct("step", "score", "first"), "step").alias("b")).select("listing_id", "product_id", "b.*")
    free = best.join(batch.select("listing_id", "source", "ord", "title", "price_minor"), "listing_id").join(taken, ["product_id", "source"], "left_anti")
    ranked = free.withColumn("place", F.row_number().over(Window.partitionBy("listing_id").orderBy("step", F.desc("score"), "first", "product_id")))
    asked = (F.col("step") == 3) & (F.col("score") < SURE)
    named = ranked.join(products.select("product_id", F.col("title").alias("p_title")), "product_id", "left").join(medians.select("product_id", F.col("median").alias("p_price")), "product_id", "left")
    return named.select("listing_id", "source", "ord", "place", "product_id", "step", "score", F.when(asked, title_pair_key(F.col("title"), F.col("p_title"))).alias("pair_key"), "title", "price_minor", "p_title", "p_price")


def claimed(chain: DataFrame, judge: Callable[[DataFrame], DataFrame] = silent, verdicts: DataFrame | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Who gets which product of its chain (from candidates()), and the verdicts with those that were asked for.

    The first is (listing_id, product_id, reason, score) of every offer that has a candidate; product_id is null for one that
    stays new. A pair of titles is judged once, when an offer has come to it, unless verdicts holds a younger answer than
    VERDICT_SECONDS; what the judge doesn't answer isn't kept. An offer that the judge turns away from its best product left
    looks no further. Each round is written to the shared folder.
    """
    spark = chain.sparkSession
    now = F.current_timestamp() if now is None else now
    kept = spark.createDataFrame([], VERDICTS) if verdicts is None else verdicts
    young = kept.where((now.cast("long") - F.col("judged_at").cast("long")) < VERDICT_SECONDS)
    known = written(young.groupBy("pair_key").agg(F.max_by("same", "judged_at").alias("same"), F.max("judged_at").alias("judged_at")), "verdicts")
    state = chain.groupBy("listing_id").agg(F.lit(1).alias("place"))
    settled = None
    while True:
        at = chain.join(state, ["listing_id", "place"])
        pairs = at.join(known, "pair_key", "left_anti").where("pair_key is not null").groupBy("pair_key").agg(F.min_by(F.struct("title", "price_minor", "p_title", "p_price"), F.struct("listing_id", "product_id")).alias("p")).select("pair_key", "p.*")
        pairs = written(pairs, "pairs")
        if not pairs.isEmpty():
            known = written(known.unionByName(judge(pairs).select("pair_key", "same", now.cast("timestamp").alias("judged_at"))), "verdicts")
        cut = at.join(known.select("pair_key", "same"), "pair_key", "left")
        attach = (F.col("step") < 3) | (F.col("score") >= SURE) | F.coalesce("same", F.col("score") >= SILENT)
        reason = F.when(F.col("step") == 1, "number").when(F.col("step") == 2, "image").when(F.col("same"), "judge-yes").when(~F.col("same"), "judge-no").when(attach, "cosine").otherwise("no-match")
        decided = written(cut.select("listing_id", "source", "ord", "place", "product_id", "score", attach.alias("attach"), reason.alias("reason")), "decided")
        holders = decided.where("attach").groupBy("product_id", "source").agg(F.min(F.struct("ord", "listing_id")).alias("holder"))
        # an offer that the judge turns away stays at its product unless an earlier offer takes it; then it looks further
        mine = F.struct("ord", "listing_id")
        tried = decided.join(holders, ["product_id", "source"], "left").withColumn("stays", F.coalesce(F.when(F.col("attach"), F.col("holder") == mine).otherwise(F.col("holder") > mine), F.lit(True)))
        lost = tried.where("not stays").select("listing_id", (F.col("place") + 1).alias("place"))
        on = written(lost.join(chain.select("listing_id", "place"), ["listing_id", "place"]), "lost")
        gone = lost.join(on, "listing_id", "left_anti").select("listing_id", F.lit(None).cast("long").alias("product_id"), F.lit("no-match").alias("reason"), F.lit(None).cast("double").alias("score"))
        settled = gone if settled is None else settled.unionByName(gone)
        if on.isEmpty():
            placed = tried.where("stays").select("listing_id", F.when(F.col("attach"), F.col("product_id")).cast("long").alias("product_id"), "reason", "score")
            return settled.unionByName(placed), known.where("same is not null")
        state = tried.where("stays").select("listing_id", "place").unionByName(on)


def resolved(batch: DataFrame, members: DataFrame, products: DataFrame, judge: Callable[[DataFrame], DataFrame] = silent, verdicts: DataFrame | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(listing_id, product_id, reason, score) of every offer of the batch, and the verdicts; see candidates() and claimed().

    An offer without a product gets a null product_id: it becomes a product of its own.
    """
    found, verdicts = claimed(written(candidates(batch, members, products), "candidates"), judge, verdicts, now)
    out = batch.select("listing_id").join(found, "listing_id", "left").withColumn("reason", F.coalesce("reason", F.lit("no-match")))
    return out, verdicts
