"""Entities of ranked candidates, the relevance gates, and diversification."""

from __future__ import annotations

import math
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring, text
from ..session import dealt, written
from . import retrieval

#: Rows of one query, the best by base score, that one task diversifies first, and at most; how much more it takes each time.
POOL, MOST, MORE = 500, 32_000, 4
#: Identities of a product, the strongest first.
NUMBERS = ("canonical", "gtin", "upc", "ean", "asin")
SIGNALS = ("semantic", "lexical", "relevance", "quality")


def bare(c: Column) -> Column:
    """An identifier in normal form without spaces; null if nothing is left."""
    return F.nullif(F.replace(text.normalize_search(c), F.lit(" ")), F.lit(""))


def model_key(brand: Column, model: Column, mpn: Column | None = None) -> Column:
    """brand:model, the family that exposure caps count; null without a model or part number."""
    name = F.nullif(text.normalize_search(model), F.lit(""))
    name = name if mpn is None else F.coalesce(name, bare(mpn))
    maker = F.coalesce(F.nullif(text.normalize_search(brand), F.lit("")), F.lit("unknown"))
    return F.when(name.isNotNull(), F.concat(maker, F.lit(":"), name))


def canonical_key(title: Column, brand: Column, model: Column, numbers: dict[str, Column] | None = None, mpn: Column | None = None) -> Column:
    """The strongest identity of a listing: a product number, then brand and model, then the title's fingerprint."""
    numbers = numbers or {}
    known = [F.concat(F.lit(f"{n}:"), bare(numbers[n])) for n in NUMBERS if n in numbers]
    return F.coalesce(*known, F.concat(F.lit("model:"), model_key(brand, model, mpn)), F.concat(F.lit("title:"), text.title_fingerprint(title)))


def base_score(rrf: Column) -> Column:
    """The hybrid base score of a row with the columns of SIGNALS, null where a signal is missing; to nine places, so that the order of a sum decides no tie."""
    signals = {s: F.when(F.col(s).isNotNull(), (scoring.semantic if s == "semantic" else scoring.clamp)(F.col(s))) for s in SIGNALS}
    return F.round(scoring.clamp(retrieval.hybrid({"rrf": rrf, **signals})), 9)


def entities(candidates: DataFrame, channels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, key, id, base, offers, sources, source, model, title, words, aspects, embedding), one row for each entity of a query.

    candidates: query_id, id, key, source, model, title, price_minor, words, aspects, embedding and SIGNALS; channels: query_id, id,
    channel, rank. The offer with the best base score of its own stands for its entity, the smallest id among equals; the
    entity's own base has the best rank in each channel and the best of each signal over its offers.
    """
    rrf = retrieval.reciprocal_rank_fusion(channels, weights)
    scored = candidates.join(rrf, ["query_id", "id"], "left").withColumn("own", base_score(F.coalesce("rrf", F.lit(0.0)))).drop("rrf")
    order = F.struct((-F.col("own")).alias("minus"), F.col("id"))
    kept = ("id", "source", "model", "title", "words", "aspects")
    grouped = scored.groupBy("query_id", "key").agg(
        F.min_by(F.struct(*kept), order).alias("best"),
        F.min_by("embedding", F.when(F.size("embedding") > 0, order)).alias("embedding"),
        F.count("*").alias("offers"),
        F.countDistinct("source").alias("sources"),
        *(F.max(s).alias(s) for s in SIGNALS),
    )
    ranks = channels.where("rank > 0").join(candidates.select("query_id", "id", "key"), ["query_id", "id"]).groupBy("query_id", F.col("key").alias("id"), "channel").agg(F.min("rank").alias("rank"))
    fused = retrieval.reciprocal_rank_fusion(ranks, weights).withColumnRenamed("id", "key")
    out = grouped.join(fused, ["query_id", "key"], "left").withColumn("base", base_score(F.coalesce("rrf", F.lit(0.0))))
    return out.select("query_id", "key", *(F.col(f"best.{c}").alias(c) for c in kept), "base", "offers", "sources", "embedding")


def entities_by_vector(offers: DataFrame, ranks: DataFrame, asked: DataFrame, weights: dict[str, float], channel: str, floor: float) -> DataFrame:
    """entities() of queries that share a text's offers and differ by their vectors: (text_id, query_id, key, id, vector_id, base).

    offers and ranks are those of entities() with text_id for query_id, without `semantic` and the vectors' channel;
    asked: text_id, query_id, query_embedding (null: no vector), broadcast. An offer without a vector is worth the same for every query, and
    so is an entity of such offers alone: both are worked out once for each text. A query meets the offers with a vector only.
    channel ranks those whose cosine is over the floor. vector_id is the offer whose vector an entity has.
    """
    has = F.coalesce(F.size("embedding") > 0, F.lit(False))
    part = lambda rank: F.coalesce(F.lit(max(0.0, float(weights[channel]))) / (retrieval.RANK_OFFSET + rank), F.lit(0.0))
    base = lambda s: base_score(scoring.clamp(s / F.col("total")))
    order = F.struct((-F.col("own")).alias("minus"), "id")
    others = retrieval.other_channels(ranks, weights).withColumnRenamed("query_id", "text_id")
    sums = retrieval.rank_sums(ranks, weights).withColumnRenamed("query_id", "text_id")
    rows = offers.join(sums, ["text_id", "id"], "left").join(F.broadcast(others), "text_id", "left").withColumn("total", retrieval.rank_total(weights, F.col("others")))
    rows = written(rows.select("text_id", "id", "key", "embedding", "lexical", "relevance", "quality", F.coalesce("s", F.lit(0.0)).alias("s"), "total"), "fused")

    # for each text and key: the best offers without and with a vector before any cosine, and what all offers have together
    signals = [s for s in SIGNALS if s != "semantic"]
    alone = rows.withColumn("semantic", F.lit(None).cast("double")).withColumn("own", base(F.col("s")))
    keyed = alone.groupBy("text_id", "key").agg(F.min(F.when(~has, order)).alias("alone"), F.min(F.when(has, order)).alias("held"), F.first("total").alias("total"), *(F.max(s).alias(s) for s in signals))
    best = ranks.where("rank > 0").withColumnRenamed("query_id", "text_id").join(rows.select("text_id", "id", "key"), ["text_id", "id"])
    best = best.groupBy(F.col("text_id").alias("query_id"), F.col("key").alias("id"), "channel").agg(F.min("rank").alias("rank"))
    keyed = keyed.join(retrieval.rank_sums(best, weights).select(F.col("query_id").alias("text_id"), F.col("id").alias("key"), "s"), ["text_id", "key"], "left")
    keyed = written(keyed.withColumn("s", F.coalesce("s", F.lit(0.0))), "keyed")

    # for each query: its vector beside those of the text's offers; what each has by itself is summed once
    own = lambda c: scoring.dot(F.col(c), F.col(c))
    pointed = asked.where("query_embedding is not null").withColumn("other", own("query_embedding"))
    near = dealt(rows.where(has)).withColumn("square", own("embedding")).join(F.broadcast(pointed), "text_id")
    cosine = scoring.cosine_of(scoring.dot(F.col("embedding"), F.col("query_embedding")), F.col("square"), F.col("other"))
    near = near.withColumn("semantic", F.when(F.size("embedding") == F.size("query_embedding"), cosine)).drop("embedding", "query_embedding", "square", "other")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("semantic"), F.asc("id")))
    near = near.withColumn("rank", F.when(F.col("semantic") > floor, place))
    near = near.withColumn("own", base(F.col("s") + part(F.col("rank"))))
    near = near.groupBy("query_id", "key").agg(F.min(order).alias("near"), F.max("semantic").alias("semantic"), F.min("rank").alias("rank"))
    every = keyed.join(F.broadcast(asked.select("text_id", "query_id", F.col("query_embedding").isNull().alias("plain"))), "text_id").join(near, ["query_id", "key"], "left")
    every = every.withColumn("near", F.coalesce("near", F.when(F.col("plain"), F.col("held")))).withColumn("base", base(F.col("s") + part(F.col("rank"))))
    return every.select("text_id", "query_id", "key", F.least("alone", "near")["id"].alias("id"), F.col("near.id").alias("vector_id"), "base")


def gated(rows: DataFrame, gate: Column, least: float) -> DataFrame:
    """rows of at least the base score `least`, with eligible: whether they are within the share `gate` of their query's best.

    The best is a grouped maximum: partial in each task, and a row for each query of the block is joined back.
    """
    kept = rows.where(F.col("base") >= least)
    top = kept.groupBy("query_id").agg(F.max("base").alias("top"))
    return kept.join(F.broadcast(top), "query_id").withColumn("eligible", F.col("base") >= F.col("top") * gate).drop("top")


def similarities(vectors: np.ndarray, known: np.ndarray, words: list[set], aspects: list[set], models: list, i: int) -> np.ndarray:
    """Entity similarity of all rows with row i."""

    def overlap(sets: list[set]) -> np.ndarray:
        own = sets[i]
        return np.array([len(own & s) / len(own | s) if own and s else 0.0 for s in sets])

    titles, tags = overlap(words), overlap(aspects)
    cosine = np.clip(vectors @ vectors[i], 0, 1)
    both = known & known[i]
    out = np.where(both, 0.65 * cosine + 0.25 * titles + 0.1 * tags, 0.75 * titles + 0.25 * tags)
    same = np.array([m is not None and m == models[i] for m in models])
    return np.where(same, 1.0, np.clip(out, 0, 1))


def mmr_order(pdf: pd.DataFrame, results: int, per_source: int, per_model: int, shown: int | None = None) -> pd.DataFrame:
    """Greedy maximal marginal relevance with aspect coverage and exposure caps, for one query's rows.

    With shown, the rows after the first `shown` by base score stand for those that aren't here: a pick is safe if it is within the
    caps and no row of their best base score could be worth more, however new it were.
    """
    pdf = pdf.sort_values(["base", "key"], ascending=[False, True]).reset_index(drop=True)
    beyond = float(pdf["base"].iloc[shown]) if shown is not None and len(pdf) > shown else None
    pdf = pdf if beyond is None else pdf.iloc[:shown]
    n, lam = len(pdf), float(pdf["lam"].iloc[0])
    lists = [np.asarray(v, float) if v is not None else np.empty(0) for v in pdf["embedding"]]
    width = max((len(v) for v in lists), default=0)
    vectors = np.array([v if len(v) == width else np.zeros(width) for v in lists]).reshape(n, width)
    size = np.linalg.norm(vectors, axis=1)
    vectors = vectors / np.where(size > 0, size, 1)[:, None]
    base = pdf["base"].to_numpy(float)
    aspects = [list(a) if a is not None else [] for a in pdf["aspects"]]
    words = [set(w) if w is not None else set() for w in pdf["words"]]
    tags = list(map(set, aspects))
    sources, models = pdf["source"].tolist(), [m if isinstance(m, str) else None for m in pdf["model"]]
    left, nearest = list(range(n)), np.zeros(n)
    seen, of_source, of_model = Counter(), Counter(), Counter()
    picks = []
    while left and len(picks) < results:
        scored = []
        for i in left:
            gain = sum(1 / (1 + seen[a]) for a in aspects[i]) / len(aspects[i]) if aspects[i] else 0.0
            scored.append((min(1.0, max(0.0, lam * base[i] + (1 - lam) * (0.6 * (1 - nearest[i]) + 0.4 * gain))), i))
        scored.sort(key=lambda x: (-x[0], x[1]))
        free = [(s, i) for s, i in scored if of_source[sources[i]] < per_source and (models[i] is None or of_model[models[i]] < per_model)]
        final, i = (free or scored)[0]
        picks.append((i, final, not free))
        left.remove(i)
        seen.update(aspects[i])
        of_source[sources[i]] += 1
        if models[i] is not None:
            of_model[models[i]] += 1
        nearest = np.maximum(nearest, similarities(vectors, size > 0, words, tags, models, i))
    out = pdf.iloc[[p[0] for p in picks]][["query_id", "key", "id", "base"]].copy()
    out["final"], out["relaxed"] = [float(p[1]) for p in picks], [bool(p[2]) for p in picks]
    out["position"] = np.arange(1, len(out) + 1)
    if shown is not None:
        most = None if beyond is None else min(1.0, lam * beyond + 1 - lam)
        enough = beyond is None or len(picks) >= results
        out["safe"] = [enough and (most is None or not relaxed and final >= most) for _, final, relaxed in picks]
    return out


PICKED = ("query_id", "key", "id", "base", "final", "relaxed", "position")


def one_place(rows: DataFrame, picks: DataFrame, per_source: int, per_model: int) -> DataFrame:
    """The best row of each query beside its picks so far: one partial maximum over all rows. picks: a few rows a query."""
    so_far = picks.groupBy("query_id").agg(F.collect_list(F.struct("key", "source", "model", "words", "aspects", "embedding")).alias("picks"))
    left = rows.join(F.broadcast(so_far), "query_id", "left").withColumn("picks", F.coalesce("picks", F.expr("filter(array(struct(key, source, model, words, aspects, embedding)), x -> false)")))
    left = left.where(~F.exists("picks", lambda p: p["key"] == F.col("key")))
    similar = lambda p: scoring.entity_similarity(F.col("model"), F.col("embedding"), F.col("words"), F.col("aspects"), p["model"], p["embedding"], p["words"], p["aspects"])
    nearest = F.aggregate("picks", F.lit(0.0), lambda s, p: F.greatest(s, similar(p)))
    covered = F.flatten(F.transform("picks", lambda p: F.coalesce(p["aspects"], F.expr("cast(array() as array<string>)"))))
    gains = F.transform("aspects", lambda a: 1 / (1 + F.size(F.filter(covered, lambda x: x == a))))
    gain = F.when(F.size("aspects") > 0, F.aggregate(gains, F.lit(0.0), lambda s, x: s + x) / F.size("aspects")).otherwise(0.0)
    final = scoring.clamp(F.col("lam") * F.col("base") + (1 - F.col("lam")) * (0.6 * (1 - nearest) + 0.4 * gain))
    count = lambda c: F.size(F.filter("picks", lambda p: p[c] == F.col(c)))
    free = (count("source") < per_source) & (F.col("model").isNull() | (count("model") < per_model))
    scored = left.select(*rows.columns, final.alias("final"), (~F.coalesce(free, F.lit(True))).alias("relaxed"))
    best = F.min_by(F.struct(*rows.columns, "final", "relaxed"), F.struct(F.col("relaxed"), (-F.col("final")).alias("f"), (-F.col("base")).alias("b"), F.col("key")))
    return scored.groupBy(F.col("query_id").alias("q")).agg(best.alias("best")).select("best.*")


def by_places(rows: DataFrame, results: int, per_source: int, per_model: int) -> DataFrame:
    """mmr_order for queries with any number of rows: place after place, each by one distributed maximum."""
    spark = rows.sparkSession
    schema = rows.withColumns({"final": F.lit(0.0), "relaxed": F.lit(False), "position": F.lit(0).cast("long")}).schema
    picks = []
    for place in range(1, results + 1):
        found = one_place(rows, spark.createDataFrame(picks, schema), per_source, per_model).withColumn("position", F.lit(place).cast("long")).collect()  # a row for each query of the block
        if not found:
            break
        picks += found
    return spark.createDataFrame(picks, schema).select(*PICKED)


def _one_argument(order):
    """A function of a group's rows alone, as Spark tells by the number of parameters."""
    return lambda pdf: order(pdf)


def by_bound(rows: DataFrame, results: int, per_source: int, per_model: int, pool: int, schema: str) -> DataFrame:
    """mmr_order for queries with many rows: over the best by base score, as many as the picks' worth shows to be enough.

    What isn't looked at could be worth lam * base + 1 - lam at most. Queries with a pick below that, or out of the caps, are
    worked out again over MORE times the rows; those that would need over MOST go place after place over all their rows.
    """
    place, out, size = Window.partitionBy("query_id").orderBy(F.desc("base"), "key"), None, pool
    while True:
        near = rows.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= size + 1).drop("_r")
        order = partial(mmr_order, results=results, per_source=per_source, per_model=per_model, shown=size)
        found = written(near.groupBy("query_id").applyInPandas(_one_argument(order), f"{schema}, safe boolean"), "picks")
        unsafe = found.where("not safe").select("query_id").distinct()
        left = [r.query_id for r in unsafe.collect()]  # some of a block's queries
        good = found.drop("safe") if not left else found.join(F.broadcast(unsafe), "query_id", "left_anti").drop("safe")
        out = good if out is None else out.unionByName(good)
        if not left:
            return out
        rows, size = rows.where(F.col("query_id").isin(left)), size * MORE
        if size > MOST:
            return out.unionByName(by_places(rows, results, per_source, per_model))


def diversify(df: DataFrame, lam: float | None = None, results: int = 24, per_source: int | None = None, per_model: int = 1, pool: int = POOL) -> DataFrame:
    """(query_id, key, id, base, final, relaxed, position) over rows (query_id, key, id, base, words, aspects, embedding, source, model).

    Each pick maximises relevance, novelty against the picks before it and aspects not yet covered; sources and models
    have caps that give way only when nothing else is left. lam is the share of relevance, or else the column `lam`. All
    rows compete: those of a query with up to `pool` rows in one task, of larger ones those that a bound doesn't rule out.
    Missing vectors, words and aspects are allowed.
    """
    cap = per_source if per_source is not None else max(2, math.ceil(results * 0.4))
    lam_column = F.col("lam") if lam is None else F.lit(lam)
    rows = written(df.select("query_id", "key", "id", "base", "words", "aspects", "embedding", "source", "model", lam_column.cast("double").alias("lam")), "diversify")
    sizes = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    large = [r.query_id for r in sizes.where(F.col("n") > pool).select("query_id").collect()]  # some of a block's queries
    kinds = dict(rows.dtypes)
    schema = f"query_id {kinds['query_id']}, key string, id {kinds['id']}, base double, final double, relaxed boolean, position long"
    near = rows if not large else rows.where(~F.col("query_id").isin(large))
    out = near.groupBy("query_id").applyInPandas(lambda pdf: mmr_order(pdf, results, cap, per_model), schema)
    return out if not large else out.unionByName(by_bound(rows.where(F.col("query_id").isin(large)), results, cap, per_model, pool, schema))


def ranked(rows: DataFrame, results: int, per_source: int | None = None, per_model: int = 1, pool: int = POOL) -> DataFrame:
    """diversify() over the eligible rows of gated(), and after them the others by base score, up to `results` a query."""
    rows = written(rows, "ranked")
    picked = diversify(rows.where("eligible"), None, results, per_source, per_model, pool)
    picked = written(picked, "picked")
    taken = picked.groupBy("query_id").agg(F.count("*").alias("taken"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "key"))
    tail = rows.where("not eligible").withColumn("place", place).where(F.col("place") <= results).join(F.broadcast(taken), "query_id", "left")
    tail = tail.withColumn("position", (F.coalesce("taken", F.lit(0)) + F.col("place")).cast("long")).where(F.col("position") <= results)
    return picked.unionByName(tail.select("query_id", "key", "id", "base", F.col("base").alias("final"), F.lit(False).alias("relaxed"), "position"))


def covered_scores(asked: DataFrame, scores: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, id, relevance) of a judge's answer: bounded to [0, 1], 0 for rows it left out; nothing for a query it answered too sparsely.

    asked: query_id, id; scores: query_id, id, score. A score counts if it is a finite number of a row that was asked;
    a query's answer counts if at least the share `least` of its rows, rounded up, have one.
    """
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    good = scores.where(finite).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rows = asked.select("query_id", "id").distinct().join(good, ["query_id", "id"], "left")
    covered = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count("score").alias("answered")).where(F.col("answered") >= F.ceil(F.col("n") * F.lit(least)))
    return rows.join(covered.select("query_id"), "query_id").select("query_id", "id", F.coalesce(scoring.clamp(F.col("score")), F.lit(0.0)).alias("relevance"))


def entity_groups(df: DataFrame, key: str, score: str = "base", id_col: str = "id") -> DataFrame:
    """One row for each entity: its best offer, offers and sources, best score and rank."""
    best = F.max_by(F.struct(id_col, score), F.struct(F.col(score), (-F.col(id_col)).alias("minus")))
    grouped = df.groupBy(key).agg(best.alias("best"), F.count("*").alias("offers"), F.countDistinct("source").alias("sources"), F.max("semantic").alias("semantic"), F.min("rank").alias("rank"))
    return grouped.select(key, F.col(f"best.{id_col}").alias("representative"), F.col(f"best.{score}").alias(score), "offers", "sources", "semantic", "rank")
