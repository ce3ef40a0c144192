"""Entity resolution: blocked candidate joins for hashes, centroids and titles; products and their offers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import scoring, text
from ..session import written
from . import vector_index

#: Bit ranges of seven bands: two hashes within six bits agree on at least one.
BANDS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))
#: Centroids that are broadcast together; more take several passes over the vectors.
CENTRES_AT_ONCE = 10_000
#: Overlap of the words of two titles without a model token in common.
TITLE_OVERLAP = 0.72


def sign_hash(vector) -> object:
    """A 64-bit hash of a vector: bit k is set if value k is positive (the first 64 values)."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def banded(df: DataFrame, hash_col: str) -> DataFrame:
    """df with one row for each band of its hash: band, part."""
    parts = F.array(*(F.struct(F.lit(k).alias("band"), F.expr(f"shiftrightunsigned({hash_col}, {start}) & {(1 << size) - 1}").alias("part")) for k, (start, size) in enumerate(BANDS)))
    return df.withColumn("b", F.explode(parts)).select("*", "b.band", "b.part").drop("b")


def hamming_pairs(left: DataFrame, right: DataFrame, distance: int = 6, within: bool = False) -> DataFrame:
    """(left_id, right_id, distance) of useful hashes (id, hash) that differ in at most `distance` bits (6 at most).

    within: both sides are one table, and each pair is wanted once, the smaller id on the left.
    """
    if distance > len(BANDS) - 1:
        raise ValueError(f"seven bands find distances up to {len(BANDS) - 1}")
    use = lambda df, side: banded(df.where(scoring.useful_hash(F.col("hash"))), "hash").select(F.col("id").alias(f"{side}_id"), F.col("hash").alias(f"{side}_hash"), "band", "part")
    pairs = use(left, "left").join(use(right, "right"), ["band", "part"]).where(scoring.hamming(F.col("left_hash"), F.col("right_hash")) <= distance)
    if within:
        pairs = pairs.where("left_id < right_id")
    return pairs.select("left_id", "right_id", scoring.hamming(F.col("left_hash"), F.col("right_hash")).cast("long").alias("distance")).distinct()


def centroids(df: DataFrame, key: str, vector: str, digits: int = 12) -> DataFrame:
    """Unit centroid of each key's vectors: sums of values by place, so that keys of any size aggregate partially."""
    sums = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    rows = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v"))
    return rows.select(key, scoring.unit(F.transform("v", lambda p: p["s"])).alias("centroid"))


def nearest_centroid(df: DataFrame, centres: DataFrame, key: str, vector: str, id_col: str) -> DataFrame:
    """(id, key, score): the most similar centroid, the smallest key among equals.

    The centroids are a stated set against all vectors: they go in blocks of CENTRES_AT_ONCE, each of which leaves one row
    for each vector, worked out as matrix products in the tasks.
    """
    spark, passes = df.sparkSession, max(1, -(-centres.count() // CENTRES_AT_ONCE))
    vectors = vector_index.clean(df, id_col, vector)
    kind, out = dict(centres.dtypes)[key], None
    for k in range(passes):
        part = centres.where(F.pmod(F.xxhash64(key), F.lit(passes)) == k).orderBy(key).select(key, "centroid").collect()
        if not part:
            continue
        names = spark.createDataFrame([(i, r[key]) for i, r in enumerate(part)], f"cell int, `{key}` {kind}")
        found = vector_index.nearest(vectors, np.array([r["centroid"] for r in part], float), 9).join(F.broadcast(names), "cell").select("id", key, "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"id long, `{key}` {kind}, score double")
    best = F.max_by(F.struct(key, "score"), F.struct("score", (-F.col(key)).alias("k"))).alias("best")
    return out if passes == 1 else out.groupBy("id").agg(best).select("id", f"best.{key}", "best.score")


def price_medians(df: DataFrame, key: str, price: str) -> DataFrame:
    """Exact median of the known prices of each key."""
    return df.where(F.col(price) > 0).groupBy(key).agg(F.expr(f"percentile({price}, 0.5)").alias("median"))


def title_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of rows (id, title) whose titles may be identity-compatible; none is missing.

    Where both titles have model tokens, one has to be shared, so tokens are the join key. Other pairs have to share
    TITLE_OVERLAP of their words, so they share one of the rarest of each title, of as many as may differ and one more:
    words that most titles have are keys of none but titles made of such words.
    """
    side = lambda df, name: df.select(F.lit(name).alias("side"), "id", text.identity_tokens(F.col("title")).alias("tokens"), text.identity_words(F.col("title")).alias("words"))
    rows = side(left, "left").unionByName(side(right, "right"))
    words = rows.select("side", "id", F.size("tokens").alias("models"), F.size("words").alias("size"), F.explode("words").alias("word"))
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("uses")), "word")
    ordered = ranked.groupBy("side", "id", "models", "size").agg(F.array_sort(F.collect_list(F.struct("uses", "word"))).alias("ordered"))
    keys = ordered.select("side", "id", "models", F.explode(F.slice("ordered", F.lit(1), (F.col("size") - F.ceil(F.col("size") * TITLE_OVERLAP) + 1).cast("int"))).alias("key")).select("side", "id", "models", F.col("key.word").alias("key"))
    of = lambda df, name, *more: df.where(F.col("side") == name).select(F.col("id").alias(f"{name}_id"), "key", *(F.col(c).alias(f"{name}_{c}") for c in more))
    tokens = rows.select("side", "id", F.explode("tokens").alias("key"))
    by_token = of(tokens, "left").join(of(tokens, "right"), "key").select("left_id", "right_id")
    by_word = of(keys, "left", "models").join(of(keys, "right", "models"), "key").where("left_models = 0 or right_models = 0").select("left_id", "right_id")
    return by_token.unionByName(by_word).distinct()


def product_aggregates(df: DataFrame, product: str, source: str) -> DataFrame:
    return df.groupBy(product).agg(F.count("*").alias("listing_count"), F.countDistinct(source).alias("source_count"))


def duplicate_groups(df: DataFrame, product: str, source: str) -> DataFrame:
    """(product, source) pairs with several offers: candidates for repair."""
    return df.groupBy(product, source).agg(F.count("*").alias("n")).where("n > 1")


def keepers(df: DataFrame, product: str, source: str, *order: str) -> DataFrame:
    """df with keep: the first offer of each product and source stays, the others are to be resolved again."""
    first = df.groupBy(product, source).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first, [product, source]).withColumn("keep", F.struct(*order) == F.col("_first")).drop("_first")


def title_verdicts(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, same, fits) of every different pair of titles in two columns: equal when clean, and identity-compatible.

    What is read from a title is worked out once for each different title, and the verdict once for each different pair.
    """
    pairs = written(rows.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct(), "title-pairs")
    titles = pairs.select(F.col(left).alias("t")).unionByName(pairs.select(F.col(right).alias("t"))).distinct()
    t = F.col("t")
    read = written(titles.select("t", text.normalize_title(t).alias("clean"), text.identity_tokens(t).alias("ids"), text.identity_words(t).alias("words")), "titles")
    of = lambda name: read.select(F.col("t").alias(name), F.struct("clean", "ids", "words").alias(f"_{name}"))
    a, b = F.col(f"_{left}"), F.col(f"_{right}")
    fits = F.coalesce(text.identity_compatible(a["ids"], a["words"], b["ids"], b["words"]), F.lit(False))
    return written(pairs.join(of(left), left).join(of(right), right).select(left, right, (a["clean"] == b["clean"]).alias("same"), fits.alias("fits")), "title-verdicts")


def detached(listings: DataFrame, products: DataFrame) -> DataFrame:
    """listings with keep: whether an offer may stay with its product.

    listings: listing_id, product_id, source, title, captured; products: product_id, title. A product keeps one offer for
    sure: the first whose clean title is the product's, else the first that is compatible with it, else the first. Of the
    others those stay that are compatible with that offer, from another source, and the first of their source.
    """
    known = written(listings.where("product_id is not null").join(products.select("product_id", F.col("title").alias("own")), "product_id"), "offers")
    of_product = title_verdicts(known, "own", "title")
    order = [F.col("captured"), F.col("listing_id")]
    rank = F.when(F.col("same"), 0).when(F.col("fits"), 1).otherwise(2).alias("rank")
    chosen = F.min_by(F.struct("listing_id", "source", "title"), F.struct(rank, *order))
    keeper = known.join(of_product, ["own", "title"], "left").groupBy("product_id").agg(chosen.alias("k"))
    keeper = written(keeper.select("product_id", F.col("k.listing_id").alias("keeper"), F.col("k.source").alias("keeper_source"), F.col("k.title").alias("keeper_title")), "keepers")
    rest = known.join(keeper, "product_id").where((F.col("listing_id") != F.col("keeper")) & (F.col("source") != F.col("keeper_source")))
    rest = rest.join(title_verdicts(rest, "keeper_title", "title").where("fits"), ["keeper_title", "title"])
    firsts = rest.groupBy("product_id", "source").agg(F.min_by("listing_id", F.struct(*order)).alias("listing_id")).select("listing_id")
    kept = firsts.unionByName(keeper.select(F.col("keeper").alias("listing_id"))).withColumn("keep", F.lit(True))
    return listings.join(kept, "listing_id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def moved(listings: DataFrame, moves: DataFrame) -> DataFrame:
    """listings (listing_id, product_id, ...) after moves (listing_id, product_id); a null product detaches."""
    new = moves.select("listing_id", F.col("product_id").alias("_to"), F.lit(True).alias("_moves"))
    return listings.join(new, "listing_id", "left").withColumn("product_id", F.when(F.col("_moves"), F.col("_to")).otherwise(F.col("product_id"))).select(listings.columns)


def refreshed(listings: DataFrame, moves: DataFrame) -> DataFrame:
    """(product_id, action, listing_count, source_count) of the products that moves touch: refreshed, or deleted where no listing is left."""
    before = listings.join(moves.select("listing_id", F.col("product_id").alias("_to")), "listing_id").where(~F.col("product_id").eqNullSafe(F.col("_to")))
    touched = before.select(F.explode(F.array_compact(F.array("product_id", "_to"))).alias("product_id")).distinct()
    now = product_aggregates(moved(listings, moves).where("product_id is not null"), "product_id", "source")
    joined = touched.join(now, "product_id", "left")
    return joined.select(
        "product_id",
        F.when(F.col("listing_count").isNull(), "delete").otherwise("refresh").alias("action"),
        F.coalesce("listing_count", F.lit(0).cast("long")).alias("listing_count"),
        F.coalesce("source_count", F.lit(0).cast("long")).alias("source_count"),
    )


def late_merges(listings: DataFrame) -> DataFrame:
    """(listing_id, product_id): listings alone in their product, or without one, that move to the product of an image like theirs.

    listings: listing_id, product_id, hash, price_minor. The smallest such listing decides; prices that are both known
    have to be within a factor of four of each other. Sources play no part here. Of two that would move to each other's
    product, all are judged against one snapshot, only the one with the larger number moves.
    """
    sizes = listings.where("product_id is not null").groupBy("product_id").agg(F.count("*").alias("members"))
    rows = listings.join(sizes, "product_id", "left")
    hashed = rows.where("hash is not null").select(F.col("listing_id").alias("id"), "hash")
    single = rows.where("hash is not null and coalesce(members, 1) = 1").select(F.col("listing_id").alias("id"), "hash")
    mine = rows.select(F.col("listing_id").alias("left_id"), F.col("product_id").alias("own"), F.col("price_minor").alias("price"))
    theirs = rows.where("product_id is not null").select(F.col("listing_id").alias("right_id"), "product_id", F.col("price_minor").alias("other"), F.col("members").alias("other_members"))
    met = hamming_pairs(single, hashed).where("left_id != right_id").join(mine, "left_id").join(theirs, "right_id").where("own is null or own != product_id")
    found = met.groupBy("left_id").agg(F.min_by(F.struct("right_id", "product_id", "price", "other", "other_members"), F.col("right_id")).alias("m")).select("left_id", "m.*")
    fits = (F.col("price") <= 0) | (F.col("other") <= 0) | (F.col("price") / F.col("other")).between(0.25, 4.0)
    mutual = (F.col("other_members") == 1) & (F.col("left_id") < F.col("right_id"))
    return found.where(fits & ~mutual).select(F.col("left_id").alias("listing_id"), "product_id")
