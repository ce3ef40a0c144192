"""The search plan: parse, classify, retrieve, fuse, gate and diversify, for many queries in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring, text
from ..operators import gates, ranking, relational, retrieval
from ..session import written
from . import spec

WEIGHTS = {"lexical:literal": 2.2, "lexical:expanded": 0.75, "semantic": 1.0}
NATIVE_WEIGHT, SEMANTIC_FLOOR, JUDGED, PER_SOURCE, RESULTS, BLOCK, FLOOR = 1.35, 0.15, 48, 8, 30, 500, 0.2
#: Queries of typed texts whose vectors are broadcast together.
VECTORS = 2000


def members(queries: DataFrame) -> DataFrame:
    """(query_id, class_id) of queries (query_id, query, query_embedding): those alike in text and vector have one answer, that of the smallest of them."""
    alike = ["query", "query_embedding"]
    first = queries.groupBy(*alike).agg(F.min("query_id").alias("class_id"))
    same = F.col("q.query").eqNullSafe(F.col("c.query")) & F.col("q.query_embedding").eqNullSafe(F.col("c.query_embedding"))
    return queries.alias("q").join(first.alias("c"), same).select("q.query_id", "c.class_id")


def with_type(queries: DataFrame) -> DataFrame:
    """queries with the product type that their text names; each text is parsed once."""
    types = spec.parse_queries(queries.select("query").distinct()).select("query", "product_type")
    return queries.alias("q").join(types.alias("t"), F.col("q.query").eqNullSafe(F.col("t.query"))).select("q.*", "t.product_type")


def role_classes(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that have the same decisions: (query_id, class_id) of every query, and those that stand for a class.

    A vector speaks only for listings of a text that names no product type, so the vectors of the others are left out.
    """
    told = with_type(queries).withColumn("query_embedding", F.when(F.col("product_type").isNull(), F.col("query_embedding"))).drop("product_type")
    told = written(told, "told")
    of = written(members(told), "members")
    return of, told.join(of.where("query_id = class_id").select("query_id"), "query_id", "left_semi")


def eligible_candidates(listings: DataFrame, queries: DataFrame) -> DataFrame:
    """Listings that a query term or product type brings in, classified and filtered by role.

    listings: id, title, details, price_minor, source, has_image, availability, reviews, rating, cached, embedding;
    queries: a stated set (query_id, query, query_embedding), broadcast. Candidates meet by token, never as a product of
    both sides. Only the vector tells queries of one text apart, so a text's candidates are classified once.
    """
    asked = written(queries.groupBy("query").agg(F.min("query_id").alias("text_id"), F.collect_list(F.struct("query_id", "query_embedding")).alias("asked")), "query-texts")
    specs = parsed(asked.select(F.col("text_id").alias("query_id"), "query"))
    # an untyped query may still take what its vector speaks for
    rows = decided(listings, specs).where("eligible or product_type is null").withColumnRenamed("query_id", "text_id")
    rows = rows.join(F.broadcast(asked.select("text_id", F.explode("asked").alias("q")).select("text_id", "q.*")), "text_id").drop("text_id")
    rows = rows.withColumn("semantic", scoring.cosine(F.col("embedding"), F.col("query_embedding")))
    return exact(spec.escape_hatch(rows).where("eligible"), specs)


def parsed(queries: DataFrame) -> DataFrame:
    """The specs of queries (query_id, query), with the variants that are looked for."""
    variants = spec.query_variants(F.col("refined"), F.col("must"), F.col("brand"), F.col("model"), F.col("product_type"))
    return written(spec.parse_queries(queries).withColumn("variants", variants), "query-specs")


def exact(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """spec.exact_only over rows of these specs; without a model or brand in any of them nothing is moved or written."""
    return rows if specs.where("model is not null or brand is not null").isEmpty() else spec.exact_only(written(rows, "eligible"))


def decided(listings: DataFrame, specs: DataFrame) -> DataFrame:
    """Candidates of parsed() queries with role, lexical score and quality, those that aren't eligible too.

    A listing meets a query at the first of its tokens that the query looks for: each pair is made once, where the listing lies.
    """
    forms = retrieval.query_terms(specs.select("query_id", F.concat_ws(" ", "variants").alias("query"))).select("query_id", F.col("form").alias("token")).distinct()
    forms = forms.join(forms.groupBy("query_id").agg(F.collect_list("token").alias("sought")), "query_id")
    body = F.concat_ws(" ", "title", "details")
    listings = listings.withColumns({"plain": text.normalize_search(body), "tokens": text.lexical_tokens(body)}).withColumn("each", F.array_distinct("tokens"))
    met = listings.select("*", F.posexplode("each").alias("at", "token")).join(F.broadcast(forms), "token")
    met = met.where(~F.arrays_overlap(F.slice("each", F.lit(1), F.col("at")), "sought")).drop("each", "at", "token", "sought")
    rows = met.withColumn("forms", scoring.token_forms(F.col("tokens"))).join(F.broadcast(specs), "query_id")
    rows = spec.classified(rows)
    rows = rows.withColumn("lexical", F.array_max(F.transform("variants", lambda v: scoring.lexical_match(v, F.col("plain"), F.col("forms")))))
    return rows.withColumn("quality", scoring.listing_quality(F.col("price_minor"), F.col("has_image"), F.col("availability"), F.col("reviews"), F.col("rating"), F.col("cached")))


def channels(candidates: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """(query_id, id, channel, rank): literal and expanded BM25 over each query's own candidates, the vector channel, and sources' own order."""
    c = candidates.select("query_id", "id", "tokens", "plain", "variants", "semantic")
    literal = bm25_within(c, F.element_at("variants", 1))
    expanded = bm25_within(c.where("size(variants) > 1"), F.concat_ws(" ", F.slice("variants", 2, 3)))
    out = [("lexical:literal", literal, 0.0), ("lexical:expanded", expanded, 0.0), ("semantic", c.where("semantic is not null").select("query_id", "id", F.col("semantic").alias("score")), SEMANTIC_FLOOR)]
    found = None
    for name, scores, floor in out:
        one = retrieval.ranked(scores, floor=floor).select("query_id", "id", F.lit(name).alias("channel"), "rank")
        found = one if found is None else found.unionByName(one)
    return found if native is None else found.unionByName(native.select("query_id", "id", "channel", "rank"))


def bm25_within(df: DataFrame, query: Column, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """(query_id, id, score): BM25 where each query's corpus is its own rows (query_id, id, tokens, plain)."""
    rows = df.select("query_id", "id", "tokens", "plain", F.array_distinct(text.lexical_tokens(query)).alias("terms"), text.normalize_search(query).alias("phrase"))
    single = lambda x: F.when(x.endswith("s"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    hits = rows.withColumn("term", F.explode("terms")).withColumn("tf", F.size(F.filter("tokens", lambda t: (t == F.col("term")) | (t == single(F.col("term"))) | (single(t) == F.col("term"))))).where("tf > 0")
    stats = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("tokens")), F.lit(1.0)).alias("mean"))
    df_ = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.size("tokens") / F.col("mean")))
    bonus = F.when((F.first("phrase") != "") & F.contains(F.first("plain"), F.first("phrase")), retrieval.PHRASE_BONUS).otherwise(0.0)
    return hits.join(F.broadcast(df_), ["query_id", "term"]).join(F.broadcast(stats), "query_id").groupBy("query_id", "id").agg((F.sum(part) + bonus).alias("score"))


def search(listings: DataFrame, queries: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = None, results: int = RESULTS, sources: int = 0, native: DataFrame | None = None, cached: DataFrame | None = None) -> DataFrame:
    """(query_id, key, id, position, base, final, relaxed): diversified results of every query, one offer of each entity.

    rerank, if given, takes the judged pool (the 48 best of a query by relevance, semantic and lexical score together, eight of a source at most) and gives
    (query_id, id, relevance): the hook for a cross-encoder. Without it the lexical score stands in, as the deterministic
    default. native has the sources' own order (query_id, id, source, rank), without query_id if it is the same for all; cached has listings like `listings` that count
    where no live one has their id. Queries go in blocks, so that what is broadcast is bounded. Queries alike in text and vector
    are answered once, unless rerank or native may tell them apart; of a text that names a product type all but the vector's
    part is worked out once for all its queries.
    """
    every = listings if cached is None else relational.live_and_cached(listings.drop("cached"), cached.drop("cached"), "id").withColumn("cached", F.col("origin") == "cache").drop("origin")
    if rerank is None and (native is None or "query_id" not in native.columns):
        of = written(members(queries), "members")
        one = with_type(queries.join(of.where("query_id = class_id").select("query_id"), "query_id", "left_semi"))
        one = written(one.withColumn("text_id", F.min("query_id").over(Window.partitionBy("query"))), "asked")
        typed, other = one.where("product_type is not null"), one.where("product_type is null").drop("product_type", "text_id")
        found = None
        if not typed.isEmpty():
            texts = typed.select(F.col("text_id").alias("query_id"), "query").distinct()
            found = retrieval.in_blocks(texts, lambda part: by_text(every, part, typed, results, sources, native), BLOCK)
        if found is None or not other.isEmpty():
            rest = retrieval.in_blocks(other, lambda part: ranking.ranked(search_block(every, part, None, sources, native), results, PER_SOURCE), BLOCK)
            found = rest if found is None else found.unionByName(rest)
        return found.withColumnRenamed("query_id", "class_id").join(of, "class_id").select("query_id", *(c for c in found.columns if c != "query_id"))
    return retrieval.in_blocks(queries, lambda part: ranking.ranked(search_block(every, part, rerank, sources, native), results, PER_SOURCE), BLOCK)


def judged_pool(rows: DataFrame) -> DataFrame:
    """The best rows of each query by the sum of relevance, semantic and lexical score: eight of a source at most, 48 altogether."""
    signals = [c for c in ("relevance", "semantic", "lexical") if c in rows.columns]
    worth = sum((F.coalesce(c, F.lit(0.0)) for c in signals), F.lit(0.0))
    order = [worth.desc(), F.asc("id")]
    near = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order))).where(F.col("r") <= PER_SOURCE)
    return near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("r") <= JUDGED).drop("r")


def own_order(found: DataFrame, native: DataFrame | None) -> DataFrame | None:
    """native as channels of the candidates."""
    if native is None:
        return None
    channel = F.concat(F.lit("native:"), F.col("source").cast("string")).alias("channel")
    return found.select("query_id", "id").join(native, [c for c in ("query_id", "id") if c in native.columns]).select("query_id", "id", channel, "rank")


def offered(rows: DataFrame) -> DataFrame:
    """What entities are made of: candidates with their signals, identity, and what diversification reads of a title."""
    title = F.col("title")
    rows = rows.withColumn("own_brand", text.brand(title)).withColumn("own_model", text.model(title, F.col("own_brand")))
    numbers = {n: F.col(n) for n in ranking.NUMBERS if n in rows.columns}
    tags = gates.entity_aspects(F.expr("cast(array() as array<string>)"), F.lit(""), F.coalesce("own_brand", F.lit("")), scoring.price_band(F.col("price_minor")))
    return rows.select(
        "query_id", "id", "title", "price_minor", "embedding", *ranking.SIGNALS,
        ranking.canonical_key(title, F.col("own_brand"), F.col("own_model"), numbers).alias("key"),
        ranking.model_key(F.col("own_brand"), F.col("own_model")).alias("model"),
        text.normalize_search(F.col("source").cast("string")).alias("source"),
        F.array_distinct(text.title_tokens(title)).alias("words"),
        tags.alias("aspects"),
    )


def with_gate(made: DataFrame, queries: DataFrame) -> DataFrame:
    """Entities (query_id, base, ...) at the floor or over, with eligible and lam by how specific their query is."""
    specific = queries.select("query_id", scoring.query_specificity(F.substring(F.trim("query"), 1, 500)).alias("specificity"))
    made = made.join(F.broadcast(specific), "query_id").withColumn("lam", scoring.dynamic_lambda(F.col("specificity")))
    return ranking.gated(made, scoring.relative_gate(F.col("specificity")), FLOOR)


def by_text(listings: DataFrame, texts: DataFrame, asked: DataFrame, results: int, sources: int, native: DataFrame | None) -> DataFrame:
    """search() of the queries (text_id, query_id, query, query_embedding) of texts (query_id, query) that name a product type.

    No vector changes the candidates of such a text, so these, their ranks by words and sources and their identities are
    worked out once for each text; its queries' vectors then meet the offers that have one.
    """
    specs = parsed(texts)
    found = exact(decided(listings, specs).where("eligible"), specs).withColumns({"semantic": F.lit(None).cast("double"), "relevance": F.col("lexical")})
    found = written(found.select("query_id", "id", "title", "price_minor", "source", "embedding", "tokens", "plain", "variants", *ranking.SIGNALS, *(n for n in ranking.NUMBERS if n in found.columns)), "candidates")
    weights = WEIGHTS | {f"native:{k}": NATIVE_WEIGHT for k in range(sources)}
    ranks = written(channels(found, own_order(found, native)), "ranks")
    offers = written(offered(found), "offers")
    own = offers.withColumnRenamed("query_id", "text_id")
    titles, vectors = own.select("text_id", "id", "source", "model", "words", "aspects"), own.select("text_id", F.col("id").alias("vector_id"), "embedding")
    asked = written(asked.join(texts.select(F.col("query_id").alias("text_id")), "text_id", "left_semi"), "block")

    def one(part: DataFrame) -> DataFrame:
        made = ranking.entities_by_vector(own, ranks, part.select("text_id", "query_id", "query_embedding"), weights, "semantic", SEMANTIC_FLOOR)
        made = with_gate(written(made, "entities"), part)
        return ranking.ranked(made.join(titles, ["text_id", "id"]).join(vectors, ["text_id", "vector_id"], "left").drop("text_id", "vector_id"), results, PER_SOURCE)

    return retrieval.in_blocks(asked, one, VECTORS)


def search_block(listings: DataFrame, queries: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None, sources: int, native: DataFrame | None) -> DataFrame:
    """Entities of a block of queries at the floor or over, with eligible and lam: all that search() ranks."""
    found = written(eligible_candidates(listings, queries), "candidates")  # the channels, the judge and the entities read it
    weights = WEIGHTS | {f"native:{k}": NATIVE_WEIGHT for k in range(sources)}
    if rerank is None:
        rows = found.withColumn("relevance", F.col("lexical"))
    else:
        scores = rerank(judged_pool(found)).select("query_id", "id", F.col("relevance").alias("judged"))
        rows = found.join(scores, ["query_id", "id"], "left").withColumn("relevance", scoring.blend(F.col("lexical"), F.col("judged")))
    ranks = written(channels(found, own_order(found, native)), "ranks")
    return with_gate(written(ranking.entities(offered(rows), ranks, weights), "entities"), queries)


def diagnostics(listings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, eligible, entities, duplicates, dropped): candidates of each query, their entities, offers that share one, and entities under the floor."""
    found = eligible_candidates(listings, queries).groupBy("query_id").agg(F.count("*").alias("eligible"))
    kept = search_block(listings, queries, None, 0, None).groupBy("query_id").agg(F.count("*").alias("kept"), F.sum("offers").alias("offers"))
    joined = found.join(kept, "query_id", "left").withColumns({"kept": F.coalesce("kept", F.lit(0)), "offers": F.coalesce("offers", F.lit(0))})
    return joined.select("query_id", "eligible", F.col("kept").alias("entities"), (F.col("offers") - F.col("kept")).alias("duplicates"), (F.col("eligible") - F.col("offers")).alias("dropped"))
