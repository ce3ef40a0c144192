"""Numbers: vectors, clamps, similarity and ranking scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; null, NaN and infinities are low."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(low)).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]; null if a vector is missing, empty or zero, or the lengths differ."""
    from . import text

    # one pass over the pairs of values gives the product and both squares
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    sums = F.aggregate(pairs, zero, lambda s, z: F.struct((s["p"] + z["x"] * z["y"]).alias("p"), (s["x"] + z["x"] * z["x"]).alias("x"), (s["y"] + z["y"] * z["y"]).alias("y")))
    ratio = text.let(sums, lambda s: cosine_of(s["p"], s["x"], s["y"]))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0), ratio)


def cosine_of(product: Column, square: Column, other: Column) -> Column:
    """cosine() of two vectors of one length from their dot product and the dot product of each with itself."""
    return F.when((square > 0) & (other > 0), F.least(F.greatest(product / F.sqrt(square * other), F.lit(0.0)), F.lit(1.0)))


def entity_similarity(model: Column, vector: Column, words: Column, aspects: Column, other_model: Column, other_vector: Column, other_words: Column, other_aspects: Column) -> Column:
    """Similarity of two entities: 1 for one model, else 0.65 cosine + 0.25 title + 0.1 aspect overlap, or 0.75 and 0.25 of the overlaps without vectors."""
    from . import text

    none = F.expr("cast(array() as array<string>)")
    overlap = lambda x, y: jaccard(F.coalesce(x, none), F.coalesce(y, none))
    titles, tags = overlap(words, other_words), overlap(aspects, other_aspects)
    mixed = text.let(cosine(vector, other_vector), lambda c: F.when(c.isNull(), 0.75 * titles + 0.25 * tags).otherwise(0.65 * c + 0.25 * titles + 0.1 * tags))
    return F.when(F.coalesce(model == other_model, F.lit(False)), 1.0).otherwise(clamp(mixed))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    from . import text

    return text.let(norm(a), lambda n: F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


def semantic(score: Column) -> Column:
    """A cosine as a signal in [0, 1]: negative ones move to (s + 1) / 2."""
    return F.when(score < 0, clamp((score + 1) / 2)).otherwise(clamp(score))


def useful_hash(h: Column) -> Column:
    """Whether a 64-bit image hash has between 4 and 60 bits set."""
    return F.bit_count(h).between(4, 60)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays; `empty` for two empty ones."""
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def price_band(price_minor: Column) -> Column:
    return F.when(price_minor.isNull() | (price_minor <= 0), None).when(price_minor < 2_500, "price:entry").when(price_minor < 10_000, "price:value").when(price_minor < 30_000, "price:mid").when(price_minor < 75_000, "price:premium").otherwise("price:luxury")


def price_window(price_minor: Column, low: Column, high: Column) -> Column:
    """Unknown prices pass; others lie within the bounds that are set."""
    return (price_minor <= 0) | ((low.isNull() | (price_minor >= low)) & (high.isNull() | (price_minor <= high)))


def spec_price_gate(price_minor: Column, low: Column, high: Column) -> Column:
    """As price_window, but an unknown price fails where a bound is set."""
    return (low.isNull() & high.isNull()) | ((price_minor > 0) & (low.isNull() | (price_minor >= low)) & (high.isNull() | (price_minor <= high)))


def price_fit(price_minor: Column, median: Column) -> Column:
    """Whether a price is between a quarter and four times the median; unknown on either side passes."""
    return (price_minor <= 0) | median.isNull() | (median <= 0) | (price_minor / median).between(0.25, 4.0)


def listing_quality(price_minor: Column, has_image: Column, availability: Column, reviews: Column, rating: Column, cached: Column) -> Column:
    w = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), F.lit(v)).otherwise(0.0)
    return clamp(F.when(cached, 0.35).otherwise(0.55) + w(price_minor > 0, 0.12) + w(has_image, 0.08) + w(availability == "in_stock", 0.1) - w(availability == "out", 0.35) + w(reviews >= 10, 0.05) + w(rating >= 4, 0.05))


def query_specificity(query: Column) -> Column:
    """How exact a query is, in [0, 1]: more words, quotes, model-like tokens and the word model raise it, one generic word lowers it."""
    from . import lexicon as lx, text

    tokens = F.filter(F.split(text.normalize_search(query), " "), lambda t: t != "")
    n = F.size(tokens)
    w = lambda cond, v: F.when(cond, F.lit(v)).otherwise(0.0)
    score = F.lit(0.15) + w(n >= 2, 0.1) + w(n >= 4, 0.15) + w(query.rlike('["“”]'), 0.25) + w(F.exists(tokens, lambda t: t.rlike(r"[a-z]+\d|\d+[a-z]+")), 0.4) + w(F.exists(tokens, lambda t: t.rlike(r"^\d{4,}$")), 0.25) - w(
        (n == 1) & F.try_element_at(tokens, F.lit(1)).isin(*lx.GENERIC_QUERY_WORDS),
        0.12,
    ) + w(query.rlike(r"(?i)\b(?:exact|model|sku|mpn|part number)\b"), 0.25)
    return F.when(n == 0, 0.5).otherwise(clamp(score))


def dynamic_lambda(specificity: Column) -> Column:
    return 0.64 + 0.3 * specificity


def relative_gate(specificity: Column) -> Column:
    return 0.55 + 0.3 * specificity


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Mean of the signals that aren't null, by weight; null if all are."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in pairs), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in pairs), F.lit(0.0))
    return F.try_divide(value, F.when(total > 0, total))


def token_forms(tokens: Column) -> Column:
    """Different tokens with their plurals and singulars: what a query token may equal."""
    plural = F.transform(tokens, lambda x: F.concat(x, F.lit("s")))
    singular = F.transform(F.filter(tokens, lambda x: x.endswith("s")), lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
    return F.array_distinct(F.concat(tokens, plural, singular))


def lexical_match(query: Column, plain: Column, forms: Column) -> Column:
    """lexical_score where the text's normal form and token forms are columns already."""
    from . import text

    def score(q: Column) -> Column:
        tokens = text.let(F.array_distinct(text.lexical_tokens(q)), lambda t: F.when(F.size(t) == 0, F.lit(None)).otherwise(F.size(F.array_intersect(t, forms)) / F.size(t)))
        tight = F.replace(q, F.lit(" "))
        whole = F.when(F.contains(plain, q), 0.2).otherwise(0.0) + F.when((F.length(tight) >= 4) & F.contains(F.replace(plain, F.lit(" ")), tight), 0.15).otherwise(0.0)
        return F.when((q == "") | (plain == ""), 0.0).otherwise(F.coalesce(F.least(tokens * 0.65 + whole, F.lit(1.0)), F.lit(0.0)))

    return text.let(text.normalize_search(query), score)


def lexical_score(query: Column, text_column: Column) -> Column:
    """0.65 share of query tokens (plural-tolerant) + 0.2 whole phrase + 0.15 phrase without spaces; at most 1."""
    from . import text

    return lexical_match(query, text.normalize_search(text_column), token_forms(text.lexical_tokens(text_column)))


def relevance_thresholds(tokens: Column) -> tuple[Column, Column]:
    """(floor, trust) of a semantic score by the number of query tokens."""
    return F.when(tokens <= 1, 0.4).when(tokens == 2, 0.35).otherwise(0.3), F.when(tokens <= 1, 0.5).when(tokens == 2, 0.45).otherwise(0.42)


def blend(prior: Column, model_score: Column) -> Column:
    """Prior relevance with a reranker's score; the prior alone where there is none."""
    return F.when(model_score.isNull(), prior).otherwise(0.65 * prior + 0.35 * clamp(model_score))


def dcg_gain(grade: Column, position: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(position + 1.0)
