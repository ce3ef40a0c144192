"""Queries that list several products, for specs, intents and missions alike."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicon as lx, text


def words_of(query: Column) -> Column:
    """Words of a query without its price bounds, in lower case."""
    plain = F.regexp_replace(F.lower(query), rf"\b(?:{lx.LIST_BOUNDS})\s*\$?\s*\d+(?:\.\d{{1,2}})?", " ")
    return F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))


def listed_products(query: Column) -> Column:
    """Categories of a query that lists two or more products, compounds first; empty for other queries.

    At each place the phrase with the most words wins. A list has a separator, or three categories, with at most three
    unknown words, or two categories and none.
    """
    known = lx.COMPOUND_CATEGORIES | lx.CATEGORIES
    phrases = sorted(known, key=lambda p: (-p.count(" "), list(known).index(p)))
    pattern = f"(?<= )(?:{'|'.join(phrases)})(?= )"
    labels = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))

    def listed(tokens: Column) -> Column:
        padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        found = F.regexp_extract_all(padded, F.lit(pattern), F.lit(0))
        named = lambda some: F.transform(some, lambda p: F.element_at(labels, p))
        compounds, single = F.filter(found, lambda p: F.contains(p, F.lit(" "))), F.filter(found, lambda p: ~F.contains(p, F.lit(" ")))
        rest = F.filter(F.split(F.trim(F.regexp_replace(padded, pattern, " ")), r"\s+"), lambda t: (t != "") & ~t.isin(*lx.LIST_NOISE) & ~t.rlike(r"^\d+$"))
        return F.struct(F.array_distinct(F.concat(named(compounds), named(single))).alias("labels"), F.size(rest).alias("unknown"), F.size(tokens).alias("n"))

    def decided(x: Column) -> Column:
        many = F.size(x["labels"])
        few = (x["unknown"] <= 3) & (query.rlike(lx.LIST_SEPARATORS) | (many >= 3))
        return F.when((x["n"] >= 2) & (many >= 2) & (few | ((many == 2) & (x["unknown"] == 0))), x["labels"]).otherwise(F.expr("cast(array() as array<string>)"))

    return text.let(text.let(words_of(query), listed), decided)
