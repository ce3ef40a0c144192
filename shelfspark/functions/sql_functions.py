"""The library's functions for Spark SQL: scalars as SQL functions, which Catalyst inlines, and the card extractor as a table function."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import ship
from . import text

#: name, parameters, type, and body; bodies are plain SQL, so no Python runs.
SCALARS = (
    ("normalized_text", "x STRING", "STRING", f"trim(regexp_replace(regexp_replace(translate(lower(x), '{text.ACCENTED}', '{text.PLAIN}'), '[̀-ͯ]', ''), '[^a-z0-9]+', ' '))"),
    ("text_key", "x STRING", "STRING", "replace(normalized_text(x), ' ', '')"),
    ("url_host", "x STRING", "STRING", "regexp_replace(lower(parse_url(trim(x), 'HOST')), '^www[.]', '')"),
    ("price_fits", "price BIGINT, middle DOUBLE", "BOOLEAN", "price <= 0 OR middle IS NULL OR middle <= 0 OR price / middle BETWEEN 0.25 AND 4.0"),
    ("hash_distance", "a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    ("hash_useful", "h BIGINT", "BOOLEAN", "bit_count(h) BETWEEN 4 AND 60"),
    ("set_similarity", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0.0)"),
    ("minor_units", "amount DOUBLE", "BIGINT", "cast(floor(amount * 100 + 0.5) AS BIGINT)"),
)
#: Fields of a card besides its place, in the order of the table function's columns.
FIELDS = ("external_id", "title", "url", "price_text", "image_url")


class SelectorCards:
    """selector_cards(html, config): the cards of a page by a constant configuration (JSON). Optional fields are columns only if it has a selector for them."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.config: dict = {}
        self.names: list[str] = []

    @staticmethod
    def fields(config: dict) -> list[str]:
        return [f for f in FIELDS if f not in ("price_text", "image_url") or config.get(f.split("_")[0])]

    @staticmethod
    def analyze(html: AnalyzeArgument, config: AnalyzeArgument) -> AnalyzeResult:
        if not config.isConstantExpression or config.value is None:
            raise ValueError("selector_cards: the configuration has to be a constant string")
        schema = StructType().add("place", LongType())
        for name in SelectorCards.fields(json.loads(config.value)):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, html: str, config: str):
        from ..sources.payloads import extract_cards

        if not self.config:
            self.config = json.loads(config)
            self.names = self.fields(self.config)
        for place, card in enumerate(extract_cards(html, self.config)):
            yield (place, *(card[n] for n in self.names))


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session, as temporary ones; gives their names."""
    ship(spark)
    for name, parameters, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("selector_cards", udtf(SelectorCards))
    return [s[0] for s in SCALARS] + ["selector_cards"]
