"""Registered queries: offers matched to products by number, image, centre and judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring
from ..operators import matching
from ..tables import table
from .catalog import query

COLOURS = ("red", "black", "golden", "silver grey")


def sample_offers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batch, members, products) from the vectors: of each ten, two products alike, four offers that they have and six new ones.

    The two products' vectors are near each other, so new offers have a second choice; noise of several strengths puts them
    above, in and below the judge's band.
    """
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), scoring.unit(F.col("embedding").cast("array<double>")).alias("u"))
    mixed = lambda a, b, t: scoring.unit(F.zip_with(a, b, lambda x, y: x + t * y))
    base = v.where("i % 5 = 0").select(F.col("i").alias("p"), F.col("u").alias("pu"))
    first = v.where("i % 10 = 0").select((F.col("i") + 5).alias("p"), F.col("u").alias("fu"))
    centre = base.join(first, "p", "left").select("p", F.when(F.col("fu").isNull(), F.col("pu")).otherwise(mixed(F.col("fu"), F.col("pu"), F.lit(0.5))).alias("pv"))
    colour = lambda i: F.element_at(F.array(*map(F.lit, COLOURS)), (i % 4 + 1).cast("int"))
    title = lambda i: F.concat(F.lit("Acme widget WH-"), (1000 + i - i % 10).cast("string"), F.lit("XM gadget "), colour(i))
    image = (F.col("p") + 1) * 2654435761 % 1099511627776 * 4194304
    i, new = F.col("i"), F.col("i") % 5 > 1
    number = F.lpad(F.col("p").cast("string"), 8, "0")
    noise = F.when(i % 5 == 0, 0.0).when(i % 5 == 1, 0.3).otherwise(0.3 + 0.05 * (i % 13))
    rows = v.withColumn("p", i - i % 5).join(centre, "p").select(
        i.alias("listing_id"),
        F.col("p").alias("product_id"),
        (i % 97).alias("ord"),
        F.when(new, 1 + i % 2).when(i % 7 == 0, 1).otherwise(5 + i % 3).alias("source"),
        F.when(~new & (i % 4 == 0), F.concat(F.lit("https://shop.example/dp/B0"), number))
        .when(new & (i % 6 == 0), F.concat(F.lit("https://other.example/gp/product/b0"), number))
        .otherwise(F.concat(F.lit("https://shop.example/p/"), i.cast("string")))
        .alias("url"),
        F.when(i % 5 == 1, image).when(new & (i % 8 == 0), image.bitwiseXOR(F.pow(F.lit(2), i % 9).cast("long") - 1)).alias("hash"),
        mixed(F.col("pv"), F.col("u"), noise).alias("embedding"),
        title(i).alias("title"),
        F.when(~new, 1000 + 100 * (i % 7)).when(i % 11 == 0, 12000).otherwise(1200).alias("price_minor"),
    )
    products = v.where("i % 5 = 0").select(i.alias("product_id"), title(i).alias("title"))
    return rows.where("listing_id % 5 > 1").drop("product_id"), rows.where("listing_id % 5 < 2").drop("ord"), products


@query(f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u
  FROM embeddings),
c AS (
  SELECT b.i AS p, CASE WHEN b.i % 10 = 0 THEN b.u ELSE list_transform(list_zip(f.u, b.u), lambda z: z[1] + 0.5 * z[2]) END AS raw
  FROM v b LEFT JOIN v f ON f.i = b.i - 5 WHERE b.i % 5 = 0),
m AS (
  SELECT i, i - i % 5 AS p, i % 5 > 1 AS new,
    list_transform(list_zip(list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))), u),
      lambda z: z[1] + z[2] * CASE WHEN i % 5 = 0 THEN 0.0 WHEN i % 5 = 1 THEN 0.3 ELSE 0.3 + 0.05 * (i % 13) END) AS raw
  FROM v JOIN c ON c.p = i - i % 5),
rows AS (
  SELECT i AS listing_id, p, new, i - i % 10 AS family, i % 97 AS ord, CASE WHEN new THEN 1 + i % 2 WHEN i % 7 = 0 THEN 1 ELSE 5 + i % 3 END AS source,
    CASE WHEN NOT new AND i % 4 = 0 OR new AND i % 6 = 0 THEN p END AS number,
    CASE WHEN i % 5 = 1 THEN (p + 1) * 2654435761 % 1099511627776 * 4194304
      WHEN new AND i % 8 = 0 THEN xor((p + 1) * 2654435761 % 1099511627776 * 4194304, (1 << (i % 9)) - 1) END AS hash,
    list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS e,
    'acme widget wh-' || (1000 + i - i % 10) || 'xm gadget ' || ['red', 'black', 'golden', 'silver grey'][i % 4 + 1] AS title,
    CASE WHEN NOT new THEN 1000 + 100 * (i % 7) WHEN i % 11 = 0 THEN 12000 ELSE 1200 END AS price
  FROM m),
batch AS (SELECT * FROM rows WHERE new), members AS (SELECT * FROM rows WHERE NOT new),
places AS (SELECT p, k, sum(e[k]) AS s FROM members, range(1, 65) r(k) GROUP BY p, k),
sums AS (SELECT p, list(s ORDER BY k) AS s FROM places GROUP BY p),
products AS (
  SELECT s.p, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS centre, median(price) AS median, min(CASE WHEN listing_id = s.p THEN title END) AS title, min(family) AS family
  FROM sums s JOIN members m ON m.p = s.p GROUP BY s.p, s),
steps AS (
  SELECT DISTINCT b.listing_id, m.p, 1 AS step, 1.0::DOUBLE AS score, 0::BIGINT AS first FROM batch b JOIN members m ON b.number = m.number
  UNION ALL
  SELECT b.listing_id, m.p, 2, 1.0, min(m.listing_id) FROM batch b JOIN members m ON bit_count(xor(b.hash, m.hash)) <= 6
  WHERE bit_count(b.hash) BETWEEN 4 AND 60 AND bit_count(m.hash) BETWEEN 4 AND 60 AND b.price / m.price BETWEEN 0.25 AND 4 GROUP BY b.listing_id, m.p
  UNION ALL
  SELECT b.listing_id, p.p, 3, round(list_dot_product(b.e, p.centre), 9), 0 FROM batch b JOIN products p ON p.family = b.family
  WHERE b.price / p.median BETWEEN 0.25 AND 4 AND round(list_dot_product(b.e, p.centre), 9) >= 0.78),
met AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY listing_id, p ORDER BY step) = 1),
keyed AS (
  SELECT met.*, b.source, length(least(b.title, p.title) || '||' || greatest(b.title, p.title)) AS size
  FROM met JOIN batch b USING (listing_id) JOIN products p ON p.p = met.p WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.p = met.p AND m.source = b.source)),
chains AS (
  SELECT listing_id, list({{'p': p, 'step': step, 'score': score,
      'said': CASE WHEN step < 3 OR score >= 0.86 THEN 'sure' WHEN size % 3 = 0 THEN 'yes' WHEN size % 3 = 1 THEN 'no' ELSE 'silent' END}} ORDER BY step, score DESC, first, p) AS chain
  FROM keyed GROUP BY listing_id),
turns AS (SELECT listing_id, source, coalesce(chain, []) AS chain, row_number() OVER (PARTITION BY source ORDER BY ord, listing_id) AS k FROM batch LEFT JOIN chains USING (listing_id)),
go AS (
  SELECT source, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS listing_id, NULL::BIGINT AS p, NULL::VARCHAR AS reason, NULL::DOUBLE AS score FROM turns GROUP BY source
  UNION ALL
  SELECT source, k, CASE WHEN fits THEN list_append(taken, best.p) ELSE taken END, listing_id, CASE WHEN fits THEN best.p END,
    CASE WHEN best IS NULL THEN 'no-match' WHEN best.step = 1 THEN 'number' WHEN best.step = 2 THEN 'image' WHEN best.said = 'yes' THEN 'judge-yes' WHEN best.said = 'no' THEN 'judge-no'
      WHEN fits THEN 'cosine' ELSE 'no-match' END, best.score
  FROM (
    SELECT *, coalesce(best.said IN ('sure', 'yes') OR best.said = 'silent' AND best.score >= 0.82, false) AS fits
    FROM (SELECT t.source, t.k, g.taken, t.listing_id, list_filter(t.chain, lambda x: NOT list_contains(g.taken, x.p))[1] AS best FROM go g JOIN turns t ON t.source = g.source AND t.k = g.k + 1)))
SELECT listing_id, p AS product_id, reason, round(score, 6) AS score FROM go WHERE k > 0
""")
def entity_cascade(spark, sf_dir):
    """New offers of two sources, matched to products by number, image, centre and judge, each product once a source."""
    batch, members, products = sample_offers(spark, sf_dir)

    def judge(pairs: DataFrame) -> DataFrame:
        size = F.length("pair_key") % 3
        return pairs.select("pair_key", F.when(size == 0, True).when(size == 1, False).alias("same"))

    found, _ = matching.resolved(batch, members, products, judge)
    return found.select("listing_id", "product_id", "reason", F.round("score", 6).alias("score"))
