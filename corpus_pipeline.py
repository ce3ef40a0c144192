"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last give the columns of
documents. A stage that drops does so by doc_id, exact dedup by doc_id and text: a row whose doc_id is null can't be
named by a decision and stays. Texts of any length are read whole, null and empty ones are texts without words, columns
that docs have besides are carried along whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfspark.llm import chunk_dedup, decontamination, golay_simhash, sentencepiece_codec, toxicity
from shelfspark.llm.common import columns, configure, materialize, small_side, table
from shelfspark.llm.queries import PIECE_MODEL


#: Rows of decisions with a text's digest up to which they are broadcast.
DIGESTS = 1 << 18


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity operator rejects.

    Null and empty texts have no evidence and stay unless the labels make them all toxic. Rows of one doc_id go together
    if one of them is rejected; rows without a doc_id stay.
    """
    configure(spark)
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    rejected = materialize(scored.where("predicted = 1 and doc_id is not null").select("doc_id").distinct(), "toxic")
    return docs.join(small_side(rejected), "doc_id", "left_anti").select(columns(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, decided for each row.

    Texts of one doc_id that differ are kept or dropped apart; repeated rows of one doc_id and equal text become one, the
    longest original (the first in order among equals). Null and empty texts are equal. Rows without a doc_id stay.
    """
    configure(spark)
    found = materialize(chunk_dedup.exact_duplicates(docs), "exact-decisions")
    text, row = F.coalesce("text", F.lit("")), columns(docs)
    named = [c.lower() for c in docs.columns]
    digest, place = (next(n for n in (f"{'_' * k}{base}" for k in range(len(row) + 1)) if n.lower() not in named) for base in ("text_sha256", "place_of_row"))
    marked = docs.withColumn(digest, F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", ""), 256))
    dropped = materialize(found.where("not kept and doc_id is not null").select("doc_id", F.col("text_sha256").alias(digest)).distinct(), "exact-dropped")
    out = marked.join(small_side(dropped, DIGESTS), ["doc_id", digest], "left_anti")
    again = materialize(found.where("kept and doc_id is not null").groupBy("doc_id", F.col("text_sha256").alias(digest)).count().where("count > 1").select("doc_id", digest), "exact-repeated")
    if not again.isEmpty():
        longest = Window.partitionBy("doc_id", digest).orderBy(F.desc(F.length(text)), text)
        one = out.join(small_side(again, DIGESTS), ["doc_id", digest], "left_semi").withColumn(place, F.row_number().over(longest)).where(F.col(place) == 1)
        out = out.join(small_side(again, DIGESTS), ["doc_id", digest], "left_anti").select(row).unionByName(one.select(row))
    return out.select(row)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id.

    Texts without words are alike and one of them stays. Rows of one doc_id stay or go together, rows without one stay.
    """
    configure(spark)
    return golay_simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none. Rows of one doc_id go together if one of them holds an item, rows without one stay.
    """
    configure(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left; null texts are encoded as empty ones."""
    configure(spark)
    return sentencepiece_codec.encode_digests(docs, PIECE_MODEL)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: No SQL can express the stages' models, components and merges; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
