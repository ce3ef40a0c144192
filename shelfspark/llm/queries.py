"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import attention_quality, block_max_search, chunk_dedup, decontamination, feistel_pii, golay_simhash, language_mixture, sentencepiece_codec, slot_sharding, spelling_variants, toxicity, warc, word_bpe_codec
from .common import table

#: The vocabulary file of the public tokenizer; a parameter of the operators.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


#: Key of the pseudonyms in the query; a deployment passes its own.
PSEUDONYM_KEY = b"query-key-16byte"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held fold; toxicity.score_documents defines the edge cases."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1, threshold=0.7)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held fold; language_mixture.predict defines the edge cases."""
    return language_mixture.predict(table(spark, sf_dir, "documents"), folds=4, held=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held fold; attention_quality.score_documents defines the edge cases."""
    return attention_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.3)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests; sentencepiece_codec defines the edge cases."""
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds; decontamination.leaks defines the edge cases."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts; chunk_dedup.exact_duplicates defines the edge cases."""
    return chunk_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS original, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(original) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back; warc.round_trip defines the edge cases."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"), smallest=0)


#: SHA-1 in base 32: the digest's bits, five at a time.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * (strpos('0123456789abcdef', c) - 1) + 1 AS INT), 4)), '') AS bits FROM p),
e AS (SELECT page_id, html, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest FROM d),
l AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM e)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM l
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document by a stored map; slot_sharding.shard_documents defines the edge cases."""
    return slot_sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its values replaced by pseudonyms; feistel_pii.pseudonymised defines the edge cases."""
    return feistel_pii.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; golay_simhash.near_duplicates defines the edge cases."""
    found = golay_simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return word_bpe_codec.encode_digests(table(spark, sf_dir, "documents"), WORD_MODEL)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words' number, form and root."""
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


#: crc32 in SQL: two steps a byte over the table of the reversed polynomial's sixteen nibbles (fixed values).
OP12_SQL = """
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, times, list_transform(range(octet_length(encode(i || ':' || run))), lambda k: CAST('0x' || substr(hex(encode(i || ':' || run)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM low),
crc AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, b), lambda c, x:
    xor(xor(xor(c, x) >> 4, t[CAST(xor(c, x) & 15 AS INT) + 1]) >> 4, t[CAST(xor(xor(c, x) >> 4, t[CAST(xor(c, x) & 15 AS INT) + 1]) & 15 AS INT) + 1])), 4294967295) AS h
  FROM bytes, (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS t)),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM crc),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
holes AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n, a.n FROM holes a JOIN holes b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n, a.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n, b.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
forms AS (SELECT near.word, min(other) AS form, top AS form_n FROM near JOIN best USING (word) WHERE other_n = top AND top >= 10 * n GROUP BY ALL),
steps AS (SELECT word, form AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root),
ends AS (SELECT word, root FROM steps WHERE root NOT IN (SELECT word FROM forms))
SELECT words.word, form, coalesce(root, words.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)
"""


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return block_max_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH terms AS (SELECT doc_id, d.rowid AS place, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents) d),
tf AS (SELECT doc_id, place, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT place, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY place),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, n_docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, place, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (place), whole GROUP BY item_id, doc_id, place),
ranks AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranks WHERE rank <= 10
"""


def queries():
    return {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_quality, op4_sentencepiece, op5_decontamination, op6_exact_dedup, op7_warc, op8_sharding, op9_pii, op10_simhash_near_dedup, op11_word_bpe, op12_spelling_variants, op13_block_max_search)}


def oracle_sql():
    return {"op6_exact_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op12_spelling_variants": OP12_SQL, "op13_block_max_search": OP13_SQL}
