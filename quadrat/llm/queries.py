"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import bpe, jaccard_join, license_scan, line_dedup, lm_score, mixing, order_minhash, quality, suffix_dedup, token_counts
from quadrat.llm.common import read_documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(read_documents(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_documents(spark, sf_dir), k=3, num=90)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(read_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_documents(spark, sf_dir))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"f.{c}").alias(c) for c in base], "kept", "quality")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(read_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(read_documents(spark, sf_dir))
    return rows.select(F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_gone").cast("long").alias("n_gone"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_order_minhash, op3_lm_score, op4_jaccard_join, op5_suffix_dedup, op6_quality, op7_token_counts, op8_license_scan, op9_line_dedup, op10_mixing)}

_SHINGLES = r"""docs AS (SELECT doc_id, text FROM documents),
  words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
  shingles AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words)"""

#: Set join by shared shingles, and the components of its links.  Quadratic in the documents of a shingle, which the checked tables allow.
_SET_JOIN = f"""WITH RECURSIVE {_SHINGLES},
  sizes AS (SELECT doc_id, len(s) AS n FROM shingles), flat AS (SELECT doc_id, unnest(s) AS x FROM shingles),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sizes"""

#: Later places of a pair of neighbouring lines go, and those of a long line.
_LINE_RUNS = r"""WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM raw),
  worded AS (SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
  placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM worded),
  pairs AS (SELECT doc_id, k, row_number() OVER (PARTITION BY w, after ORDER BY doc_id, k) AS nth FROM placed WHERE after IS NOT NULL),
  longs AS (SELECT doc_id, k, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS nth FROM placed WHERE len(regexp_split_to_array(w, '[\x20\x09-\x0D]+')) >= 30),
  marks AS (SELECT doc_id, k FROM pairs WHERE nth > 1 UNION SELECT doc_id, k + 1 FROM pairs WHERE nth > 1 UNION SELECT doc_id, k FROM longs WHERE nth > 1),
  gone AS (SELECT doc_id, i FROM placed JOIN marks USING (doc_id, k)),
  kept AS (SELECT lines.doc_id, count(*) AS n_lines, count(gone.i) AS n_gone, coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (gone.i IS NULL), '') AS text
    FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.i = gone.i GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_gone, sha256(kept.text) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

#: The others can't be stated in SQL as a whole (hash orders, fitted models, tokenizers, byte strings); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_jaccard_join": _SET_JOIN, "op9_line_dedup": _LINE_RUNS}
