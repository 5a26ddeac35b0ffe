"""The registered queries of this subpackage, ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import byte_bpe, decontaminate, language, lexical, lines, pii_spans, quality, simhash, substrings, token_files, toxicity, variants, windows
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir), shingle=3, max_bits=2)


@query
def op2_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = byte_bpe.bpe_encode(documents(spark, sf_dir), decode=True)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens-orc")
    token_files.write_tokens(documents(spark, sf_dir), path)
    rows = token_files.token_starts(token_files.read_tokens(spark, path))
    return rows.select("doc_id", "start", "n_tokens", token_files.ids_crc32("ids").alias("ids_crc32"))


@query
def op4_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.window_dedup(documents(spark, sf_dir), width=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.substring_dedup(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op3_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
word AS (
  SELECT doc_id, pos, line,
         list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM line),
firsts AS (
  SELECT words, len(words) AS n, min((doc_id, pos)) AS first FROM word WHERE len(words) > 0 GROUP BY words),
spot AS (SELECT words, n, first, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 5),
variant AS (
  SELECT words, n, first, i, hash(list_concat(words[1:i - 1], words[i + 1:])) AS v FROM spot),
swap AS (SELECT v, i, n, min(first) AS m FROM variant GROUP BY v, i, n),
earlier AS (
  SELECT a.words, min(s.m) AS m FROM variant a JOIN swap s USING (v, i, n) WHERE s.m < a.first GROUP BY a.words
  UNION ALL
  SELECT a.words, min(b.first) FROM variant a JOIN firsts b ON hash(b.words) = a.v AND b.n = a.n - 1
  WHERE b.first < a.first GROUP BY a.words
  UNION ALL
  SELECT b.words, min(a.first) FROM variant a JOIN firsts b ON hash(b.words) = a.v AND b.n = a.n - 1
  WHERE a.first < b.first GROUP BY b.words),
best AS (
  SELECT f.words, least(f.first, coalesce(min(e.m), f.first)) AS best
  FROM firsts f LEFT JOIN earlier e ON e.words = f.words GROUP BY f.words, f.first),
judged AS (
  SELECT w.doc_id, w.pos, w.line, coalesce(b.best < (w.doc_id, w.pos), false) AS gone
  FROM word w LEFT JOIN best b ON b.words = w.words AND len(w.words) > 0)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), benchmark, rules=decontaminate.RULES).drop("mark")


@query
def op9_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language.learn(docs.filter(fold != 1))
    return (language.predict_language(docs, model)
            .select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"))


@query
def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.predict_chain(docs, toxicity.train_chain(docs, labels))


@query
def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir), spoil_every=199)


@query
def op11_k2treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"), k=10)


ORACLE["op11_k2treap_search"] = r"""
WITH lowered AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
term AS (
  SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM lowered),
point AS (SELECT id AS doc_id, t, count(*) AS tf FROM term WHERE side = 'd' GROUP BY id, t),
size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM point GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
           FROM point, total GROUP BY t),
wanted AS (SELECT DISTINCT id AS item_id, t FROM term WHERE side = 'i'),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM wanted JOIN point USING (t) JOIN weight USING (t) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


@query
def op13_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.pii_digest(documents(spark, sf_dir))
