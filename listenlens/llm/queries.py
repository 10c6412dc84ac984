"""Registered queries of the corpus operators: the digest columns of each result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listenlens.llm import (brown_lm, decontam, fim, html_text, huffman, langid, mixing, neardup, quality, resample,
                            secrets, suffixes, warc)
from listenlens.llm.common import table
from listenlens.plans.catalog import QueryFn

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@register("op2_token_ids")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as Huffman blocks and read back."""
    return huffman.round_trip(table(spark, sf_dir, "documents"))


@register("op3_warc_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written as a WARC record and read back through the capture index."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@register("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "rate", "copies"))


@register("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@register("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression."""
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op7_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tok AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT r, i, lead(w, 1) OVER t AS w2, lead(w, 2) OVER t AS w3, w FROM tok WINDOW t AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, w3, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             (len(regexp_extract_all(text, '[A-Za-z]')) + len(regexp_extract_all(text, '[^\x00-\x7F]')))::BIGINT AS n_letters,
             len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '!'))::BIGINT AS n_bangs
      FROM w LEFT JOIN cover USING (r)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
      + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (100 * n_upper > 50 * n_letters)::INT + 32 * (100 * n_bangs > 30 * n_words)::INT
      + 64 * (word_chars < 2 * n_words)::INT + 128 * (word_chars > 14 * n_words)::INT + 256 * (100 * n_letters < 50 * word_chars)::INT)::BIGINT
      AS failed_bits FROM m)
SELECT *, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""


@register("op8_quality_ledger", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document with the default policy's verdict."""
    return quality.quality(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\x00', ' ', 'g'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item_id, least(10, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2),
             lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS key FROM iw WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS key
         FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
hit AS (SELECT dwin.r, dwin.i, dwin.k, win.item_id FROM dwin JOIN win USING (k, key)),
words AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) + max((item_id IS NULL)::INT) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@register("op9_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register("op10_brown_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class bigram score of every document."""
    return brown_lm.score(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@register("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put in fill-in-the-middle order."""
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


@register("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark's texts."""
    return resample.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT *, (strlen(h) // 2)::BIGINT AS n FROM d),
w AS (SELECT r, o, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, o, h, unnest(range(0, n - 49)) AS p FROM b)),
hit AS (SELECT r, p FROM (SELECT r, o, p, min(o) OVER (PARTITION BY s) AS first FROM w) WHERE first < o),
edge AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM hit),
run AS (SELECT r, p, sum((before IS NULL OR p > before + 50)::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM edge),
span AS (SELECT r, k, min(p) AS a, max(p) + 50 AS z FROM run GROUP BY r, k),
keep AS (SELECT r, a, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM (SELECT r, a, z FROM span UNION ALL SELECT r, n, n FROM b)),
rest AS (SELECT r, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS h FROM keep JOIN b USING (r) GROUP BY r),
cut AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM span GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest.h)) AS kept_sha256
FROM b JOIN rest USING (r) LEFT JOIN cut USING (r)
"""


@register("op13_suffix_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 50 bytes that an earlier one holds."""
    return suffixes.digest(suffixes.dedup(table(spark, sf_dir, "documents")))
