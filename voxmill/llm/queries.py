"""Registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_extract, lang_id, licenses, near_dedup, packing, substring_dedup, suffix_dedup, token_counts
from .runtime import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_suffixes(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.identify(docs, lang_id.train(lang_id.training_sample(docs)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.LICENSES)


#: A word as textvec has it, for lower-cased text.
WORD = r"[0-9a-z\x{80}-\x{9F}\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{A000}-\x{10FFFF}]+|[\x{3040}-\x{9FFF}]"

#: Every window of 50 words at two places or more, with its first place and the one before.
WINDOWS = f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
        win AS (SELECT DISTINCT doc_id, p - 1 AS p, md5(array_to_string(w[p:p + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
        rep AS (SELECT doc_id, p, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp, lag(doc_id) OVER o AS bd, lag(p) OVER o AS bp, count(*) OVER (PARTITION BY g) AS copies
                FROM win WINDOW o AS (PARTITION BY g ORDER BY doc_id, p)),"""

SQL = {
    "op5_suffix_array_dedup": f"""{WINDOWS}
        later AS (SELECT *, bp - p AS shift FROM rep WHERE bd IS NOT NULL),
        fresh AS (SELECT *, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS f FROM later WINDOW o AS (PARTITION BY doc_id, bd, shift ORDER BY p)),
        isle AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, bd, shift ORDER BY p) AS k FROM fresh)
        SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word, bd AS source_doc_id, min(p) + shift AS source_start_word
        FROM isle GROUP BY doc_id, bd, shift, k""",
    "op8_substring_dedup": f"""{WINDOWS}
        twice AS (SELECT *, doc_id = fd AND p = fp AS kept FROM rep WHERE copies > 1),
        fresh AS (SELECT *, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS f FROM twice WINDOW o AS (PARTITION BY doc_id, kept ORDER BY p)),
        isle AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, kept ORDER BY p) AS k FROM fresh)
        SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word, max(copies) AS copies, min(fd) AS first_doc_id, kept
        FROM isle GROUP BY doc_id, kept, k""",
    "op9_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark),
        dg AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
        ig AS (SELECT item_id, p, n, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) - 3)) AS p FROM i)),
        hit AS (SELECT doc_id, item_id, n, dg.p AS dp, ig.p AS ip FROM dg JOIN ig USING (g)),
        isle AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, ip - dp ORDER BY dp) AS k FROM hit),
        run AS (SELECT doc_id, item_id, min(n) AS n, min(dp) AS dp, max(dp) - min(dp) + 5 AS size, min(ip) AS ip FROM isle GROUP BY doc_id, item_id, ip - dp, k),
        cover AS (SELECT doc_id, item_id, count(DISTINCT q) AS c FROM (SELECT doc_id, item_id, unnest(range(ip, ip + size)) AS q FROM run) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, dp - 1 AS start_word, dp - 1 + size AS end_word
        FROM run JOIN cover USING (doc_id, item_id) WHERE size >= 8 OR c >= 0.5 * n""",
    "op2_exact_dedup": """
        SELECT doc_id, keep_doc_id, copies FROM (
            SELECT doc_id,
                   min(doc_id) OVER (PARTITION BY text) AS keep_doc_id,
                   count(*) OVER (PARTITION BY text) AS copies,
                   row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS rn
            FROM documents WHERE text IS NOT NULL) t
        WHERE rn > 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
