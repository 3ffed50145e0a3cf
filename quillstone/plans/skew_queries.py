"""Queries over keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.frequency import heavy_keys, key_profile
from quillstone.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Laws, exactly as stored, that hold at least 4 % of all passages."""
    return heavy_keys(table(spark, d, "ris_sentences"), "law_type", "page", 0.04).select("law_type")


def p1_law_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct pages and texts, the most frequent page and text, and page percentiles of each law."""
    t = key_profile(table(spark, d, "ris_sentences").select("law_type", "page", "sentence"), "law_type", ["page", "sentence"], [0.5, 0.9])
    return t.select(
        "law_type",
        "n_rows",
        "page_values",
        "page_distinct",
        "page_mode",
        F.round("page_q0", 6).alias("page_p50"),
        F.round("page_q1", 6).alias("page_p90"),
        "sentence_values",
        "sentence_distinct",
        "sentence_mode",
    )


QUERIES = {"p1_found": p1_found, "p1_law_profile": p1_law_profile}

ORACLE = {
    "p1_found": "SELECT law_type FROM ris_sentences WHERE law_type IS NOT NULL GROUP BY 1 HAVING count(*) * 25 >= (SELECT count(*) FROM ris_sentences)",
    "p1_law_profile": """
WITH pages AS (SELECT law_type, page, count(*) AS w FROM ris_sentences WHERE page IS NOT NULL GROUP BY 1, 2),
     texts AS (SELECT law_type, sentence, count(*) AS w FROM ris_sentences WHERE sentence IS NOT NULL GROUP BY 1, 2),
     pm AS (SELECT law_type, page AS page_mode FROM pages QUALIFY row_number() OVER (PARTITION BY law_type ORDER BY w DESC, page) = 1),
     tm AS (SELECT law_type, sentence AS sentence_mode FROM texts QUALIFY row_number() OVER (PARTITION BY law_type ORDER BY w DESC, sentence) = 1),
     laws AS (
       SELECT law_type, count(*) AS n_rows, count(page) AS page_values, count(DISTINCT page) AS page_distinct,
              round(quantile_cont(page, 0.5), 6) AS page_p50, round(quantile_cont(page, 0.9), 6) AS page_p90,
              count(sentence) AS sentence_values, count(DISTINCT sentence) AS sentence_distinct
       FROM ris_sentences GROUP BY 1)
SELECT laws.law_type, n_rows, page_values, page_distinct, page_mode, page_p50, page_p90, sentence_values, sentence_distinct, sentence_mode
FROM laws LEFT JOIN pm ON laws.law_type IS NOT DISTINCT FROM pm.law_type LEFT JOIN tm ON laws.law_type IS NOT DISTINCT FROM tm.law_type""",
}
