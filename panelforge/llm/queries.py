"""Queries p6_ to p8_: training-data operators over texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, quality, tokenize


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode(_docs(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold an evaluation passage, and the item."""
    return leaks.leaks(_docs(spark, d), spark.read.parquet(f"{d}/eval_items.parquet"))


def p7_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate page and item, how many consecutive words it holds and how many make a case."""
    return leaks.alignments(_docs(spark, d), spark.read.parquet(f"{d}/eval_items.parquet"))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every document's text."""
    out = quality.statistics(_docs(spark, d), spark.read.parquet(f"{d}/common_words.parquet"))
    return out.select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_ratio", "line_end_share", "common_share")])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are no prose."""
    return quality.found(_docs(spark, d), spark.read.parquet(f"{d}/common_words.parquet"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and outlier score of every page with words."""
    out = quality.scored(_docs(spark, d), spark.read.parquet(f"{d}/common_words.parquet"))
    return out.withColumn("score", F.round("score", 6))


def p8_tails(spark: SparkSession, d: str) -> DataFrame:
    """The outlier score over the statistics that SQL has as well."""
    stats = p8_stats(spark, d).filter(F.col("n_words") > 0).join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    out = quality.outlier_scores(stats, "lang", quality.PLAIN_TAILS, F.col("common_share") >= quality.SURE_SHARE)
    return out.select("doc_id", F.round("score", 6).alias("score"))


_S = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

QUERIES = {f.__name__: f for f in (p6_ids, p7_found, p7_alignments, p8_found, p8_stats, p8_scores, p8_tails)}

_STATS = rf"""WITH c AS (SELECT list(DISTINCT lower(word)) AS cw FROM common_words),
  w AS (SELECT doc_id, lang, text, cw, regexp_extract_all(coalesce(text, ''), '[^{_S}]+') AS ws,
    list_filter(regexp_split_to_array(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[\n\r]'), lambda x: regexp_matches(x, '[^{_S}]')) AS ls FROM documents, c),
  s AS (SELECT doc_id, lang, len(ws) AS n_words, nullif(len(ws), 0)::DOUBLE AS n, list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE AS chars,
    length(regexp_replace(text, '[\p{{L}}\p{{N}}{_S}]', '', 'g')) AS symbols,
    len(list_filter(ls, lambda x: regexp_matches(x, '[.!?;:,]["''\x{{201d}}\x{{201c}}\x{{bb}})]*[{_S}]*$'))) / nullif(len(ls), 0)::DOUBLE AS line_end_share,
    len(list_filter(ws, lambda x: list_contains(cw, regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')))) AS hits FROM w),
  st AS (SELECT doc_id, lang, n_words, round(chars / n, 9) AS mean_word_length, round(symbols / chars, 9) AS symbol_ratio, round(line_end_share, 9) AS line_end_share, round(hits / n, 9) AS common_share FROM s)"""


def _tails_sql() -> str:
    """Ranks among the different reference pages by window sums, apart from the operator's sort and offsets."""
    cols = list(quality.PLAIN_TAILS)
    parts = []
    for c, side in quality.PLAIN_TAILS.items():
        left = f"-ln((sum(w) OVER (PARTITION BY g ORDER BY {c}) + 1) / (nn + 1.0))"
        right = f"-ln((nn - sum(w) OVER (PARTITION BY g ORDER BY {c}) + sum(w) OVER (PARTITION BY g, {c}) + 1) / (nn + 1.0))"
        parts.append(left if side == "left" else right if side == "right" else f"greatest({left}, {right})")
    return f"""{_STATS}, p AS (SELECT *, row_number() OVER (PARTITION BY lower(lang), {", ".join(cols)}) = 1 AND common_share >= {quality.SURE_SHARE} AS first_of FROM st WHERE n_words > 0),
  q AS (SELECT *, '=' || coalesce(lower(lang), '') AS g FROM p UNION ALL SELECT *, '*' AS g FROM p),
  n AS (SELECT *, CAST(first_of AS INTEGER) AS w, count(*) FILTER (first_of) OVER (PARTITION BY g) AS nn FROM q),
  t AS (SELECT doc_id, g, nn, ({" + ".join(parts)}) / nullif(ln(nn + 1.0), 0) AS u FROM n),
  b AS (SELECT a.doc_id, CASE WHEN o.nn >= {quality.LEAST_REFERENCE} THEN o.u ELSE a.u END AS mine, a.u AS every FROM t a JOIN t o ON a.doc_id = o.doc_id WHERE a.g = '*' AND o.g <> '*')
  SELECT doc_id, round((mine + every) / 2, 6) AS score FROM b"""


SQL = {"p8_stats": f"{_STATS} SELECT * EXCLUDE (lang) FROM st", "p8_tails": _tails_sql()}
