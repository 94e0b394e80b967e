"""Snapshot digests and freshness diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_digests(articles: DataFrame) -> DataFrame:
    """``(name, article_count, content_hash)`` of ``articles(name,
    ordinal, jo_no, title, body)``: sha256 of the ordered lines, 16 digits."""
    line = F.concat_ws("|", "jo_no", "title", "body")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x.line)
    return articles.groupBy("name").agg(F.count("*").alias("article_count"), F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16).alias("content_hash"))


def monitored(adjacent: DataFrame) -> DataFrame:
    """All laws of the adjacency table, by name."""
    return adjacent.select("law").union(adjacent.select("parallel")).distinct().orderBy("law")


def compare(names: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """``(name, status, detail)``; unchanged laws are left out.

    Snapshots have ``name, mst, enforced, article_count, content_hash``.
    """
    now = current.select("name", *[F.col(c).alias(f"now_{c}") for c in ("mst", "enforced", "article_count", "content_hash")])
    joined = names.select("name").distinct().join(now, "name", "left").join(stored, "name", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
    arrow = lambda label, c: F.concat(F.lit(f"{label} "), F.coalesce(c, F.lit("")), F.lit(" → "), F.coalesce(f"now_{c}", F.lit("")))
    counts = F.concat(F.lit("본문 변경 ("), F.col("article_count").cast("string"), F.lit("→"), F.col("now_article_count").cast("string"), F.lit("개 조문)"))
    detail = F.concat_ws("; ", F.when(differs("mst"), arrow("MST", "mst")), F.when(differs("enforced"), arrow("시행일", "enforced")), F.when(differs("content_hash"), counts))
    status = F.when(F.col("now_mst").isNull(), "unresolved").when(F.col("mst").isNull(), "new").when(detail != "", "changed")
    return joined.select("name", status.alias("status"), F.when(status == "changed", detail).otherwise("").alias("detail")).where("status is not null")
