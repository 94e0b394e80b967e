"""Sinks: manifest, graph, link records, reports (K1-K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_manifest(snapshots: DataFrame, path: str, checked_at: str) -> None:
    """K1: one JSON document of all snapshots (a few rows per monitored law)."""
    rows = snapshots.withColumnsRenamed({"enforced": "시행일", "promulgated": "공포일"})
    rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("laws")).select(F.lit(checked_at).alias("checked_at"), "laws").write.mode("overwrite").json(path)


# Laws of a citation graph.
GRAPH_LAWS = ("소득세법", "소득세법 시행령")
EXTENDED_GRAPH_LAWS = (*GRAPH_LAWS, "법인세법", "법인세법 시행령", "부가가치세법", "부가가치세법 시행령")


def graph_scope(extended: bool = False, manifest: DataFrame | None = None) -> list[str]:
    """K2: the laws of a graph: two, six, or all of a manifest (a few rows)."""
    if manifest is not None:
        return [r.name for r in manifest.select("name").distinct().orderBy("name").collect()]
    return list(EXTENDED_GRAPH_LAWS if extended else GRAPH_LAWS)


def write_graph(edges: DataFrame, path: str, built_at: str = "", laws: list[str] | None = None, files: int = 8) -> None:
    """K2: ``edges``, partitioned by source law, a law's in up to ``files``
    files sorted by target, and ``meta``: date, laws and number of edges."""
    part = F.pmod(F.xxhash64("target_law", "target_ref"), F.lit(files))
    edges.repartition("source_law", part).sortWithinPartitions("source_law", "target_law", "target_ref").write.mode("overwrite").partitionBy("source_law").parquet(f"{path}/edges")
    named = F.array(*[F.lit(x) for x in laws or ()]).cast("array<string>")
    edges.agg(F.count("*").alias("edge_count")).select(F.lit(built_at).alias("built_at"), named.alias("laws"), "edge_count").write.mode("overwrite").json(f"{path}/meta")


def write_records(records: DataFrame, path: str) -> None:
    """K3: nested JSON lines."""
    records.write.mode("overwrite").json(path)


def markdown_summary(records: DataFrame, top_records: int = 80, top_links: int = 8) -> DataFrame:
    """K4: ``(place, text)`` lines: a header with linked/total, then the first
    records that have links with their first links."""
    ranked = records.withColumn("shown", F.slice("linked_articles", 1, top_links)).withColumn("more", F.size("linked_articles") - F.size("shown"))
    entry = F.transform("shown", lambda x: F.concat(F.lit("  - "), x.law_name, F.lit(" "), F.coalesce(F.nullif(x.article, F.lit("")), F.lit("(조문 미특정)")), F.lit(": "), x.reason))
    tail = F.when(F.col("more") > 0, F.concat(F.lit("\n  - 외 "), F.col("more").cast("string"), F.lit("건"))).otherwise("")
    body = ranked.where(F.size("linked_articles") > 0).orderBy("ordinal").limit(top_records)
    lines = body.select(F.col("ordinal").cast("long").alias("place"), F.concat(F.lit("- "), "jo_no", F.lit(" "), "title", F.lit("\n"), F.array_join(entry, "\n"), tail).alias("text"))
    header = records.agg(F.count_if(F.size("linked_articles") > 0).alias("n"), F.count("*").alias("all")).select(F.lit(-1).cast("long").alias("place"), F.format_string("# %d/%d", "n", "all").alias("text"))
    return header.unionByName(lines)


def freshness_report(changes: DataFrame) -> DataFrame:
    """K5: report lines, numbered by name."""
    order = Window.orderBy("name")  # one row per monitored law
    return changes.select(F.row_number().over(order).alias("place"), F.format_string("- [%s] %s %s", "status", "name", "detail").alias("text"))


def exit_code(changes: DataFrame, manifest: DataFrame) -> int:
    """K5: 2 without a manifest, 1 with changes, else 0."""
    return 2 if manifest.isEmpty() else 0 if changes.isEmpty() else 1
