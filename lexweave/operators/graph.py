"""Citation edges (G2), their reverse index (A3) and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.refs import format_ref, lookup_keys, normalize_law


def edges(citations: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(source_law, source_jo, target_law, target_ref, jo, jo_sub, hang, ho, cite_raw)``.

    A relative citation targets its source law; blank laws too.
    """
    target = F.when(F.col("relative").isin("같은법", "같은조"), F.col("source_law")).otherwise(F.coalesce(F.nullif("law_name", F.lit("")), "source_law"))
    rows = citations.where("jo <> ''").withColumn("target_law", target)
    if scope is not None:
        bare = normalize_law(F.col("target_law"))
        rows = rows.where(F.exists(F.array(*[F.lit(x) for x in scope]), lambda s: F.contains(normalize_law(s), bare)))
    return rows.select("source_law", "source_jo", "target_law", format_ref(F.col("jo"), F.col("jo_sub"), F.col("hang"), F.col("ho")).alias("target_ref"), "jo", "jo_sub", "hang", "ho", F.col("raw").alias("cite_raw"))


def reverse_index(edge_rows: DataFrame) -> DataFrame:
    """One row per edge and key it can be found under, repeats removed."""
    keys = lookup_keys(F.col("jo"), F.col("jo_sub"), F.col("hang"), F.col("ho"))
    return edge_rows.select("target_law", F.explode(keys).alias("key"), "source_law", "source_jo", "cite_raw", "target_ref").distinct()


def graph_meta(edge_rows: DataFrame) -> DataFrame:
    """``(edge_count, laws, available)`` of a graph's edges."""
    laws = F.array_join(F.array_sort(F.collect_set("source_law")), ",")
    return edge_rows.agg(F.count("*").alias("edge_count"), laws.alias("laws")).withColumn("available", F.col("edge_count") > 0)


def ordered_hits(hits: DataFrame) -> DataFrame:
    """O2: each target's hits numbered by law, then by article number as text."""
    order = Window.partitionBy("target_law", "target_jo").orderBy("source_law", "source_jo", "pos", "raw")
    return hits.withColumn("place", F.row_number().over(order))


def reverse_hits(edge_rows: DataFrame, probes: DataFrame) -> DataFrame:
    """J3 without an index: only edges of the probes' laws and articles are
    exploded to their keys, so that work follows the probes."""
    parts = [F.col(x) for x in ("jo", "jo_sub", "hang", "ho")]
    near = edge_rows.join(probes.select("target_law", "jo").distinct(), ["target_law", "jo"], "left_semi")
    return reverse_lookup(near.select("target_law", F.explode(lookup_keys(*parts)).alias("key"), "source_law", "source_jo", "cite_raw", "target_ref").distinct(), probes)


def reverse_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Citing articles of ``probes(target_law, jo, jo_sub, hang, ho)``, one
    row per source article, found under the most specific key."""
    asked = probes.select("target_law", F.posexplode(lookup_keys(F.col("jo"), F.col("jo_sub"), F.col("hang"), F.col("ho"))).alias("rank", "key"))
    order = Window.partitionBy("target_law", "source_law", "source_jo").orderBy("rank", "cite_raw", "target_ref")
    return index.join(asked, ["target_law", "key"]).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def _paragraph_matches(hang: str, hang_end: str, target: Column) -> Column:
    number = lambda c: F.col(c).try_cast("int")
    inside = (number(hang) <= target.try_cast("int")) & (target.try_cast("int") <= number(hang_end))
    return (target == "") | (F.col(hang) == "") | F.when(F.col(hang_end) == "", F.col(hang) == target).otherwise(F.coalesce(inside, F.lit(False)))


def citing_articles(citations: DataFrame, jo: str, jo_sub: str = "", hang: str = "") -> DataFrame:
    """Articles of one corpus that cite the target, with their citations.

    The law is ignored, an empty branch matches any, the target's own rows
    are left out, and equal citations count once, the first text kept.
    """
    target = F.lit(hang)
    rows = citations.where((F.col("jo") == jo) & (F.lit(jo_sub == "") | (F.col("jo_sub") == jo_sub)) & _paragraph_matches("hang", "hang_end", target))
    rows = rows.where(F.col("source_jo") != (f"{jo}의{jo_sub}" if jo_sub else jo))
    each = rows.groupBy("source_jo", "law_name", "jo", "jo_sub", "hang", "hang_end").agg(F.min(F.struct("pos", "raw")).alias("first"))
    return each.groupBy("source_jo").agg(F.array_join(F.transform(F.array_sort(F.collect_list("first")), lambda x: x.raw), ",").alias("citations"), F.count("*").alias("n"))


def citing_across(citations: DataFrame, targets: DataFrame) -> DataFrame:
    """Citations of ``targets(target_law, target_jo, target_sub, target_hang)``
    over all corpora: equal normalised law, then article equality or range."""
    law = normalize_law(F.coalesce(F.nullif("law_name", F.lit("")), "source_law"))
    number = lambda c: F.col(c).try_cast("int")
    within = (F.col("range_end_jo") != "") & (number("jo") <= number("target_jo")) & (number("target_jo") <= number("range_end_jo"))
    match = ((F.col("jo") == F.col("target_jo")) | F.coalesce(within, F.lit(False))) & ((F.col("target_sub") == "") | (F.col("jo_sub") == F.col("target_sub")))
    match = match & _paragraph_matches("hang", "hang_end", F.col("target_hang"))
    probes = targets.withColumn("bare", normalize_law(F.col("target_law")))
    return citations.withColumn("bare", law).join(probes, "bare").where(match).drop("bare")


def number_shift(citations: DataFrame, inserted: int) -> DataFrame:
    """citations of articles that an insertion renumbers."""
    return citations.where(F.col("jo").try_cast("int") >= inserted)
