"""A statute-like corpus derived from the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a citation: law, source article and cited parts."""
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("법률"), text(F.col("l_orderkey") % 8)).alias("source_law"),
        text(F.col("l_orderkey")).alias("source_jo"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("법률 "), text(F.col("l_suppkey") % 8))).otherwise("").alias("law_name"),
        text(F.col("l_partkey") % 130 + 1).alias("jo"),
        F.when(F.col("l_suppkey") % 3 == 0, text(F.col("l_suppkey") % 9 + 2)).otherwise("").alias("jo_sub"),
        F.when(F.col("l_linenumber") % 2 == 0, text(F.col("l_quantity").cast("int"))).otherwise("").alias("hang"),
        F.when(F.col("l_linenumber") % 6 == 0, text(F.col("l_quantity").cast("int") + 2)).otherwise("").alias("hang_end"),
        F.lit("").alias("ho"),
        F.when(F.col("l_linenumber") % 5 == 0, text(F.col("l_partkey") % 130 + 4)).otherwise("").alias("range_end_jo"),
        F.when(F.col("l_suppkey") % 7 == 0, "같은법").otherwise("").alias("relative"),
        F.col("l_partkey"),
    ).withColumn("raw", F.concat(F.lit("제"), "jo", F.lit("조"), F.when(F.col("jo_sub") != "", F.concat(F.lit("의"), "jo_sub")).otherwise(""), F.when(F.col("hang") != "", F.concat(F.lit("제"), "hang", F.lit("항"))).otherwise("")))


PARTS_SQL = """parts as (select '법률' || (l_orderkey % 8) as source_law, cast(l_orderkey as varchar) as source_jo, l_linenumber as pos,
  case when l_suppkey % 4 = 0 then '법률 ' || (l_suppkey % 8) else '' end as law_name, cast(l_partkey % 130 + 1 as varchar) as jo,
  case when l_suppkey % 3 = 0 then cast(l_suppkey % 9 + 2 as varchar) else '' end as jo_sub,
  case when l_linenumber % 2 = 0 then cast(cast(l_quantity as int) as varchar) else '' end as hang,
  case when l_linenumber % 6 = 0 then cast(cast(l_quantity as int) + 2 as varchar) else '' end as hang_end, '' as ho,
  case when l_linenumber % 5 = 0 then cast(l_partkey % 130 + 4 as varchar) else '' end as range_end_jo,
  case when l_suppkey % 7 = 0 then '같은법' else '' end as relative, l_partkey from lineitem),
cites as (select *, '제' || jo || '조' || case when jo_sub <> '' then '의' || jo_sub else '' end || case when hang <> '' then '제' || hang || '항' else '' end as raw from parts)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(law, jo_no, ordinal, title, body)``: an article for each order, a
    sentence for each of its lines."""
    rows = cited_parts(spark, sf_dir).select("source_law", "source_jo", F.struct("pos", "l_partkey", "raw").alias("line"))
    lists = rows.groupBy("source_law", "source_jo").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(x.raw, F.lit("에 따른다."))), "\n")
    return lists.select(F.col("source_law").alias("law"), F.col("source_jo").alias("jo_no"), F.col("source_jo").cast("int").alias("ordinal"), F.lit("").alias("title"), body.alias("body"))


ARTICLES_SQL = PARTS_SQL + """,
articles as (select source_law as law, source_jo as jo_no, cast(source_jo as int) as ordinal, '' as title,
  string_agg(raw || '에 따른다.', chr(10) order by pos, l_partkey, raw) as body from cites group by 1, 2)"""
