"""Special-law link records (G3-G5), their merge (A5) and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import fixed_values as V
from lexweave.functions.refs import format_ref
from lexweave.functions.terms import canonical_law, is_tax_law


def citation_links(citations: DataFrame, source_law: str) -> DataFrame:
    """``(jo_no, law_name, article, confidence, reason, source)`` from
    citations of other tax laws, one per law and article."""
    law = canonical_law(F.col("law_name"))
    article = format_ref(F.col("jo"), F.col("jo_sub"), F.col("hang"), F.col("ho"))
    rows = citations.where(is_tax_law(F.col("law_name"))).select("jo_no", "pos", law.alias("law_name"), article.alias("article"), "raw").where(F.col("law_name") != source_law)
    order = Window.partitionBy("jo_no", "law_name", "article").orderBy("pos")
    first = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select("jo_no", "law_name", "article", F.lit("high").alias("confidence"), F.concat(F.lit("명시 인용: "), "raw").alias("reason"), F.lit("citation").alias("source"))


def keyword_links(articles: DataFrame, rules=V.TITLE_TOPIC_RULES, prefix: int = 500) -> DataFrame:
    """The first matching topic rule of each law for ``articles(jo_no,
    title, body)``; a rule looks at the title and the body's first part."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("body", F.lit("")), 1, prefix))
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("keyword"), F.lit(law).alias("law_name"), F.lit(why).alias("reason")) for n, (k, law, why) in enumerate(rules)])
    hits = articles.withColumn("text", text).select("jo_no", F.inline(F.filter(table, lambda r: F.contains(F.col("text"), r.keyword))))
    first = hits.groupBy("jo_no", "law_name").agg(F.min(F.struct("n", "reason")).alias("rule"))
    return first.select("jo_no", "law_name", F.lit("").alias("article"), F.lit("low").alias("confidence"), F.col("rule.reason").alias("reason"), F.lit("keyword").alias("source"))


def merge_links(links: DataFrame) -> DataFrame:
    """A5: citation before model before keyword; one link per law and article,
    or per law and reason where there is no article."""
    rank = F.when(F.col("source") == "citation", 0).when(F.col("source") == "gpt", 1).otherwise(2)
    key = F.coalesce(F.nullif("article", F.lit("")), F.concat(F.lit("\u0001"), "reason"))
    order = Window.partitionBy("jo_no", "law_name", key).orderBy("rank", "law_name", "article", "reason")
    return links.withColumn("rank", rank).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def link_records(articles: DataFrame, links: DataFrame) -> DataFrame:
    """Every article with its ordered links, the link-less ones too."""
    item = F.struct("rank", "law_name", "article", "confidence", "reason", "source")
    lists = merge_links(links).groupBy("jo_no").agg(F.array_sort(F.collect_list(item)).alias("linked_articles"))
    return articles.join(lists, "jo_no", "left").withColumn("linked_articles", F.coalesce("linked_articles", F.array().cast(lists.schema["linked_articles"].dataType)))


def needing_review(records: DataFrame, words: list[str], top: int) -> DataFrame:
    """Articles with a topic word in the title and under two citations."""
    few = F.size(F.filter("linked_articles", lambda x: x.source == "citation")) < 2
    topic = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("title"), w))
    return records.where(few & topic).orderBy("ordinal").limit(top)


def enrich(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Merges a judge's ``(jo_no, law_name, article, confidence, reason,
    review_note)`` rows back; blank laws only leave their note."""
    links = records.select("jo_no", F.inline("linked_articles")).drop("rank")
    added = judged.where("law_name <> ''").select("jo_no", "law_name", "article", "confidence", "reason", F.lit("gpt").alias("source"))
    notes = judged.groupBy("jo_no").agg(F.max("review_note").alias("review_note"))
    return link_records(records.drop("linked_articles", "review_note"), links.unionByName(added)).join(notes, "jo_no", "left")
