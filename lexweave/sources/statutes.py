"""Scans: nested statute XML, catalog, JSON manifests and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions.refs import parse_article
from lexweave.functions.terms import scrub_html

_SUBITEM = "array<struct<`목내용`: string>>"
_ITEM = f"array<struct<`호내용`: string, `목`: {_SUBITEM}>>"
UNIT = f"`조문번호` string, `조문가지번호` string, `조문여부` string, `조문제목` string, `조문내용` string, `항` array<struct<`항내용`: string, `호`: {_ITEM}>>"


def read_statute(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``(jo_no, title, body)`` of each article unit; items are indented
    by two blanks, subitems by four, blank lines are skipped."""
    units = spark.read.format("xml").option("rowTag", "조문단위").schema(UNIT).load(path).where("`조문여부` = '조문'")
    clean = lambda c: scrub_html(F.coalesce(c, F.lit("")))
    subitems = lambda item: F.transform(F.coalesce(item["목"], F.array().cast(_SUBITEM)), lambda m: F.concat(F.lit("    "), clean(m["목내용"])))
    items = lambda par: F.flatten(F.transform(F.coalesce(par["호"], F.array().cast(_ITEM)), lambda h: F.concat(F.array(F.concat(F.lit("  "), clean(h["호내용"]))), subitems(h))))
    kind = units.schema["항"].dataType
    paragraphs = F.flatten(F.transform(F.coalesce("항", F.array().cast(kind)), lambda p: F.concat(F.array(clean(p["항내용"])), items(p))))
    lines = F.filter(F.concat(F.array(clean(F.col("조문내용"))), paragraphs), lambda x: F.trim(x) != "")
    jo_no = F.concat(F.col("조문번호"), F.when(F.coalesce("조문가지번호", F.lit("")) != "", F.concat(F.lit("의"), "조문가지번호")).otherwise(""))
    return units.select(jo_no.alias("jo_no"), F.coalesce("조문제목", F.lit("")).alias("title"), F.array_join(lines, "\n").alias("body"))


def article(articles: DataFrame, jo_no: str) -> DataFrame:
    """The first article of that number."""
    return articles.where(F.col("jo_no") == jo_no).orderBy("ordinal").limit(1)


def article_of_ref(articles: DataFrame, refs: DataFrame) -> DataFrame:
    """``(id, law, jo_no, title, body)``: the first article of the law
    with the number of the first reference in ``refs(id, law, text)``."""
    parsed = parse_article(F.col("text"))
    number = F.concat(parsed["jo"], F.when(parsed["sub"] != "", F.concat(F.lit("의"), parsed["sub"])).otherwise(""))
    found = refs.select("id", "law", number.alias("jo_no")).where("jo_no is not null").join(articles, ["law", "jo_no"])
    order = Window.partitionBy("id").orderBy("ordinal")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "law", "jo_no", "title", "body")


def articles_of_law(articles: DataFrame, results: DataFrame, law: str) -> DataFrame:
    """The articles of the search result of that name, else of the first of
    ``results(pos, name)``."""
    order = Window.partitionBy("all").orderBy(F.when(F.col("name") == law, 0).otherwise(1), "pos")
    chosen = results.withColumn("all", F.lit(0)).withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("name").alias("law"))
    return articles.join(chosen, "law", "left_semi")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``(name, mst, kind)`` of a search response: one law or a list."""
    rows = _json(spark, path, "LawSearch struct<law:string>")
    law = "array<struct<`법령명한글`:string,`법령일련번호`:string,`법령구분명`:string>>"
    text = F.col("LawSearch.law")
    listed = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), law)
    return rows.select(F.inline(listed)).toDF("name", "mst", "kind")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A multi-line JSON file; a missing path is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per law of a snapshot manifest."""
    rows = _json(spark, path, "checked_at string, laws array<struct<name:string,mst:string,`시행일`:string,`공포일`:string,article_count:long,content_hash:string>>")
    return rows.select("checked_at", F.inline("laws")).withColumnsRenamed({"시행일": "enforced", "공포일": "promulgated"})


def read_precedents(spark: SparkSession, path: str) -> DataFrame:
    """S8."""
    return _json(spark, path, "id string, law_name string, article_title_keywords array<string>, outline_keywords array<string>, application_basis string, effect_type string, article_title_suffix string, application_sentence string, source string")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """The edges of a citation graph file."""
    rows = _json(spark, path, "built_at string, laws array<string>, edge_count long, edges array<struct<source_law:string,source_jo:string,source_title:string,target_law:string,target_ref:string,cite_raw:string,type:string>>")
    return rows.select("built_at", F.inline("edges"))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of a special-law record file, one row per link."""
    rows = _json(spark, path, "records array<struct<jo_no:string,jo_label:string,title:string,linked_articles:array<struct<law_name:string,article:string,confidence:string,reason:string,source:string>>>>")
    return rows.select(F.inline("records")).select("jo_no", "jo_label", "title", F.inline("linked_articles"))
