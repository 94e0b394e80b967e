"""Addenda precedents: scoring, choice, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import fixed_values as V
from lexweave.functions.refs import law_pronoun

AUTOMATIC = "자동 추천"


def precedent_table(spark: SparkSession, rows=V.PRECEDENTS) -> DataFrame:
    schema = "ordinal int, precedent_id string, p_law string, title_keywords array<string>, outline_keywords array<string>, basis string, effect string, suffix string, sentence string, origin string"
    return spark.createDataFrame([(i, a, b, list(c), list(d), *rest) for i, (a, b, c, d, *rest) in enumerate(rows)], schema)


def effect_of(basis: Column, effect: Column) -> Column:
    """F43."""
    return F.when(basis == "신고", "부진정소급효").otherwise(effect)


def best_precedents(cases: DataFrame, precedents: DataFrame) -> DataFrame:
    """The best-scored precedent of ``cases(id, law_name, title,
    outline, effect_type, application_basis)``, ties to the earlier one.

    The table of precedents is small reference data; Catalyst broadcasts it
    while it is under its threshold.
    """
    automatic = F.col("application_basis") == AUTOMATIC
    match = F.col("basis") == F.col("application_basis")
    law = F.when(F.col("p_law") == "", 0).when(F.col("p_law") == F.col("law_name"), 4).otherwise(-2)
    hits = lambda words, text: F.size(F.filter(words, lambda k: F.contains(F.col(text), k)))
    start = F.when(automatic & (F.col("effect") != effect_of(F.col("application_basis"), F.col("effect_type"))), -1).otherwise(0)
    score = start + F.when(match, 5).otherwise(0) + law + 3 * hits("title_keywords", "title") + 2 * hits("outline_keywords", "outline")
    scored = cases.join(precedents).where(automatic | match).withColumn("score", score).where("score > 0")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "ordinal")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def addenda(cases: DataFrame, precedents: DataFrame) -> DataFrame:
    """``(id, precedent_id, score, text)``; the basis's sentence, else the
    effect's, where no precedent scores."""
    best = best_precedents(cases, precedents).select("id", "precedent_id", "score", "suffix", "sentence")
    table = lambda rows: F.create_map(*[F.lit(x) for pair in rows for x in pair])
    plain = F.coalesce(F.try_element_at(table(V.BASIS_TEMPLATES), F.col("application_basis")), F.try_element_at(table(V.EFFECT_TEMPLATES), effect_of(F.col("application_basis"), F.col("effect_type"))), F.lit(V.EFFECT_TEMPLATES[0][1]))
    sentence = F.coalesce("sentence", F.concat(F.lit("{jo_label}의 개정규정은 "), plain))
    ref = law_pronoun(F.col("law_name"))
    filled = F.replace(F.replace(F.replace(sentence, F.lit("{law_ref}"), ref), F.lit("{jo_label}"), F.col("jo_label")), F.lit("{article_title}"), F.col("title"))
    text = F.concat(F.lit("제1조(시행일) "), ref, F.lit("은 공포한 날부터 시행한다.\n제2조("), "title", F.coalesce("suffix", F.lit("에 관한 적용례")), F.lit(") "), filled)
    return cases.join(best, "id", "left").select("id", "precedent_id", "score", text.alias("text"))
