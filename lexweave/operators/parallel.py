"""Parallel provisions: rules, hints, similarity, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import fixed_values as V
from lexweave.functions.refs import format_ref, lookup_keys, parse_article, ref_of_text
from lexweave.functions.terms import article_title, canonical_text, core_terms, generic_terms, text_variants, topic_terms


def rule_table(spark: SparkSession, rows=V.PARALLEL_RULES) -> DataFrame:
    return spark.createDataFrame(list(rows), "source_law string, parallel_law string, key string, seq int, article string, reason string")


def related_table(spark: SparkSession, rows=V.RELATED_HINTS) -> DataFrame:
    return spark.createDataFrame(list(rows), "law string, jo string, hang string, ho string, seq int, related_law string, article string, reason string, relation_type string")


def adjacency(spark: SparkSession, rows=V.PARALLEL_LAWS) -> DataFrame:
    return spark.createDataFrame([(k, i, x) for k, xs in rows for i, x in enumerate(xs)], "law string, seq int, parallel string")


def subordinate_names(law: Column) -> Column:
    """The law with its decree and rule; a decree with itself alone."""
    return F.when(law.endswith("시행령") | law.endswith("시행규칙"), F.array(law)).otherwise(F.array(law, F.concat(law, F.lit(" 시행령")), F.concat(law, F.lit(" 시행규칙"))))


def related_closure(laws: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(law, seq, related): the law, its subordinates, then each parallel
    law with its own, first occurrences in order."""
    lists = adjacent.groupBy("law").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "parallel"))), lambda x: x.parallel).alias("parallels"))
    names = F.concat(subordinate_names(F.col("law")), F.flatten(F.transform(F.coalesce("parallels", F.array().cast("array<string>")), subordinate_names)))
    return laws.join(lists, "law", "left").select("law", F.posexplode(F.array_distinct(names)).alias("seq", "related"))


def rule_hints(refs: DataFrame, rules: DataFrame, citation_hints: DataFrame | None = None) -> DataFrame:
    """Hints for ``refs(id, source_law, parallel_law, jo, jo_sub, hang, ho)``:
    rules before citation hints, specific keys first, one row per article."""
    asked = refs.select("id", "source_law", "parallel_law", F.posexplode(lookup_keys(F.col("jo"), F.col("jo_sub"), F.col("hang"), F.col("ho"))).alias("key_rank", "key"))
    columns = ["id", "source_rank", "key_rank", "seq", "article", "reason"]
    found = asked.join(rules, ["source_law", "parallel_law", "key"]).withColumn("source_rank", F.lit(0)).select(columns)
    if citation_hints is not None:
        found = found.unionByName(asked.join(citation_hints, ["source_law", "parallel_law", "key"]).withColumn("source_rank", F.lit(1)).select(columns))
    order = Window.partitionBy("id", F.coalesce(F.nullif("article", F.lit("")), "reason")).orderBy("source_rank", "key_rank", "seq")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def citation_hints(links: DataFrame, special_law: str) -> DataFrame:
    """(source_law, parallel_law, key, seq, article, reason) both ways from
    ``links(jo_no, jo_label, law_name, article, confidence, source, reason)``."""
    good = links.where("source = 'citation' and confidence = 'high' and article <> '' and law_name <> ''")
    forward = good.select(F.lit(special_law).alias("source_law"), F.col("law_name").alias("parallel_law"), F.col("jo_no").alias("key"), "article", "reason")
    pattern = r"제(\d+)조(?:의(\d+))?(?:제(\d+)항)?(?:제(\d+)호)?"
    keys = lookup_keys(*[F.regexp_extract("article", pattern, g) for g in (1, 2, 3, 4)])
    backward = good.select(F.col("law_name").alias("source_law"), F.lit(special_law).alias("parallel_law"), F.explode(keys).alias("key"), F.col("jo_label").alias("article"), "reason")
    return forward.unionByName(backward).distinct().withColumn("seq", F.lit(0))


def related_hints(refs: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints for ``refs(id, law, jo, hang, ho)`` at item, paragraph and
    article level; one row per related law and article."""
    levels = F.array(F.struct(F.lit(0).alias("rank"), F.col("hang").alias("h"), F.col("ho").alias("o")), F.struct(F.lit(1).alias("rank"), F.col("hang").alias("h"), F.lit("").alias("o")), F.struct(F.lit(2).alias("rank"), F.lit("").alias("h"), F.lit("").alias("o")))
    asked = refs.select("id", "law", "jo", F.inline(levels)).withColumnsRenamed({"h": "hang", "o": "ho"})
    order = Window.partitionBy("id", "related_law", "article").orderBy("rank", "seq")
    return asked.join(hints, ["law", "jo", "hang", "ho"]).withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "related_law", "article", "reason", "relation_type", "rank", "seq")


def existing_hints(hints: DataFrame, articles: DataFrame) -> DataFrame:
    """Each id's first hint whose article exists in ``articles(jo_no, …)``."""
    jo_no = F.concat(F.regexp_extract("article", r"제(\d+)", 1), F.regexp_replace(F.regexp_extract("article", r"제\d+조?(의\d+)", 1), "^$", ""))
    order = Window.partitionBy("id").orderBy("source_rank", "key_rank", "seq")
    return hints.withColumn("jo_no", jo_no).join(articles, "jo_no").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def similar_titles(sources: DataFrame, candidates: DataFrame, least: int = 8, same: bool = False) -> DataFrame:
    """The best candidate of each source by title and shared terms.

    ``sources(id, text)``, ``candidates(ordinal, text)``.  A pair scores 8 for
    equal canonical titles, else 6 for containment (six characters at least),
    2 per shared term, and more for company cars.  Only pairs that share a
    term or a title can reach ``least``; containment alone stays under it.
    The score depends on title and terms alone, so rows are grouped by these
    before the join: the work grows with the pairs of distinct groups.

    ``same`` tells that both are rows of one table: no row is its own candidate.
    """

    def described(rows: DataFrame, key: str, prefix: str) -> DataFrame:
        title = canonical_text(article_title(F.col("text")))
        return rows.select(F.col(key), title.alias(f"{prefix}_title"), topic_terms(F.col("text")).alias(f"{prefix}_terms")).distinct()

    left, right = described(sources, "id", "s"), described(candidates, "ordinal", "c")
    # The two smallest of a group are enough: one of them may be the source itself.
    first = F.row_number().over(Window.partitionBy("c_title", "c_terms").orderBy("ordinal"))
    right = right.withColumn("n", first).where("n <= 2").groupBy("c_title", "c_terms").agg(F.collect_list("ordinal").alias("ordinals"))
    kinds = left.select("s_title", "s_terms").distinct()
    columns = ["s_title", "s_terms", "c_title", "c_terms", "ordinals"]
    by_term = kinds.withColumn("t", F.explode("s_terms")).join(right.withColumn("t", F.explode("c_terms")), "t").select(columns)
    by_title = kinds.where("s_title <> ''").join(right, F.col("s_title") == F.col("c_title")).select(columns)
    shared = F.array_intersect("s_terms", "c_terms")
    equal = (F.col("s_title") != "") & (F.col("s_title") == F.col("c_title"))
    contained = (F.length("s_title") >= 6) & (F.col("c_title") != "") & (F.contains(F.col("c_title"), F.col("s_title")) | F.contains(F.col("s_title"), F.col("c_title")))
    car = F.array_contains(shared, "업무용승용차")
    score = F.when(equal, 8).when(contained, 6).otherwise(0) + 2 * F.size(shared) + F.when(car, 4).otherwise(0) + F.when(car & F.array_contains(shared, "필요경비불산입"), 4).otherwise(0)
    scored = by_term.unionByName(by_title).withColumn("score", score).where(F.col("score") >= least)
    ranked = scored.select("s_title", "s_terms", "score", F.explode("ordinals").alias("ordinal")).groupBy("s_title", "s_terms", "ordinal").agg(F.max("score").alias("score"))
    order = Window.partitionBy("s_title", "s_terms").orderBy(F.desc("score"), "ordinal")
    best = ranked.withColumn("n", F.row_number().over(order)).where("n <= 2").select(F.col("s_title").alias("b_title"), F.col("s_terms").alias("b_terms"), "ordinal", "score")
    # As structs: from equal columns Spark infers a filter whose column is not there.
    pairs = left.join(best, F.struct("s_title", "s_terms") == F.struct("b_title", "b_terms"))
    if same:
        pairs = pairs.where("id <> ordinal")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "ordinal")
    return pairs.withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "ordinal", "score")


def keyword_matches(articles: DataFrame, keywords: list[str], top: int = 20) -> DataFrame:
    """The first ``top`` articles ``(ordinal, title, body)`` that hold a
    keyword, as they are or in a phrase variant without blanks."""
    text = F.concat_ws("", "title", "body")
    words = F.array(*[F.lit(k) for k in keywords])
    if not keywords:
        return articles.limit(0)
    variants = text_variants(text)
    hit = F.exists(words, lambda k: F.contains(text, k) | F.exists(variants, lambda v: F.contains(v, k)))
    return articles.where(hit).orderBy("ordinal").limit(top)


def hinted_first(hinted: DataFrame, others: DataFrame) -> DataFrame:
    """``(jo_no, ordinal)`` rows, hinted ones first, one per number."""
    both = hinted.withColumn("rank", F.lit(0)).unionByName(others.withColumn("rank", F.lit(1)))
    return both.groupBy("jo_no").agg(F.min(F.struct("rank", "ordinal")).alias("place")).select("jo_no", "place.rank", "place.ordinal")


def frequent_terms(articles: DataFrame, pattern: str = "[가-힣]{4,}", least: int = 2, top: int = 3) -> DataFrame:
    """A4: an article's commonest words that aren't generic, ties by place."""
    words = F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
    each = articles.select("id", F.posexplode(words).alias("pos", "word")).where(~F.array_contains(generic_terms(), F.col("word")))
    counted = each.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where(F.col("n") >= least)
    order = Window.partitionBy("id").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def extract_keywords(articles: DataFrame) -> DataFrame:
    """``(id, keywords)`` of ``articles(id, text)``: the title's words if
    two or more are not generic, else core terms, these and the body's commonest."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    line = F.substring_index(text, "\n", 1)
    inside = F.regexp_extract(line, "[（(]([^）)]{2,})[）)]", 1)
    title = F.regexp_extract_all(F.when(inside != "", inside).otherwise(line), F.lit("[가-힣]{3,}"), F.lit(0))
    rows = articles.select("id", text.alias("text"), title.alias("title"), F.filter(title, lambda w: ~F.array_contains(generic_terms(), w)).alias("own"), core_terms(text).alias("core"))
    body = rows.where(F.size("own") < 2).select("id", F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("body"))
    common = frequent_terms(body).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x.word).alias("common"))
    none = F.array().cast("array<string>")
    both = rows.join(common, "id", "left").withColumn("both", F.array_distinct(F.concat("core", "own", F.coalesce("common", none))))
    return both.select("id", F.when(F.size("own") >= 2, F.col("own")).when(F.size("both") > 0, F.col("both")).otherwise(F.col("title")).alias("keywords"))


def resolve_entries(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """``(seq, wanted, name, mst)``: each wanted name's search result of that
    very name, else its first; of results that repeat, the first wanted keeps it.

    ``wanted(seq, wanted)``, ``results(wanted, pos, name, mst)``.
    """
    order = Window.partitionBy("wanted").orderBy(F.when(F.col("name") == F.col("wanted"), 0).otherwise(1), "pos")
    chosen = results.withColumn("n", F.row_number().over(order)).where("n = 1").select("wanted", "name", "mst")
    key = F.coalesce(F.nullif("mst", F.lit("")), "name")
    found = wanted.join(chosen, "wanted").withColumn("key", key).where("key <> ''")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).where("n = 1").select("seq", "wanted", "name", "mst")


#: The pair of laws whose articles are compared by title and terms.
TAX_PAIR = ("법인세법", "소득세법")


def parallel_cascade(sources: DataFrame, scope: DataFrame, articles: DataFrame, rules: DataFrame, cited: DataFrame | None = None, judge=None) -> DataFrame:
    """M3: ``(id, parallel_law, article, reason, stage)``: the parallel provision
    of each source in each law of its scope.

    ``sources(id, law, text)``, ``scope(law, parallel)``, ``articles(law, jo_no,
    ordinal, title, body)``.  The first hint whose article exists decides, else
    the most similar title and terms of the tax pair, else ``judge``: a function
    of what is left, ``(id, law, parallel_law, text)``, that gives the same
    columns; without one there is no match.  What it names must exist.
    """
    asked = sources.join(scope.select("law", F.col("parallel").alias("parallel_law")).distinct(), "law").where("law <> parallel_law")
    ref = ref_of_text(F.col("text"))
    parts = asked.select("id", F.col("law").alias("source_law"), "parallel_law", *[ref[x].alias(x) for x in ("jo", "sub", "hang", "ho")]).withColumnRenamed("sub", "jo_sub").where("jo is not null")
    keyed = parts.withColumn("id", F.struct("id", "parallel_law"))
    hints = rule_hints(keyed, rules, cited).select(F.col("id.id").alias("id"), F.col("id.parallel_law").alias("parallel_law"), "source_rank", "key_rank", "seq", "article", "reason")
    number = parse_article(F.col("article"))
    jo_no = F.concat(number["jo"], F.when(number["sub"] != "", F.concat(F.lit("의"), number["sub"])).otherwise(""))
    known = articles.select(F.col("law").alias("parallel_law"), "jo_no").distinct()
    order = Window.partitionBy("id", "parallel_law").orderBy("source_rank", "key_rank", "seq")
    first = hints.withColumn("jo_no", jo_no).join(known, ["parallel_law", "jo_no"], "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    reason = F.when(F.col("source_rank") == 1, F.concat(F.lit("[명시 인용] "), "reason")).otherwise(F.col("reason"))
    out = first.select("id", "parallel_law", "article", reason.alias("reason"), F.lit("hint").alias("stage"))
    left = asked.join(out, ["id", "parallel_law"], "left_anti")
    for law, other in (TAX_PAIR, TAX_PAIR[::-1]):
        texts = articles.where(F.col("law") == other)
        numbered = texts.select("ordinal", F.concat_ws("\n", F.concat(F.lit("("), "title", F.lit(")")), "body").alias("text"))
        best = similar_titles(left.where((F.col("law") == law) & (F.col("parallel_law") == other)).select("id", "text"), numbered)
        named = best.join(texts.groupBy("ordinal").agg(F.min("jo_no").alias("jo_no")), "ordinal")
        at = parse_article(F.col("jo_no"))
        why = f"{law}과 {other} 사이의 조문 제목·핵심 표현이 코드 매칭 기준으로 동일 취지입니다."
        out = out.unionByName(named.select("id", F.lit(other).alias("parallel_law"), format_ref(at["jo"], at["sub"]).alias("article"), F.lit(why).alias("reason"), F.lit("similar").alias("stage")))
    if judge is not None:
        judged = judge(asked.join(out, ["id", "parallel_law"], "left_anti")).withColumn("jo_no", jo_no).join(known, ["parallel_law", "jo_no"], "left_semi")
        out = out.unionByName(judged.select("id", "parallel_law", "article", "reason", F.lit("judge").alias("stage")))
    return out


def resolve_names(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each wanted name's catalog entry: exact without blanks, else one
    whose name contains it, else none."""
    bare = lambda c: F.regexp_replace(c, " ", "")
    exact = wanted.join(catalog, bare("wanted") == bare("name")).withColumn("match", F.lit(0))
    rest = wanted.join(exact.select("wanted"), "wanted", "left_anti")
    partial = rest.join(catalog, F.contains(bare("name"), bare("wanted"))).withColumn("match", F.lit(1))
    order = Window.partitionBy("wanted").orderBy("match", "pos")
    best = exact.unionByName(partial).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return wanted.join(best, "wanted", "left")


def first_entries(catalog: DataFrame) -> DataFrame:
    """One row per serial number, or name where it has none, first page first."""
    key = F.coalesce(F.nullif("mst", F.lit("")), "name")
    order = Window.partitionBy(key).orderBy("page", "pos")
    return catalog.where(key != "").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
