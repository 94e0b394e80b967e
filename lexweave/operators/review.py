"""Review queue: union, tiers, dedup with upgrade, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import fixed_values as V
from lexweave.functions.refs import SYMBOLS, candidate_id, first_filled, label_parts, lookup_keys, parse_article, ref_of_text, stripped
from lexweave.functions.terms import relation_label, relation_type, strings
from lexweave.operators.parallel import related_hints, rule_hints

#: Sources in queue order.
SOURCES = ("back_citation", "parallel_hint", "same_article", "hint", "gpt")


def tier(source: Column, suggested: Column, reason: Column) -> Column:
    """F22."""
    direct = F.exists(strings(V.DIRECT_CITE_MARKERS), lambda m: F.contains(reason, m))
    return F.when(source.isin("parallel_hint", "back_citation"), "required").when(suggested, F.when(direct, "required").otherwise("reference")).when(source == "hint", "reference").when(direct, "required").otherwise("reference")


def parse_lines(texts: DataFrame) -> DataFrame:
    """Candidates of ``[제안]``/``[검토] label: "old" → "new" — reason``
    lines in ``texts(id, text)``; other lines are dropped."""
    pattern = r'^\[(제안|검토)\]\s*([^:]+):\s*"([^"]*)"\s*→\s*"([^"]*)"(?:\s*—\s*(.*))?$'
    line = F.trim(F.col("line"))
    rows = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(line.rlike(pattern))
    part = lambda g: F.trim(F.regexp_extract(line, pattern, g))
    return rows.select("id", "pos", (part(1) == "제안").alias("suggested"), part(2).alias("label"), part(3).alias("old_text"), part(4).alias("new_text"), part(5).alias("reason"))


def line_candidates(texts: DataFrame, source: str = "gpt") -> DataFrame:
    """Candidates of the lines of ``texts(id, law, text)``; ``same_article``
    lines name paragraphs of the law's own article."""
    lines = parse_lines(texts.select("id", "text")).join(texts.select("id", "law"), "id")
    part = label_parts(F.col("label"))
    symbol = F.regexp_extract("label", f"([{SYMBOLS}])", 1)
    own = F.lit(source == "same_article")
    law = F.when(own | (part["law"] == ""), F.col("law")).otherwise(part["law"])
    other = "같은 조 다른 항" if source == "same_article" else "GPT 연관항"
    return lines.select(
        "id",
        law.alias("law_name"),
        F.when(own, "").otherwise(F.when(part["ref"] != "", part["ref"]).otherwise(F.col("label"))).alias("article_ref"),
        F.lit(source).alias("source"),
        symbol.alias("symbol"),
        "label",
        first_filled(F.col("reason"), F.lit(other)).alias("reason"),
        "suggested",
        F.col("pos").cast("long").alias("seq"),
        "old_text",
        "new_text",
        F.lit("").alias("relation_type"),
    )


_INTENT = ("id", "law", "jo", "hang", "ho", "old_text", "new_text")


def _candidate(rows: DataFrame, source: str, law: Column, ref: Column, label: Column, reason: Column, seq: Column, kind: Column) -> DataFrame:
    return rows.select("id", law.alias("law_name"), ref.alias("article_ref"), F.lit(source).alias("source"), F.lit("").alias("symbol"), label.alias("label"), reason.alias("reason"), F.lit(False).alias("suggested"), seq.cast("long").alias("seq"), "old_text", "new_text", kind.alias("relation_type"))


def hint_candidates(intents: DataFrame, hints: DataFrame) -> DataFrame:
    """One candidate for each related hint of ``intents(id, law, jo, hang,
    ho, old_text, new_text)``; ``jo`` is an article number like 27의2."""
    found = related_hints(intents.select("id", "law", "jo", "hang", "ho"), hints).join(intents.select("id", "old_text", "new_text"), "id")
    law, ref = F.col("related_law"), F.col("article")
    return _candidate(found, "hint", law, ref, F.concat_ws(" ", law, ref), F.col("reason"), F.col("rank") * 1000 + F.col("seq"), relation_type(law, ref, F.col("reason"), F.col("relation_type")))


def back_hits(intents: DataFrame, edges: DataFrame) -> DataFrame:
    """Articles that cite an intent's article in its law or, for an act, in its
    decree: ``(id, scope, rank, law_name, hit_jo, raw)`` beside the intent."""
    laws = F.when(F.col("law").endswith("법"), F.array("law", F.concat("law", F.lit(" 시행령")))).otherwise(F.array("law"))
    parsed = parse_article(F.col("jo"))
    asked = intents.select(*_INTENT, parsed["jo"].alias("base"), parsed["sub"].alias("sub"), F.posexplode(laws).alias("scope", "target_law"))
    probes = asked.select("target_law", F.col("base").alias("jo"), F.col("sub").alias("jo_sub"), "hang", "ho").distinct()
    keys = lookup_keys(F.col("jo"), F.col("jo_sub"), F.col("hang"), F.col("ho"))
    near = edges.join(probes.select("target_law", "jo").distinct(), ["target_law", "jo"], "left_semi")
    index = near.select("target_law", F.explode(keys).alias("key"), "source_law", "source_jo", "cite_raw", "target_ref").distinct()
    sought = asked.withColumn("keys", lookup_keys(F.col("base"), F.col("sub"), F.col("hang"), F.col("ho"))).select("*", F.posexplode("keys").alias("rank", "key"))
    order = Window.partitionBy("id", "scope", "source_law", "source_jo").orderBy("rank", "cite_raw", "target_ref")
    hits = sought.join(index, ["target_law", "key"]).withColumn("n", F.row_number().over(order)).where("n = 1 and source_jo <> jo")
    return hits.select(*_INTENT, "base", "scope", "rank", F.col("source_law").alias("law_name"), F.col("source_jo").alias("hit_jo"), F.col("cite_raw").alias("raw"))


def back_candidates(intents: DataFrame, edges: DataFrame) -> DataFrame:
    """A required candidate for each article that cites an intent's."""
    ref = F.concat(F.lit("제"), "hit_jo", F.lit("조"))
    reason = F.when(F.col("raw") != "", F.concat(F.lit("제"), "base", F.lit("조 인용: "), "raw")).otherwise("역인용")
    return _candidate(back_hits(intents, edges), "back_citation", F.col("law_name"), ref, F.concat_ws(" ", "law_name", ref), reason, F.col("scope") * 1000 + F.col("rank"), F.lit(""))


def parallel_candidates(intents: DataFrame, texts: DataFrame, related: DataFrame, rules: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """A required candidate for each parallel hint of the intents' articles
    ``texts(id, text)`` in the other laws of ``related(law, related)``."""
    ref = ref_of_text(F.col("text"))
    asked = intents.join(texts, "id").join(related, "law").where("law <> related")
    refs = asked.select(F.struct("id", "related").alias("id"), F.col("law").alias("source_law"), F.col("related").alias("parallel_law"), ref["jo"].alias("jo"), ref["sub"].alias("jo_sub"), ref["hang"].alias("hang"), ref["ho"].alias("ho")).where("jo is not null")
    found = rule_hints(refs, rules, cited).select(F.col("id.id").alias("id"), F.col("id.related").alias("law_name"), "source_rank", "key_rank", "seq", "article", "reason")
    found = found.join(intents.select("id", "old_text", "new_text"), "id")
    place = F.col("source_rank") * 1_000_000 + F.col("key_rank") * 1000 + F.col("seq")
    return _candidate(found, "parallel_hint", F.col("law_name"), F.col("article"), F.concat_ws(" ", "law_name", "article"), F.col("reason"), place, F.lit("parallel_tax_law"))


def _review_row(label: Column, reason: Column) -> Column:
    return F.concat(F.lit("[검토] "), label, F.lit(': "'), "old_text", F.lit('" → "'), "new_text", F.lit('" — '), reason)


def review_rows(intents: DataFrame, hints: DataFrame, edges: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """``(id, origin, row)``: text rows to review for each intent: its
    related hints, then the articles that cite it, each row and label once.

    Articles that a hint names are left out; with an item, those whose citation
    names another paragraph too.  ``scanned`` are :func:`back_hits` of another
    source for intents of which the graph has none.
    """
    found = related_hints(intents.select("id", "law", "jo", "hang", "ho"), hints).join(intents.select("id", "old_text", "new_text"), "id")
    kind = relation_label(relation_type(F.col("related_law"), F.col("article"), F.col("reason"), F.col("relation_type")))
    label = F.concat(F.concat_ws(" ", "related_law", "article"), F.lit("("), "reason", F.lit(")"), F.when(kind != "", F.concat(F.lit(" ["), kind, F.lit("]"))).otherwise(""))
    hinted = found.select("id", F.lit("hint").alias("origin"), _review_row(label, F.lit("확정 연관 매핑")).alias("row"))
    hits = back_hits(intents, edges)
    if scanned is not None:
        hits = hits.unionByName(scanned.join(hits.select("id").distinct(), "id", "left_anti"))
    named = found.select("id", F.trim(F.substring_index("article", "(", 1)).alias("ref")).distinct()
    hits = hits.withColumn("ref", F.concat(F.lit("제"), "hit_jo", F.lit("조"))).join(named, ["id", "ref"], "left_anti")
    item = F.concat(F.lit("제"), "hang", F.lit("항제"), "ho", F.lit("호"))
    fits = (F.col("hang") == "") | (F.col("ho") == "") | F.contains(F.col("raw"), item) | F.contains(F.col("raw"), F.concat(F.lit("제"), "hang", F.lit("항")))
    reason = F.when(F.col("raw") != "", F.concat(F.lit("제"), "base", F.lit("조 인용: "), "raw")).otherwise("그래프 역인용")
    order = Window.partitionBy("id", "law_name", "ref").orderBy("scope", "rank", "raw")
    cited = hits.where(fits).withColumn("n", F.row_number().over(order)).where("n = 1")
    cited = cited.select("id", F.lit("citation").alias("origin"), _review_row(F.concat_ws(" ", "law_name", "ref"), reason).alias("row"))
    return hinted.unionByName(cited).groupBy("id", "row").agg(F.max("origin").alias("origin")).select("id", "origin", "row")


def drop_malformed(lines: Column) -> Column:
    """lines where a decree or rule is followed by an act are dropped."""
    return F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"(시행령|시행규칙)\s*소득세법"))


def merged_lines(first: Column, second: Column) -> Column:
    """Trimmed lines of both texts, each once, in order."""
    each = F.filter(F.transform(F.concat(F.split(first, "\n"), F.split(second, "\n")), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(each), "\n")


def build_queue(sources: list[DataFrame]) -> DataFrame:
    """U4: ``(law_name, article_ref, source, symbol, label, reason, suggested,
    seq)`` rows of all sources with tier and id, one per id; a required row
    replaces one that isn't, else the first stays; of rows alike in that, a
    suggested one, then the least by the other columns in their order.  Rows
    with a column ``id`` are the queues of several articles."""
    rows = reduce(DataFrame.unionByName, sources)
    rows = rows.withColumn("tier", tier(F.col("source"), F.col("suggested"), F.col("reason"))).withColumn("candidate_id", candidate_id(F.col("law_name"), F.col("article_ref"), F.col("source"), F.col("symbol")))
    rows = rows.withColumn("source_rank", F.coalesce(F.nullif(F.array_position(strings(SOURCES), F.col("source")), F.lit(0)) - 1, F.lit(len(SOURCES))).cast("int"))
    own = [x for x in ("id",) if x in rows.columns]
    used = {*own, "law_name", "article_ref", "source", "symbol", "label", "reason", "suggested", "seq", "tier", "candidate_id", "source_rank"}
    rest = [f"`{name}`" for name, kind in rows.dtypes if name not in used and "map<" not in kind]
    order = Window.partitionBy(*own, "candidate_id").orderBy(F.when(F.col("tier") == "required", 0).otherwise(1), "source_rank", "seq", "label", "reason", F.desc("suggested"), *rest, "law_name", "article_ref", "symbol")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def ordered_queue(queue: DataFrame) -> DataFrame:
    """O3: required first, then by source, then by label."""
    return queue.orderBy(F.when(F.col("tier") == "required", 0).otherwise(1), "source_rank", "label", "candidate_id")


def queue_summary(queue: DataFrame) -> DataFrame:
    """A7."""
    return queue.agg(F.count_if(F.col("tier") == "required").alias("required"), F.count_if(F.col("tier") == "reference").alias("reference"), F.count("*").alias("total"))


def pending(queue: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Required candidates without a review ``(candidate_id)``."""
    return queue.where("tier = 'required'").join(reviewed, "candidate_id", "left_anti")


def enqueue_jobs(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """adds entries as pending jobs unless their id is queued already."""
    fresh = entries.dropDuplicates(["job_id"]).join(jobs, "job_id", "left_anti").withColumn("status", F.lit("pending"))
    return jobs.unionByName(fresh.select(jobs.columns))


def cascade_outline(outline: Column, parent_law: Column, parent_article: Column, reason: Column) -> Column:
    """an outline that tells what it follows from."""
    return stripped(F.concat(stripped(outline), F.lit("\n\n※ 연쇄 개정: "), parent_law, F.lit(" "), parent_article, F.lit(" 개정에 따른 검토\n※ 검토 사유: "), reason))


def activate_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """the job becomes active; the one that was active is done."""
    return jobs.withColumn("status", F.when(F.col("job_id") == job_id, "active").when(F.col("status") == "active", "done").otherwise(F.col("status")))
