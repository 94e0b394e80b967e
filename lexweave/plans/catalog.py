"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import fixed_values as V
from lexweave.functions import refs, terms
from lexweave.operators import citations, compare, freshness, graph, links, parallel, precedents, review
from lexweave.plans.corpus import ARTICLES_SQL, PARTS_SQL, articles, cited_parts, table
from lexweave.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _values(rows, names: str) -> str:
    """A VALUES list of fixed rows; tuples become lists."""

    def item(x):
        if isinstance(x, tuple):
            return "[" + ", ".join(map(item, x)) + "]"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"(values {', '.join('(' + ', '.join(map(item, row)) + ')' for row in rows)}) as t({names})"


def _rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


_DIRECT_SQL = refs.DIRECT.replace("'", "''")


@_query(f"""with {ARTICLES_SQL}, m as (select law, jo_no, body, unnest(range(0, len(regexp_extract_all(body, '{_DIRECT_SQL}')))) as pos from articles)
select law, jo_no, cast(pos as integer) as pos, regexp_extract_all(body, '{_DIRECT_SQL}', 0)[pos + 1] as raw, {', '.join(f"coalesce(regexp_extract_all(body, '{_DIRECT_SQL}', {g})[pos + 1], '') as {n}" for g, n in ((1, 'jo'), (2, 'jo_sub'), (3, 'hang'), (4, 'ho')))} from m""")
def direct_citations(spark, sf_dir):
    """G1, pass 5."""
    return citations.direct_citations(articles(spark, sf_dir).select("law", "jo_no", "body"))


_INTRA_SQL = "(조.{0,2})?제(\\d+)(항|호|목)(까지)?"


@_query(f"""with {ARTICLES_SQL}, t as (select law, jo_no, replace(body, '제', ' 제') as body from articles),
m as (select *, unnest(range(0, len(regexp_extract_all(body, '{_INTRA_SQL}')))) as pos from t)
select law, jo_no, cast(pos as integer) as pos, regexp_extract_all(body, '{_INTRA_SQL}', 2)[pos + 1] as number, regexp_extract_all(body, '{_INTRA_SQL}', 3)[pos + 1] as unit from m
where coalesce(regexp_extract_all(body, '{_INTRA_SQL}', 1)[pos + 1], '') = '' and coalesce(regexp_extract_all(body, '{_INTRA_SQL}', 4)[pos + 1], '') = ''""")
def intra_citations(spark, sf_dir):
    """G1, pass 6, over the corpus with a blank before each number."""
    rows = articles(spark, sf_dir).select("law", "jo_no", F.regexp_replace("body", "제", " 제").alias("body"))
    return citations.intra_citations(rows)


@_query()
def full_citations(spark, sf_dir):
    """G1, all passes."""
    mixed = articles(spark, sf_dir).select("law", "jo_no", F.concat(F.lit("「소득세법」 "), "body", F.lit(" 같은 조 제2항부터 제3항까지.")).alias("body"))
    return citations.extract(mixed)


_HIT = "(c.hang = '' or case when c.hang_end = '' then c.hang = {h} else try_cast(c.hang as int) <= try_cast({h} as int) and try_cast({h} as int) <= try_cast(c.hang_end as int) end)"


@_query(f"""with {PARTS_SQL}, h as (select source_jo, law_name, jo, jo_sub, hang, hang_end, min(row(pos, raw)) as first from cites c
  where jo = '27' and {_HIT.format(h="'3'")} and source_jo <> '27' group by all)
select source_jo, array_to_string(list_transform(list_sort(list(first)), lambda x: x[2]), ',') as citations, count(*) as n from h group by 1""")
def back_citations_article(spark, sf_dir):
    """Who cites article 27, paragraph 3."""
    return graph.citing_articles(cited_parts(spark, sf_dir), "27", "", "3")


_TARGETS = [("법률1", "27", "", "3"), ("법률 2", "40", "2", ""), ("법률ㆍ3", "100", "", "10")]


@_query(f"""with {PARTS_SQL}, targets as (select * from {_values(_TARGETS, 'target_law, target_jo, target_sub, target_hang')})
select c.source_law, c.source_jo, c.pos, c.raw, t.target_law, t.target_jo from cites c join targets t
  on replace(replace(case when c.law_name = '' then c.source_law else c.law_name end, ' ', ''), 'ㆍ', '') = replace(replace(t.target_law, ' ', ''), 'ㆍ', '')
where (c.jo = t.target_jo or (c.range_end_jo <> '' and cast(c.jo as int) <= cast(t.target_jo as int) and cast(t.target_jo as int) <= cast(c.range_end_jo as int)))
  and (t.target_sub = '' or c.jo_sub = t.target_sub) and (t.target_hang = '' or {_HIT.format(h='t.target_hang')})""")
def back_citations_interval(spark, sf_dir):
    """Citations of three targets over all laws."""
    targets = _rows(spark, _TARGETS, "target_law string, target_jo string, target_sub string, target_hang string")
    return graph.citing_across(cited_parts(spark, sf_dir), targets).select("source_law", "source_jo", "pos", "raw", "target_law", "target_jo")


@_query(f"with {PARTS_SQL} select source_law, source_jo, pos, raw from cites where cast(jo as int) >= 100")
def number_shift(spark, sf_dir):
    """F11."""
    return graph.number_shift(cited_parts(spark, sf_dir), 100).select("source_law", "source_jo", "pos", "raw")


def _edges(spark, sf_dir):
    return graph.edges(cited_parts(spark, sf_dir), ["법률1", "법률2", "법률3"])


_EDGES_SQL = PARTS_SQL + """, tg as (select *, case when relative <> '' then source_law when law_name <> '' then law_name else source_law end as target_law from cites where jo <> ''),
edges as (select source_law, source_jo, target_law, raw as target_ref, jo, jo_sub, hang, ho, raw as cite_raw from tg where replace(target_law, ' ', '') in ('법률1', '법률2', '법률3'))"""


@_query(f"with {_EDGES_SQL} select * from edges")
def graph_edges(spark, sf_dir):
    """G2, K2's rows."""
    return _edges(spark, sf_dir)


_KEYS_SQL = "list_filter([case when hang <> '' then base || 'h' || hang end, base], lambda k: k is not null)"
_PROBES = [("법률1", "27", "2", "3", ""), ("법률2", "30", "", "4", "")]


@_query(f"""with {_EDGES_SQL}, k as (select *, jo || case when jo_sub <> '' then '의' || jo_sub else '' end as base from edges),
ix as (select distinct target_law, unnest({_KEYS_SQL}) as key, source_law, source_jo, cite_raw, target_ref from k),
pr as (select *, jo || case when jo_sub <> '' then '의' || jo_sub else '' end as base from {_values(_PROBES, 'target_law, jo, jo_sub, hang, ho')}),
pk as (select target_law, unnest({_KEYS_SQL}) as key, unnest(range(0, len({_KEYS_SQL}))) as rank from pr),
j as (select ix.*, pk.rank, row_number() over (partition by ix.target_law, source_law, source_jo order by pk.rank, cite_raw, target_ref) as n from ix join pk on ix.target_law = pk.target_law and ix.key = pk.key)
select target_law, key, source_law, source_jo, cite_raw, target_ref, cast(rank as integer) as rank from j where n = 1""")
def graph_reverse_lookup(spark, sf_dir):
    """J3, A3."""
    probes = _rows(spark, _PROBES, "target_law string, jo string, jo_sub string, hang string, ho string")
    return graph.reverse_hits(_edges(spark, sf_dir), probes)


_ADJACENT_SQL = "adj as (select law, unnest(parallels) as parallel, unnest(range(0, len(parallels))) as seq from " + _values(V.PARALLEL_LAWS, "law, parallels") + ")"
_SUB_SQL = "case when {x} like '%시행령' or {x} like '%시행규칙' then [{x}] else [{x}, {x} || ' 시행령', {x} || ' 시행규칙'] end"


@_query(f"""with {_ADJACENT_SQL}, own as (select law, -1 as seq, {_SUB_SQL.format(x='law')} as names from (select distinct law from adj)),
par as (select law, seq, {_SUB_SQL.format(x='parallel')} as names from adj),
u as (select law, seq, unnest(names) as related, unnest(range(0, len(names))) as i from (select * from own union all select * from par)),
f as (select law, related, min(row(seq, i)) as place from u group by 1, 2)
select law, cast(row_number() over (partition by law order by place) - 1 as integer) as seq, related from f""")
def scope_closure(spark, sf_dir):
    """U1, S12, S13."""
    adjacent = parallel.adjacency(spark)
    return parallel.related_closure(adjacent.select("law").distinct(), adjacent)


def _catalog(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit("M"), (F.col("n_nationkey") % 20).cast("string"))).alias("mst"), (F.col("n_nationkey") / 10).cast("int").alias("page"), F.col("n_nationkey").alias("pos"))


_CATALOG_SQL = "cat as (select n_name as name, case when n_nationkey % 5 = 0 then '' else 'M' || (n_nationkey % 20) end as mst, cast(floor(n_nationkey / 10) as integer) as page, n_nationkey as pos from nation)"


@_query(f"with {_CATALOG_SQL}, r as (select *, row_number() over (partition by case when mst = '' then name else mst end order by page, pos) as n from cat where name <> '') select name, mst, page, pos from r where n = 1")
def paged_catalog(spark, sf_dir):
    """S1, S2."""
    return parallel.first_entries(_catalog(spark, sf_dir))


_WANTED = [("NATION_1",), ("NATION 2",), ("ION_3",), ("UNITED",), ("CHINA",), ("none such",)]


@_query(f"""with {_CATALOG_SQL}, w as (select * from {_values(_WANTED, 'wanted')}),
c as (select w.wanted, cat.*, case when replace(wanted, ' ', '') = replace(name, ' ', '') then 0 else 1 end as match from w join cat on contains(replace(name, ' ', ''), replace(wanted, ' ', ''))),
r as (select *, row_number() over (partition by wanted order by match, pos) as n from c)
select w.wanted, r.name, r.mst, r.page, r.pos, r.match from w left join (select * from r where n = 1) r on w.wanted = r.wanted""")
def law_resolution(spark, sf_dir):
    """J11, J12."""
    return parallel.resolve_names(_rows(spark, _WANTED, "wanted string"), _catalog(spark, sf_dir))


_REFS = [(n, src, dst, key.split("의")[0], key.split("의")[1] if "의" in key else "", "1", "2") for n, (src, dst, key) in enumerate(dict.fromkeys((r[0], r[1], r[2].split("h")[0]) for r in V.PARALLEL_RULES))]


@_query(f"""with rules as (select * from {_values(V.PARALLEL_RULES, 'source_law, parallel_law, key, seq, article, reason')}),
q as (select *, jo || case when jo_sub <> '' then '의' || jo_sub else '' end as base from {_values(_REFS, 'id, source_law, parallel_law, jo, jo_sub, hang, ho')}),
k as (select id, source_law, parallel_law, unnest([base || 'h' || hang || 'o' || ho, base || 'h' || hang, base]) as key, unnest([0, 1, 2]) as key_rank from q),
h as (select k.id, k.key_rank, r.seq, r.article, r.reason, row_number() over (partition by k.id, case when article = '' then reason else article end order by key_rank, seq) as n
  from k join rules r on k.source_law = r.source_law and k.parallel_law = r.parallel_law and k.key = r.key)
select cast(id as integer) as id, 0 as source_rank, key_rank, seq, article, reason from h where n = 1""")
def rule_lookup(spark, sf_dir):
    """J5 over the 54 rule rows."""
    asked = _rows(spark, _REFS, "id int, source_law string, parallel_law string, jo string, jo_sub string, hang string, ho string")
    return parallel.rule_hints(asked, parallel.rule_table(spark))


_LINKS = [("5의2", "제5조의2", "법인세법", "제36조", "high", "citation", "명시 인용: 「법인세법」 제36조"), ("6", "제6조", "소득세법", "제20조제1항", "high", "citation", "명시 인용"), ("7", "제7조", "소득세법", "", "low", "keyword", "키워드")]


@_query(f"""with l as (select * from {_values(_LINKS, 'jo_no, jo_label, law_name, article, confidence, source, reason')} where source = 'citation' and confidence = 'high' and article <> '' and law_name <> ''),
p as (select *, regexp_extract(article, '제(\\d+)조', 1) as base, regexp_extract(article, '제(\\d+)항', 1) as hang from l)
select distinct * from (select '조세특례제한법' as source_law, law_name as parallel_law, jo_no as key, article, reason, 0 as seq from l
union all select law_name, '조세특례제한법', unnest(list_filter([case when hang <> '' then base || 'h' || hang end, base], lambda x: x is not null)), jo_label, reason, 0 from p)""")
def citation_hints(spark, sf_dir):
    """J4, S10's index."""
    rows = _rows(spark, _LINKS, "jo_no string, jo_label string, law_name string, article string, confidence string, source string, reason string")
    return parallel.citation_hints(rows, "조세특례제한법")


@_query(f"select 0 as id, related_law, article, reason, relation_type, 0 as rank, seq from {_values(V.RELATED_HINTS, 'law, jo, hang, ho, seq, related_law, article, reason, relation_type')}")
def related_hints(spark, sf_dir):
    """Article 129, paragraph 1, item 3."""
    asked = _rows(spark, [(0, "소득세법", "129", "1", "3")], "id int, law string, jo string, hang string, ho string")
    return parallel.related_hints(asked, parallel.related_table(spark))


def _titled(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.array(*[F.lit(t) for t in V.TOPIC_TERMS])
    term = lambda shift: F.element_at(words, ((F.col("p_partkey") + shift) % len(V.TOPIC_TERMS) + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("제"), F.col("p_partkey").cast("string"), F.lit("조("), term(0), F.lit(" "), term(F.col("p_size")), F.lit(")\n"), term(3)).alias("text"))


_CANON_SQL = "regexp_replace({x}, '\\s+', '', 'g')"
for _old, _new in sorted(V.TAX_PAIR_REPLACEMENTS, key=lambda pair: -len(pair[0])):
    _CANON_SQL = f"replace({_CANON_SQL}, '{_old}', '{_new}')"
_TERM_SQL = "[" + ", ".join(f"'{t}'" for t in V.TOPIC_TERMS) + "]"
_TITLE_SQL = _CANON_SQL.replace("{x}", "regexp_extract(text, '[(]([^)]{2,})[)]', 1)")
_TITLED_SQL = f"""titled as (select p_partkey as ordinal, '제' || p_partkey || '조(' || {_TERM_SQL}[p_partkey % 19 + 1] || ' ' || {_TERM_SQL}[(p_partkey + p_size) % 19 + 1] || ')' || chr(10) || {_TERM_SQL}[(p_partkey + 3) % 19 + 1] as text from part),
canon as (select ordinal, {_TITLE_SQL} as title, {_CANON_SQL.replace("{x}", "text")} as whole from titled),
d as (select ordinal, title, list_filter({_TERM_SQL}, lambda t: contains(whole, t)) as terms from canon)"""


@_query(f"""with {_TITLED_SQL},
p as (select s.ordinal as id, d.ordinal, case when s.title <> '' and s.title = d.title then 8 when length(s.title) >= 6 and d.title <> '' and (contains(d.title, s.title) or contains(s.title, d.title)) then 6 else 0 end
  + 2 * len(list_intersect(s.terms, d.terms)) + case when list_contains(list_intersect(s.terms, d.terms), '업무용승용차') then 4 else 0 end
  + case when list_contains(list_intersect(s.terms, d.terms), '업무용승용차') and list_contains(list_intersect(s.terms, d.terms), '필요경비불산입') then 4 else 0 end as score from d s join d on d.ordinal <> s.ordinal),
r as (select id, arg_min({{'ordinal': ordinal, 'score': score}}, {{'worse': -score, 'ordinal': ordinal}}) as best from p where score >= 8 group by id)
select id, best.ordinal as ordinal, cast(best.score as integer) as score from r""")
def title_similarity_top1(spark, sf_dir):
    """Every part's article against all others."""
    rows = _titled(spark, sf_dir)
    return parallel.similar_titles(rows.withColumnRenamed("ordinal", "id"), rows, same=True)


@_query("""select doc_id as ordinal from documents where contains(coalesce(source, '') || coalesce(text, ''), 'entre') or contains(regexp_replace(coalesce(source, '') || coalesce(text, ''), '\\s+', '', 'g'), 'entre') order by doc_id limit 20""")
def keyword_filter_top20(spark, sf_dir):
    """A top-20 report."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    return parallel.keyword_matches(rows, ["entre"]).select("ordinal")


@_query("""with w as (select doc_id as id, unnest(regexp_extract_all(text, '[a-z]{4,}')) as word, unnest(range(0, len(regexp_extract_all(text, '[a-z]{4,}')))) as pos from documents),
c as (select id, word, count(*) as n, min(pos) as first from w group by 1, 2 having count(*) >= 2),
r as (select *, row_number() over (partition by id order by n desc, first) as rank from c)
select id, word, n, cast(first as integer) as first, cast(rank as integer) as rank from r where rank <= 3""")
def keyword_freq_top3(spark, sf_dir):
    """A4, O4."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return parallel.frequent_terms(rows, "[a-z]{4,}")


def _link_rows(spark, sf_dir):
    c = cited_parts(spark, sf_dir).withColumn("pick", F.col("l_partkey") % 3)
    return c.select(F.col("source_jo").alias("jo_no"), F.concat(F.lit("법"), (F.col("l_partkey") % 4).cast("string")).alias("law_name"), F.when(F.col("pick") == 2, "").otherwise(F.concat(F.lit("제"), (F.col("l_partkey") % 10).cast("string"), F.lit("조"))).alias("article"), F.lit("high").alias("confidence"), F.concat(F.lit("사유"), (F.col("l_partkey") % 2).cast("string")).alias("reason"), F.element_at(F.array(F.lit("citation"), F.lit("gpt"), F.lit("keyword")), (F.col("pick") + 1).cast("int")).alias("source"))


@_query(f"""with {PARTS_SQL}, l as (select source_jo as jo_no, '법' || (l_partkey % 4) as law_name, case when l_partkey % 3 = 2 then '' else '제' || (l_partkey % 10) || '조' end as article, 'high' as confidence,
  '사유' || (l_partkey % 2) as reason, ['citation', 'gpt', 'keyword'][l_partkey % 3 + 1] as source, cast(l_partkey % 3 as integer) as rank from cites),
r as (select *, row_number() over (partition by jo_no, law_name, case when article = '' then '#' || reason else article end order by rank, law_name, article, reason) as n from l)
select jo_no, law_name, article, confidence, reason, source, rank from r where n = 1""")
def link_merge_priority(spark, sf_dir):
    """A5."""
    return links.merge_links(_link_rows(spark, sf_dir))


@_query(f"""with r as (select *, row_number() over () - 1 as n from {_values(V.TITLE_TOPIC_RULES, 'keyword, law_name, reason')}),
a as (select p_partkey as ordinal, '조문 ' || ['법인세 감면', '소득세 공제', '투자', '취득 이월', '기타'][p_partkey % 5 + 1] as text from part),
h as (select ordinal, law_name, min(row(n, reason)) as rule from a join r on contains(a.text, r.keyword) group by 1, 2)
select cast(ordinal as varchar) as jo_no, law_name, '' as article, 'low' as confidence, rule[2] as reason, 'keyword' as source from h""")
def keyword_topic_links(spark, sf_dir):
    """G4."""
    words = F.array(*[F.lit(x) for x in ("법인세 감면", "소득세 공제", "투자", "취득 이월", "기타")])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("jo_no"), F.lit("조문").alias("title"), F.element_at(words, (F.col("p_partkey") % 5 + 1).cast("int")).alias("body"))
    return links.keyword_links(rows)


@_query(f"""with {PARTS_SQL}, l as (select source_jo as jo_no, '법' || (l_partkey % 4) as law_name, case when l_partkey % 3 = 2 then '' else '제' || (l_partkey % 10) || '조' end as article,
  '사유' || (l_partkey % 2) as reason, cast(l_partkey % 3 as integer) as rank from cites),
r as (select *, row_number() over (partition by jo_no, law_name, case when article = '' then '#' || reason else article end order by rank, law_name, article, reason) as n from l),
g as (select jo_no, list('  - ' || law_name || ' ' || case when article = '' then '(조문 미특정)' else article end || ': ' || reason order by rank, law_name, article, reason) as lines from r where n = 1 group by 1),
t as (select *, row_number() over (order by cast(jo_no as integer)) as k from g)
select cast(-1 as bigint) as place, '# ' || count(*) || '/' || count(*) as text from g
union all select cast(jo_no as bigint), '- ' || jo_no || ' 감면' || chr(10) || array_to_string(lines[1:8], chr(10)) || case when len(lines) > 8 then chr(10) || '  - 외 ' || (len(lines) - 8) || '건' else '' end from t where k <= 80""")
def link_records_summary(spark, sf_dir):
    """The Markdown summary of the link records."""
    rows = articles(spark, sf_dir).select("jo_no", "ordinal", F.lit("감면").alias("title"))
    return sinks.markdown_summary(links.link_records(rows, _link_rows(spark, sf_dir)))


def _candidates(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    names = F.array(*[F.lit(x) for x in review.SOURCES])
    reasons = F.array(F.lit("직접 인용 검토"), F.lit("범위 검토"), F.lit("일반"))
    at = lambda a, n: F.element_at(a, (n + 1).cast("int"))
    return e.select(F.concat(F.lit("법"), (F.col("l_suppkey") % 5).cast("string")).alias("law_name"), F.concat(F.lit("제"), (F.col("l_partkey") % 60).cast("string"), F.lit("조")).alias("article_ref"), at(names, F.col("l_orderkey") % 5).alias("source"), F.lit("").alias("symbol"), F.concat(F.lit("라벨"), F.col("l_linenumber").cast("string")).alias("label"), at(reasons, F.col("l_partkey") % 3).alias("reason"), (F.col("l_suppkey") % 2 == 0).alias("suggested"), F.col("l_orderkey").alias("seq"))


_QUEUE_SQL = """c as (select '법' || (l_suppkey % 5) as law_name, '제' || (l_partkey % 60) || '조' as article_ref, ['back_citation', 'parallel_hint', 'same_article', 'hint', 'gpt'][l_orderkey % 5 + 1] as source, '' as symbol,
  '라벨' || l_linenumber as label, ['직접 인용 검토', '범위 검토', '일반'][l_partkey % 3 + 1] as reason, l_suppkey % 2 = 0 as suggested, l_orderkey as seq, cast(l_orderkey % 5 as integer) as source_rank from lineitem),
t as (select *, case when source in ('parallel_hint', 'back_citation') then 'required' when suggested then case when contains(reason, '직접 인용') then 'required' else 'reference' end
  when source = 'hint' then 'reference' when contains(reason, '직접 인용') then 'required' else 'reference' end as tier, law_name || '|' || article_ref || '|' || source || '|' || symbol as candidate_id from c),
r as (select *, row_number() over (partition by candidate_id order by case when tier = 'required' then 0 else 1 end, source_rank, seq, label, reason) as n from t),
queue as (select law_name, article_ref, source, symbol, label, reason, suggested, seq, tier, candidate_id, source_rank from r where n = 1)"""


@_query(f"with {_QUEUE_SQL} select * from queue")
def review_queue(spark, sf_dir):
    """U4, A6, F22, F9, O3."""
    rows = _candidates(spark, sf_dir)
    return review.build_queue([rows.where(F.col("source") == s) for s in review.SOURCES])


@_query(f"with {_QUEUE_SQL} select count(*) filter (tier = 'required') as required, count(*) filter (tier = 'reference') as reference, count(*) as total from queue")
def queue_summary(spark, sf_dir):
    """A7."""
    return review.queue_summary(review_queue(spark, sf_dir))


@_query(f"with {_QUEUE_SQL} select candidate_id, label from queue where tier = 'required' and law_name <> '법1'")
def pending_reviews(spark, sf_dir):
    """J16."""
    queue = review_queue(spark, sf_dir)
    return review.pending(queue, queue.where("law_name = '법1'").select("candidate_id")).select("candidate_id", "label")


def _event_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mark = F.substring(F.lit(refs.SYMBOLS), (F.col("event_id") % 20 + 1).cast("int"), F.lit(1))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(mark, F.lit(" 본문"))).otherwise(F.concat(mark, F.lit(" (생략)")))
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), text.alias("line"))


_LINES_SQL = f"""lines as (select user_id as id, event_id as pos, substr('{refs.SYMBOLS}', cast(event_id % 20 + 1 as integer), 1) as sym, event_id % 3 = 0 as changed from events)"""


@_query(f"""with {_LINES_SQL}, i as (select *, sum(case when changed or coalesce(prev, true) then 1 else 0 end) over (partition by id order by pos) as island
  from (select *, lag(changed) over (partition by id order by pos) as prev from lines)),
g as (select id, island, min(pos) as pos, count(*) as n, arg_min(sym, pos) as first, arg_max(sym, pos) as last, bool_or(changed) as changed from i group by 1, 2)
select id, pos, case when changed then first || ' 본문' else case n when 1 then first when 2 then first || '·' || last else first || '~' || last end || ' (생략)' end as line from g""")
def run_compression(spark, sf_dir):
    """W1."""
    return compare.compress_runs(_event_lines(spark, sf_dir))


@_query(f"""with {_LINES_SQL}, b as (select *, sum(case when changed then 1 else 0 end) over (partition by id order by pos) as block from lines)
select id, cast(block as bigint) as block, max(case when changed then sym else '' end) as symbol, string_agg(case when changed then sym || ' 본문' else '(' || sym || ')' end, chr(10) order by pos) as text from b group by 1, 2""")
def block_split(spark, sf_dir):
    """W3."""
    rows = _event_lines(spark, sf_dir)
    mark = F.substring("line", 1, 1)
    return compare.blocks(rows.withColumn("line", F.when(F.col("pos") % 3 == 0, F.col("line")).otherwise(F.concat(F.lit("("), mark, F.lit(")")))))


@_query(f"""with o as (select distinct l_orderkey as id, l_linenumber as k, substr('{refs.SYMBOLS}', l_linenumber, 1) as symbol from lineitem where l_partkey % 3 <> 0),
n as (select distinct l_orderkey as id, l_linenumber as k, substr('{refs.SYMBOLS}', l_linenumber, 1) as symbol from lineitem where l_partkey % 3 <> 1)
select coalesce(o.id, n.id) as id, coalesce(o.symbol, n.symbol) as symbol, cast(coalesce(o.k, n.k) as integer) as place, case when o.id is null then '' else o.symbol || ' 종전' end as "left",
  case when n.id is null then o.symbol || '(현행과같음)' else n.symbol || ' 개정' end as "right" from o full join n on o.id = n.id and o.k = n.k""")
def full_outer_align(spark, sf_dir):
    """J14, A10."""
    rows = table(spark, sf_dir, "lineitem")
    mark = F.substring(F.lit(refs.SYMBOLS), F.col("l_linenumber"), F.lit(1))
    side = lambda keep, word: rows.where(keep).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("block"), mark.alias("symbol"), F.concat(mark, F.lit(f" {word}")).alias("text")).distinct()
    return compare.align(side("l_partkey % 3 <> 0", "종전"), side("l_partkey % 3 <> 1", "개정"))


@_query()
def dash_mask(spark, sf_dir):
    """F36-F38, K6."""
    rows = articles(spark, sf_dir).select("law", "jo_no", F.regexp_replace("body", r"제(\d+)항", "제<u>$1</u>항").alias("body"))
    return rows.select("law", "jo_no", compare.mask_lines("body").alias("masked"), F.size(compare.runs_of(F.col("body"))).alias("runs"))


_CASES_SQL = """cases as (select doc_id as id, case when doc_id % 3 = 0 then '법인세법' when doc_id % 3 = 1 then '소득세법' else '소득세법 시행령' end as law_name, case when doc_id % 2 = 0 then '세율' else '업무용승용차 필요경비' end as title,
  case when doc_id % 5 = 0 then '과세표준 신고기한 인하' else '손금 한도 거래' end as outline, '장래효' as effect_type, case when doc_id % 4 = 0 then '신고' when doc_id % 4 = 1 then '사업연도' else '자동 추천' end as application_basis, '제' || doc_id || '조' as jo_label from documents)"""


@_query(f"""with {_CASES_SQL}, p as (select * from {_values([(i, *r) for i, r in enumerate(V.PRECEDENTS)], 'ordinal, precedent_id, p_law, tk, ok, basis, effect, suffix, sentence, origin')}),
s as (select id, precedent_id, ordinal, case when application_basis = '자동 추천' and effect <> effect_type then -1 else 0 end + case when basis = application_basis then 5 else 0 end
  + case when p_law = '' then 0 when p_law = law_name then 4 else -2 end + 3 * len(list_filter(tk, lambda k: contains(title, k))) + 2 * len(list_filter(ok, lambda k: contains(outline, k))) as score
  from cases cross join p where application_basis = '자동 추천' or basis = application_basis),
r as (select *, row_number() over (partition by id order by score desc, ordinal) as n from s where score > 0)
select c.id, r.precedent_id, cast(r.score as integer) as score from cases c left join (select * from r where n = 1) r on c.id = r.id""")
def precedent_top1(spark, sf_dir):
    """A12, F43-F45, S8."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    k = F.col("id")
    cases = d.select("id", F.when(k % 3 == 0, "법인세법").when(k % 3 == 1, "소득세법").otherwise("소득세법 시행령").alias("law_name"), F.when(k % 2 == 0, "세율").otherwise("업무용승용차 필요경비").alias("title"), F.when(k % 5 == 0, "과세표준 신고기한 인하").otherwise("손금 한도 거래").alias("outline"), F.lit("장래효").alias("effect_type"), F.when(k % 4 == 0, "신고").when(k % 4 == 1, "사업연도").otherwise("자동 추천").alias("application_basis"), F.concat(F.lit("제"), k.cast("string"), F.lit("조")).alias("jo_label"))
    return precedents.addenda(cases, precedents.precedent_table(spark)).drop("text")


_DIGEST_SQL = ARTICLES_SQL + """,
digests as (select law as name, count(*) as article_count, substr(sha256(string_agg(jo_no || '|' || title || '|' || body, chr(10) order by ordinal, jo_no || '|' || title || '|' || body)), 1, 16) as content_hash from articles group by 1)"""


@_query(f"with {_DIGEST_SQL} select * from digests")
def content_digests(spark, sf_dir):
    """A9, S11, A2."""
    return freshness.content_digests(articles(spark, sf_dir).withColumnRenamed("law", "name"))


@_query(f"""with {_DIGEST_SQL}, now as (select *, 'm' as mst, '20260101' as enforced from digests where name <> '법률7'),
old as (select name, 'm' as mst, case when name = '법률2' then '20250101' else '20260101' end as enforced, article_count, case when name = '법률3' then 'x' else content_hash end as content_hash from digests where name <> '법률5')
select d.name, case when n.name is null then 'unresolved' when o.name is null then 'new' else 'changed' end as status,
  case when n.name is not null and o.name is not null then concat_ws('; ', case when o.enforced <> n.enforced then '시행일 ' || o.enforced || ' → ' || n.enforced end, case when o.content_hash <> n.content_hash then '본문 변경 (' || o.article_count || '→' || n.article_count || '개 조문)' end) else '' end as detail
from digests d left join now n on d.name = n.name left join old o on d.name = o.name where n.name is null or o.name is null or o.enforced <> n.enforced or o.content_hash <> n.content_hash""")
def freshness_diff(spark, sf_dir):
    """J13, S7, K1, K5."""
    digests = content_digests(spark, sf_dir).cache()  # a row for each law, read three times
    now = digests.where("name <> '법률7'").withColumns({"mst": F.lit("m"), "enforced": F.lit("20260101")})
    old = digests.where("name <> '법률5'").withColumns({"mst": F.lit("m"), "enforced": F.when(F.col("name") == "법률2", "20250101").otherwise("20260101"), "content_hash": F.when(F.col("name") == "법률3", "x").otherwise(F.col("content_hash"))})
    return freshness.compare(digests, now, old)


@_query("""select page_id, md5(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')) as digest from pages""")
def html_scrub(spark, sf_dir):
    """F23, S15's hook aside."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(terms.scrub_html(F.coalesce("html", F.lit("")))).alias("digest"))


@_query(f"""with x as (select doc_id, {', '.join(f"contains(coalesce(text, ''), '{w}') as {n}" for n, w in (('a', 'entre'), ('b', 'thing')))} from documents)
select doc_id, case when a then 'rate_application' when b then 'definition_scope' else '' end as relation_type, case when a then '세율 적용 축' when b then '정의→대상' else '' end as label from x""")
def relation_types(spark, sf_dir):
    """F21."""
    text = F.coalesce("text", F.lit(""))
    reason = F.when(F.contains(text, F.lit("entre")), "세율 개정").when(F.contains(text, F.lit("thing")), "범위 확대").otherwise("기타")
    kind = terms.relation_type(F.lit("소득세법"), F.lit("제1조"), reason, F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("relation_type"), terms.relation_label(kind).alias("label"))
