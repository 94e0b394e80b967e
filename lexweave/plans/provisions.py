"""Registered queries of references, displays, lookups and review, with SQL.

Texts are built from numbers of the tables, so that the SQL can state what an
operator must find in them without its patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import fixed_values as V
from lexweave.functions import refs, terms
from lexweave.operators import citations, compare, display, graph, intent, links, parallel, review
from lexweave.plans.catalog import _TITLED_SQL, QUERIES, _edges, _link_rows, _query, _rows, _titled, _values
from lexweave.plans.corpus import ARTICLES_SQL, PARTS_SQL, articles, cited_parts, table
from lexweave.sources import statutes

__all__ = ["QUERIES"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b, h, o, form): the numbers of a reference for each part."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "part").select(k.alias("id"), text(k % 150 + 1).alias("a"), text(k % 7 + 2).alias("b"), text(k % 25 + 1).alias("h"), text(k % 9 + 1).alias("o"), (k % 4).cast("int").alias("form"))


_PARTS_SQL = "p as (select p_partkey as id, cast(p_partkey % 150 + 1 as varchar) as a, cast(p_partkey % 7 + 2 as varchar) as b, cast(p_partkey % 25 + 1 as varchar) as h, cast(p_partkey % 9 + 1 as varchar) as o, p_partkey % 4 as form from part)"
_SYMBOLS_SQL = f"case when cast(h as int) <= 20 then substr('{refs.SYMBOLS}', cast(h as int), 1) else '' end"


def _join(*pieces) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) and not x.startswith("$") else F.col(x[1:]) for x in pieces])


@_query(f"""with {_PARTS_SQL}
select id, a as article, case when form < 2 then b else '' end as branch,
  case form when 2 then null when 1 then '제' || a || '조의' || b when 0 then '제' || a || '조의' || b || '제' || h || '항제' || o || '호' else '제' || a || '조제' || h || '항' end as formatted,
  case form when 0 then '제' || a || '조의' || b || '제' || h || '항제' || o || '호' when 1 then '제' || a || '조의' || b when 2 then a || '조' else '제' || a || '조제' || h || '항(사유)' end as normalized,
  case form when 0 then a || '의' || b || 'h' || h || 'o' || o || ',' || a || '의' || b || 'h' || h || ',' || a || '의' || b when 1 then a || '의' || b when 3 then a || 'h' || h || ',' || a end as keys,
  case form when 3 then '소득세법' else '' end as label_law,
  case form when 0 then '제' || a || '조' when 1 then '제' || a || '의' || b || '조' when 2 then '' else '제' || a || '조제' || h || '항' end as label_ref,
  {_SYMBOLS_SQL} as symbol, 'https://www.law.go.kr/법령/소득세법시행령' as url from p""")
def reference_forms(spark, sf_dir):
    """F1-F5, F7, F8, F27."""
    forms = [_join("제", "$a", "조의", "$b", "제", "$h", "항제", "$o", "호"), _join("제", "$a", "의", "$b", "조"), _join("$a", "조"), _join("소득세법 시행령 제", "$a", "조제", "$h", "항(사유)")]
    rows = _parts(spark, sf_dir).withColumn("text", F.element_at(F.array(*forms), F.col("form") + 1))
    text, law = F.col("text"), F.lit("소득세법 시행령")
    one, parts, label = refs.parse_article(text), refs.ref_of_text(F.concat(text, F.lit("\n제999조"))), refs.label_parts(text)
    parts = F.when(F.col("form") != 2, parts)
    keys = F.array_join(refs.lookup_keys(*[parts[x] for x in ("jo", "sub", "hang", "ho")]), ",")
    return rows.select(
        "id",
        one["jo"].alias("article"),
        one["sub"].alias("branch"),
        F.when(F.col("form") != 2, refs.format_ref(*[parts[x] for x in ("jo", "sub", "hang", "ho")])).alias("formatted"),
        refs.normalize_ref(text, law).alias("normalized"),
        F.when(F.col("form") != 2, keys).alias("keys"),
        label["law"].alias("label_law"),
        label["ref"].alias("label_ref"),
        refs.symbol_of(F.col("h")).alias("symbol"),
        refs.law_url(law).alias("url"),
    )


@_query(f"""with {_PARTS_SQL}, t as (select *, case when form < 2 then a || '의' || b else a end as jo_no, case form when 3 then '' else '제목' || o end as title,
  '제' || a || '조' || case when form < 2 then '의' || b else '' end as label from p)
select id, label || case when title <> '' then '(' || title || ')' else '' end as heading,
  case when form = 1 then '제5조에 따라' || chr(10) || '끝' else label || case when title <> '' then '(' || title || ')' else '' end || chr(10) || '본문 ' || h end as whole,
  jo_no as stub_no, title as stub_title, case when form = 0 then {_SYMBOLS_SQL} else '' end as mark,
  case when form = 2 then '소득세법 시행령 일부개정령(안)' else '소득세법 일부개정법률(안)' end as amendment,
  '요강' || h || chr(10) || chr(10) || '※ 연쇄 개정: 소득세법 ' || label || ' 개정에 따른 검토' || chr(10) || '※ 검토 사유: 병행' as outline from t""")
def article_headings(spark, sf_dir):
    """F6, F42, F46."""
    rows = _parts(spark, sf_dir).withColumn("jo_no", F.when(F.col("form") < 2, _join("$a", "의", "$b")).otherwise(F.col("a"))).withColumn("title", F.when(F.col("form") == 3, "").otherwise(_join("제목", "$o")))
    body = F.when(F.col("form") == 1, F.lit("제5조에 따라\n끝 ")).otherwise(_join(" 본문 ", "$h"))
    rows = rows.withColumns({"head": refs.heading(F.col("jo_no"), F.col("title")), "whole": refs.headed_text(F.col("jo_no"), F.col("title"), body)})
    rows = rows.withColumn("stub", refs.article_stub(F.when(F.col("form") == 0, F.col("jo_no")).otherwise(""), F.concat("head", F.lit("\n"), body)))
    stub = F.col("stub")
    law = F.when(F.col("form") == 2, "소득세법 시행령").otherwise("소득세법")
    number = refs.parse_article(F.col("jo_no"))
    return rows.select(
        "id",
        F.col("head").alias("heading"),
        "whole",
        stub["jo_no"].alias("stub_no"),
        stub["title"].alias("stub_title"),
        refs.first_symbol(F.when(F.col("form") == 0, F.concat(F.lit("  "), refs.symbol_of(F.col("h")), F.lit(" 가"))).otherwise("가 ①")).alias("mark"),
        refs.amendment_title(law).alias("amendment"),
        review.cascade_outline(_join(" 요강", "$h", "\n"), F.lit("소득세법"), refs.format_ref(number["jo"], number["sub"]), F.lit("병행 ")).alias("outline"),
    )


@_query(f"""with {PARTS_SQL}, r as (select *, row_number() over (partition by source_jo, law_name, jo, jo_sub, hang, ho order by pos, raw) as n from cites)
select source_jo as id, pos, raw as ref, raw, case when law_name = '' then '현행법' else law_name end as law, range_end_jo <> '' as ranged,
  'https://www.law.go.kr/법령/' || replace(case when law_name = '' then '현행법' else law_name end, ' ', '') || '/제' || jo || '조' || case when jo_sub <> '' then '의' || jo_sub else '' end as url,
  '제' || jo || '조' || case when jo_sub <> '' then '의' || jo_sub else '' end || case when hang <> '' then '제' || hang || '항' || case when hang_end <> '' then '~제' || hang_end || '항' else '' end else '' end || case when range_end_jo <> '' then '~제' || range_end_jo || '조' else '' end as full
from r where n = 1""")
def citation_rows(spark, sf_dir):
    """F10, F3 with ranges."""
    rows = cited_parts(spark, sf_dir).withColumnRenamed("source_jo", "id").withColumns({"mok": F.lit(""), "is_range": F.col("range_end_jo") != ""})
    listed = citations.citation_table(rows, "현행법")
    order = Window.partitionBy("id", "law_name", "jo", "jo_sub", "hang", "ho").orderBy("pos", "raw")
    full = refs.ranged_ref(*[F.col(x) for x in ("jo", "jo_sub", "hang", "hang_end", "ho", "mok", "range_end_jo")], F.lit(""))
    named = rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "pos", "raw", F.when(F.col("law_name") == "", "현행법").otherwise(F.col("law_name")).alias("law"), F.col("is_range").alias("ranged"), full.alias("full"))
    numbered = lambda frame: frame.withColumn("k", F.row_number().over(Window.partitionBy("id", "pos", "raw", "law", "ranged").orderBy(*[x for x in ("url", "full") if x in frame.columns])))
    return numbered(listed).join(numbered(named), ["id", "pos", "raw", "law", "ranged", "k"]).select("id", "pos", "ref", "raw", "law", "ranged", "url", "full")


@_query(f"""with {PARTS_SQL}, t as (select distinct jo from cites), h as (select source_law, source_jo, pos, raw, jo as target_jo, '전체' as target_law from cites where law_name <> '')
select target_jo, source_law, source_jo, pos, raw, cast(row_number() over (partition by target_jo order by source_law, source_jo, pos, raw) as integer) as place from h""")
def ordered_hits(spark, sf_dir):
    """O2."""
    hits = cited_parts(spark, sf_dir).where("law_name <> ''").select("source_law", "source_jo", "pos", "raw", F.col("jo").alias("target_jo"), F.lit("전체").alias("target_law"))
    return graph.ordered_hits(hits).drop("target_law")


@_query(f"""with {ARTICLES_SQL}, q as (select p_partkey as id, '법률' || (p_partkey % 8) as law, cast(p_partkey as varchar) as jo_no from part),
r as (select q.id, q.law, q.jo_no, a.title, a.body, row_number() over (partition by q.id order by a.ordinal) as n from q join articles a on q.law = a.law and q.jo_no = a.jo_no)
select id, law, jo_no, title, body from r where n = 1""")
def article_lookup(spark, sf_dir):
    """The article that a part's outline names."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("법률"), (F.col("p_partkey") % 8).cast("string")).alias("law"), F.concat(F.lit("제"), F.col("p_partkey").cast("string"), F.lit("조제1항의 한도를 올린다.")).alias("text"))
    return statutes.article_of_ref(articles(spark, sf_dir), asked)


@_query(f"with {ARTICLES_SQL} select law, jo_no, ordinal, title, body from articles where law = '법률3'")
def law_articles(spark, sf_dir):
    """No result has the very name, so the first counts."""
    results = _rows(spark, [(2, "법률4"), (1, "법률3"), (3, "법률5")], "pos int, name string")
    return statutes.articles_of_law(articles(spark, sf_dir), results, "법률 3")


_NAMES = [(0, "NATION"), (1, "NATION_3"), (2, "NATION_3"), (3, "UNITED"), (4, "NATION_7"), (5, "none"), (6, "CHINA")]


@_query(f"""with w as (select * from {_values(_NAMES, 'seq, wanted')}), res as (select w.seq, w.wanted, n_nationkey as pos, n_name as name, case when n_nationkey % 4 = 0 then '' else 'M' || (n_nationkey % 6) end as mst from w join nation on contains(n_name, wanted)),
c as (select *, row_number() over (partition by seq order by case when name = wanted then 0 else 1 end, pos) as n from res),
d as (select *, row_number() over (partition by case when mst = '' then name else mst end order by seq) as k from c where n = 1)
select cast(seq as integer) as seq, wanted, name, mst from d where k = 1""")
def entry_resolution(spark, sf_dir):
    """Exact, else the first result; entries that repeat are dropped."""
    wanted = _rows(spark, _NAMES, "seq int, wanted string")
    k = F.col("n_nationkey")
    laws = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), k.alias("pos"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("M"), (k % 6).cast("string"))).alias("mst"))
    # A search's results for a handful of wanted names.
    results = laws.join(F.broadcast(wanted.select("wanted").distinct()), F.contains("name", "wanted")).select("wanted", "pos", "name", "mst")
    return parallel.resolve_entries(wanted, results)


@_query("""with x as (select user_id as id, event_id as pos, substr('""" + refs.SYMBOLS + """', cast(event_id % 20 + 1 as integer), 1) as sym, case when event_id % 3 = 0 then 'changed' when event_id % 11 = 0 then 'bare' else 'same' end as kind from events),
i as (select *, sum(case when kind = 'changed' or coalesce(prev, 'changed') = 'changed' then 1 else 0 end) over (partition by id order by pos) as island from (select *, lag(kind) over (partition by id order by pos) as prev from x)),
g as (select *, max(case when kind = 'same' then 1 else 0 end) over (partition by id, island) as marked from i),
r as (select id, island, min(pos) as pos, count(*) filter (kind = 'same') as n, arg_min(sym, pos) filter (kind = 'same') as a, arg_max(sym, pos) filter (kind = 'same') as b from g where kind <> 'changed' and marked = 1 group by 1, 2)
select id, pos, sym || ' <del>전</del>' as "left", sym || ' <u>후</u>' as "right" from g where kind = 'changed'
union all select id, pos, '(생략)', '(현행과같음)' from g where kind = 'bare' and marked = 0
union all select id, pos, l || ' (생략)', l || ' (현행과같음)' from (select id, pos, case n when 1 then a when 2 then a || '·' || b else a || '~' || b end as l from r)""")
def pair_compression(spark, sf_dir):
    """W2."""
    k = F.col("event_id")
    mark = F.substring(F.lit(refs.SYMBOLS), (k % 20 + 1).cast("int"), F.lit(1))
    side = lambda changed, same: F.when(k % 3 == 0, F.concat(mark, F.lit(changed))).when(k % 11 == 0, same).otherwise(F.concat(mark, F.lit(f" {same}")))
    pairs = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), k.alias("pos"), side(" <del>전</del>", "(생략)").alias("left"), side(" <u>후</u>", "(현행과같음)").alias("right"))
    return compare.compress_pairs(pairs)


@_query("""with d as (select p_partkey as id, p_partkey % 4 as form, cast(p_partkey as varchar) as k from part)
select id, case form when 0 then '지시 ' || k when 1 then '' when 2 then '"구' || k || '"을 "신"으로' else '다시' end as 지시문, case form when 0 then '제1조' || chr(10) || '① ' || k when 2 then '현 ' || k else '' end as 현행,
  case form when 0 then '개정 ' || k when 2 then '<u>신</u>' else '' end as 개정안, case form when 2 then '시행' else '' end as 부칙, case form when 3 then '[검토] ' || k else '' end as 연관항 from d""")
def draft_sections(spark, sf_dir):
    """separators, no section at all, key words, and a section twice."""
    drafts = [
        _join("머리말\n===SECTION:지시문===\n지시 ", "$k", "\n\n===SECTION:현행===\n제1조\n① ", "$k", "\n===SECTION:모름===\n버림\n===SECTION:개정안===\n개정 ", "$k", "\n===SECTION:부칙==="),
        _join("구분 없는 글 ", "$k"),
        _join("1. 개정지시문\n<del>구", "$k", "</del>을 <u>신</u>으로\n[현행]\n현 ", "$k", "\n[개정안]\n<u>신</u>\n부칙\n시행\n연관 항 검토"),
        _join("===SECTION:지시문===\n처음\n===SECTION:연관항===\n [검토] ", "$k", " \n===SECTION:지시문===\n다시"),
    ]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("k"))
    return compare.draft_sections(rows.select("id", F.element_at(F.array(*drafts), (F.col("id") % 4 + 1).cast("int")).alias("text")))


_CORE_SQL, _GENERIC = "[" + ", ".join(f"'{t}'" for t in V.CORE_TERMS) + "]", sorted(({k for k, _ in V.KEYWORD_SYNONYMS} | {x for _, xs in V.KEYWORD_SYNONYMS for x in xs}) - set(V.CORE_TERMS))
_GENERIC_SQL = "[" + ", ".join(f"'{t}'" for t in _GENERIC) + "]"
_TITLES = ("업무용승용차 관련비용", "세액공제", "기부금", "한도", "필요경비 불산입 특례규정", "이월결손금공제순서")
_WORDS = ("감가상각비한도", "세액공제", "처분손실이월", "전용보험가입")


@_query(f"""with t as (select p_partkey as id, {list(_TITLES)}[p_partkey % 6 + 1] as title, list_transform(range(0, 9), lambda i: {list(_WORDS)}[(p_partkey * (i + 1) + i) % 4 + 1]) as words from part),
x as (select id, title, words, list_filter(regexp_extract_all(title, '[가-힣]{{3,}}'), lambda w: not list_contains({_GENERIC_SQL}, w)) as own,
  list_filter({_CORE_SQL}, lambda c: contains(replace('제' || id || '조(' || title || ')' || chr(10) || array_to_string(words, ' '), ' ', ''), c)) as core from t),
w as (select id, unnest(words) as word, unnest(range(0, 9)) as place from x), c as (select id, word, count(*) as n, min(place) as first from w where not list_contains({_GENERIC_SQL}, word) group by 1, 2 having count(*) >= 2),
r as (select *, row_number() over (partition by id order by n desc, first) as rank from c), top as (select id, list(word order by rank) as top from r where rank <= 3 group by 1),
b as (select x.*, list_concat(core, own, coalesce(top, [])) as every from x left join top using (id)),
u as (select *, list_filter(every, lambda v, i: list_position(every, v) = i) as once from b)
select id, array_to_string(case when len(own) >= 2 then own when len(once) > 0 then once else regexp_extract_all(title, '[가-힣]{{3,}}') end, ',') as keywords from u""")
def keywords(spark, sf_dir):
    """F18, U5, A4."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    body = F.concat_ws(" ", *[pick(_WORDS, (k * (i + 1) + i) % 4) for i in range(9)])
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("제"), k.cast("string"), F.lit("조("), pick(_TITLES, k % 6), F.lit(")\n"), body).alias("text"))
    return parallel.extract_keywords(rows).select("id", F.array_join("keywords", ",").alias("keywords"))


_RULES_SQL = f"rules as (select * from {_values(V.PARALLEL_RULES, 'source_law, parallel_law, key, seq, article, reason')})"
_SCORE_SQL = "case when s.title <> '' and s.title = d.title then 8 when length(s.title) >= 6 and d.title <> '' and (contains(d.title, s.title) or contains(s.title, d.title)) then 6 else 0 end + 2 * len(list_intersect(s.terms, d.terms)) + case when list_contains(list_intersect(s.terms, d.terms), '업무용승용차') then 4 else 0 end + case when list_contains(list_intersect(s.terms, d.terms), '업무용승용차') and list_contains(list_intersect(s.terms, d.terms), '필요경비불산입') then 4 else 0 end"


@_query(f"""with {_TITLED_SQL}, {_RULES_SQL}, a as (select *, case when ordinal % 2 = 0 then '법인세법' else '소득세법' end as law, cast(ordinal as varchar) as jo_no from d),
q as (select law, ordinal as id, jo_no, title, terms, case when law = '법인세법' then '소득세법' else '법인세법' end as other from a),
h as (select q.id, r.article, r.reason, r.parallel_law, row_number() over (partition by q.id, r.parallel_law order by r.seq) as n from q join rules r on r.source_law = q.law and r.parallel_law = q.other and r.key = q.jo_no
  join a on a.law = r.parallel_law and a.jo_no = regexp_extract(r.article, '제(\\d+)조', 1) || case when regexp_extract(r.article, '제\\d+조의(\\d+)', 1) <> '' then '의' || regexp_extract(r.article, '제\\d+조의(\\d+)', 1) else '' end),
p as (select s.id, s.law, s.other, d.ordinal, {_SCORE_SQL} as score from q s join a d on d.law = s.other where s.id not in (select id from h)),
b as (select *, row_number() over (partition by id order by score desc, ordinal) as n from p where score >= 8)
select id, parallel_law, article, reason, 'hint' as stage from h where n = 1
union all select id, other, '제' || ordinal || '조', law || '과 ' || other || ' 사이의 조문 제목·핵심 표현이 코드 매칭 기준으로 동일 취지입니다.', 'similar' from b where n = 1""")
def parallel_cascade(spark, sf_dir):
    """Each part's article in the other law of the tax pair."""
    rows = _titled(spark, sf_dir)
    law = F.when(F.col("ordinal") % 2 == 0, "법인세법").otherwise("소득세법")
    title, body = terms.article_title(F.col("text")), F.element_at(F.split("text", "\n"), 2)
    laws = rows.select(law.alias("law"), F.col("ordinal").cast("string").alias("jo_no"), "ordinal", title.alias("title"), body.alias("body"))
    scope = _rows(spark, [parallel.TAX_PAIR, parallel.TAX_PAIR[::-1]], "law string, parallel string")
    return parallel.parallel_cascade(rows.select(F.col("ordinal").alias("id"), law.alias("law"), "text"), scope, laws, parallel.rule_table(spark))


_INTENTS = [(0, "소득세법", "129", "1", "3", "100분의 3", "100분의 2"), (1, "소득세법", "27", "2", "", "800만원", "1,000만원"), (2, "소득세법 시행령", "40의2", "", "", "가", "나"), (3, "법인세법", "5", "4", "1", "다", "라")]
_INTENT_SCHEMA = "id int, law string, jo string, hang string, ho string, old_text string, new_text string"
_TAX_LAWS = ("소득세법", "소득세법 시행령", "법인세법")


def _tax_edges(spark, sf_dir):
    """Edges between three laws, from the order lines."""
    pick = lambda n: F.element_at(F.array(*map(F.lit, _TAX_LAWS)), (n % 3 + 1).cast("int"))
    c = cited_parts(spark, sf_dir).withColumn("source_law", pick(F.col("source_jo").cast("long")))
    return c.select("source_law", "source_jo", pick(F.col("l_partkey")).alias("target_law"), F.col("raw").alias("target_ref"), "jo", "jo_sub", "hang", "ho", F.col("raw").alias("cite_raw"))


_LAWS_SQL = str(list(_TAX_LAWS))
_HITS_SQL = f"""{PARTS_SQL}, e as (select {_LAWS_SQL}[cast(source_jo as bigint) % 3 + 1] as source_law, source_jo, {_LAWS_SQL}[l_partkey % 3 + 1] as target_law, raw, jo || case when jo_sub <> '' then '의' || jo_sub else '' end as base, hang from cites),
ix as (select distinct target_law, unnest(list_filter([case when hang <> '' then base || 'h' || hang end, base], lambda x: x is not null)) as key, source_law, source_jo, raw from e),
ints as (select * from {_values(_INTENTS, 'id, law, jo, hang, ho, old_text, new_text')}),
asked as (select *, unnest(case when law like '%법' then [law, law || ' 시행령'] else [law] end) as target_law, unnest(case when law like '%법' then [0, 1] else [0] end) as scope from ints),
keys as (select *, unnest(list_filter([case when hang <> '' and ho <> '' then jo || 'h' || hang || 'o' || ho end, case when hang <> '' then jo || 'h' || hang end, jo], lambda x: x is not null)) as key,
  unnest(range(0, case when hang <> '' and ho <> '' then 3 when hang <> '' then 2 else 1 end)) as rank from asked),
j as (select k.*, ix.source_law, ix.source_jo, ix.raw, row_number() over (partition by id, scope, source_law, source_jo order by rank, raw) as n from keys k join ix on k.target_law = ix.target_law and k.key = ix.key),
hits as (select * from j where n = 1 and source_jo <> jo)"""
_HINTS_SQL = f"rh2 as (select i.id, i.old_text, i.new_text, r.* from ints i join (select * from {_values(V.RELATED_HINTS, 'h_law, h_jo, h_hang, h_ho, seq, related_law, article, reason, relation_type')}) r on i.law = h_law and i.jo = h_jo and i.hang = h_hang and i.ho = h_ho)"
_HITS_SQL += ",\n" + _HINTS_SQL
_LABEL_SQL = "case relation_type " + " ".join(f"when '{k}' then '{v}'" for k, v in V.RELATION_LABELS) + " else relation_type end"


@_query(f"""with {_HITS_SQL}, h as (select * from hits where not exists (select 1 from rh2 where rh2.id = hits.id and rh2.article = '제' || source_jo || '조')
  and (hang = '' or ho = '' or contains(raw, '제' || hang || '항'))),
o as (select *, row_number() over (partition by id, source_law, source_jo order by scope, rank, raw) as k from h)
select cast(id as integer) as id, 'hint' as origin, '[검토] ' || related_law || ' ' || article || '(' || reason || ') [' || {_LABEL_SQL} || ']: "' || old_text || '" → "' || new_text || '" — 확정 연관 매핑' as row from rh2
union all select cast(id as integer), 'citation', '[검토] ' || source_law || ' 제' || source_jo || '조: "' || old_text || '" → "' || new_text || '" — 제' || split_part(jo, '의', 1) || '조 인용: ' || raw from o where k = 1""")
def review_rows(spark, sf_dir):
    """G9, U2, J6, J3."""
    return review.review_rows(_rows(spark, _INTENTS, _INTENT_SCHEMA), parallel.related_table(spark), _tax_edges(spark, sf_dir))


@_query(f"""with {_HITS_SQL}, {_RULES_SQL}, adj as (select law, unnest(parallels) as parallel from {_values(V.PARALLEL_LAWS, 'law, parallels')}),
rel as (select law, unnest([parallel, parallel || ' 시행령', parallel || ' 시행규칙']) as related from adj where parallel not like '%시행령' union select law, parallel from adj where parallel like '%시행령'),
pk as (select i.id, i.old_text, i.new_text, rel.related, r.article, r.reason, row_number() over (partition by i.id, rel.related, case when r.article = '' then r.reason else r.article end order by r.seq) as n
  from ints i join rel on i.law = rel.law and rel.related <> i.law join rules r on r.source_law = i.law and r.parallel_law = rel.related and r.key = i.jo),
c as (select id, related_law as law_name, article as article_ref, 'hint' as source, related_law || ' ' || article as label, reason, 'reference' as tier, old_text, new_text, relation_type from rh2
union all select id, source_law, '제' || source_jo || '조', 'back_citation', source_law || ' 제' || source_jo || '조', '제' || split_part(jo, '의', 1) || '조 인용: ' || raw, 'required', old_text, new_text, '' from
  (select *, row_number() over (partition by id, source_law, source_jo order by scope * 1000 + rank, source_law || ' 제' || source_jo || '조', raw) as k from hits) where k = 1
union all select id, related, article, 'parallel_hint', case when article = '' then related || ' ' else related || ' ' || article end, reason, 'required', old_text, new_text, 'parallel_tax_law' from pk where n = 1
union all select i.id, '소득세법', '제' || (100 + i.id) || '조', 'gpt', '소득세법 제' || (100 + i.id) || '조', '제129조 직접 인용', 'required', 'x', 'y', '' from ints i)
select cast(id as integer) as id, law_name, article_ref, source, label, reason, tier, old_text, new_text, relation_type, law_name || '|' || article_ref || '|' || source || '|' as candidate_id from c""")
def review_candidates(spark, sf_dir):
    """The queues of four intents."""
    intents = _rows(spark, _INTENTS, _INTENT_SCHEMA)
    number = refs.parse_article(F.col("jo"))
    texts = intents.select("id", F.concat(refs.format_ref(number["jo"], number["sub"]), F.lit("(제목)\n본문 제999조제1항")).alias("text"))
    adjacent = parallel.adjacency(spark)
    related = parallel.related_closure(adjacent.select("law").distinct(), adjacent).select("law", "related")
    own = related.where(~F.col("related").isin("소득세법 시행규칙") | (F.col("law") != "소득세법"))
    lines = intents.select("id", "law", F.concat(F.lit('[검토] 소득세법 제'), (F.col("id") + 100).cast("string"), F.lit('조: "x" → "y" — 제129조 직접 인용\n다른 줄')).alias("text"))
    sources = [review.hint_candidates(intents, parallel.related_table(spark)), review.back_candidates(intents, _tax_edges(spark, sf_dir)), review.parallel_candidates(intents, texts, own, parallel.rule_table(spark)), review.line_candidates(lines)]
    return review.build_queue(sources).select("id", "law_name", "article_ref", "source", "label", "reason", "tier", "old_text", "new_text", "relation_type", "candidate_id")


_OUTLINES_SQL = """o as (select doc_id as id, doc_id % 5 as form, cast((doc_id % 8 + 1) * 100 as bigint) as a, cast((doc_id % 8 + 1) * 100 + (doc_id % 3 + 1) * 200 as bigint) as n, cast((doc_id % 6 + 1) * 50 as bigint) as b from documents)"""


def _outlines(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("id"), (k % 5).cast("int").alias("form"), ((k % 8 + 1) * 100).alias("a"), ((k % 8 + 1) * 100 + (k % 3 + 1) * 200).alias("n"), ((k % 6 + 1) * 50).alias("b"))
    won = lambda c: F.concat(F.format_number(c, 0), F.lit("만원"))
    return rows.withColumns({"old": won("a"), "new": won("n"), "other": won("b"), "plain": F.col("n").cast("string")})


@_query(f"""with {_OUTLINES_SQL}
select id, case form when 0 then '3' when 1 then '3' when 2 then '3' when 3 then '1' else '' end as hangs, case form when 3 then '3' else '' end as ho, '' as mok,
  case form when 3 then '100분의 3' when 4 then null else format('{{:,}}', a) || '만원' end as old_text, case form when 3 then '100분의 2' when 4 then null when 1 then '1,000만원' else format('{{:,}}', n) || '만원' end as new_text,
  case form when 0 then 'regex' when 3 then 'regex' when 4 then 'none' else 'heuristic' end as source, case form when 3 then 'ho' else 'hang' end as level from o""")
def outline_intents(spark, sf_dir):
    """F32-F35, W5."""
    outline = [
        _join("제3항 ", "$old", "을 ", "$new", "으로 상향한다."),
        F.lit("③ 한도 천만원으로 올리자. ⑤도 본다."),
        F.concat(F.lit("제3항 한도금액 인상 ("), F.col("a").cast("string"), F.lit("→"), F.col("plain"), F.lit("만원)")),
        F.lit("129조 1항 3호의 원천징수 세율을 현행 3%에서 2%로 하향한다."),
        F.lit("없음"),
    ]
    body = _join("제27조의2(한도)\n① 일반 ", "$other", " 100분의 3\n③ 한도는 정한다.\n③ 같은 항은 ", "$old", "으로 한다.\n④ 제3항의 ", "$other", "\n⑤ 끝")
    rows = _outlines(spark, sf_dir).select("id", F.element_at(F.array(*outline), F.col("form") + 1).alias("outline"), body.alias("body"))
    found = intent.parse_intent(rows)
    return found.select("id", F.array_join("hangs", ",").alias("hangs"), "ho", "mok", "old_text", "new_text", "source", intent.amendment_level(F.col("ho"), F.col("mok")).alias("level"))


@_query(f"""with {_OUTLINES_SQL}, s as (select *, format('{{:,}}', a) || '만원' as old, format('{{:,}}', n) || '만원' as new, format('{{:,}}', b) || '만원' as other, b * (n / a) as scaled from o),
f as (select *, case when abs(scaled - round(scaled)) < 0.000001 then format('{{:,}}', cast(round(scaled) as bigint)) else format('{{:,.1f}}', scaled) end || '만원' as follows from s)
select id, '④' as symbol, old as amount, new as proposal, 'suggest' as kind from f where form <> 4
union all select id, '④', other, follows, 'proportional' from f where form <> 4 and b <> a and follows <> other
union all select id, '⑤', old, new, 'review' from f where form <> 4
union all select id, '⑥', old, new, 'suggest' from f where form <> 4
union all select id, '⑦', other, follows, 'proportional' from f where form <> 4 and b <> a and follows <> other
union all select id, '④', '100분의 3', '100분의 2', 'suggest' from f where form = 4""")
def related_amounts(spark, sf_dir):
    """Amounts before the old one stay, wordings that are no amounts count too."""
    # Without the old amount in it, all of a paragraph's amounts follow: ⑦.
    body = F.when(F.col("form") == 4, F.lit("③ 세율은 100분의 3\n④ 제3항의 100분의 3과 900만원\n⑤ 제4항")).otherwise(
        F.concat(_join("제27조의2(한도)\n③ 한도는 ", "$old", "으로 한다.\n④ 제3항의 ", "$old", " 중 ", "$other", "\n⑤ ", "$old", "\n⑥ 제3항 77만원 뒤 ", "$old", "\n⑦ 제3항에 따라"), F.when(F.col("a") != F.col("b"), F.concat(F.lit(" "), F.col("other"))).otherwise(""))
    )
    rows = _outlines(spark, sf_dir).withColumn("text", body)
    old, new = F.when(F.col("form") == 4, "100분의 3").otherwise(F.col("old")), F.when(F.col("form") == 4, "100분의 2").otherwise(F.col("new"))
    return intent.related_amounts(rows.select("id", "text"), rows.select("id", F.lit("3").alias("hang"), old.alias("old_text"), new.alias("new_text")))


@_query(f"""with {_PARTS_SQL} select id, '제' || a || '조(제목)' || chr(10) || '① 가 ② 나' || chr(10) || '③ 다' as separated, '제' || a || '조(제목) ' || chr(10) || '① 가 ' || chr(10) || '② 나' || chr(10) || '③ 다' as on_lines,
  case when form = 1 then '' else '100분의 ' || h end as fraction, case when form = 0 then '소득세법 시행령' when form = 1 then '법인세법' when form = 2 then '부가가치세법 시행규칙' else '민법' end as canonical,
  case when form = 0 then '이 영' when form = 2 then '이 규칙' else '이 법' end as pronoun, '[검토] 소득세법 제' || a || '조|[제안] ②항' as kept, '가|나 ' || h || '|다' as merged from p""")
def text_rules(spark, sf_dir):
    """F13, F14, F25, F26, F31, F35, U3."""
    law = F.element_at(F.array(*map(F.lit, ("소득 세법 시행령", "법인세법", "부가가치세법시행규칙", "민 법"))), F.col("form") + 1)
    text = _join("제", "$a", "조(제목) ① 가 ② 나\n③ 다")
    percent = F.when(F.col("form") == 1, _join("$h", ".5%")).when(F.col("form") == 2, _join("$h", ".0%")).otherwise(_join(" ", "$h", "%"))
    lines = _join(" [검토] 소득세법 제", "$a", "조\n\n[검토] 소득세법 시행령 소득세법 제", "$a", "조\n[제안] ②항 ")
    return _parts(spark, sf_dir).select(
        "id",
        terms.split_inline_paragraph(text).alias("separated"),
        terms.lines_before_marks(text).alias("on_lines"),
        terms.percent_to_fraction(percent).alias("fraction"),
        terms.canonical_law(law).alias("canonical"),
        refs.law_pronoun(law).alias("pronoun"),
        F.array_join(review.drop_malformed(lines), "|").alias("kept"),
        F.replace(review.merged_lines(_join("가\n나 ", "$h", " "), _join(" 나 ", "$h", "\n\n다")), F.lit("\n"), F.lit("|")).alias("merged"),
    )


@_query(f"""with {PARTS_SQL}, c as (select source_jo as jo_no, pos, raw, {list(V.TAX_LAW_KEYWORDS)[:4]}[l_partkey % 4 + 1] as law from cites where l_partkey % 5 <> 0),
r as (select *, row_number() over (partition by jo_no, law, raw order by pos) as n from c where law <> '{V.TAX_LAW_KEYWORDS[0]}')
select jo_no, law as law_name, raw as article, 'high' as confidence, '명시 인용: ' || raw as reason, 'citation' as source from r where n = 1""")
def citation_links(spark, sf_dir):
    """Links to other tax laws."""
    laws = F.array(*[F.lit(x) for x in V.TAX_LAW_KEYWORDS[:4]])
    c = cited_parts(spark, sf_dir)
    law = F.when(F.col("l_partkey") % 5 == 0, "민법").otherwise(F.element_at(laws, (F.col("l_partkey") % 4 + 1).cast("int")))
    return links.citation_links(c.select(F.col("source_jo").alias("jo_no"), "pos", "raw", law.alias("law_name"), "jo", "jo_sub", "hang", "ho"), V.TAX_LAW_KEYWORDS[0])


@_query("""with l as (select doc_id as id, unnest([0, 1, 2, 3]) as pos from documents)
select id, cast(pos as integer) as pos, pos = 1 as suggested, case pos when 0 then '소득세법 제' || id || '조' else '②항(이유)' end as label, case pos when 0 then '100분의 3' else '가 ' || id end as old_text,
  case pos when 0 then '100분의 2' else '나' end as new_text, case pos when 0 then '제129조 직접 인용' else '' end as reason from l where pos in (0, 1)""")
def review_lines(spark, sf_dir):
    """G7."""
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("[검토] 소득세법 제"), k, F.lit('조: "100분의 3" → "100분의 2" — 제129조 직접 인용\n[제안] ②항(이유): "가 '), k, F.lit('" → "나"\n머리 [검토] x: "a" → "b"\n[검토] y "a" → "b"'))
    return review.parse_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text")))


_EVENT_SQL = f"""e as (select user_id as id, event_id as pos, substr('{refs.SYMBOLS}', cast(event_id % 20 + 1 as integer), 1) as sym, event_id % 4 as form from events)"""


@_query(f"""with {_EVENT_SQL}, b as (select *, sum(case when form = 0 then 1 else 0 end) over (partition by id order by pos) as block from e),
g as (select id, block, max(case when form = 0 then sym else '' end) as symbol, string_agg(case form when 0 then sym || ' 본문' when 3 then '<u>새 글</u>' else '글' end, chr(10) order by pos) as text, max(case when form = 3 then 1 else 0 end) as changed from b group by 1, 2)
select id, cast(block as bigint) as block, symbol, text, row_number() over (partition by id order by block) = 1 as first from g where changed = 1""")
def changed_paragraphs(spark, sf_dir):
    """W7, A13."""
    k = F.col("event_id")
    mark = F.substring(F.lit(refs.SYMBOLS), (k % 20 + 1).cast("int"), F.lit(1))
    line = F.when(k % 4 == 0, F.concat(mark, F.lit(" 본문"))).when(k % 4 == 3, "<u>새 글</u>").otherwise("글")
    return compare.changed_paragraphs(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), k.alias("pos"), line.alias("line")))


@_query("""with e as (select user_id as id, event_id as pos, event_id % 4 as form, cast(event_id % 9 + 1 as varchar) as n from events), b as (select *, sum(case when form < 2 then 1 else 0 end) over (partition by id order by pos) as block from e)
select id, cast(block as bigint) as block, max(case form when 0 then n when 1 then n || '의2' else '' end) as symbol, string_agg(case form when 0 then '  ' || n || '. 호' when 1 then n || '의2. 호' else '이어짐 ' || n || '.' end, chr(10) order by pos) as text from b group by 1, 2""")
def item_blocks(spark, sf_dir):
    """W4."""
    k = F.col("event_id")
    n = (k % 9 + 1).cast("string")
    line = F.when(k % 4 == 0, F.concat(F.lit("  "), n, F.lit(". 호"))).when(k % 4 == 1, F.concat(n, F.lit("의2. 호"))).otherwise(F.concat(F.lit("이어짐 "), n, F.lit(".")))
    return compare.items(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), k.alias("pos"), line.alias("line")))


@_query(f"""with {_RULES_SQL}, n as (select source_law || '/' || parallel_law || '/' || key as id, seq, article, reason, regexp_extract(article, '제(\\d+)', 1) || regexp_extract(article, '제\\d+조?(의\\d+)', 1) as jo_no from rules where article <> '' and key not like '%h%'),
f as (select n.*, row_number() over (partition by id order by seq) as k from n join (select distinct cast(p_partkey as varchar) as jo_no from part) a using (jo_no))
select id, seq, article, reason, jo_no, 0 as source_rank, 0 as key_rank from f where k = 1""")
def existing_hints(spark, sf_dir):
    """The first hint whose article is among the parts."""
    rules = parallel.rule_table(spark).where("article <> '' and key not like '%h%'")
    hints = rules.select(F.concat_ws("/", "source_law", "parallel_law", "key").alias("id"), F.lit(0).alias("source_rank"), F.lit(0).alias("key_rank"), "seq", "article", "reason")
    return parallel.existing_hints(hints, table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("jo_no")))


@_query("""with a as (select cast(p_partkey % 500 as varchar) as jo_no, p_partkey as ordinal, case when p_partkey % 7 = 0 then 0 else 1 end as rank from part)
select jo_no, cast(min(rank) as integer) as rank, arg_min(ordinal, {'r': rank, 'o': ordinal}) as ordinal from a group by 1""")
def hinted_first(spark, sf_dir):
    """J10."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).cast("string").alias("jo_no"), F.col("p_partkey").alias("ordinal"))
    return parallel.hinted_first(rows.where("ordinal % 7 = 0"), rows.where("ordinal % 7 <> 0"))


_MERGED_SQL = """l as (select source_jo as jo_no, '법' || (l_partkey % 4) as law_name, case when l_partkey % 3 = 2 then '' else '제' || (l_partkey % 10) || '조' end as article,
  '사유' || (l_partkey % 2) as reason, ['citation', 'gpt', 'keyword'][l_partkey % 3 + 1] as source from cites)"""


@_query(f"""with {PARTS_SQL}, {_MERGED_SQL}, n as (select jo_no, count(distinct law_name || '/' || article) filter (source = 'citation') as cited from l group by 1),
r as (select cast(jo_no as integer) as ordinal, jo_no, cited, row_number() over (order by cast(jo_no as integer)) as k from n where cited < 2 and jo_no like '%7%') select jo_no, ordinal, cast(cited as integer) as cited from r where k <= 40""")
def records_to_review(spark, sf_dir):
    """A report of the first forty."""
    rows = articles(spark, sf_dir).select("jo_no", "ordinal", F.concat(F.lit("조 "), "jo_no").alias("title"))
    found = links.needing_review(links.link_records(rows, _link_rows(spark, sf_dir)), ["7"], 40)
    return found.select("jo_no", "ordinal", F.size(F.filter("linked_articles", lambda x: x.source == "citation")).alias("cited"))


@_query(f"""with {PARTS_SQL}, {_MERGED_SQL}, g as (select distinct source_jo as jo_no, case when cast(source_jo as bigint) % 4 = 1 then '' else '법9' end as law_name, '제1조' as article, '판단' as reason, 'gpt' as source from cites where cast(source_jo as bigint) % 2 = 1),
a as (select * from l union all select * from g where law_name <> ''), k as (select distinct jo_no, law_name, case when article = '' then '#' || reason else article end as key from a)
select c.jo_no, cast(count(k.key) as integer) as n, max(case when cast(c.jo_no as bigint) % 2 = 1 then '메모' end) as review_note from (select distinct source_jo as jo_no from cites) c left join k on c.jo_no = k.jo_no group by 1""")
def enriched_records(spark, sf_dir):
    """J17."""
    rows = articles(spark, sf_dir).select("jo_no", "ordinal", F.lit("감면").alias("title"))
    records = links.link_records(rows, _link_rows(spark, sf_dir))
    odd = rows.where(F.col("ordinal") % 2 == 1)
    judged = odd.select("jo_no", F.when(F.col("ordinal") % 4 == 1, "").otherwise("법9").alias("law_name"), F.lit("제1조").alias("article"), F.lit("low").alias("confidence"), F.lit("판단").alias("reason"), F.lit("메모").alias("review_note"))
    return links.enrich(records, judged).select("jo_no", F.size("linked_articles").alias("n"), "review_note")


@_query("""with j as (select 'job' || p_partkey as job_id, 'law' || (p_partkey % 3) as law, case when p_partkey % 5 = 0 then 'active' else 'pending' end as status from part where p_partkey % 2 = 0),
q as (select * from j union all select 'job' || p_partkey, 'law' || (p_partkey % 3), 'pending' from part where p_partkey % 2 = 1 and p_partkey % 3 = 0)
select job_id, law, case when job_id = 'job3' then 'active' when status = 'active' then 'done' else status end as status from q""")
def job_queue(spark, sf_dir):
    """jobs are added once, one becomes active."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat(F.lit("job"), k.cast("string")).alias("job_id"), F.concat(F.lit("law"), (k % 3).cast("string")).alias("law"))
    jobs = rows.where(k % 2 == 0).select("job_id", "law", F.when(k % 5 == 0, "active").otherwise("pending").alias("status"))
    entries = rows.where(k % 3 == 0).select("job_id", "law")
    return review.activate_job(review.enqueue_jobs(jobs, entries.unionByName(entries)), "job3")


@_query("with " + PARTS_SQL + """, tg as (select source_law, case when relative <> '' then source_law when law_name <> '' then law_name else source_law end as target_law from cites where jo <> '')
select count(*) as edge_count, coalesce(string_agg(distinct source_law, ',' order by source_law), '') as laws, count(*) > 0 as available from tg where replace(target_law, ' ', '') in ('법률1', '법률2', '법률3')""")
def graph_facts(spark, sf_dir):
    """S9, A2."""
    return graph.graph_meta(_edges(spark, sf_dir))


def _shown(spark, sf_dir, how, other):
    body = _join("제", "$a", "조(한도) ① 다음 각 호에 해당하는 경우\n  1. 첫 번째 호 ", "$old", " 한도.\n  2. 두 번째 호.\n② 다른 항 ", "$old", ".\n③ 끝 항")
    k = F.col("id")
    rows = _parts(spark, sf_dir).withColumn("old", _join("$h", "만원")).withColumn("new", _join("$b", "만원"))
    hang, ho = F.when(k % 3 == 1, "2").otherwise("1"), F.when(k % 3 == 2, "1").otherwise("")
    return rows.select("id", display.shown(how, body, hang, ho, F.lit(""), F.col("old"), F.col("new"), other).alias("text"))


@_query(f"""with {_PARTS_SQL}, t as (select *, '제' || a || '조(한도)' as head, h || '만원' as old from p)
select id, head || chr(10) || case id % 3 when 1 then '① (생략)' || chr(10) || '② 다른 항 <del>' || old || '</del>.' || chr(10) || '③ (생략)'
  else '① 다음 각 호에 해당하는 경우' || chr(10) || '  1. 첫 번째 호 <del>' || old || '</del> 한도.' || chr(10) || '  2. 두 번째 호.' || chr(10) || '②·③ (생략)' end as text from t""")
def current_displays(spark, sf_dir):
    """F39, F28, F29, W1."""
    return _shown(spark, sf_dir, display.current_display, F.lit("없음"))


@_query(f"""with {_PARTS_SQL}, t as (select *, '제' || a || '조(한도)' as head, b || '만원' as new from p where p.id % 3 <> 2)
select id, head || chr(10) || case id % 3 when 1 then '① (현행과같음)' || chr(10) || '② 다른 항 <u>' || new || '</u>.' || chr(10) || '③ 끝 <u>항</u>'
  else '① 다음 각 호에 해당하는 경우' || chr(10) || '  1. 첫 번째 호 <u>' || new || '</u> 한도.' || chr(10) || '  2. 두 번째 호.' || chr(10) || '② (현행과같음)' || chr(10) || '③ 끝 <u>항</u>' end as text from t""")
def amended_displays(spark, sf_dir):
    """paragraphs; items are masked and have fixtures of their own."""
    return _shown(spark, sf_dir, display.amended_display, F.lit("① (현행과같음)\n② (현행과같음)\n③ 끝 <u>항</u>")).where("id % 3 <> 2")


@_query(f"""with {_PARTS_SQL} select id, '① (현행과같음)' || chr(10) || '② 바 <u>새 ' || h || '</u> 끝' || chr(10) || '  - - - - - -' || chr(10) || '③ (현행과같음)' as new_cell,
  '① 가 <del>' || h || '</del>' || chr(10) || '② (생략)' || chr(10) || '③ (생략)' as old_cell from p""")
def table_cells(spark, sf_dir):
    """F38, K6, F36, F37."""
    new = _join("① 가나다라마 ② 바 <u>새 ", "$h", "</u> 끝\n  1. 하위 줄 ", "$o", "\n③ (현행과같음)")
    old = _join("① 가 <del>", "$h", "</del>\n② 나", "$o", "③ (생략)")
    return _parts(spark, sf_dir).select("id", F.regexp_replace(display.cells(display.new_cell, new), " +\n", "\n").alias("new_cell"), F.regexp_replace(display.cells(display.old_cell, old), " +\n", "\n").alias("old_cell"))


@_query(f"""with {_PARTS_SQL}, n as (select *, h || '원' as old, o || '만' as new from p)
select id, '개정' as side, 1 as block, '①' as symbol, '① 첫 <u>' || new || '</u>' as text from n union all select id, '개정', 2, '②', '② (현행과같음)' from n
union all select id, '개정', 3, '③', '③ 셋 ' || case when form = 0 then '<u>' || new || '</u>' else old end from n where form <> 1 union all select id, '개정', 3, '③', '③ (현행과같음)' from n where form = 1
union all select id, '개정', 4, '④', '④ 넷 <u>' || new || '</u> <u>끝남</u>' from n
union all select id, '현행', 1, '①', '① 첫 <del>' || old || '</del>' from n union all select id, '현행', 2, '②', '② (생략)' from n
union all select id, '현행', 3, '③', case when form = 0 then '③ 셋 <del>' || old || '</del>' else '③ 셋 ' || old end from n union all select id, '현행', 4, '④', '④ 넷 <del>' || old || '</del> <del>끝</del>' from n""")
def applied_changes(spark, sf_dir):
    """F41, A11."""
    rows = _parts(spark, sf_dir).withColumn("old", _join("$h", "원")).withColumn("new", _join("$o", "만"))
    text = lambda *lines: compare.blocks(compare.lines_of(rows.select("id", F.concat_ws("\n", *lines).alias("text"))))
    original = text(_join("① 첫 ", "$old"), F.lit("② 둘"), _join("③ 셋 ", "$old"), _join("④ 넷 ", "$old", " 끝"))
    amended = text(F.lit("① (현행과같음)"), F.lit("② (현행과같음)"), _join("③ 셋 ", "$old"))
    current = text(F.lit("① (생략)"), F.lit("② (생략)"), _join("③ 셋 ", "$old"))
    edit = lambda symbol, seq, old, new, where=F.lit(True): rows.where(where).select("id", F.lit(symbol).alias("symbol"), F.lit(seq).alias("seq"), old.alias("old_text"), new.alias("new_text"))
    old, new = F.col("old"), F.col("new")
    changes = edit("①", 0, old, new).unionByName(edit("③", 1, old, new, F.col("form") == 0)).unionByName(edit("④", 2, old, new)).unionByName(edit("④", 3, F.lit("끝"), F.lit("끝남")))
    unchecked = rows.where("form = 1").select("id", F.lit("③").alias("symbol"))
    sides = {"개정": compare.apply_overrides(compare.apply_changes(amended, changes, original), unchecked), "현행": compare.apply_changes(current, changes, original, struck=True)}
    both = [frame.select("id", F.lit(name).alias("side"), F.col("block").cast("int").alias("block"), "symbol", "text") for name, frame in sides.items()]
    return both[0].unionByName(both[1])
