"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import chat, decontaminate, langid, packing, simhash, substrings, topk, toxicity, urls, warc
from lexweave.llm.sampling import held_out

#: Public tokenizer that op4 and the pipeline's packing use.
TOKENIZER = "word_bpe_49k.json"
#: Rules that op3 judges by.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.exchanges(_table(spark, sf_dir, "conversations"))
    linked = chat.link_calls(calls, results, chat.EXCHANGE_SCHEMAS)
    return linked.withColumn("errors", F.concat_ws("; ", "errors"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    model = urls.fit_url_model(urls.labelled_urls(pages, URL_RULES))
    return urls.filter_urls(pages, model, URL_RULES).withColumnRenamed("id", "page_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive_pages(spark, _table(spark, sf_dir, "pages"))
    read = warc.read_archives(manifest).where("kind in ('response', 'revisit')")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=35, texts=False)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_centroids(docs.where(~held_out() & F.col("lang").isNotNull()))
    found = langid.identified(docs.select("doc_id", "text"), model, names=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_tool_calls, op3_url_filter, op4_packing, op5_warc, op6_toxicity, op7_simhash, op8_topk, op9_substrings, op10_language)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

#: DuckDB SQL of the queries that SQL expresses.
ORACLE_SQL: dict[str, str] = {
    "op2_tool_calls": """
with u as (select conv_id, 'turn-' || turn as call_id, count(*) as n_calls,
                  min({'turn': turn, 'name': case when role = 'user' then 'reply' else 'setup' end, 'text': coalesce(text, '')}) as c
           from conversations where role in ('user', 'system') and conv_id is not null and turn is not null group by 1, 2),
o as (select conv_id, call_id, sum(case when gap <= 2 then 0 else 1 end) over (partition by conv_id order by turn) as chain, turn
      from (select conv_id, call_id, c.turn as turn, c.turn - lag(c.turn) over (partition by conv_id order by c.turn) as gap from u)),
l as (select conv_id, call_id, row_number() over (partition by conv_id, chain order by turn) - 1 as level from o),
a as (select conv_id, 'turn-' || (turn - 1) as call_id, count(*) as n_results, min({'turn': turn, 'content': text}) as r
      from conversations where role = 'assistant' and conv_id is not null and turn is not null group by 1, 2)
select conv_id, call_id, c.turn as call_turn, r.turn as result_turn, c.name as name,
       case when c is null then 'orphan' when r is null then 'unanswered' when r.turn < c.turn then 'early' else 'linked' end as status,
       cast(level as integer) as level,
       coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results,
       c is not null and length(c.text) between 1 and 300 and c.turn >= 0 as valid,
       case when c is null then '' else concat_ws('; ', case when length(c.text) not between 1 and 300 then case c.name when 'reply' then '$.prompt: length' else '$.instruction: length' end end, case when c.turn < 0 then '$.turn: range' end) end as errors,
       '{"arguments":' || case when c is null then 'null' else '{"' || case c.name when 'reply' then 'prompt' else 'instruction' end || '":' || cast(to_json(c.text) as varchar) || ',"turn":' || c.turn || '}' end
         || ',"id":' || cast(to_json(call_id) as varchar) || ',"name":' || coalesce('"' || c.name || '"', 'null')
         || ',"result":' || coalesce(cast(to_json(r.content) as varchar), 'null') || '}' as json
from u full join a using (conv_id, call_id) left join l using (conv_id, call_id)
""",
    "op5_warc": """
with p as (select page_id, sha1(encode(coalesce(html, ''))) as hex, octet_length(encode(coalesce(html, ''))) as n from pages),
k as (select hex, max(page_id) as last from p group by hex),
b as (select page_id, n, last, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        cast((cast('0x' || substr(hex, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as integer) + 1]), 'string_agg', '') as digest
      from p join k using (hex))
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when last is null or page_id is not distinct from last then 'response' else 'revisit' end as record_type,
       case when last is null or page_id is not distinct from last then null else last end as refers_to
from b
""",
    "op8_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as x from embeddings
           where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op9_substrings": rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
p as (select r, i, array_to_string(w[i:i+34], ' ') as win from (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
hot as (select win from p group by win having count(*) > 1),
f as (select r, i from p semi join hot using (win)),
gone as (select r, list_sort(list_distinct(flatten(list(range(i, i + 35))))) as g from f group by r),
k as (select doc_id, w, coalesce(len(g), 0) as n_removed,
             list_filter(w, lambda x, j: g is null or not list_contains(g, j)) as kept from d left join gone using (r))
select doc_id, cast(len(w) as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
""",
}
