"""Corpus pipeline: language, near copies, repeated passages, leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, langid, packing, simhash, substrings
from lexweave.llm.queries import tokenizer_path
from lexweave.llm.runtime import small, stored, written, written_by_spark
from lexweave.llm.sampling import held_out

#: Texts whose 5-word shingles have a Jaccard similarity of 0.8 or more share
#: about 0.9 of their word pairs, so fingerprints of pairs differ in 5 or 6 of
#: 64 bits.  Under several signatures nearly all are at most so many apart in
#: one of them; pairs that are not similar are told apart by their shingles.
NEAR_SHINGLE, NEAR_BITS, NEAR_SIGNATURES = 2, 5, 4
SAME_SHINGLE, SAME_JACCARD = 5, 0.8

#: Less than packing's own, and no tokenizer is kept: executors hold earlier
#: stages' memory here, and other stages follow in the same workers.
CACHE_WORDS, CHUNK_BYTES = 150_000, 2 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects.

    * null texts and texts without a letter go; rows that repeat an id or have
      none are judged apart; very long texts count whole; all columns stay;
    * no rows, or no labelled ones, leave no rows.
    """
    model = langid.fit_centroids(docs.where(~held_out() & F.col("lang").isNotNull()))
    return langid.identified(docs, model).where("not lang_rejected").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Fingerprints propose groups; texts stay in one if they are linked by pairs
    whose 5-word shingles have a Jaccard similarity of 0.8 or more.

    * texts that share an id, or have none, are told apart by their hash; of
      rows that repeat both, one stays; a null id is smaller than any other;
    * null, empty and blank texts are alike: one of them stays;
    * very long texts count whole; all columns stay; no rows give no rows.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    marked = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key", shingle=NEAR_SHINGLE, max_bits=NEAR_BITS, signatures=NEAR_SIGNATURES)
    rows = marked.groupBy(F.col("component.hash").alias("group"), "id").agg(F.count("*").alias("count"))
    firsts = rows.groupBy("group", F.col("id.hash").alias("hash")).agg(F.min(F.struct("id", "count")).alias("first"))
    firsts = written(firsts.select("group", "hash", F.col("first.id.id").alias("id"), F.col("first.id.size").alias("size"), F.col("first.count").alias("count")), "firsts")
    crowded = written(firsts.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    rivals = firsts.join(crowded, "group", "left_semi")
    heads = simhash.similar_heads(rivals, docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text"), SAME_SHINGLE, SAME_JACCARD)
    kept = written(firsts.join(rivals.join(heads, "hash", "left_anti"), "hash", "left_anti").select("id", "hash", "count"), "kept")
    named = rows.select(F.col("id.id").alias("id"), F.col("id.hash").alias("hash"))
    gone = stored(named.join(kept, named.id.eqNullSafe(kept.id) & (named.hash == kept.hash), "left_anti"), "gone")
    dropped = small(gone.frame, gone.rows)
    survivors = docs.join(dropped, docs.doc_id.eqNullSafe(dropped.id) & (F.xxhash64(docs.text) == dropped.hash), "left_anti")
    if kept.where("count > 1").isEmpty():
        return survivors
    return survivors.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words and more that occur elsewhere; a document of
    which nothing is left goes.

    * null and empty texts stay, as empty ones; rows that repeat an id, or have
      none, are told apart and keep their own columns; rows that repeat a text
      of 35 words or more all go;
    * very long texts count whole; ``n_chars`` is that of what is left.
    """
    others = [x for x in docs.columns if x not in ("text", "n_chars")]
    found = substrings.remove_repeats(docs, window=35, others=others).where("n_removed < n_words or n_words = 0")
    kept = found.select(*(F.col(f"others.`{x}`") for x in others), F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"))
    return kept.select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain benchmark passages.

    Null and empty texts stay; rows that repeat an id or have none are judged
    apart; very long texts count whole; an empty benchmark drops nothing.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; one row per piece.

    Null and empty texts are the end id alone; rows that repeat an id, or have
    none, are packed like different documents; very long texts are cut.
    """
    return packing.pack(docs, tokenizer_path(), cache_words=CACHE_WORDS, chunk_bytes=CHUNK_BYTES, keep_tokenizer=False).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", sequences),
]

#: SQL expresses neither the centroids nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written_by_spark(stage(spark, docs, sf_dir), name)
    return docs
