"""Bounded, repeatable samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 40
#: Bytes of text drawn of a class, and classes that are drawn (the largest).
CLASS_BYTES, CLASSES = 64 << 20, 1000


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``place``, a row's number in the order of drawing, by the hash of id
    and text, and ``bytes``, its text's size (null for a null text).

    Added before labels are joined, they spare the join the texts.
    """
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("sample")), F.lit(_SPACE))
    return docs.withColumn("place", place).withColumn("bytes", F.octet_length(F.col(text_col)).cast("long"))


def class_sample(rows: DataFrame, texts: DataFrame, class_col: str, text_col: str, per_class: int, class_bytes: int = CLASS_BYTES, classes: int = CLASSES) -> tuple[list, dict]:
    """``([(class, text, copies)], {class: rows})`` of labelled rows.

    ``rows`` have the class and :func:`placed`'s columns, ``texts`` the text
    and ``place``; both may be one table.  At most ``per_class`` texts of a
    class and ``class_bytes`` of text are drawn, one at least, in the order of
    ``place``.  Rows that repeat id and text are one text with its number of
    ``copies``, so no number of copies exceeds the bound; other copies are
    drawn like any row.  Null classes and null texts are left out.
    """
    known = rows.where(F.col(class_col).isNotNull() & F.col("bytes").isNotNull()).select(F.col(class_col).alias("class"), "place", "bytes")
    counts = known.groupBy("class").agg(F.count("*").alias("count"), F.approx_count_distinct("place").alias("kinds"))
    counts = counts.orderBy(F.desc("count"), "class").limit(classes).collect()
    sizes = {r[0]: r[1] for r in counts}
    if not sizes:
        return [], sizes
    # Twice the number wanted: the excess over the expectation is never missed.
    likely = F.create_map(*[F.lit(x) for value, _, kinds in counts for x in (value, int((_SPACE - 1) * min(1.0, 2 * per_class / kinds)))])
    found = known.where(F.col("place") <= F.try_element_at(likely, F.col("class"))).groupBy("class", "place").agg(F.count("*").alias("copies"), F.max("bytes").alias("bytes"))
    taken: dict = {}
    chosen: dict = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        count, size = taken.get(r[0], (0, 0))
        if count and (count >= per_class or size + r.bytes > class_bytes):
            taken[r[0]] = (per_class, size)  # here the class's order of places ends
            continue
        taken[r[0]] = (count + 1, size + r.bytes)
        chosen[r[0], r.place] = r.copies
    # At most ``per_class`` numbers of each class.
    wanted = rows.sparkSession.createDataFrame([(x,) for x in sorted({place for _, place in chosen})], "place long")
    drawn = texts.join(F.broadcast(wanted), "place").select("place", F.col(text_col).alias("text")).dropDuplicates(["place"]).collect()
    text_at = {r.place: r.text for r in drawn}
    return [(value, text_at[place], copies) for (value, place), copies in sorted(chosen.items(), key=lambda x: (str(x[0][0]), x[0][1]))], sizes
