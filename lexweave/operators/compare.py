"""Old/new comparison: blocks, runs, alignment, masking."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions import fixed_values as V
from lexweave.functions.refs import SYMBOLS, first_symbol
from lexweave.session import attach

MARK = f"[{SYMBOLS}]"


def lines_of(texts: DataFrame) -> DataFrame:
    """``(id, pos, line)`` of ``texts(id, text)``."""
    return texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def blocks(lines: DataFrame, start: str = rf"^\s*({MARK})") -> DataFrame:
    """``(id, block, symbol, text)``: a block at each line that begins
    with a mark; lines before the first are block 0 without symbol."""
    found = F.regexp_extract("line", start, 1)
    order = Window.partitionBy("id").orderBy("pos")
    placed = lines.withColumn("symbol", found).withColumn("block", F.sum(F.when(F.col("symbol") != "", 1).otherwise(0)).over(order))
    return placed.groupBy("id", "block").agg(F.max("symbol").alias("symbol"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))


def items(lines: DataFrame) -> DataFrame:
    """Blocks of items (``3.``, ``3의2.``)."""
    return blocks(lines, r"^\s*(\d+(?:의\d+)?)\.")


def run_label(first: Column, last: Column, size: Column) -> Column:
    """①, ①·② or ①~④."""
    return F.when(size == 1, first).when(size == 2, F.concat(first, F.lit("·"), last)).otherwise(F.concat(first, F.lit("~"), last))


def compress_runs(lines: DataFrame, suffix: str = r"\((?:생략|현행과\s*같음)\)") -> DataFrame:
    """``(id, pos, line)`` with each run of adjacent unchanged lines
    (``① (생략)``) as one line."""
    pattern = rf"^\s*({MARK})\s*({suffix})\s*$"
    order = Window.partitionBy("id").orderBy("pos")
    symbol, kind = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)
    marked = lines.withColumn("symbol", symbol).withColumn("kind", kind)
    apart = (F.col("symbol") == "") | F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True))
    islands = marked.withColumn("island", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    each = islands.groupBy("id", "island").agg(F.min("pos").alias("pos"), F.count("*").alias("size"), F.min_by("symbol", "pos").alias("first"), F.max_by("symbol", "pos").alias("last"), F.min_by("kind", "pos").alias("kind"), F.min_by("line", "pos").alias("line"))
    return each.select("id", "pos", F.when(F.col("first") == "", F.col("line")).otherwise(F.concat(run_label(F.col("first"), F.col("last"), F.col("size")), F.lit(" "), F.col("kind"))).alias("line"))


def compress_pairs(pairs: DataFrame) -> DataFrame:
    """``(id, pos, left, right)`` with each run of adjacent unchanged pairs
    as one; runs without paragraph marks stay as they are."""
    same = F.contains("right", F.lit("(현행과같음)")) & ~F.contains("right", F.lit("<u>")) & F.contains("left", F.lit("(생략)")) & ~F.contains("left", F.lit("<del>"))
    order = Window.partitionBy("id").orderBy("pos")
    marked = pairs.withColumn("same", same).withColumn("symbol", first_symbol(F.col("left")))
    apart = ~F.col("same") | ~F.coalesce(F.lag("same").over(order), F.lit(False))
    islands = marked.withColumn("island", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    has = F.max(F.when(F.col("symbol") != "", 1).otherwise(0)).over(Window.partitionBy("id", "island"))
    runs = islands.withColumn("run", F.when(F.col("same") & (has == 1), F.lit(-1)).otherwise(F.col("pos")))
    # Of a run only the rows with a mark count; rows that stay are groups of their own.
    at = F.when((F.col("run") != -1) | (F.col("symbol") != ""), F.col("pos"))
    each = runs.groupBy("id", "island", "run").agg(F.min("pos").alias("pos"), F.count(F.when(F.col("symbol") != "", 1)).alias("size"), F.min_by("symbol", at).alias("first"), F.max_by("symbol", at).alias("last"), F.min_by("left", "pos").alias("left"), F.min_by("right", "pos").alias("right"))
    label = run_label(F.col("first"), F.col("last"), F.col("size"))
    word = lambda side, text: F.when(F.col("run") == -1, F.concat(label, F.lit(f" {text}"))).otherwise(F.col(side))
    return each.select("id", "pos", word("left", "(생략)").alias("left"), word("right", "(현행과같음)").alias("right"))


def draft_sections(drafts: DataFrame, names=V.DRAFT_SECTIONS) -> DataFrame:
    """``(id, <a column for each name>)`` of ``drafts(id, text)``.

    A line ``===SECTION:name===`` opens a section; the last of a name counts,
    unless it is the draft's last and has no line; unknown names are ignored.
    A draft without such lines is split at the sections' key words instead,
    and tags in its instruction become quotation marks.
    """
    line = F.trim("line")
    named = F.regexp_extract(line, "^===SECTION:([가-힣]+)===", 1)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(F.col("line"), F.lit(w)) for w in words])
    word = F.when(has("개정지시문") | (has("1.") & has("지시문")), "지시문").when(has("[현행]"), "현행").when(has("[개정안]"), "개정안").when(has("부칙") & ~has("적용례", "===", "유형"), "부칙").when(has("연관 항 검토", "연관항 검토"), "연관항").otherwise("")
    rows = drafts.select("id", F.posexplode(F.split("text", "\r\n|\n")).alias("pos", "line"))
    whole = Window.partitionBy("id")
    rows = rows.withColumn("named", named).withColumn("marked", F.max(F.when(named != "", 1).otherwise(0)).over(whole) == 1)
    rows = rows.withColumn("opens", F.when(F.col("marked"), F.col("named")).otherwise(word))
    rows = rows.withColumn("part", F.sum(F.when(F.col("opens") != "", 1).otherwise(0)).over(whole.orderBy("pos"))).withColumn("parts", F.max("part").over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("opens") == "", F.struct("pos", "line")))), lambda x: x.line), "\n")
    parts = rows.where("part > 0").groupBy("id", "marked", "part", "parts").agg(F.max("opens").alias("name"), F.count("*").alias("n"), F.regexp_replace(content, r"(?U)^\s+|\s+$", "").alias("text"))
    last = parts.where("part < parts or n > 1").groupBy("id", "marked", "name").agg(F.max_by("text", "part").alias("text"))
    quoted = F.regexp_replace("text", "(?s)<(del|u)>(.*?)</\\1>", '"$2"')
    last = last.withColumn("text", F.when(~F.col("marked") & (F.col("name") == names[0]), quoted).otherwise(F.col("text")))
    wide = last.groupBy("id").agg(*[F.max(F.when(F.col("name") == x, F.col("text"))).alias(x) for x in names])
    return drafts.select("id").join(wide, "id", "left").select("id", *[F.coalesce(x, F.lit("")).alias(x) for x in names])


def one_per_symbol(chunks: DataFrame) -> DataFrame:
    """A10: each symbol's first block, or its first marked-up one if the first
    has no markup, at the first one's place."""
    markup = F.col("text").rlike("<(u|del)>")
    window = Window.partitionBy("id", "symbol")
    chosen = F.row_number().over(window.orderBy(F.when(markup, 0).otherwise(1), "block"))
    return chunks.withColumn("place", F.min("block").over(window)).withColumn("n", chosen).where("n = 1 or symbol = ''").select("id", F.when(F.col("symbol") == "", F.col("block")).otherwise(F.col("place")).alias("block"), "symbol", "text")


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, symbol, left, right)``: full outer alignment of blocks by
    symbol; header blocks align by position."""
    left = one_per_symbol(old).where("text <> ''").select("id", "symbol", F.when(F.col("symbol") == "", F.col("block")).otherwise(-1).alias("head"), F.col("text").alias("l"))
    right = one_per_symbol(new).where("text <> ''").select("id", "symbol", F.when(F.col("symbol") == "", F.col("block")).otherwise(-1).alias("head"), F.col("text").alias("r"))
    both = left.join(right, ["id", "symbol", "head"], "full")
    same = F.when(F.col("symbol") != "", F.concat(F.col("symbol"), F.lit("(현행과같음)"))).otherwise("")
    return both.select("id", "symbol", F.when(F.col("symbol") == "", 0).otherwise(F.instr(F.lit(SYMBOLS), F.col("symbol"))).alias("place"), F.coalesce("l", F.lit("")).alias("left"), F.coalesce("r", same).alias("right"))


def changed_paragraphs(lines: DataFrame) -> DataFrame:
    """Blocks whose lines are marked as new, the first one flagged."""
    found = blocks(lines).where(F.contains("text", F.lit("<u>")))
    return found.withColumn("first", F.row_number().over(Window.partitionBy("id").orderBy("block")) == 1)


def runs_of(text: Column) -> Column:
    """array<struct(kind, text)> of plain, del and u runs."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)<del>.*?</del>|<u>.*?</u>|(?:(?!<del>|<u>).)+"), F.lit(0))
    kind = lambda p: F.when(p.startswith("<del>"), "del").when(p.startswith("<u>"), "u").otherwise("plain")
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("kind"), F.regexp_replace(p, "</?(del|u)>", "").alias("text")))


_WIDE = re.compile("[ᄀ-ᇿ⺀-鿿가-힣豈-﫿！-｠]")


def dashes(text: str) -> str:
    """at least three dashes, half as many as the text is wide, between its
    outer blanks; texts of under two characters stay."""
    inner = text.strip()
    if len(inner) < 2:
        return text
    count = max(3, (len(inner) + len(_WIDE.findall(inner))) // 2)
    return text[: len(text) - len(text.lstrip())] + ("- " * count).rstrip() + text[len(text.rstrip()) :]


def mask_line(line: str) -> str:
    """what isn't new becomes dashes; the paragraph mark and the parts of
    a word that touch new text stay, unless they are particles or signs."""
    line = re.sub(r"(?s)<del>.*?</del>", "", line)
    if "<u>" not in line:
        return line
    tokens = re.split(r"(?s)(<u>.*?</u>)", line)
    for k in range(0, len(tokens), 2):  # plain text is at even places
        rest, keep_left, keep_right = tokens[k], "", ""
        if k == 0 and (m := re.match(rf"\s*{MARK}", rest)):
            keep_left, rest = m.group(0), rest[m.end() :]
        elif k and (m := re.match(r"\S+", rest)) and m.group(0) not in V.PARTICLES and m.group(0)[0].isalnum():
            keep_left, rest = m.group(0), rest[m.end() :]
        if k + 1 < len(tokens) and (m := re.search(r"\S+$", rest)):
            keep_right, rest = m.group(0), rest[: m.start()]
        tokens[k] = keep_left + (dashes(rest) if rest else "") + keep_right
    return "".join(tokens)


def _mask_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else "\n".join(mask_line(x) for x in text.split("\n")))


def mask_lines(text: Column | str) -> Column:
    """F37 for each line of a text, in Arrow batches."""
    attach(SparkSession.active())
    return F.pandas_udf(_mask_texts, T.StringType())(text)


def apply_changes(texts: DataFrame, changes: DataFrame, originals: DataFrame, struck: bool = False) -> DataFrame:
    """Blocks ``(id, block, symbol, text)`` with the accepted
    ``changes(id, symbol, seq, old_text, new_text)``, each symbol's in order.

    In an amended text new wordings are marked, in a paragraph that only says
    that it is unchanged those of the original; with ``struck``, old wordings
    of the original are struck out.  Paragraphs that the text lacks follow it.

    All sides grow with the texts and compress well, so that Spark takes them
    for small ones: the joins are merged, none is broadcast.
    """
    lists = changes.groupBy("id", "symbol").agg(F.array_sort(F.collect_list(F.struct("seq", "old_text", "new_text"))).alias("edits"))
    own = originals.where("symbol <> ''").groupBy("id", "symbol").agg(F.max_by("text", "block").alias("original"))
    marked = lambda e: F.concat(F.lit("<del>"), e.old_text, F.lit("</del>")) if struck else F.concat(F.lit("<u>"), e.new_text, F.lit("</u>"))
    edited = lambda base: F.aggregate("edits", base, lambda acc, e: F.replace(acc, e.old_text, marked(e)))
    joined = texts.join(lists.hint("merge"), ["id", "symbol"], "left").join(own.hint("merge"), ["id", "symbol"], "left")
    taken = F.lit(True) if struck else F.contains("text", F.lit("(현행과같음)"))
    base = F.when(taken, F.coalesce("original", "text")).otherwise(F.col("text"))
    kept = joined.select("id", "block", "symbol", F.when(F.col("edits").isNull(), F.col("text")).otherwise(edited(base)).alias("text"))
    lacking = lists.join(texts.select("id", "symbol").hint("merge"), ["id", "symbol"], "left_anti").join(own.hint("merge"), ["id", "symbol"])
    last = texts.groupBy("id").agg(F.max("block").alias("last"))
    order = Window.partitionBy("id").orderBy(F.col("edits")[0].seq, "symbol")
    added = lacking.join(last.hint("merge"), "id").withColumn("block", F.col("last") + F.row_number().over(order))
    return kept.unionByName(added.select("id", F.col("block").cast(texts.schema["block"].dataType).alias("block"), "symbol", edited(F.col("original")).alias("text")))


def apply_overrides(texts: DataFrame, unchecked: DataFrame) -> DataFrame:
    """blocks of the ``unchecked(id, symbol)`` paragraphs are unchanged ones."""
    marked = unchecked.where("symbol <> ''").select("id", "symbol", F.lit(True).alias("off")).distinct()
    same = F.concat("symbol", F.lit(" (현행과같음)"))
    return texts.join(marked.hint("merge"), ["id", "symbol"], "left").select("id", "block", "symbol", F.when(F.col("off"), same).otherwise(F.col("text")).alias("text"))
