"""Amendment intent from free text (F32-F35) and ratio propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.refs import SYMBOLS, first_filled, symbol_of
from lexweave.functions.terms import format_manwon, parse_manwon, percent_to_fraction
from lexweave.operators.compare import blocks, lines_of

_NUMBER = r"[0-9,]+(?:\.\d+)?%?|[0-9,]+만원|[0-9,]+원"
# How an outline states an old and a new wording.
PAIRS = (
    r"['\"]([^'\"]+)['\"]\s*을\s*['\"]([^'\"]+)['\"]\s*(?:으로|로)",
    rf"({_NUMBER})\s*을\s*({_NUMBER})\s*(?:으로|로)",
    r"([0-9,]+만원)\s*에서\s*([0-9,]+만원)\s*(?:으로|로)",
    r"현행\s*['\"]?([^'\"\s]+?)['\"]?에서\s*['\"]?([^'\"\s]+?)['\"]?(?:으로|로)",
)
# Verbs of a rise, an amount that rises, items and subitems.
RAISES = "상향|인상|올리|증액|확대|높이|늘리"
RISE = r"([0-9,]+)\s*[→\-]\s*([0-9,]+)\s*만원"
ITEMS = (
    r"제\d+항제(\d+)호(?:제?([가-힣])\.?\s*목)?",
    r"제(\d+)호(?:제?([가-힣])\.?\s*목)?",
    r"(?<!\d)(\d+)호(?:\s*([가-힣])\.?\s*목)?",
)


def target_paragraphs(outline: Column) -> Column:
    """F32: numbers of ``제N항`` and ``N항``, then of marks, each once."""
    numbered = F.regexp_extract_all(outline, F.lit(r"(?<![\d])(\d+)항"), F.lit(1))
    marks = F.filter(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda n: F.when(F.contains(outline, F.substring(F.lit(SYMBOLS), n, F.lit(1))), n.cast("string"))), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(numbered, marks))


def target_item(outline: Column) -> tuple[Column, Column]:
    """(item, subitem)."""
    ho = first_filled(*[F.regexp_extract(outline, f, 1) for f in ITEMS])
    mok = F.lit("")
    for form in reversed(ITEMS):
        mok = F.when(F.regexp_extract(outline, form, 1) != "", F.regexp_extract(outline, form, 2)).otherwise(mok)
    return ho, mok


def stated_pair(outline: Column) -> Column:
    """struct(old, new) of the first form that matches, else null."""
    out = None
    for form in PAIRS:
        hit = outline.rlike(form)
        value = F.struct(F.trim(F.regexp_extract(outline, form, 1)).alias("old"), F.trim(F.regexp_extract(outline, form, 2)).alias("new"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def resolved_pair(pair: Column, body: Column) -> Column:
    """percentages as the body writes them (100분의 N)."""
    old, new = pair["old"], pair["new"]
    f_old, f_new = percent_to_fraction(old), percent_to_fraction(new)
    same = F.contains(body, old)
    new_same = F.when(~F.contains(body, new) & (f_new != ""), f_new).otherwise(new)
    swapped = (f_old != "") & F.contains(body, f_old)
    return F.when(same, F.struct(old.alias("old"), new_same.alias("new"))).when(swapped, F.struct(f_old.alias("old"), F.when(f_new != "", f_new).otherwise(new).alias("new"))).otherwise(pair)


def paragraph_block(body: Column, symbol: Column) -> Column:
    """The text from the paragraph's mark to the next other mark that
    begins a line; a line that repeats the mark goes on with the block."""
    after = F.try_element_at(F.split(body, F.concat(F.lit(r"(?m)^[ \t]*"), symbol), 2), F.lit(2))
    return F.try_element_at(F.split(after, F.concat(F.lit(rf"(?m)^[ \t]*[{SYMBOLS}&&[^"), symbol, F.lit("]]")), 2), F.lit(1))


def parse_intent(outlines: DataFrame) -> DataFrame:
    """``(id, hangs, ho, mok, old_text, new_text, source)`` of
    ``outlines(id, outline, body)``: stated pair, else a raised amount, which
    holds for the first paragraph alone."""
    outline, body = F.col("outline"), F.col("body")
    ho, mok = target_item(outline)
    pair = resolved_pair(stated_pair(outline), body)
    found = F.contains(body, pair["old"]) | (body == "")
    rows = outlines.select("id", "outline", "body", target_paragraphs(outline).alias("hangs"), ho.alias("ho"), mok.alias("mok"), F.when(found, pair).alias("pair"))
    arrow = F.regexp_extract(outline, RISE, 2)
    amount = F.when(arrow != "", F.replace(arrow, F.lit(","), F.lit("")).try_cast("long")).when(F.contains(F.replace(outline, F.lit(" "), F.lit("")), F.lit("천만원")), F.lit(1000).cast("long"))
    symbol = symbol_of(F.try_element_at("hangs", F.lit(1)))
    block = F.when(symbol != "", paragraph_block(body, symbol))
    offers = F.filter(F.regexp_extract_all(block, F.lit("[0-9,]+만원"), F.lit(0)), lambda x: parse_manwon(x) != amount)
    guess = F.when(outline.rlike(RAISES) & (amount > 0), F.struct(F.try_element_at(offers, F.lit(1)).alias("old"), format_manwon(amount).alias("new")))
    rows = rows.withColumn("guess", F.when(guess["old"].isNotNull(), guess))
    source = F.when(F.col("pair").isNotNull(), "regex").when(F.col("guess").isNotNull(), "heuristic").otherwise("none")
    hangs = F.when(source == "heuristic", F.slice("hangs", 1, 1)).otherwise(F.col("hangs"))
    chosen = F.coalesce("pair", "guess")
    return rows.select("id", hangs.alias("hangs"), "ho", "mok", chosen["old"].alias("old_text"), chosen["new"].alias("new_text"), source.alias("source"))


def amendment_level(ho: Column, mok: Column) -> Column:
    """The smallest part that an intent names: subitem, item or paragraph."""
    return F.when(mok != "", "mok").when(ho != "", "ho").otherwise("hang")


def scaled_manwon(amount: Column, ratio: Column) -> Column:
    """an amount times a ratio, with a decimal unless it is whole."""
    value = amount * ratio
    whole = F.abs(value - F.round(value)) < 0.000001
    return F.concat(F.when(whole, F.format_number(F.round(value), 0)).otherwise(F.format_number(value, 1)), F.lit("만원"))


def related_amounts(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """``(id, symbol, amount, proposal, kind)``: what a paragraph's change
    asks of the article's other paragraphs.

    ``articles(id, text)``, ``changes(id, hang, old_text, new_text)``.  A
    paragraph that holds the old wording is a suggestion if it cites the changed
    one, else to review.  Where it cites it and both wordings are amounts, the
    amounts behind the old one (all, if it is not there) follow in proportion.
    """
    each = blocks(lines_of(articles)).where("symbol <> ''").join(changes, "id").where(F.col("symbol") != symbol_of(F.col("hang")))
    cites = F.contains(F.col("text"), F.concat(F.lit("제"), "hang", F.lit("항")))
    at = F.instr(F.col("text"), F.col("old_text"))
    old, new = parse_manwon(F.col("old_text")), parse_manwon(F.col("new_text"))
    scope = F.when(at > 0, F.substring("text", at + F.length("old_text"), F.length("text"))).otherwise(F.col("text"))
    rows = each.select("id", "symbol", "old_text", "new_text", cites.alias("cites"), (at > 0).alias("same"), F.when((old > 0) & (new > 0), new / old).alias("ratio"), scope.alias("scope"))
    stated = rows.where("same").select("id", "symbol", F.col("old_text").alias("amount"), F.col("new_text").alias("proposal"), F.when(F.col("cites"), "suggest").otherwise("review").alias("kind"))
    amounts = rows.where("cites and ratio is not null").select("id", "symbol", "old_text", "ratio", F.explode(F.array_distinct(F.regexp_extract_all("scope", F.lit("[0-9,]+만원"), F.lit(0)))).alias("amount"))
    value = parse_manwon(F.col("amount"))
    scaled = amounts.where((value > 0) & (F.col("amount") != F.col("old_text"))).select("id", "symbol", "amount", scaled_manwon(value, F.col("ratio")).alias("proposal"), F.lit("proportional").alias("kind"))
    return stated.unionByName(scaled.where("proposal <> amount"))
