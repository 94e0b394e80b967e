"""Terms, titles, scrubbing, relation types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import fixed_values as V


def strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def canonical_law(name: Column, keywords=V.TAX_LAW_KEYWORDS) -> Column:
    """the first keyword the name contains, in the table's order, with
    its decree or rule suffix if the keyword names an act."""
    bare = F.regexp_replace(name, r"\s+", "")
    out = None
    for key in keywords:
        value = F.lit(key) if "법" not in key else F.when(F.contains(bare, F.lit("시행규칙")), f"{key} 시행규칙").when(F.contains(bare, F.lit("시행령")), f"{key} 시행령").otherwise(key)
        test = F.contains(bare, F.lit(key))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(bare)


def is_tax_law(name: Column, keywords=V.TAX_LAW_KEYWORDS) -> Column:
    return F.exists(strings(keywords), lambda k: F.contains(F.regexp_replace(name, r"\s+", ""), k))


def article_title(text: Column) -> Column:
    """the first parenthesised text of two characters or more on line 1."""
    return F.trim(F.regexp_extract(F.substring_index(F.trim(text), "\n", 1), "[（(]([^）)]{2,})[）)]", 1))


def canonical_text(text: Column, pairs=V.TAX_PAIR_REPLACEMENTS) -> Column:
    """F16: blanks removed, replacements applied longest first."""
    ordered = sorted(pairs, key=lambda pair: -len(pair[0]))
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), ordered, F.regexp_replace(text, r"\s+", ""))


def topic_terms(text: Column, terms=V.TOPIC_TERMS) -> Column:
    """F17."""
    canon = canonical_text(text)
    return F.filter(strings(terms), lambda t: F.contains(canon, t))


def generic_terms() -> Column:
    """Synonyms and their keys without the core terms."""
    keys = [k for k, _ in V.KEYWORD_SYNONYMS]
    values = [x for _, xs in V.KEYWORD_SYNONYMS for x in xs]
    return F.array_except(F.array_union(strings(keys), strings(values)), strings(V.CORE_TERMS))


def expand_keywords(words: Column, synonyms=V.KEYWORD_SYNONYMS) -> Column:
    """each word, its synonyms, then compounds with a synonym put in."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), strings(v).alias("v")) for k, v in synonyms])
    own = lambda w: F.flatten(F.transform(F.filter(table, lambda s: s.k == w), lambda s: s.v))
    compound = lambda w: F.flatten(F.transform(F.filter(table, lambda s: (s.k != w) & F.contains(w, s.k)), lambda s: F.transform(s.v, lambda v: F.replace(w, s.k, v))))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), own(w), compound(w)))))


def text_variants(text: Column, synonyms=V.PHRASE_SYNONYMS) -> Column:
    """the blank-free text and its phrase-synonym variants, each once."""
    bare = F.regexp_replace(text, r"\s+", "")
    pairs = [(k, v) for k, vs in synonyms for v in vs]
    table = F.array(*[F.struct(F.lit(k).alias("old"), F.lit(v).alias("new")) for k, v in pairs])
    return F.aggregate(table, F.array(bare), lambda acc, p: F.array_distinct(F.concat(acc, F.transform(acc, lambda x: F.replace(x, p.old, p.new)))))


def relation_type(law: Column, ref: Column, reason: Column, explicit: Column) -> Column:
    """a valid explicit type, else the first rule whose keyword occurs."""
    text = F.concat_ws(" ", law, ref, reason)
    out = F.when(explicit.isin(*[k for k, _ in V.RELATION_LABELS]), explicit)
    for name, words in V.RELATION_KEYWORDS:
        out = out.when(F.exists(strings(words), lambda w: F.contains(text, w)), name)
    decree = F.contains(law, F.lit("시행령")) & F.contains(reason, F.lit("법")) & ~F.contains(F.substring_index(F.trim(reason), " ", 1), F.lit("시행령"))
    return out.when(decree, "law_to_decree").otherwise("")


def relation_label(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.RELATION_LABELS for x in pair])
    return F.coalesce(F.try_element_at(table, kind), kind)


def scrub_html(text: Column) -> Column:
    """download images become [alt] (or [표]), other tags go."""
    images = F.regexp_replace(text, r'(?is)<img[^>]*flDownload[^>]*alt="([^"]+)"[^>]*>', "[$1]")
    images = F.regexp_replace(images, r"(?is)<img[^>]*flDownload[^>]*>", "[표]")
    return F.regexp_replace(F.regexp_replace(images, "<[^>]+>", ""), r"(?U)^\s+|\s+$", "")


def split_inline_paragraph(text: Column) -> Column:
    """the first paragraph mark behind an article's number begins a line,
    where the line does not begin with one."""
    return F.regexp_replace(text, r"(?m)^(?![ \t]*[①-⑳])(.*?제\d+조(?:의\d+)?[^①-⑳\n]*?)[ \t]*([①-⑳])", "$1\n$2")


def lines_before_marks(text: Column) -> Column:
    """a line for every paragraph mark that doesn't follow a line or ∼."""
    return F.regexp_replace(F.regexp_replace(text, "(?<![\n∼~])([①-⑳])", "\n$1"), "^\n+", "")


def visual_width(text: Column) -> Column:
    """Hangul and CJK characters are two wide."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^ᄀ-ᇿ⺀-鿿가-힣豈-﫿！-｠]", ""))


def percent_to_fraction(text: Column) -> Column:
    """``3%`` as ``100분의 3``, whole numbers only, else empty."""
    n = F.regexp_extract(F.trim(text), r"^(\d+)(?:\.0+)?%$", 1)
    return F.when(n != "", F.concat(F.lit("100분의 "), n)).otherwise("")


def parse_manwon(text: Column) -> Column:
    """``1,000만원`` as a number, else null."""
    return F.regexp_extract(F.regexp_replace(text, "[, ]", ""), r"^(\d+)만원$", 1).try_cast("long")


def format_manwon(value: Column) -> Column:
    return F.concat(F.format_number(value, 0), F.lit("만원"))


def core_terms(text: Column) -> Column:
    """The core terms that a text holds, blanks aside, in the table's order."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    return F.filter(strings(V.CORE_TERMS), lambda t: F.contains(bare, t))
