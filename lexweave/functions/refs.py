"""Reference-string algebra (F1-F11) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paragraph marks and reference forms of statutes.
SYMBOLS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
ARTICLE = r"제(?:(\d+)의(\d+)조|(\d+)조(?:의(\d+))?)"
PARTS = ARTICLE + r"(?:제(\d+)항)?(?:제(\d+)호)?"
#: A direct citation: article, branch, paragraph, item, subitem.
DIRECT = r"제(\d+)조(?:의(\d+))?(?:제(\d+)항)?(?:제(\d+)호)?(?:제(\d+)목)?"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_filled(*options: Column) -> Column:
    """The first option that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in options], F.lit(""))


def _group(text: Column, pattern: str, *groups: int) -> Column:
    return first_filled(*[F.regexp_extract(text, pattern, g) for g in groups])


def parse_article(text: Column) -> Column:
    """struct(jo, sub) of the first reference; also ``27조`` and ``27의2``."""
    jo = first_filled(_group(text, ARTICLE, 1, 3), F.regexp_extract(text, r"(\d+)조", 1), F.regexp_extract(text, r"^\s*(\d+)(?:의\d+)?\s*$", 1))
    sub = F.when(F.regexp_extract(text, ARTICLE, 0) != "", _group(text, ARTICLE, 2, 4)).otherwise(first_filled(F.regexp_extract(text, r"\d+조의(\d+)", 1), F.regexp_extract(text, r"^\s*\d+의(\d+)\s*$", 1)))
    return F.when(jo != "", F.struct(jo.alias("jo"), sub.alias("sub")))


def parse_parts(text: Column) -> Column:
    """struct(jo, sub, hang, ho) of the first reference, else null."""
    parts = [_group(text, PARTS, 1, 3), _group(text, PARTS, 2, 4), F.regexp_extract(text, PARTS, 5), F.regexp_extract(text, PARTS, 6)]
    return F.when(parts[0] != "", F.struct(*[x.alias(n) for x, n in zip(parts, ("jo", "sub", "hang", "ho"), strict=True)]))


def _marked(prefix: str, value: Column, suffix: str) -> Column:
    value = F.coalesce(value, F.lit(""))
    return F.when(value != "", F.concat(F.lit(prefix), value, F.lit(suffix))).otherwise("")


def format_ref(jo: Column, sub: Column, hang: Column | None = None, ho: Column | None = None) -> Column:
    """제…조의…제…항제…호; empty parts are left out."""
    pieces = [_marked("제", jo, "조"), _marked("의", sub, "")]
    pieces += [_marked("제", hang, "항")] if hang is not None else []
    pieces += [_marked("제", ho, "호")] if ho is not None else []
    return F.concat(*pieces)


def ranged_ref(jo: Column, sub: Column, hang: Column, hang_end: Column, ho: Column, mok: Column, end_jo: Column, end_sub: Column) -> Column:
    """with the ends of paragraph and article ranges: 제27조제1항~제3항."""
    until = F.when(F.coalesce(hang, F.lit("")) != "", _marked("~제", hang_end, "항")).otherwise("")
    upto = F.when(F.coalesce(end_jo, F.lit("")) != "", F.concat(F.lit("~"), format_ref(end_jo, end_sub))).otherwise("")
    return F.concat(format_ref(jo, sub, hang), until, _marked("제", ho, "호"), _marked("제", mok, "목"), upto)


def cited_ref(jo: Column, sub: Column, hang: Column, ho: Column, mok: Column, raw: Column) -> Column:
    """as far as it is known, else the text itself."""
    known = F.concat(F.when(jo != "", format_ref(jo, sub)).otherwise(""), _marked("제", hang, "항"), _marked("제", ho, "호"), _marked("제", mok, "목"))
    return first_filled(known, raw)


def heading(jo_no: Column, title: Column) -> Column:
    """``제27조의2(제목)`` of an article number like 27의2."""
    parsed = parse_article(jo_no)
    label = F.coalesce(format_ref(parsed["jo"], parsed["sub"]), jo_no)
    return F.concat(label, _marked("(", stripped(title), ")"))


def headed_text(jo_no: Column, title: Column, body: Column) -> Column:
    """the body, under its heading unless its first line has a reference."""
    text = stripped(body)
    has = parse_article(F.substring_index(text, "\n", 1)).isNotNull()
    return F.when(has, text).otherwise(stripped(F.concat(heading(jo_no, title), F.lit("\n"), text)))


def article_stub(ref: Column, text: Column) -> Column:
    """struct(jo_no, title) from a reference, else from the first line."""
    line = F.substring_index(text, "\n", 1)
    parsed = F.coalesce(parse_article(ref), parse_article(line))
    jo_no = F.coalesce(F.concat(parsed["jo"], _marked("의", parsed["sub"], "")), F.lit(""))
    return F.struct(jo_no.alias("jo_no"), stripped(F.regexp_extract(line, r"\(([^()]*)\)", 1)).alias("title"))


def first_symbol(text: Column) -> Column:
    """the paragraph mark that a chunk begins with, else empty."""
    return F.regexp_extract(text, rf"^\s*([{SYMBOLS}])", 1)


def amendment_title(law: Column) -> Column:
    """acts are amended by an act, decrees and rules by a decree."""
    decree = F.contains(law, F.lit("시행령")) | F.contains(law, F.lit("시행규칙"))
    return F.concat(law, F.when(decree, " 일부개정령(안)").otherwise(" 일부개정법률(안)"))


def normalize_ref(text: Column, law: Column | None = None) -> Column:
    """without the law's name; ``제N의M조`` as ``제N조의M``."""
    bare = F.trim(F.when(text.startswith(law), F.substring(text, F.length(law) + 1, F.length(text))).otherwise(text)) if law is not None else F.trim(text)
    return F.regexp_replace(bare, r"제(\d+)의(\d+)조", "제$1조의$2")


def ref_of_text(text: Column) -> Column:
    """the first reference of the first line, else of the whole text."""
    return F.coalesce(parse_parts(F.substring_index(text, "\n", 1)), parse_parts(text))


def lookup_keys(jo: Column, sub: Column, hang: Column, ho: Column) -> Column:
    """Keys of a reference, most specific first: 27의2h3o1, 27의2h3, 27의2."""
    base = F.concat(jo, _marked("의", sub, ""))
    by_hang = F.when(hang != "", F.concat(base, F.lit("h"), hang))
    by_ho = F.when((hang != "") & (ho != ""), F.concat(base, F.lit("h"), hang, F.lit("o"), ho))
    return F.array_compact(F.array(by_ho, by_hang, F.when(jo != "", base)))


def law_url(law: Column) -> Column:
    """F7."""
    return F.concat(F.lit("https://www.law.go.kr/법령/"), F.replace(law, F.lit(" "), F.lit("")))


def label_parts(label: Column) -> Column:
    """F8: struct(law, ref); the law without its decree suffix, the reference
    without a branch after 조."""
    laws = r"^(소득세법|법인세법|부가가치세법|조세특례제한법)(?:\s*시행령|\s*시행규칙)?\s+"
    ref = r"(제\d+(?:의\d+)?조(?:제\d+항)?(?:제\d+호)?)"
    text = F.trim(label)
    law = F.regexp_extract(text, laws + ref, 1)
    return F.struct(law.alias("law"), F.when(law != "", F.regexp_extract(text, laws + ref, 2)).otherwise(F.regexp_extract(text, "^" + ref, 1)).alias("ref"))


def candidate_id(law: Column, ref: Column, source: Column, symbol: Column) -> Column:
    """F9."""
    return F.concat_ws("|", law, ref, source, symbol)


def symbol_of(number: Column) -> Column:
    """①-⑳ for 1-20, else empty."""
    n = F.regexp_extract(number, r"^(\d{1,2})$", 1).try_cast("int")
    return F.when(n.between(1, 20), F.substring(F.lit(SYMBOLS), n, F.lit(1))).otherwise("")


def normalize_law(name: Column) -> Column:
    """without blanks and middle dots."""
    return F.trim(F.translate(name, " ㆍ·", ""))


def law_pronoun(name: Column) -> Column:
    """F14."""
    return F.when(F.contains(name, F.lit("시행규칙")), "이 규칙").when(F.contains(name, F.lit("시행령")), "이 영").otherwise("이 법")
