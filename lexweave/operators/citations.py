"""Citation extraction (G1): full nine-pass parser and native direct form.

The parser resolves overlaps: passes run from the most to the least specific
form and each claims spans of the text.  It runs over Arrow batches, one row
in, one row per citation out.  Single-form queries use the native variant.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexweave.functions.refs import DIRECT, cited_ref, format_ref, law_url
from lexweave.session import attach

_TAIL = r"제(\d+)조(?:의(\d+))?(?:제(\d+)항)?(?:제(\d+)호)?(?:제(\d+)목)?"
# The citation forms of statutes.
FORMS = {
    "cross": r"「([^」]+)」\s*" + _TAIL,
    "named": r"([가-힣][가-힣\sㆍ·]{1,40}(?:법률|법|영|령|규칙))\s*" + _TAIL,
    "same_law": r"(같은\s*(?:법|령|영|규칙))\s*" + _TAIL,
    "same_article": r"(같은\s*조)\s*(?:제(\d+)항)?(?:제(\d+)호)?(?:제(\d+)목)?",
    "article_range": r"제(\d+)조(?:의(\d+))?(?:부터|에서)\s*제(\d+)조(?:의(\d+))?까지",
    "unit_range": r"제(\d+)(항|호|목)(?:부터|에서)\s*제(\d+)(항|호|목)까지",
    "paragraph_range": r"제(\d+)조(?:의(\d+))?제(\d+)항\s*(?:부터|에서)\s*제(\d+)항까지",
    "direct": _TAIL,
    "intra": r"제(\d+)(항|호|목)(?!까지)",
}
_COMPILED = {name: re.compile(pattern) for name, pattern in FORMS.items()}

CITATION = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("raw", "law_name", "jo", "jo_sub", "hang", "hang_end", "ho", "mok", "relative")]
    + [T.StructField("is_range", T.BooleanType()), T.StructField("range_end_jo", T.StringType()), T.StructField("range_end_jo_sub", T.StringType()), T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType())]
)


@dataclass(frozen=True)
class Found:
    raw: str
    start: int
    end: int
    law_name: str = ""
    jo: str = ""
    jo_sub: str = ""
    hang: str = ""
    hang_end: str = ""
    ho: str = ""
    mok: str = ""
    relative: str = ""
    is_range: bool = False
    range_end_jo: str = ""
    range_end_jo_sub: str = ""


def _fields(form: str, m: re.Match) -> dict | None:
    """The citation's fields from a match of one form; None refuses it."""
    g = [x or "" for x in m.groups()]
    if form in ("cross", "named", "same_law"):
        law = re.sub(r"\s+", "", g[0]) if form == "same_law" else g[0].strip()
        if form == "named" and "같은" in law:
            return None
        return dict(law_name=law, jo=g[1], jo_sub=g[2], hang=g[3], ho=g[4], mok=g[5], relative="같은법" if form == "same_law" else "")
    if form == "same_article":
        return dict(hang=g[1], ho=g[2], mok=g[3], relative="같은조")
    if form == "article_range":
        return dict(jo=g[0], jo_sub=g[1], is_range=True, range_end_jo=g[2], range_end_jo_sub=g[3])
    if form == "unit_range":
        unit = {"항": "hang", "호": "ho", "목": "mok"}[g[1]]
        return {unit: g[0], "is_range": True} | ({"hang_end": g[2]} if g[1] == "항" else {})
    if form == "paragraph_range":
        return dict(jo=g[0], jo_sub=g[1], hang=g[2], hang_end=g[3], is_range=True)
    if form == "direct":
        return dict(jo=g[0], jo_sub=g[1], hang=g[2], ho=g[3], mok=g[4])
    if "조" in m.string[max(0, m.start() - 3) : m.start()]:
        return None
    return {{"항": "hang", "호": "ho", "목": "mok"}[g[1]]: g[0]}


class _Claims:
    """Spans that citations have taken, for exact and containment tests.

    Of the spans, those that no other contains are kept, by start: their ends
    rise too, so a span is contained if the last one that starts at or before
    it ends at or behind it.
    """

    def __init__(self):
        self._exact: set[tuple[int, int]] = set()
        self._starts: list[int] = []
        self._ends: list[int] = []

    def taken(self, start: int, end: int, exact_only: bool) -> bool:
        if exact_only:
            return (start, end) in self._exact
        k = bisect_right(self._starts, start)
        return k > 0 and self._ends[k - 1] >= end

    def add(self, start: int, end: int) -> None:
        self._exact.add((start, end))
        if self.taken(start, end, False):
            return
        first = bisect_left(self._starts, start)
        last = bisect_right(self._ends, end)
        self._starts[first : max(first, last)] = [start]
        self._ends[first : max(first, last)] = [end]


def _resolve(found: list[Found], text: str) -> list[Found]:
    """같은 법 and 같은 조 from the citations before them in the sentence."""
    out: list[Found] = []
    for c in found:
        if c.relative:
            begin = max((text.rfind(mark, 0, c.start) for mark in ".?!\n;"), default=-1) + 1
            before = [p for p in out if p.start >= begin and p.end <= c.start]
            if c.relative == "같은조":
                last = next((p for p in reversed(before) if p.jo), None)
                c = replace(c, jo=last.jo, jo_sub=last.jo_sub, law_name=last.law_name) if last else c
            else:
                last = next((p for p in reversed(before) if p.law_name and not p.relative), None)
                c = replace(c, law_name=last.law_name) if last else c
        out.append(c)
    return out


def parse(text: str | None) -> list[Found]:
    """All citations of a text, by start."""
    text = text or ""
    claims, found = _Claims(), []
    for form, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            if claims.taken(m.start(), m.end(), form in ("cross", "article_range")):
                continue
            fields = _fields(form, m)
            if fields is None:
                continue
            claims.add(m.start(), m.end())
            found.append(Found(m.group(0), m.start(), m.end(), **fields))
    return _resolve(sorted(found, key=lambda c: c.start), text)


def extract(articles: DataFrame, body: str = "body") -> DataFrame:
    """One row per citation: the input's columns but the body, and CITATION."""
    attach(articles.sparkSession)
    kept = [c for c in articles.columns if c != body]
    schema = T.StructType([articles.schema[c] for c in kept] + CITATION.fields)
    names = {"span_start": "start", "span_end": "end"}
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = [parse(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            take = pa.array([k for k, citations in enumerate(found) for _ in citations], pa.int64())
            own = [pa.array([getattr(c, names.get(f.name, f.name)) for citations in found for c in citations], f.type) for f in list(target)[len(kept) :]]
            yield pa.record_batch([*(x.take(take) for x in batch.columns[:-1]), *own], names=target.names)

    return articles.select(*kept, body).mapInArrow(run, schema)


def citation_table(citations: DataFrame, current_law: str) -> DataFrame:
    """``(id, pos, ref, raw, law, ranged, url)`` of the citations with an
    article in amended texts ``(id, pos, …CITATION)``: each law and part once, the
    first; a blank law, or one that begins with 같은, is the current one."""
    parts = ["law_name", "jo", "jo_sub", "hang", "ho", "mok"]
    order = Window.partitionBy("id", *parts).orderBy("pos", "raw")
    first = citations.where("jo <> ''").withColumn("n", F.row_number().over(order)).where("n = 1")
    law = F.when((F.col("law_name") == "") | F.col("law_name").startswith("같은"), F.lit(current_law)).otherwise(F.col("law_name"))
    ref = cited_ref(*[F.col(x) for x in parts[1:]], F.col("raw"))
    url = F.concat(law_url(law), F.lit("/"), format_ref(F.col("jo"), F.col("jo_sub")))
    return first.select("id", "pos", ref.alias("ref"), "raw", law.alias("law"), F.col("is_range").alias("ranged"), url.alias("url"))


def direct_citations(articles: DataFrame, body: str = "body") -> DataFrame:
    """Pass 5 alone, native: (…, pos, raw, jo, jo_sub, hang, ho)."""
    groups = {"raw": 0, "jo": 1, "jo_sub": 2, "hang": 3, "ho": 4}
    zipped = F.arrays_zip(*[F.regexp_extract_all(F.col(body), F.lit(DIRECT), F.lit(g)).alias(n) for n, g in groups.items()])
    kept = [c for c in articles.columns if c != body]
    return articles.select(*kept, F.posexplode(zipped).alias("pos", "c")).select(*kept, "pos", *[F.col("c")[n].alias(n) for n in groups])


def intra_citations(articles: DataFrame, body: str = "body") -> DataFrame:
    """Pass 6 alone, native: units (항, 호, 목) without 까지 behind them and
    without 조 in the three characters before."""
    pattern = r"(조.{0,2})?제(\d+)(항|호|목)(까지)?"
    groups = {"near": 1, "number": 2, "unit": 3, "upto": 4}
    zipped = F.arrays_zip(*[F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()])
    kept = [c for c in articles.columns if c != body]
    rows = articles.select(*kept, F.posexplode(zipped).alias("pos", "c"))
    return rows.where("c.near = '' and c.upto = ''").select(*kept, "pos", F.col("c.number").alias("number"), F.col("c.unit").alias("unit"))
