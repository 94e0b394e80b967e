"""Displays, parsing, lookups, caches and streams on fixtures."""

import json
import random

from pyspark.sql import functions as F

from lexweave.operators import citations, display, parallel
from lexweave.sources import statutes
from lexweave.sources.cache import TableCache
from lexweave.streaming import freshness as stream


class _Plain:
    """Every accepted span, each compared."""

    def __init__(self):
        self.spans = []

    def taken(self, start, end, exact_only):
        return any((a, b) == (start, end) if exact_only else a <= start and end <= b for a, b in self.spans)

    def add(self, start, end):
        self.spans.append((start, end))


def test_claims_against_all_spans(monkeypatch):
    rng = random.Random(7)
    pieces = ["「소득세법」 ", "제20조", "제20조의2", "부터 ", "제25조까지", "제1항", "제3호", "제2목", " 및 ", "같은 법 ", "같은 조 ", ". ", "\n", "법인세법 ", "까지", "에서 ", "가나다 ", "「" + "긴" * 500 + "법」 "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(400)]
    found = [citations.parse(x) for x in texts]
    monkeypatch.setattr(citations, "_Claims", _Plain)
    assert found == [citations.parse(x) for x in texts] and sum(map(len, found)) > 1000


def test_long_law_names_contain_citations():
    (only,) = citations.parse("「" + "긴" * 500 + "법」 제1조제2항")
    assert (only.jo, only.hang, len(only.law_name)) == ("1", "2", 501)


ITEMS = "① 다음 각 호의 어느 하나에 해당하는 경우에는 손금불산입한다.\n  1. 첫 번째 호 800만원 한도.\n  2. 두 번째 호.\n② 다른 항 전체."
ART129 = (
    "제129조(원천징수세율) ① 원천징수의무자가 제127조제1항 각 호에 따른 소득을 지급하여 소득세를 원천징수할 때 적용하는 세율은 다음 각 호의 구분에 따른다.\n"
    "  1. 근로소득에 대해서는 100분의 6 이상 100분의 45 이하.\n  2. 퇴직소득에 대해서는 100분의 3.\n  3. 원천징수대상 사업소득에 대해서는 100분의 3. 다만, 그 밖의 소득에 대해서는 100분의 20으로 한다.\n"
    "  4. 기타소득에 대해서는 100분의 20.\n  5. 연금소득에 대해서는 100분의 5.\n② 다른 항."
)


def test_item_displays():
    change = display.Change("1", "1", "", "800만원", "1,000만원")
    current = display.current_display(ITEMS, change)
    assert "① 다음 각 호" in current and "2. 두 번째 호." in current and "<del>800만원</del>" in current and "② (생략)" in current
    amended = display.amended_display(ITEMS, change, "① (현행과같음)\n② (현행과같음)")
    assert amended.count("①") == 1 and "<u>1,000만원</u>" in amended and "  2. (현행과같음)" in amended
    assert display.current_display(ITEMS, display.Change("1", "2", "", "800만원", "x"), "그대로") == "그대로"
    assert display.current_display(ITEMS, display.Change("", "", "", "800만원", "x"), "그대로") == "그대로"


def test_article_with_inline_paragraph():
    change = display.Change("1", "3", "", "100분의 3", "100분의 2")
    draft = "제129조(원천징수세율) ① ...\n  1. (현행과같음)\n  2. (현행과같음)\n  3. ... <u>100분의 2</u> ...\n  4. (현행과같음)\n② (현행과같음)"
    amended = display.amended_display(ART129, change, draft)
    for part in ("제129조(원천징수세율)", "다음 각 호의 구분에 따른다", "1. (현행과같음)", "2. (현행과같음)", "<u>100분의 2</u>", "4. (현행과같음)", "5. (현행과같음)", "② (현행과같음)"):
        assert part in amended
    assert amended.count("①") == 1 and amended.split("②")[0].count("- - -") < 5
    assert display.title_line(display.own_lines(ART129)) == "제129조(원천징수세율)"


def test_subitem_display():
    body = "① 각 호와 같다.\n  1. 첫 호\n    가. 하나 10만원\n    나. 둘 10만원\n② 끝"
    change = display.Change("1", "1", "나", "10만원", "20만원")
    current, amended = display.current_display(body, change), display.amended_display(body, change, "")
    assert "가. 하나 10만원" in current and "나. 둘 <del>10만원</del>" in current
    assert "    가. (현행과같음)" in amended and "<u>20만원</u>" in amended and "② (현행과같음)" in amended
    assert display.amended_display("본문", change, "초안") == "초안" and display.current_display("", change, "없음") == "없음"


def test_runs_are_shortened():
    assert display.shortened(["① (생략)", "③ (생략)", "④ (생략)", "⑤ <del>x</del> (생략)", ""], display.OMITTED) == ["①~④ (생략)", "⑤ <del>x</del> (생략)"]


def test_judge_names_existing_articles_only(spark):
    sources = spark.createDataFrame([(1, "가법", "제1조(x)\n본문"), (2, "가법", "제2조(y)\n본문")], "id int, law string, text string")
    scope = spark.createDataFrame([("가법", "나법")], "law string, parallel string")
    laws = spark.createDataFrame([("나법", "7", 1, "t", "b")], "law string, jo_no string, ordinal int, title string, body string")
    rules = parallel.rule_table(spark)
    assert parallel.parallel_cascade(sources, scope, laws, rules).count() == 0
    judge = lambda left: left.select("id", "parallel_law", F.when(F.col("id") == 1, "제7조").otherwise("제8조").alias("article"), F.lit("같다").alias("reason"))
    (row,) = parallel.parallel_cascade(sources, scope, laws, rules, judge=judge).collect()
    assert (row.id, row.parallel_law, row.article, row.stage) == (1, "나법", "제7조", "judge")


def test_hint_of_a_citation_is_marked(spark):
    links = spark.createDataFrame([("5의2", "제5조의2", "법인세법", "제36조", "high", "citation", "명시 인용: 「법인세법」 제36조")], "jo_no string, jo_label string, law_name string, article string, confidence string, source string, reason string")
    cited = parallel.citation_hints(links, "조세특례제한법")
    sources = spark.createDataFrame([(1, "조세특례제한법", "제5조의2(x)\n")], "id int, law string, text string")
    scope = spark.createDataFrame([("조세특례제한법", "법인세법")], "law string, parallel string")
    laws = spark.createDataFrame([("법인세법", "36", 1, "", "")], "law string, jo_no string, ordinal int, title string, body string")
    (row,) = parallel.parallel_cascade(sources, scope, laws, parallel.rule_table(spark), cited).collect()
    assert (row.article, row.reason) == ("제36조", "[명시 인용] 명시 인용: 「법인세법」 제36조")


def test_catalog_of_one_and_of_many(spark, tmp_path):
    law = {"법령명한글": "소득세법", "법령일련번호": "1", "법령구분명": "법률"}
    for name, value in (("one", law), ("many", [law, law | {"법령일련번호": "2"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"LawSearch": {"law": value}}, ensure_ascii=False))
    assert [tuple(r) for r in statutes.read_catalog(spark, str(tmp_path / "one.json")).collect()] == [("소득세법", "1", "법률")]
    assert statutes.read_catalog(spark, str(tmp_path / "many.json")).count() == 2
    assert statutes.read_catalog(spark, str(tmp_path / "missing.json")).count() == 0


def test_cache(spark):
    loaded = []

    def load(key):
        loaded.append(key)
        return spark.range(key)

    cache = TableCache(load, size=2)
    assert [cache.get(k).count() for k in (1, 2, 1, 3, 1, 2)] == [1, 2, 1, 3, 1, 2] and loaded == [1, 2, 3, 2]
    stale = TableCache(load, seconds=-1)
    assert stale.get(5).count() == stale.get(5).count() and loaded[-2:] == [5, 5]
    cache.clear()
    stale.clear()


def test_streams(spark, tmp_path):
    schema = "name string, mst string, enforced string, article_count long, content_hash string"
    stored = spark.createDataFrame([("가", "1", "d", 1, "h"), ("나", "1", "d", 1, "h")], schema)
    spark.createDataFrame([("가", "1", "d", 1, "h"), ("나", "2", "d", 1, "h"), ("다", "1", "d", 1, "h")], schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream.watch_snapshots(source, stored, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = {(r.name, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("나", "changed"), ("다", "new")}
    events = spark.createDataFrame([("2026-01-01 00:01:00", "a", 1.0), ("2026-01-01 00:02:00", "a", 2.0), ("2026-01-01 00:07:00", "b", 4.0)], "at string, event_type string, value double").select(F.to_timestamp("at").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "events"))
    counted = stream.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("counted").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
