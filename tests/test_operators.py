"""Fixtures of single operators."""

import json

from pyspark.sql import functions as F

from lexweave.functions import refs, terms
from lexweave.operators import compare, freshness, intent, parallel, review
from lexweave.sources import sinks, statutes


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_references(spark):
    a = F.col("a")
    assert tuple(_one(spark, refs.parse_article(a), a="제33의2조")) == ("33", "2")
    assert tuple(_one(spark, refs.parse_article(a), a="27조의2")) == ("27", "2")
    assert tuple(_one(spark, refs.parse_article(a), a="27의2")) == ("27", "2")
    assert _one(spark, refs.parse_article(a), a="없음") is None
    assert tuple(_one(spark, refs.parse_parts(a), a="제129조제1항제3호")) == ("129", "", "1", "3")
    assert _one(spark, refs.normalize_ref(a), a="제33의2조") == "제33조의2"
    assert _one(spark, refs.symbol_of(a), a="3") == "③" and _one(spark, refs.symbol_of(a), a="21") == ""
    assert tuple(_one(spark, refs.label_parts(a), a="소득세법 시행령 제137조제1항(이유)")) == ("소득세법", "제137조제1항")
    assert _one(spark, refs.normalize_law(a), a="상속세 및ㆍ증여세법") == "상속세및증여세법"
    keys = refs.lookup_keys(a, F.lit("2"), F.lit("3"), F.lit("1"))
    assert _one(spark, keys, a="27") == ["27의2h3o1", "27의2h3", "27의2"]


def test_terms(spark):
    a = F.col("a")
    assert _one(spark, terms.canonical_text(a), a="각 사업연도 손금 불산입") == "과세기간필요경비불산입"
    assert _one(spark, terms.percent_to_fraction(a), a="3%") == "100분의 3" and _one(spark, terms.percent_to_fraction(a), a="2.5%") == ""
    assert _one(spark, terms.relation_type(F.lit(""), F.lit(""), a, F.lit("")), a="세율 개정") == "rate_application"
    assert set(_one(spark, terms.expand_keywords(F.array(a)), a="손금불산입")) >= {"손금불산입", "필요경비불산입"}
    assert len(_one(spark, terms.text_variants(a), a="접대비")) == 2


def test_run_compression(spark):
    lines = ["① (생략)", "② (생략)", "③ 본문", "④ (생략)", "⑥ (생략)", "⑦ (생략)"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "id int, pos int, line string")
    assert [r.line for r in compare.compress_runs(rows).orderBy("pos").collect()] == ["①·② (생략)", "③ 본문", "④~⑦ (생략)"]


def test_masking():
    masked = compare.mask_line("③ 한도는 <u>1,000</u>만원으로 한다")
    assert masked.startswith("③") and "<u>1,000</u>만원으로" in masked and masked.endswith("-")
    assert compare.mask_line("바뀌지 않음") == "바뀌지 않음"
    assert "(" not in compare.mask_line("<u>1</u>(해당 있음)")


def test_alignment(spark):
    schema = "id int, block long, symbol string, text string"
    old = spark.createDataFrame([(1, 0, "", "제1조"), (1, 1, "①", "① 가"), (1, 2, "②", "② 나")], schema)
    new = spark.createDataFrame([(1, 1, "②", "② <u>다</u>"), (1, 2, "③", "③ 라")], schema)
    rows = {r.symbol: (r.left, r.right) for r in compare.align(old, new).collect()}
    assert rows == {"": ("제1조", ""), "①": ("① 가", "①(현행과같음)"), "②": ("② 나", "② <u>다</u>"), "③": ("", "③ 라")}


def test_intents(spark):
    body = "제27조의2(한도)\n③ 한도는 800만원으로 한다.\n④ 제3항의 800만원"
    outlines = ["제3항 800만원을 1,000만원으로 상향한다.", "③ 한도 천만원으로 올리자", "제3항 한도금액 인상 (800→1000만원)", "없음", None]
    rows = spark.createDataFrame([(k, x, body) for k, x in enumerate(outlines)], "id int, outline string, body string")
    found = {r.id: (r.source, r.old_text, r.new_text) for r in intent.parse_intent(rows).collect()}
    assert found[0] == ("regex", "800만원", "1,000만원")
    assert found[1] == found[2] == ("heuristic", "800만원", "1,000만원")
    assert found[3][0] == found[4][0] == "none"
    percent = spark.createDataFrame([(1, "129조 1항 3호의 원천징수 세율을 현행 3%에서 2%로 하향한다.", "3. 100분의 3.")], "id int, outline string, body string")
    row = intent.parse_intent(percent).first()
    assert (row.hangs, row.ho, row.old_text, row.new_text) == (["1"], "3", "100분의 3", "100분의 2")


def test_hints_and_closure(spark):
    asked = spark.createDataFrame([(0, "소득세법", "129", "1", "3")], "id int, law string, jo string, hang string, ho string")
    assert parallel.related_hints(asked, parallel.related_table(spark)).count() == 5
    assert parallel.rule_table(spark).count() == 54
    closure = parallel.related_closure(spark.createDataFrame([("소득세법",)], "law string"), parallel.adjacency(spark)).orderBy("seq").collect()
    assert [r.related for r in closure][:4] == ["소득세법", "소득세법 시행령", "소득세법 시행규칙", "법인세법"]


def test_queue_upgrade(spark):
    schema = "law_name string, article_ref string, source string, symbol string, label string, reason string, suggested boolean, seq int"
    rows = spark.createDataFrame([("법", "1", "gpt", "", "a", "일반", False, 0), ("법", "1", "gpt", "", "b", "직접 인용", True, 1)], schema)
    queue = review.build_queue([rows, rows.limit(0)])
    assert [(r.label, r.tier) for r in queue.collect()] == [("b", "required")]
    lines = spark.createDataFrame([(1, '[검토] 소득세법 제127조: "100분의 3" → "100분의 2" — 제129조 직접 인용\n잡음')], "id int, text string")
    (row,) = review.parse_lines(lines).collect()
    assert (row.label, row.new_text, row.suggested) == ("소득세법 제127조", "100분의 2", False)


def test_queue_of_tied_rows(spark):
    """Rows alike in the queue's order are chosen by their values, not by where they come from."""
    schema = "law_name string, article_ref string, source string, symbol string, label string, reason string, suggested boolean, seq int, new_text string, extra map<string, int>"
    rows = [("법", "1", "gpt", "", "a", "일반", suggested, 0, text, {"k": 1}) for suggested in (False, True) for text in ("나", "가", None, "다")]
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        (row,) = review.build_queue([spark.createDataFrame(order, schema).coalesce(1)]).collect()
        assert (row.suggested, row.new_text) == (True, None)


def test_statute_xml(spark, tmp_path):
    (tmp_path / "law.xml").write_text("<법령><조문단위><조문번호>27</조문번호><조문가지번호>2</조문가지번호><조문여부>조문</조문여부><조문제목>한도</조문제목><조문내용>제27조의2(한도)</조문내용><항><항내용>① 가</항내용><호><호내용>1. 나</호내용><목><목내용>가. 다</목내용></목></호></항></조문단위><조문단위><조문번호>1</조문번호><조문여부>전문</조문여부><조문내용>장</조문내용></조문단위></법령>")
    (row,) = statutes.read_statute(spark, str(tmp_path / "law.xml")).collect()
    assert (row.jo_no, row.title, row.body) == ("27의2", "한도", "제27조의2(한도)\n① 가\n  1. 나\n    가. 다")


def test_json_round_trips(spark, tmp_path):
    snapshot = spark.createDataFrame([("소득세법", "1", "20260101", "20251231", 3, "ab")], "name string, mst string, enforced string, promulgated string, article_count long, content_hash string")
    sinks.write_manifest(snapshot, str(tmp_path / "m"), "2026-06-03")
    back = statutes.read_manifest(spark, str(tmp_path / "m"))
    assert freshness.compare(back, back, back).count() == 0
    assert statutes.read_manifest(spark, str(tmp_path / "none")).count() == 0
    assert json.loads(back.toJSON().first())["enforced"] == "20260101"


def test_similar_titles(spark):
    """Every row against all others but itself, by brute force."""
    names = ["업무용승용차", "필요경비불산입", "감가상각", "이월결손금"]
    titles = ["업무용승용차의 필요경비불산입", "업무용승용차 필요경비불산입 특례", "감가상각", "이월결손금", "", "기타 규정"]
    rows = [(k, f"제{k}조({titles[k % 6]})\n{names[k % 4]} {names[k // 5 % 4]}" if k % 7 else f"제{k}조 {names[k % 4]}") for k in range(60)] + [(60, None), (61, "제61조(혼자만의 제목)\n")]
    frame = spark.createDataFrame(rows, "ordinal long, text string")
    columns = ["ordinal", terms.canonical_text(terms.article_title(F.col("text"))).alias("title"), terms.topic_terms(F.col("text")).alias("terms")]
    described = [(i, t, set(w)) for i, t, w in frame.where("text is not null").select(*columns).collect()]

    def score(a, b):
        shared = a[2] & b[2]
        points = 8 if a[1] and a[1] == b[1] else 6 if len(a[1]) >= 6 and b[1] and (a[1] in b[1] or b[1] in a[1]) else 0
        car = names[0] in shared
        return points + 2 * len(shared) + 4 * car + 4 * (car and names[1] in shared)

    expected = {}
    for a in described:
        found = [(-score(a, b), b[0]) for b in described if a[0] != b[0] and score(a, b) >= 8]
        if found:
            expected[a[0]] = (min(found)[1], -min(found)[0])
    got = parallel.similar_titles(frame.withColumnRenamed("ordinal", "id"), frame, same=True).collect()
    assert {r.id: (r.ordinal, r.score) for r in got} == expected and len(got) == len(expected) > 30


def test_applied_changes_are_merged(spark):
    """However small Spark takes the sides for, none goes through the driver."""
    texts = spark.createDataFrame([(1, 1, "①", "① (현행과같음)"), (1, 3, "③", "③ 셋 5원"), (2, 1, "①", "① 하나")], "id long, block int, symbol string, text string")
    originals = spark.createDataFrame([(1, 1, "①", "① 첫 5원"), (1, 4, "④", "④ 넷 5원")], "id long, block int, symbol string, text string")
    changes = spark.createDataFrame([(1, "①", 0, "5원", "7만"), (1, "④", 1, "넷", "네")], "id long, symbol string, seq int, old_text string, new_text string")
    unchecked = spark.createDataFrame([(1, "③")], "id long, symbol string")
    found = compare.apply_overrides(compare.apply_changes(texts, changes, originals), unchecked)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in found.collect())
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # as adapted
    assert got == [(1, 1, "①", "① 첫 <u>7만</u>"), (1, 3, "③", "③ (현행과같음)"), (1, 4, "④", "④ <u>네</u> 5원"), (2, 1, "①", "① 하나")]
