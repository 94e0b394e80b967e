"""The parser's documented consequences and relative references."""

import pytest

from lexweave.operators.citations import parse

CASES = [
    ("「소득세법」 제20조부터 제25조까지", [("소득세법", "20", "", ""), ("", "20", "", "25")]),
    ("제27조제1항부터 제3항까지", [("", "27", "1", ""), ("", "", "1", "")]),
    ("제1조 제3항", [("", "1", "", "")]),
    ("「법인세법」 제10조 및 같은 법 제11조", [("법인세법", "10", "", ""), ("법인세법", "11", "", "")]),
    ("제5조 및 같은 조 제2항", [("", "5", "", ""), ("", "5", "2", "")]),
    ("제3항까지", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_rows(text, expected):
    found = [(c.law_name, c.jo, c.hang, c.range_end_jo) for c in parse(text)]
    assert sorted(found) == sorted(expected)


def test_fields_of_a_full_reference():
    (c,) = parse("제27조의2제3항제1호제4목")
    assert (c.jo, c.jo_sub, c.hang, c.ho, c.mok, c.start, c.end) == ("27", "2", "3", "1", "4", 0, 15)


def test_relative_law_stays_in_its_sentence():
    rows = parse("「법인세법」 제10조. 같은 법 제11조")
    assert [(c.law_name, c.relative) for c in rows] == [("법인세법", ""), ("같은법", "같은법")]


def test_named_law_is_greedy():
    (c,) = parse("따라 소득세법 제10조")
    assert c.law_name == "따라 소득세법"


def test_long_text_is_linear():
    assert len(parse("제1조에 따른다.\n" * 3000)) == 3000
