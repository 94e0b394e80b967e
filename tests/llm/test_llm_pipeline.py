"""The pipeline's stages on the smallest tables, and the queries' SQL."""

import os
import random
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from lexweave.llm import queries, simhash

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_entry import DIR, same  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    same(spark, name, queries.QUERIES, queries.ORACLE_SQL)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept and len(ids) > 0.5 * len(kept)
        kept = set(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_near_copies_are_verified(spark):
    """Of texts that fingerprints put together, only those over 0.8 are dropped."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = [(900, None), (901, ""), (902, "one two"), (903, "One Two"), (None, "no id"), (None, "no id")]
    for group in range(8):
        base = [word() for _ in range(200)]
        for copy, edits in enumerate((0, 1, 2, 4, 6, 8)):
            words = list(base)
            for at in rng.sample(range(200), edits):
                words[at] = word()
            rows.append((10 * group + copy, " ".join(words)))
    rows.append((5, rows[8][1]))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def components(linked):
        root = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                if root[a] != root[b] and linked(a, b):
                    old, new = root[a], root[b]
                    root = [new if x == old else x for x in root]
        return root

    texts = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    sets = [shingles(t) for _, t in texts]
    prints = [simhash._fingerprint((t or "").encode(), corpus_pipeline.NEAR_SHINGLE, corpus_pipeline.NEAR_SIGNATURES) for _, t in texts]
    loose = components(lambda a, b: any((x ^ y).bit_count() <= corpus_pipeline.NEAR_BITS for x, y in zip(prints[a], prints[b], strict=True)))
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    strict = components(lambda a, b: loose[a] == loose[b] and similar(a, b))
    firsts = {strict[k]: texts[k] for k in reversed(range(len(texts)))}
    assert len(set(loose)) < len(set(strict)) < len(texts) - 8
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_copies(spark, frame, DIR).collect())
    assert got == sorted((i is not None, i or 0, t or "") for i, t in firsts.values())
    assert corpus_pipeline.near_copies(spark, frame.limit(0), DIR).count() == 0


def test_passages_of_rows_that_share_an_id(spark):
    """Rows of one id, or of none, stay apart and keep their own columns."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{n} own text {n} " + (passage if n % 2 else ""), f"l{n}", f"s{n}", 1) for n, i in enumerate([1, 1, 1, None, None, None, None, 2])]
    rows += [(3, passage, "l8", "s8", 1), (None, None, "l9", "s9", None), (2, rows[-1][1], "l10", "s10", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.repeated_passages(spark, frame, DIR)
    assert got.columns == frame.columns

    def kept(n, text):
        return f"{n} own text {n}" if n % 2 else text

    # Of the passage alone and of the two rows that are equal nothing is left.
    expected = [(i, kept(n, t), lang, source) for n, (i, t, lang, source, _) in enumerate(rows[:7])] + [(None, "", "l9", "s9")]
    found = [tuple(r)[:4] for r in got.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_stages_on_awkward_rows(spark):
    """Nulls, empty, long and repeated texts, rows of one id or of none, no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    english, french = "the house and the garden with the river " * 6, "la maison et le jardin avec la rivière " * 6
    rows = [(k, f"{t} {k}", lang, "s", 1) for k in range(20) for t, lang in ((english, "en"), (french, "fr"))]
    rows += [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t", None, "s", 1), (None, english, "en", "s", 1), (None, french, None, "s", 1), (7, "1234 !?", "en", "s", 1), (8, english * 300, "en", "s", 1)]
    rows += [rows[0], rows[0], (5, f"before {item} after", "en", "s", 1), (5, "nothing of it", "en", "s", 1), (None, item.upper(), None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    texts = lambda found: sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r.lang or "") for r in found.collect()))
    plain = lambda kept: sorted((i is not None, i or 0, t is not None, t or "", lang or "") for i, t, lang, *_ in kept)

    kept = corpus_pipeline.language(spark, frame, DIR)
    found = texts(kept)
    assert kept.columns == frame.columns and set(found) <= set(plain(rows))
    assert not any(not any(c.isalpha() for c in t) for *_, t, _ in found)
    assert found.count((True, 0, True, rows[0][1], "en")) == 3 and (False, 0, True, french, "") in found and (True, 8, True, english * 300, "en") in found

    clean = corpus_pipeline.benchmark_leaks(spark, frame, DIR)
    assert clean.columns == frame.columns
    assert texts(clean) == plain([r for r in rows if item.lower() not in (r[1] or "").lower()])

    packed = corpus_pipeline.sequences(spark, frame, DIR).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in packed if r.start == 0) == sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), DIR).count() == 0
