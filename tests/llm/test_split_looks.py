import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import looks, split


def check(text, limit, overlap):
    spans = split.bisect_spans(text, limit, overlap)
    if not text:
        assert spans == []
        return spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, end), (start, stop) in zip(spans, spans[1:]):
        assert 0 < end - start <= overlap and stop > end
    assert all(0 < b - a <= limit for a, b in spans)
    assert len(spans) == 1 or len(text) > limit
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab. \n,é́👩‍"), max_size=400))
def test_spans_cover_and_overlap(text):
    check(text, 40, 10)


def test_natural_boundaries():
    draw = random.Random(2)
    text = "\n\n".join(" ".join("word" * draw.randrange(1, 4) + ("." if draw.random() < 0.2 else "") for _ in range(draw.randrange(5, 60))) for _ in range(80))
    spans = check(text, 2000, 250)
    assert all(re.search(r"\s$", text[a:b]) for a, b in spans[:-1])
    assert all(text[a - 1].isspace() for a, _ in spans[1:])


def test_no_boundary_at_all():
    check("x" * 10_000, 2000, 250)
    spans = check(("e" + "́" * 3) * 3000, 2000, 250)
    assert all(unicodedata.combining((("e" + "́" * 3) * 3000)[a]) == 0 for a, _ in spans[1:])


def test_tables(spark):
    meta = spark.createDataFrame([(1, "x" * 2001), (2, "x" * 2000), (3, None), (4, "")], "id int, page_content string")
    records = spark.createDataFrame([("/a", "y " * 1500), ("/a", "y " * 1600), ("/b", "short"), (None, "z" * 3000)], "file_path string, page_content string")
    assert {tuple(r) for r in split.oversized(meta, records).collect()} == {("document_metadata", "1"), ("document_records", "/a")}
    clash = meta.selectExpr("*", "1 AS spans", "2 AS piece", "3 AS start")
    pieces = split.pieces(split.split_spans(clash)).collect()
    assert {(r.id, r.piece_no) for r in pieces} == {(1, 0), (1, 1), (2, 0)} and all(len(r.piece) == r.stop - r.start for r in pieces)
    assert split.oversized(meta.where("false"), records.where("false")).count() == 0
    with pytest.raises(ValueError):
        split.split_spans(meta, limit=400, overlap=200)


SAME = [
    ["Full IV fine", "Ｆｕｌｌ Ⅳ ﬁne", "Full ⅠⅤ fine", "F​ull I­V  fi⁠ne", "Full ІV finе "],
    ["é", "é", "е́", "﻿é"],
    ["ệ", "ệ", "ệ", "ệ"],
    ["a\r\nb", "a\nb", "a \n b", "a\rb", "a b"],
    ["Å", "Å", "Å"],
    ["όχι", "ό​χι", "όχι"],
    ["À", "Ὰ", "Ὰ"],
    ["ё", "ë", "ё"],
]
APART = ["a b", "ab", "a\nb", "a\n\nb", "A b", "á b", "à b", "x²", "x2", "½", "1/2", "a-b", "a—b", "a_b", "straße", "strasse", "ſo", "so", "𝐀", "A", "①", "1", "👩‍💻", "👩💻", "Ή", "H", "α", "a"]


def form(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    return [x for t in looks._looks(batch) for x in t.column(1).to_pylist()]


def test_same_look():
    for group in SAME:
        assert len(set(form(group))) == 1, (group, form(group))


def test_different_look():
    forms = form(APART)
    assert len(set(forms)) == len(APART)


def test_form_is_stable():
    texts = [t for g in SAME for t in g] + APART
    once = form(texts)
    assert form(once) == once and form([None, "", "​ ­", " "]) == [None, "", "", ""]


def test_pairs(spark):
    rows = [(1, "Ａbc"), (2, "Abc"), (3, "Abc"), (4, "abc"), (5, ""), (6, "​"), (7, None), (8, "Abс"), (9, " ")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, look string, class_id string")
    assert {tuple(r) for r in looks.look_alike_pairs(df).collect()} == {(1, 2), (1, 3), (1, 8), (2, 8), (3, 8)}
    assert looks.look_alike_pairs(df.where("false")).count() == 0
    assert {r.doc_id: r.look for r in looks.common_form(df).collect()}[1] == "Abc"


@pytest.mark.parametrize("unit", [looks.UNIT, 7])
def test_many_texts_of_one_look(spark, unit, monkeypatch):
    monkeypatch.setattr(looks, "UNIT", unit)
    blanks = [" ", "\u00a0", "\u2003", "\u3000"]
    texts = ["".join(f"w{blanks[k >> 2 * i & 3]}" for i in range(4)) + "end" for k in range(60)]
    rows = [(k, texts[k % 60]) for k in range(150)] + [(150 + k, texts[0]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {(a, b) for a, x in rows for b, y in rows if a < b and x != y}
    got = [tuple(r) for r in looks.look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    partners = {k: sum(k in p for p in expected) for k, _ in rows}
    found = looks.classes(df).collect()
    assert {r.doc_id: r.others for r in found} == partners and len({r.class_id for r in found}) == 1 and all(r.copies + r.others == 190 for r in found)
    assert looks.classes(df.where("false")).count() == 0


def test_hot_class_of_copies(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN 'the same text' WHEN id = 2 THEN 'the ѕame text' ELSE concat('text ', id) END AS text")
    got = looks.look_alike_pairs(df)
    assert got.count() == 2000 and got.where("doc_a = 2 OR doc_b = 2").count() == 2000


def test_ligatures_of_several_letters():
    for a, b in [("ﻻ", "لا"), ("x ﻵ", "x لآ"), ("ﷲ", "الله"), ("ﰀ", "ئج")]:
        assert len(set(form([a, b]))) == 1, (a, b)
    assert form(["ﻻ", None, "plain", ""])[1:] == [None, "plain", ""]
    assert len(set(form(["ﻻ", "ﻵ", "ا", "ل"]))) == 4


def test_checked_counts(spark):
    items = spark.createDataFrame([("a", "1", "word " * 900), ("a", "2", None), ("a", "3", ""), ("b", "4", "é" * 2001), ("b", "4", "x")], "src string, item_key string, page_content string")
    spans = split.split_spans(items)
    got = {r.src: tuple(r)[1:] for r in split.checked(spans).collect()}
    assert got == {"a": (3, 4500, 1, 1, 0, 0), "b": (2, 2002, 2, 1, 0, 0)}
    # What it is for: pieces too long, and pieces without an overlap.
    wrong = spans.selectExpr("src", "page_content", "array(named_struct('start', 0, 'stop', 2500), named_struct('start', 2500, 'stop', length(page_content))) AS spans").where("length(page_content) > 2500")
    assert [tuple(r)[1:] for r in split.checked(wrong).collect()] == [(1, 4500, 1, 1, 1, 1)]
    assert split.checked(spans.where("false")).count() == 0
