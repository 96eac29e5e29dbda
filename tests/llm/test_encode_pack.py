import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import encode, pack
from quillmesh.llm.common import vocabulary_file

if not os.path.exists(vocabulary_file("byte_bpe_50k.json")):
    pytest.skip("no vocabulary files", allow_module_level=True)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ours(texts):
    ids, offsets = encode.encoder(vocabulary_file("byte_bpe_50k.tiktoken")).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


HARD = [
    "", None, " ", "   a   b  ", "\n\n\n", "\t\r\n x", "it's we're I'll 'quoted' don't''s", "<|endoftext|>x<|startoftext|>", "naïve café — “x”…", "при вет  мир", "Ελληνικά κείμενα", "日本語の 索引", "👩‍💻 📄📄", "a  b c　 d",
    "\x00\x07\x1f \x1c y", "1234567890 3.14 v1.2.3", "foo_bar(baz)[0] != {x: 'y'}", "é́ combining", "�﻿​", "word" * 3000, "!" * 999 + " a", " " * 500 + "x", "ａｂｃ", "'s 't 're", "x\u0085y z",
]


def test_hard_texts(library):
    assert ours(HARD) == [library.encode(t, add_special_tokens=False).ids if t else [] for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list(" \n\t'  　aAzé1.,!-–ßжλの👩‍́")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_any_text(texts):
    from tokenizers import Tokenizer

    if not hasattr(test_any_text, "t"):
        test_any_text.t = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
        test_any_text.t.encode_special_tokens = True
    assert ours(texts) == [test_any_text.t.encode(t, add_special_tokens=False).ids if t else [] for t in texts]


def test_slices_and_null_slots():
    values = pa.array(["skip", "a b", None, "c"], pa.string()).slice(1)
    ids, offsets = encode.encoder(vocabulary_file("byte_bpe_50k.tiktoken")).encode(values)
    assert offsets.tolist()[0] == 0 and np.diff(offsets).tolist() == [2, 0, 1] and len(ids) == 3


def test_corpus(spark, library):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(HARD * 2)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df).collect()}
    assert got == {k: (library.encode(t, add_special_tokens=False).ids if t else []) for k, t in enumerate(HARD * 2)}
    assert {r.doc_id: r.n_tokens for r in encode.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    assert encode.encode_corpus(df.where("false")).count() == 0


def placed(spark, sizes, capacity=2048):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "doc_id long, n_tokens int")
    return [r.asDict() for r in pack.pack_sizes(df, capacity=capacity).collect()]


def check(rows, sizes, capacity):
    loads, pieces = {}, {}
    for r in rows:
        loads[r["container"]] = loads.get(r["container"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["first_token"], r["n_tokens"]))
    assert set(pieces) == {k for k, n in enumerate(sizes) if n > 0}
    for k, p in pieces.items():
        p.sort()
        assert [x[1] for x in p] == [capacity * i for i in range(len(p))] and sum(x[2] for x in p) == sizes[k] and (len(p) == 1 or sizes[k] > capacity)
    assert max(loads.values(), default=0) <= capacity and sorted(loads) == list(range(len(loads)))
    return len(loads)


@pytest.mark.parametrize("kind", ["mixed", "hot", "large", "halves", "tiny", "over"])
@pytest.mark.parametrize("per_salt", [pack.PER_SALT, 100])
def test_packing(spark, kind, per_salt, monkeypatch):
    monkeypatch.setattr(pack, "PER_SALT", per_salt)
    draw = random.Random(kind)
    sizes = {
        "mixed": lambda: int(draw.paretovariate(0.9) * 20) % 6000,
        "hot": lambda: 683 if draw.random() < 0.34 else draw.randrange(1, 1500),
        "large": lambda: draw.randrange(900, 1300),
        "halves": lambda: draw.choice([1023, 1024, 1025]),
        "tiny": lambda: draw.randrange(0, 4),
        "over": lambda: draw.choice([2048, 4096, 4097, 10000]),
    }[kind]
    sizes = [sizes() for _ in range(2000)]
    used = check(placed(spark, sizes), sizes, 2048)
    least = -(-sum(sizes) // 2048)
    assert least <= used <= first_fit_decreasing([n % 2048 for n in sizes]) + sum(n // 2048 for n in sizes)


def first_fit_decreasing(sizes):
    rooms = []
    for n in sorted((n for n in sizes if n), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(2048 - n)
        else:
            rooms[k] -= n
    return len(rooms)


def test_plan_against_first_fit_decreasing():
    draw = random.Random(4)
    for _ in range(5):
        sizes = [draw.randrange(100, 1200) for _ in range(1500)]
        counts = {}
        for n in sizes:
            counts[n] = counts.get(n, 0) + 1
        assert pack.make_plan(counts).containers <= first_fit_decreasing(sizes)


def test_small_inputs(spark):
    assert placed(spark, []) == [] and placed(spark, [0, 0]) == []
    assert check(placed(spark, [2048]), [2048], 2048) == 1
    assert check(placed(spark, [5, 5, 5], 10), [5, 5, 5], 10) == 2
    assert check(placed(spark, [25], 10), [25], 10) == 3
