import random
import re

import numpy as np
import pytest

from quillmesh.llm import near


def word_sets(rows, size=3, min_words=30):
    out = {}
    for k, t in rows:
        words = [w for w in re.split("[ \t\r\n\f]+", (t or "").lower()) if w]
        if len(words) >= min_words:
            out[k] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return out


def brute(rows, least=0.6, **sizes):
    sets = sorted(word_sets(rows, **sizes).items())
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if len(x & y) >= least * len(x | y)}


def agrees(got, rows, least=0.6, **sizes):
    """Nothing wrong, nothing lost that is clearly above the threshold, and next to nothing at it."""
    true, clear = brute(rows, least, **sizes), brute(rows, least + 0.07, **sizes)
    return len(got) == len(set(got)) and set(got) <= true and clear <= set(got) and len(got) >= 0.995 * len(true)


def collection(n=240, seed=5):
    """A third of all rows are exact copies, a third near copies of one text (a hot group), the rest apart."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    rows = []
    for k in range(n):
        if k % 3 == 0:
            words = base
        elif k % 3 == 1:
            words = list(base)
            for _ in range(draw.choice([1, 2, 5, 9])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.randrange(25, 300))]
        rows.append((k, " ".join(words) if k % 2 else "\n".join(words).upper()))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "short text"), (n + 4, " ".join(["same"] * 50)), (n + 5, " ".join(["same"] * 70)), (n + 6, "x " * 200_000)]


@pytest.fixture(scope="module")
def rows():
    return collection()


@pytest.mark.parametrize("tile", [near.TILE, 16])
def test_pairs_equal_brute_force(spark, rows, tile, monkeypatch):
    monkeypatch.setattr(near.candidates, "__defaults__", (tile, False))
    monkeypatch.setattr(near, "COPIES", tile // 2)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "id int, page_content string, set_key int")
    got = [tuple(r) for r in near.similar_pairs(df).collect()]
    assert agrees(got, rows)


def test_shuffle_join_beyond_the_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_PAIRS", 0)
    df = spark.createDataFrame(rows, "id int, page_content string")
    assert agrees([tuple(r) for r in near.similar_pairs(df).collect()], rows)


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "id int, page_content string")
    got = {r.id: r for r in near.groups(df).collect()}
    sets, pairs = word_sets(rows), {tuple(r) for r in near.similar_pairs(df).collect()}
    assert set(got) == set(sets)
    first = {}
    for k in sorted(sets):
        first.setdefault(frozenset(sets[k]), k)
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    for k, r in got.items():
        assert r.class_id == first[frozenset(sets[k])] and r.group_id == find(k)
    classes = {(min(got[a].class_id, got[b].class_id), max(got[a].class_id, got[b].class_id)) for a, b in pairs} - {(k, k) for k in sets}
    assert all(r.links == sum(r.class_id in c for c in classes) for r in got.values())


def test_five_words_at_four_fifths(spark, rows):
    df = spark.createDataFrame(rows, "id int, page_content string")
    assert agrees([tuple(r) for r in near.similar_pairs(df, size=5, least=0.8).collect()], rows, 0.8, size=5)


@pytest.mark.parametrize("least", [0.3, 0.4, 0.8])
def test_other_thresholds(spark, rows, least):
    df = spark.createDataFrame(rows, "id int, page_content string")
    assert agrees([tuple(r) for r in near.similar_pairs(df, least=least).collect()], rows, least)


def test_exact_loses_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(near.candidates, "__defaults__", (16, False))
    df = spark.createDataFrame(rows, "id int, page_content string")
    for least in (0.25, 0.6):
        assert {tuple(r) for r in near.similar_pairs(df, least=least, exact=True).collect()} == brute(rows, least)


def test_bands_follow_the_threshold():
    assert near.banding(0.6) == (4, 56)
    for least in (0.05, 0.1, 0.3, 0.4, 0.5, 0.7, 0.8, 0.95):
        r, b = near.banding(least)
        assert (1 - least**r) ** b <= near.MISSED and (b <= near.MOST_BANDS or r == 1)


def test_one_bucket_of_many(spark):
    """20,000 different records in one bucket: no unit holds more than two tiles, and every near pair comes out."""
    draw = np.random.default_rng(8)
    n = 20_000
    bits = np.packbits(draw.random((n, near.BITS)) < 0.1, axis=1)
    bits[1::100] = bits[::100]  # 200 pairs of equal maps
    reps = spark.createDataFrame([(k, 100 + k % 90 // 2, [7], b.tobytes()) for k, b in enumerate(bits)], "id int, n int, bands array<int>, bits binary").repartition(4)
    got = {tuple(r) for r in near.candidates(reps, 0.6, tile=2048).collect()}
    assert {(k, k + 1) for k in range(0, n, 100)} <= got and len(got) < 1000


def test_empty(spark):
    df = spark.createDataFrame([], "id int, page_content string")
    assert near.similar_pairs(df).count() == 0 and near.groups(df).count() == 0


def test_tiles_lose_no_pair_within_the_radius():
    draw = np.random.default_rng(2)
    bits = draw.integers(0, 2**63, (300, near.BITS // 64)).astype(np.uint64) & draw.integers(0, 2**63, (300, near.BITS // 64)).astype(np.uint64)
    bits[100:200] = bits[:100] ^ (draw.random((100, near.BITS // 64)) < 0.3).astype(np.uint64)
    n = np.bitwise_count(bits).sum(axis=1).astype(np.int64) + draw.integers(0, 5, 300)
    unit, side, ids = np.repeat([1, 2], [290, 10]), np.full(300, 2), np.arange(300)
    a, b = near.compare_units(unit, side, ids, n, bits, 0.6, block=32)
    apart = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    expected = {(i, j) for i in range(300) for j in range(i + 1, 300) if unit[i] == unit[j] and apart(i, j) <= 0.25 * (n[i] + n[j]) and min(n[i], n[j]) >= 0.6 * max(n[i], n[j])}
    assert set(zip(a.tolist(), b.tolist())) == expected


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.component for r in near.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}

    def find(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in parent}


def test_exact_on_small_tables(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(40))), "x"), (2, " ".join(map(str, range(40))), "y"), (3, None, None)], "id int, page_content string, bits string")
    assert [tuple(r) for r in near.similar_pairs(df, exact=True).collect()] == [(1, 2)]
    assert near.similar_pairs(df.where("false"), exact=True).count() == 0 and near.groups(df.where("id = 3"), exact=True).count() == 0
