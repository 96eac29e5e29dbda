import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import batching, chunking, citations, layout, reading, relational, retrieval, web
from quillmesh.plans import catalog, config
from quillmesh.plans.config import QueryConfig


def expected_chunks(t, size, overlap):
    t = t.strip()
    step = max(size - overlap, 1)
    parts = [(s, t[s : s + size].strip()) for s in range(0, len(t), step)]
    return [(s, c) for s, c in parts if c]


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 9), (10, 10), (1000, 0)])
def test_fixed_chunks(spark, size, overlap):
    texts = ["", "  ", "short", "x" * 20, " padded text with  gaps            here ", "emoji 🙂🙂🙂🙂 at the edge", None]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id int, text string, chunk string")
    got = {}
    for r in chunking.fixed(df, size=size, overlap=overlap).orderBy("id", "chunk_idx").collect():
        got.setdefault(r.id, []).append((r.chunk_start, r.chunk))
    assert got == {k: c for k, t in enumerate(texts) if t and (c := expected_chunks(t, size, overlap))}


def expected_pages(t, size, overlap):
    import re

    marks, at, plain = [], 0, ""
    for m in re.finditer(r"\[\[page(\d+)\]\]", t):
        plain += t[at : m.start()]
        marks.append((len(plain), int(m[1])))
        at = m.end()
    plain += t[at:]
    out = []
    for s in range(0, len(plain), size - overlap):
        c = plain[s : s + size].strip()
        if c:
            out.append((s, c, max([(k, p) for k, (pos, p) in enumerate(marks) if pos <= s], default=(0, 1))[1]))
    return out


def test_paged_chunks(spark):
    draw = random.Random(3)
    texts = ["no marker at all", "[[page1]]a[[page2]][[page5]]b", "x[[page3]]" + "y" * 30, "[[page9]]", ""]
    for _ in range(30):
        texts.append("".join(draw.choice(["ab ", "c", "\n", f"[[page{draw.randrange(20)}]]"]) for _ in range(40)))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunking.paged(df, size=12, overlap=5).orderBy("id", "chunk_idx").collect():
        got.setdefault(r.id, []).append((r.chunk_start, r.chunk, r.page_number))
    assert got == {k: c for k, t in enumerate(texts) if (c := expected_pages(t, 12, 5))}
    with pytest.raises(ValueError):
        chunking.paged(df, size=5, overlap=5)


def test_headings(spark):
    df = spark.createDataFrame([(1, "intro\n### One\n\n\nbody\n\nmore\n#### Two\nx"), (2, "none"), (3, None)], "id int, text string")
    rows = chunking.headings(df).orderBy("chunk_idx").collect()
    assert [(r.chunk, r.heading) for r in rows] == [("### One\n\nbody\nmore", "One"), ("#### Two\nx", "Two")]


def test_assemble_pages(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "  "), (2, 1, "")], "doc_id int, page int, text string")
    assert {r.doc_id: r.text for r in chunking.assemble_pages(df).collect()} == {1: "[[page1]]a[[page2]]b", 2: ""}


def vectors(spark, n=300, d=8, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, d))
    m[5] = m[0]  # a tie
    m[7] = 0
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(n, None)]
    return m, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(m, q, k):
    m = m.astype(np.float32).astype(float)
    n = np.linalg.norm(m, axis=1)
    with np.errstate(all="ignore"):
        cos = m @ m[q] / (n * n[q])
    order = [i for i in np.lexsort((np.arange(len(m)), -np.nan_to_num(cos, nan=-9))) if np.isfinite(cos[i])]
    return order[:k]


def test_topk_and_blocks(spark, monkeypatch):
    m, df = vectors(spark)
    queries = df.where("vec_id % 20 = 0")
    expected = {q: brute(m, q, 6) for q in range(0, 300, 20)}
    direct = {q: [r.vec_id for r in retrieval.topk_of(df, q, 6).orderBy("rank").collect()] for q in (0, 20)}
    assert all(direct[q] == expected[q] for q in direct)
    literal = retrieval.topk(df, [float(np.float32(x)) for x in m[0]], 6)
    assert [r.vec_id for r in literal.orderBy("rank").collect()] == expected[0]
    for held in (64 << 20, 64 * 4):  # broadcast, and blocks of both sides
        monkeypatch.setattr(retrieval, "QUERY_BYTES", held)
        monkeypatch.setattr(retrieval, "BLOCK", 64 if held < 1000 else 4096)
        monkeypatch.setattr(retrieval, "SLICE", 3)
        got = {}
        for r in retrieval.topk_many(df, queries, 6).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == expected


def test_topk_is_a_prefix(spark):
    _, df = vectors(spark)
    five = [r.vec_id for r in retrieval.topk_of(df, 3, 5).orderBy("rank").collect()]
    assert [r.vec_id for r in retrieval.topk_of(df, 3, 6).orderBy("rank").collect()][:5] == five


def test_filters_after_limit(spark):
    hits = spark.createDataFrame([(1, 0.9, "100% sure", "document"), (2, 0.7, "Half", "image"), (3, 0.1, None, None)], "rank int, similarity_score double, text string, document_type string")
    kept = lambda **c: [r.rank for r in retrieval.post_filter(hits, QueryConfig(**{"similarity": 0.0, **c})).orderBy("rank").collect()]
    assert kept() == [1, 2, 3] and kept(similarity=0.7) == [1, 2] and kept(search_term="%") == [1] and kept(search_term="HALF") == [2] and kept(document_types="image") == [2]


def test_no_result(spark):
    empty = spark.createDataFrame([], "rank int, text string, source string")
    assert retrieval.chunks_only(empty, "source").first()[0] == retrieval.NO_RESULT


def test_page_ranges(spark):
    df = spark.createDataFrame([(1, p) for p in (7, 3, 2, 1, 2, None)] + [(2, 5), (3, None)], "k int, page_number int")
    assert {r.k: r.pages for r in citations.page_ranges(df, ["k"]).collect()} == {1: "1-3, 7", 2: "5"}
    arrays = spark.createDataFrame([([7, 3, 2, 1, 2, None],), ([],), ([5],)], "p array<int>")
    assert [r[0] for r in arrays.select(citations.page_ranges_of(F.col("p"))).collect()] == ["1-3, 7", "", "5"]


def test_citations(spark):
    rows = [("/b", "b", ".pdf", 2, 0.5, 1), ("/b", "b", ".pdf", 1, 0.25, 2), ("/a", "a", ".txt", None, 0.25, 3), ("/c", "c", ".PDF", 4, 0.9, 4)]
    df = spark.createDataFrame(rows, "file_path string, file_name string, file_type string, page_number int, similarity_score double, rank int")
    got = [(r.file_path, r.scores, r.pages) for r in citations.citations(df).collect()]
    assert got == [("/a", "0.2500", None), ("/b", "0.2500-0.5000", "1-2"), ("/c", "0.9000", None)]
    assert citations.citation_list(citations.citations(df)).first()[0].startswith('<ol><li><a href="file:/a">a</a> [0.2500]</li>')


def test_batches_and_padding(spark):
    df = spark.createDataFrame([(k, " ".join(["w"] * (k % 5 + 1))) for k in range(23)], "doc_id long, text string")
    tokens = batching.tokenize(df, "doc_id", "text", max_length=4)
    padded = batching.padded_batches(tokens, "doc_id", pad_id=9, left=True, shard_size=10, batch_size=4).collect()
    assert len(padded) == 23
    for r in padded:
        n = min(r.doc_id % 5 + 1, 4)
        assert r.n_tokens == n and r.attention_mask == [0] * (len(r.input_ids) - n) + [1] * n and r.input_ids[: len(r.input_ids) - n] == [9] * (len(r.input_ids) - n)
    stats = batching.batch_stats(batching.length_sorted(tokens, F.size("input_ids"), "doc_id", shard_size=10, batch_size=4))
    total = batching.padding_efficiency(stats).first()
    assert total.real_tokens == sum(min(k % 5 + 1, 4) for k in range(23)) and 0 < total.efficiency <= 100
    assert batching.padding_efficiency(stats.where("false")).first().efficiency == 100.0


def box(x, y, w=180, h=20):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def test_tokens_up_to_what_models_take(spark, tmp_path):
    spark.createDataFrame([(0, "word " * 300), (1, "word " * 600), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.longest, r.real_tokens) for r in catalog.queries()["padded_tokens"](spark, str(tmp_path)).collect()] == [(512, 812)]


def test_reading_order():
    left, right = [box(0, 30 * k) for k in range(10)], [box(220, 30 * k) for k in range(10)]
    mixed = [b for pair in zip(left, right) for b in pair]
    assert reading.reading_order(mixed) == [*range(0, 20, 2), *range(1, 20, 2)]
    assert reading.reading_order([box(0, 60), box(0, 0), box(0, 30)]) == [1, 2, 0]
    assert reading.reading_order([box(0, 0)]) is None and reading.reading_order([]) is None
    head = [box(0, -60, 400)]
    assert reading.reading_order(mixed + head)[0] == 20


def test_rotation_and_boxes(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [5.0, 3.0]],)], "p array<array<double>>")
    assert tuple(df.select(layout.bounding_box(F.col("p"))).first()[0]) == (1.0, 2.0, 5.0, 3.0)
    turn = lambda k: df.select(layout.rotated_back(F.col("p"), k, F.lit(10.0), F.lit(20.0))).first()[0]
    assert turn(1) == [[7.0, 1.0], [6.0, 5.0]] and turn(2) == [[8.0, 17.0], [4.0, 16.0]] and turn(3) == [[2.0, 18.0], [3.0, 14.0]]


def test_ocr_gate(spark):
    rows = [("ok text here", 4, 0.9, 0), ("\ufffd\ufffd\ufffd", 9, 0.0, 0), ("", 0, 0.05, 0), ("few", 1, 0.4, 0), ("few", 1, 0.5, 0), (None, None, None, 20)]
    df = spark.createDataFrame(rows, "text string, w int, c double, d int")
    assert [r[0] for r in df.select(layout.page_needs_ocr(F.col("text"), F.col("w"), F.col("c"), F.col("d"))).collect()] == [False, True, True, False, True, True]


def test_orientation_and_verification(spark):
    trials = spark.createDataFrame([(1, "none", 10.0, 0.95), (1, "rot90", 99.0, 0.9), (2, "none", 10.0, 0.5), (2, "rot90", 12.0, 0.9), (3, "none", 10.0, 0.5), (3, "rot180", 13.0, 0.9)], "page int, orientation string, mass double, confidence double")
    assert {r.page: r.orientation for r in layout.best_orientation(trials).collect()} == {1: "none", 2: "none", 3: "rot180"}
    a = spark.createDataFrame([(1, 2, 0), (2, 2, 5), (3, 1, 0), (4, 1, 1)], "doc_id int, pages int, chars int")
    b = spark.createDataFrame([(1, 2, 9), (2, 3, 5), (3, 1, 0)], "doc_id int, pages int, chars int")
    assert {r.doc_id: r.problem for r in layout.verified_output(a, b).collect()} == {1: None, 2: "page count", 3: "no text", 4: "missing"}


def test_hocr(spark):
    rows = [(1, 0, "a<b", [[0.0, 0.0], [9.0, 9.0]], 0.555), (1, 1, "low", [[0.0, 0.0], [9.0, 9.0]], 0.2), (1, 2, "flat", [[0.0, 0.0], [9.0, 1.0]], 0.9), (1, 3, "", [[0.0, 0.0], [9.0, 9.0]], 0.9)]
    r = layout.hocr_lines(spark.createDataFrame(rows, "page int, line_no int, text string, polygon array<array<double>>, score double")).first()
    assert (r.emitted, r.dropped, r.flagged) == (1, 1, 1) and "x_wconf 56" in r.body and "a&lt;b" in r.body


def test_lookup_prefers_the_exact_name(spark):
    registry = spark.createDataFrame([("org/a-large", "a", "half"), ("org/a", "zz", "full")], "repo string, name string, precision string")
    rows = spark.createDataFrame([("org/a",), ("x-a-y",), ("q",), (None,)], "model string")
    got = {r.model: r.precision for r in relational.lookup(rows, "model", registry, "repo", "name", "precision", "default").collect()}
    assert got == {"org/a": "full", "x-a-y": "half", "q": "default", None: "default"}


def test_hot_hash_join(spark):
    docs = spark.createDataFrame([(1, "AA"), (2, "aa"), (3, ""), (4, None), (5, "bb")], "id int, hash string")
    chunks = spark.createDataFrame([(k, "aa") for k in range(500)] + [(900, "bb"), (901, "gone"), (902, None), (903, "")], "tiledb_id int, hash string")
    got = {r.document_id: r.n for r in relational.children_by_hash(chunks, docs).groupBy("document_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 500, 5: 1, None: 3}


def test_globs(spark):
    df = spark.createDataFrame([("a.bin",), ("b.txt",), ("skip.txt",)], "n string")
    kept = lambda allow, ignore: [r.n for r in df.where(relational.kept_by_globs(F.col("n"), allow, ignore)).collect()]
    assert kept(["*.txt"], ["skip*"]) == ["b.txt"] and kept([], []) == ["a.bin", "b.txt", "skip.txt"]


def test_every_word_is_laid_out(spark, tmp_path):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (3, 40, 95)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    placed = catalog.queries()["reading_order"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.page, r.line_no) for r in placed} == {(k, n // 40, n % 40) for k, t in enumerate(texts) for n in range(len(t.split()))}
    counts = {(r.doc_id, r.page): r.emitted + r.dropped for r in catalog.queries()["hocr"](spark, str(tmp_path)).collect()}
    assert counts == {(0, 0): 3, (1, 0): 40, (2, 0): 40, (2, 1): 40, (2, 2): 15}


def test_lines_of_several_pages(spark):
    box = lambda x, y: [[x, y], [x + 40.0, y], [x + 40.0, y + 8.0], [x, y + 8.0]]
    pages = {0: [box(60.0 * (k % 2), k // 2 * 10.0) for k in range(20)], 1: [box(0.0, 60.0), box(0.0, 0.0), box(0.0, 30.0)], 2: [[[0.0, 9.0], [5.0, 0.0], [9.0, 9.0]]]}
    df = spark.createDataFrame([(p, n, b) for p, boxes in pages.items() for n, b in enumerate(boxes)], "page int, line_no int, polygon array<array<double>>")
    got = {(r.page, r.line_no): r.position for r in reading.in_reading_order(df, ["page"]).collect()}
    for p, boxes in pages.items():
        order = reading.reading_order([np.array(b) for b in boxes]) or range(len(boxes))
        assert [n for n, _ in sorted(((n, got[p, n]) for n in range(len(boxes))), key=lambda x: x[1])] == list(order)


def test_crawl_and_limits(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.depth for r in web.crawl(links, seeds, catalog.checkpointed).collect()} == {"a": 0, "b": 1, "c": 1}
    assert web.crawl(links, seeds, catalog.checkpointed, limit=2).count() == 2
    statuses = [429, 429, 200, 429, 429, 429, 404, 429, 429]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(statuses)], "site string, seq int, status int")
    assert [(r.site, r.stopped_at) for r in web.rate_limited(df).collect()] == [("s", 8)]


def test_crawl_to_the_end(spark, data_dir):
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(55)], "url string, link string").coalesce(1)
    assert web.crawl(chain, spark.createDataFrame([("0",)], "url string"), catalog.checkpointed).count() == 56
    links: dict[str, set] = {}
    for r in web.links(catalog.pages_of(spark, data_dir)).collect():
        links.setdefault(r.url, set()).add(r.link)
    depth = new = {"https://docs.example/docs/1": 0}
    while new:
        new = {v: n + 1 for u, n in new.items() for v in links.get(u, ()) if v not in depth}
        depth = depth | new
    assert {r.url: r.depth for r in catalog.queries()["crawl"](spark, data_dir).collect()} == depth


def test_seeds(spark):
    text = "# x\n- [a](https://h.example/docs/a.md): y\n- [b](https://o.example/docs/b.md)\n- [c](https://h.example/other/c.md)\nno link"
    got = spark.createDataFrame([(text,)], "t string").select(web.seeds_of_index(F.col("t"), "h.example", "/docs")).first()[0]
    assert got == ["https://h.example/docs/a"]
    a = spark.createDataFrame([("u", 1), ("v", 2)], "url string, position int")
    b = spark.createDataFrame([("w", 1), ("u", 2)], "url string, position int")
    assert [r.url for r in web.merge_seeds(a, b).orderBy("position").collect()] == ["u", "v", "w"]


def test_config(tmp_path, spark):
    for bad in ({"chunk_size": 0}, {"chunk_overlap": 700}, {"contexts": 0}, {"similarity": 1.1}, {"document_types": "x"}, {"pipeline_preset": "x"}):
        with pytest.raises(ValueError):
            QueryConfig(**bad)
    assert QueryConfig(contexts="7").contexts == 7
    QueryConfig(similarity=0.5).save(tmp_path / "c.json")
    assert config.load_config(tmp_path / "c.json") == (QueryConfig(similarity=0.5), [])
    (tmp_path / "d.json").write_text('{"contexts": 9, "similarity": 5}')
    assert config.load_config(tmp_path / "d.json") == (QueryConfig(contexts=9), ["similarity"])
    assert config.load_config(tmp_path / "none.json")[1] == ["*"]
    (tmp_path / "c.yaml").write_text("database:\n  chunk_size: 900\n  contexts: '6'\n  similarity: 7\nother: 1\n")
    assert config.load_config(tmp_path / "c.yaml") == (QueryConfig(chunk_size=900, contexts=6), ["similarity"])
    (tmp_path / "broken.yaml").write_text("a: [")
    assert config.load_config(tmp_path / "broken.yaml")[1] == ["*"]
    assert config.PRESETS["normal"].on(8) == {"ingest_threads": 6, "ingest_processes": 4, "split_max_parallel_workers": 4, "tokenize_max_parallel_workers": 4, "split_worker_batch_size": 2000}
    assert config.PRESETS["low"].on(1)["ingest_threads"] == 4 and config.PRESETS["maximum"].on(64)["ingest_processes"] == 62 and config.PRESETS["maximum"].on(64)["split_max_parallel_workers"] == 0
    assert config.preflight(config.database_checks("ab", False, "m", 1)).startswith("Name") and config.preflight(config.database_checks("abc", True, "m", 1)).startswith("A vector")
    assert config.preflight(config.database_checks("abc", False, None, 1)).startswith("You") and config.preflight(config.database_checks("abc", False, "m", 0)).startswith("No") and config.preflight(config.database_checks("abc", False, "m", 3)) is None
    assert not config.valid_database_name("ab") and not config.valid_database_name("None") and config.valid_database_name("abc")
    assert config.preflight([(True, "a"), (False, "b"), (False, "c")]) == "b"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunking.fixed(docs).count() == 0 and chunking.headings(docs).count() == 0 and chunking.paged(docs).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert retrieval.topk_many(empty, empty, 3).count() == 0 and retrieval.topk_of(empty, 1, 3).count() == 0


def test_running_total_against_a_window(spark):
    rows = spark.range(2000).selectExpr("IF(id % 3 = 0, 'hot', IF(id % 7 = 0, NULL, concat('k', id % 5))) AS k", "pmod(id * 7919, 2003) AS at", "id % 4 AS v")
    from pyspark.sql import Window

    expected = rows.withColumn("total", F.sum("v").over(Window.partitionBy("k").orderBy("at"))).collect()
    got = relational.running_total(rows, ["k"], ["at"], F.floor(F.col("at") / 100), F.col("v"), "total").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert relational.running_total(rows.where("false"), ["k"], ["at"], F.col("at"), F.col("v"), "total").count() == 0


def test_history_in_blocks(spark, monkeypatch):
    from quillmesh.streaming import metrics

    df = spark.range(900).selectExpr("id AS sample_id", "IF(id % 3 < 2, 1, id % 5) AS session_id", "timestamp_micros(id * 300000000) AS sample_ts", "IF(id % 11 = 0, NULL, double(id % 17)) AS cpu_usage")
    whole = sorted(map(tuple, metrics.history(df, 20).collect()))
    for block in (25, 7):
        monkeypatch.setattr(metrics, "BLOCK", block)
        assert sorted(map(tuple, metrics.history(df, 20).collect())) == whole


def test_failing_batches(spark):
    def odd(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[len(t)] * 9 for t in texts]

    df = spark.createDataFrame([(k, "bad" if k == 5 else None if k == 6 else "ok") for k in range(12)], "doc_id int, text string").coalesce(1)
    rows = {r.doc_id: r for r in batching.tokenize_with(df, "doc_id", "text", odd, max_length=3, batch_size=4).collect()}
    assert [k for k in rows if rows[k].error] == [4, 5, 6, 7] and rows[5].error == "RuntimeError: no" and rows[0].input_ids == [2, 2, 2] and len(rows) == 12
    assert batching.tokenize_with(df.where("false"), "doc_id", "text", odd).count() == 0


def test_tries_and_saved_pages(spark):
    rows = [("a", 1, 500), ("a", 2, 200), ("b", 1, 429), ("b", 2, 404), ("b", 3, 503), ("b", 4, 200), ("c", 1, 200)]
    got = {r.url: (r.status, r.attempts, r.failed) for r in web.after_tries(spark.createDataFrame(rows, "url string, attempt int, status int")).collect()}
    assert got == {"a": (200, 2, False), "b": (503, 3, True), "c": (200, 1, False)}


def test_prefilter_fills_up(spark):
    vectors_ = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(10)], "vec_id long, embedding array<float>")
    docs = spark.createDataFrame([(k, "keep" if k > 6 else "drop", "document") for k in range(10)], "doc_id long, text string, document_type string")
    config = QueryConfig(contexts=3, similarity=0.0, search_term="keep")
    assert [r.doc_id for r in retrieval.search(vectors_, docs, 0, config).collect()] == []
    assert [r.doc_id for r in retrieval.search(vectors_, docs, 0, config, prefilter=True).orderBy("rank").collect()] == [7, 8, 9]


def test_registries(spark):
    sites = web.SiteRegistry()
    sites.register("https://www.a.example/docs/", "main")
    sites.register("https://a.example/docs/old", "body")
    rows = [("https://a.example/docs/x",), ("https://a.example/docs/old/y",), ("https://a.example/docs-new",), ("https://b.example/docs",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "u string").coalesce(1).select(sites.selector(F.col("u"))).collect()] == ["main", "body", None, None, None]
    with pytest.raises(KeyError):
        sites.register("https://a.example", "nothing")
    encoders = batching.EncoderRegistry()
    encoders.register("BGE", lambda model: lambda question: [float(len(question))])
    assert encoders.encoder("vendor/bge-small")("abc") == [3.0] and len(encoders.encoder(None)("abc")) == 64


def test_crawl_limit(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.createDataFrame([(str(k), str(j)) for k in range(40) for j in (2 * k + 1, 2 * k + 2)], "url string, link string")
    seeds = spark.createDataFrame([("0",)], "url string")
    whole = {r.url: r.depth for r in web.crawl(links, seeds, lambda df: df.checkpoint()).collect()}
    assert whole == {str(k): (k + 1).bit_length() - 1 for k in range(81)}
    some = web.crawl(links, seeds, lambda df: df.checkpoint(), limit=10).collect()
    assert len(some) == 10 and max(r.depth for r in some) == 3


def test_chunks_of_other_values(spark):
    lists = spark.createDataFrame([(1, ["a", None, "", "b"]), (2, []), (3, None)], "doc_id int, text array<string>")
    assert [(r.doc_id, r.chunk) for r in chunking.fixed(lists).collect()] == [(1, "a b")]
    numbers = spark.createDataFrame([(1, 12345), (2, None)], "doc_id int, text int")
    assert [r.chunk for r in chunking.fixed(numbers, size=2, overlap=0).orderBy("chunk_idx").collect()] == ["12", "34", "5"]
    assert [r.chunk for r in chunking.paged(lists).collect()] == ["a b"]
