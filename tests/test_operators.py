"""Operators on small hand-made tables."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfmark.functions.arabic import unicode_tokens
from shelfmark.operators import catalog, chat, fusion, pages, vector
from shelfmark.operators.bm25 import Bm25Config, Bm25Model, fit_per_request, numbered

CONFIG = Bm25Config(charset="unicode")


@pytest.fixture(scope="module")
def model(spark):
    return Bm25Model.fit(spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "")], "doc_id long, text string"), CONFIG)


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")


def test_bm25_scores(spark, model):
    got = {(r.query_id, r.doc_id): round(r.score, 6) for r in model.scores(ask(spark, "a", "b", "a b b", "z")).collect()}
    assert got == {(0, 0): 1.114579, (1, 0): 0.345591, (1, 1): 0.431196, (2, 0): 1.805761, (2, 1): 0.862392}
    assert {r.term: r.idx for r in model.terms.collect()} == {"a": 0, "b": 1, "c": 2} and model.vocab_size() == 3
    assert {r.term: r.idf and round(r.idf, 6) for r in model.idf(["a", "b", "z"]).collect()} == {"a": 0.980829, "b": 0.470004, "z": None}


def test_bm25_vectors(spark, model):
    docs = {r.doc_id: {k: round(v, 6) for k, v in (r.sparse_vector or {}).items()} for r in model.encode_documents().collect()}
    assert docs == {0: {0: 1.114579, 1: 0.345591}, 1: {1: 0.431196, 2: 0.899843}, 2: {}}
    q = model.encode_queries(ask(spark, "a b b")).first().sparse_vector
    assert {k: round(v, 6) for k, v in q.items()} == {0: 0.980829, 1: 0.940007}


def test_bm25_fills_up_and_saves(spark, model, tmp_path):
    assert [(r.doc_id, r.score > 0) for r in model.search_filled(ask(spark, "c"), 3).orderBy("rank").collect()] == [(1, True), (0, False), (2, False)]
    model.save(str(tmp_path / "m"))
    again = Bm25Model.load(spark, str(tmp_path / "m"))
    assert again.config == CONFIG and sorted(map(tuple, again.terms.collect())) == sorted(map(tuple, model.terms.collect()))
    with pytest.raises(ValueError):
        Bm25Model.fit(spark.createDataFrame([], "doc_id long, text string"))


def test_fit_per_request(spark):
    texts = spark.createDataFrame([("r", 1, "a b"), ("r", 2, "b"), ("s", 1, "b")], "request_id string, text_id int, text string")
    got = {(r.request_id, r.text_id): r.sparse_vector for r in fit_per_request(texts, CONFIG).collect()}
    assert set(got[("r", 1)]) == {0, 1} and math.isclose(got[("s", 1)][0], math.log((1 - 1 + 0.5) / 1.5 + 1))


def test_numbering(spark):
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("t"))
    assert [r.n for r in numbered(rows, "t", "n").orderBy("t").collect()] == list(range(1000))


def test_dense_paths_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in vector.METRICS:
        a = vector.dense_top_k(rows.repartition(5), asked, 7, metric).select("query_id", "id", "rank").collect()
        b = vector.dense_top_k_columns(rows, asked, 7, metric).select("query_id", "id", "rank").collect()
        assert sorted(a) == sorted(b)
    best = {(r.query_id, r.rank): r.id for r in vector.dense_top_k(rows, asked, 5).collect()}
    more = {(r.query_id, r.rank): r.id for r in vector.dense_top_k(rows, asked, 9).collect()}
    assert all(more[k] == v for k, v in best.items())
    assert vector.dense_top_k(rows, asked.limit(0), 3).count() == 0 and vector.dense_top_k(rows.limit(0), asked, 3).count() == 0


def test_null_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, embedding array<float>")
    for search in (vector.dense_top_k, vector.dense_top_k_columns):
        assert sorted((r.query_id, r.id) for r in search(rows, asked, 5, "cosine").collect()) == [(1, 1), (1, 4)]
        assert sorted((r.query_id, r.id) for r in search(rows, asked, 5).collect()) == [(q, i) for q in (1, 3) for i in (1, 3, 4)]


def test_query_blocks(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = rows.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(vector.dense_top_k(rows, asked, 3).collect())
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    assert sorted(vector.dense_top_k(rows, asked, 3).collect()) == whole


def test_query_blocks_by_columns(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = rows.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in ("ip", "l2"):
        whole = sorted(vector.dense_top_k(rows, asked, 3, metric).select("query_id", "id", "rank").collect())
        with monkeypatch.context() as m:
            m.setattr(vector, "QUERY_BLOCK", 7)
            got = sorted(vector.dense_top_k_columns(rows, asked, 3, metric).select("query_id", "id", "rank").collect())
        assert len(got) == 90 and got == whole
    assert vector.dense_top_k_columns(rows, asked.limit(0), 3).count() == 0


def test_deep_tree(spark):
    rows = spark.createDataFrame([(i, i - 1) for i in range(1, 121)], "id long, parent long")
    assert {r.id: r.depth for r in pages.depths(rows).collect()} == {i: i - 1 for i in range(1, 121)}


def test_cross_query_rrf(spark):
    rows = [("r", 0, i, k + 1, float(d)) for k, (i, d) in enumerate([(1, 3), (2, 2), (3, 1)])] + [("r", 1, i, k + 1, float(d)) for k, (i, d) in enumerate([(2, 1), (4, 1)])]
    hits = spark.createDataFrame(rows, "request_id string, passage_id int, id int, rank int, distance double")
    got = [(r.id, round(r.score, 6), r.kept.distance) for r in fusion.cross_query_rrf(hits, 10).orderBy("rank").collect()]
    assert got == [(2, 0.032522, 1.0), (1, 0.016393, 3.0), (4, 0.016129, 1.0), (3, 0.015873, 1.0)]


def test_weighted_fusion(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1, "dense"), (1, 2, 0.5, 2, "dense"), (1, 2, 8.0, 1, "sparse")], "query_id int, id int, score double, rank int, leg string")
    assert [(r.id, r.score) for r in fusion.weighted(hits, 5, {"dense": 1.0, "sparse": 0.5}).orderBy("rank").collect()] == [(2, 4.5), (1, 0.9)]
    assert [(r.id, r.score) for r in fusion.weighted(hits, 5, {"dense": 1.0, "sparse": 0.5}, "minmax").orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]


@pytest.mark.parametrize("bad", [lambda: fusion.check_ranker("RRF", []), lambda: fusion.check_ranker("RRF", [0]), lambda: fusion.check_ranker("Weighted", [0.5]), lambda: fusion.check_ranker("Weighted", [0.5, 2]), lambda: fusion.check_ranker("x", []), lambda: vector.check_k(0), lambda: vector.check_k(101), lambda: fusion.check_fields(["id", "nope"]), lambda: fusion.check_partitions(["x"], ["y"]), lambda: chat.check_query("  "), lambda: chat.check_texts([" "]), lambda: chat.check_role("system"), lambda: chat.check_settings(top_k=101), lambda: chat.check_settings(temperature=2.1), lambda: chat.check_settings(max_tokens=0), lambda: fusion.check_embeddings([]), lambda: fusion.check_embeddings([{"dense": [1.0]}] * 11), lambda: fusion.check_embeddings([{}])])
def test_requests_that_are_refused(bad):
    with pytest.raises(ValueError):
        bad()


def test_alignment(spark):
    a, b = fusion.aligned(F.array(*(F.lit(i) for i in range(3))), F.array(F.lit(1)))
    assert tuple(spark.range(1).select(a, b).first()) == ([0], [1])


def test_pages_give_all_rows_once(spark):
    rows = spark.range(53).select(F.col("id"), (F.col("id") % 4).alias("name"))
    seen = [r.id for n in range(1, 7) for r in catalog.page(rows, [F.asc("name"), F.asc("id")], n, 10).collect()]
    assert sorted(seen) == list(range(53))
    assert {(r.total, r.pages) for r in catalog.page_with_total(rows, [F.asc("id")], 6, 10).collect()} == {(53, 6)}
    with pytest.raises(ValueError):
        catalog.page(rows, [F.asc("id")], 0)


def test_keyset_walks_ties(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([5, 5, 5, 4, 4, 1])], "id int, at int")
    seen, cursor = [], None
    while True:
        got = catalog.keyset_page(rows, "at", "id", 1, cursor).collect()
        seen += [r.id for r in got]
        if not got or not got[0].has_more:
            break
        cursor = (got[-1].next_cursor, got[-1].id)
    assert seen == [2, 1, 0, 4, 3, 5]
    assert [r.id for r in catalog.keyset_page(rows, "at", "id", 1, (5, 2), legacy=True).collect()] == [4]


def test_seek(spark):
    got = catalog.seek(spark.range(20).withColumnRenamed("id", "p"), "p", 15, 3).collect()
    assert [(r.p, r.offset, r.total) for r in got] == [(15, 15, 20), (16, 15, 20), (17, 15, 20)]


def test_as_of(spark):
    toc = spark.createDataFrame([(1, 1, 0), (2, 4, 1), (3, 4, 2), (4, 9, 3)], "id int, page_id int, pos int")
    probes = spark.createDataFrame([(10, 6), (11, 0), (12, 4), (13, 99)], "k int, active int")
    assert {r.k: r.entry for r in pages.as_of(probes, toc, "k", "active").collect()} == {10: 2, 11: None, 12: 2, 13: 4}


def test_islands_and_groups(spark):
    rows = spark.createDataFrame([(1, i, n, t, f"<div>{i}</div>") for i, (n, t) in enumerate([(5, "A"), (5, ""), (6, "A"), (5, "B")])], "book_id int, page_id int, page_num int, part_title string, display_elem string")
    got = [(r.page_num, r.part_title, r.n_pages, r.show_title, r.html) for r in pages.page_groups(rows).orderBy("island").collect()]
    assert got == [(5, "A", 2, True, "<div>0</div><br><br><div>1</div>"), (6, "A", 1, False, "<div>2</div>"), (5, "B", 1, True, "<div>3</div>")]
    nulls = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "x")], "k int, o int, v string")
    assert [r.island for r in pages.islands(nulls, "k", "o", "v").orderBy("o").collect()] == [0, 0, 1]


def test_tree(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 99), (4, 2)], "id int, parent int")
    assert {r.id: (r.root, r.parent_id) for r in pages.tree(rows).collect()} == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 2)}
    assert {r.id: (r.depth, r.path) for r in pages.depths(rows).collect()} == {1: (0, "1"), 2: (1, "1/2"), 3: (0, "3"), 4: (2, "1/2/4")}


def test_chunks_cover_all_sentences(spark):
    body = " ".join(f"S{i} one two three." for i in range(40))
    got = pages.chunks(spark.createDataFrame([(1, body)], "doc_id int, text string"), most=20, overlap=2).orderBy("chunk").collect()
    assert len(got) > 5 and all(f"S{i} one" in " ".join(r.text for r in got) for i in range(40))
    for a, b in zip(got, got[1:]):
        assert b.text.startswith(" ".join(a.text.split(". ")[-2:]).split()[0])


def test_budget(spark):
    rows = spark.createDataFrame([(1, i, 100_000) for i in range(7)] + [(2, i, 10) for i in range(3)], "c int, i int, n int")
    left = chat.budgeted(rows, "c", "i", F.col("n"))
    assert sorted((r.c, r.i) for r in left.collect()) == [(1, 4), (1, 5), (1, 6), (2, 0), (2, 1), (2, 2)]


def test_categories(spark):
    tree = spark.createDataFrame([("p", 0, "x"), ("q", 0, "x"), ("q", 1, "y")], "parent string, pos int, leaf string")
    names = spark.createDataFrame([("p",), ("q",), ("none",)], "name string")
    assert sorted(r.leaf for r in catalog.expanded(names, "name", tree).collect()) == ["x", "x", "y"]


def test_state_changes(spark):
    heads = spark.createDataFrame([("a", "u", "T", 1, 1)], "id string, user_id string, title string, created_at int, updated_at int")
    turns = spark.createDataFrame([("a", "m1", "hi", 5)], "conversation_id string, id string, content string, created_at int")
    heads, turns = chat.create_conversation(heads, turns, {"id": "b", "user_id": "v", "created_at": 2, "updated_at": 2}, [{"id": "m2", "content": "x", "created_at": 9}])
    touched = {r.id: (r.title, r.updated_at) for r in chat.touch(heads, turns).collect()}
    assert touched == {"a": ("T", 5), "b": (chat.DEFAULT_TITLE, 9)}
    assert {r.id: r.title for r in chat.set_title(heads, "b", "New").collect()} == {"a": "T", "b": "New"}
    a, b = chat.delete_conversations(heads, turns, spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in a.collect()] == ["b"] and [r.id for r in b.collect()] == ["m2"]
    assert chat.owned(heads, "a", "u").count() == 1
    with pytest.raises(LookupError):
        chat.owned(heads, "z", "u")
    with pytest.raises(PermissionError):
        chat.owned(heads, "a", "v")


def test_selection(spark):
    lit = lambda *v: F.array(*(F.lit(x) for x in v))
    row = spark.range(1).select(catalog.toggled(lit(1, 2), F.lit(2)), catalog.toggled(lit(1), F.lit(2)), catalog.selection_state(lit(1, 2), lit(1, 2))).first()
    assert row[0] == [1] and row[1] == [1, 2] and tuple(row[2]) == (2, True, True)


def test_plans_push_down_and_limit_groups(spark):
    """Filters reach the scan, only needed columns are read, and top-k limits groups before the shuffle."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = rows.where(F.col("lang").isin("de")).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan and "text" not in plan.split("ReadSchema")[1]
    counted = rows.select("doc_id", F.explode(unicode_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").count()
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count")))).where("r <= 3")
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_segments(spark):
    messages = spark.createDataFrame([(1, "x [1, 9] [1] y [8] z"), (2, "[9]"), (3, None), (4, "plain"), (5, "")], "m long, content string")
    chunks = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")

    def parts(keep):
        got = chat.segmented(messages, "m", "content", chunks, keep_unresolved=keep).orderBy("m", "part").collect()
        return [(r.m, r.text, r.ids, [s.name for s in r.sources] if r.ids else None) for r in got]

    assert parts(False) == [(1, "x ", None, None), (1, None, [1, 9, 1], ["one", "one"]), (1, " y ", None, None), (1, " z", None, None), (4, "plain", None, None)]
    assert [p for p in parts(True) if p not in parts(False)] == [(1, None, [8], []), (2, None, [9], [])]
