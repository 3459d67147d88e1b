"""Stored indexes, scans of groups that no single task holds, and trees by pointer doubling."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import bm25, chat, pages, scans, vector
from shelfmark.operators.blockmax import BlockIndex
from shelfmark.plans import retrieval


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- vectors ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_stored_index(spark, sf):
    rows, asked = retrieval._vectors(spark, f"/root/testdata/{sf}")
    best = {(r.query_id, r.id) for r in vector.dense_top_k(rows, asked, 10).collect()}
    index = vector.InvertedFile.build(rows)
    found = {(r.query_id, r.id) for r in index.search(asked, 10).collect()}
    assert len(best & found) / len(best) >= 0.9
    assert {(r.query_id, r.id) for r in index.search(asked, 10, share=0.2, exact=True).collect()} == best


def clustered(spark):
    """Twenty tight clusters, some null vectors, and two queries."""
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (20, 8))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    rows = [(i, (middle[i % 20] + rng.normal(0, 0.01, 8)).tolist()) for i in range(1000)] + [(5000, None), (5001, None)]
    asked = [(0, middle[3].tolist()), (1, middle[7].tolist()), (2, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), spark.createDataFrame(asked, "query_id long, embedding array<double>")


def test_searches_read_the_cells_that_they_probe(spark, tmp_path):
    rows, asked = clustered(spark)
    vector.InvertedFile.build(rows, str(tmp_path / "index"), cells=20)
    index = vector.InvertedFile(spark, str(tmp_path / "index"))  # opened again
    assert index.sizes.sum() == 1000 and len(index.names) <= 20
    best = sorted(tuple(r) for r in vector.dense_top_k(rows, asked, 10).collect())
    probed = []
    read = index.probed
    index.probed = lambda cells: probed.append(read(cells)) or probed[-1]
    assert sorted(tuple(r) for r in index.search(asked, 10, share=0.04, exact=True).collect()) == best
    for df in probed:
        assert "PartitionFilters: [" in plan_of(df) and "cell" in plan_of(df).split("PartitionFilters: [")[1].split("]")[0]
    folders = {r[0].split("cell=")[1].split("/")[0] for df in probed for r in df.select(F.input_file_name()).distinct().collect()}
    assert len(folders) <= 8  # of 20: two queries, each with its cell and those that could be as good


def test_stored_index_of_few_vectors(spark):
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    for rows, want in (([], []), ([(4, None)], []), ([(4, [0.5, 0.5])], [(0, 4, 0.5, 1)]), ([(4, [0.5, 0.5])] * 3, [(0, 4, 0.5, 1), (0, 4, 0.5, 2), (0, 4, 0.5, 3)])):
        index = vector.InvertedFile.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert [tuple(r) for r in index.search(asked, 5).orderBy("rank").collect()] == want
        assert [tuple(r) for r in index.search(asked, 5, exact=True).orderBy("rank").collect()] == want


def test_best_of_many_ties():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(0, 60)
        score, names = rng.integers(0, 4, n).astype(float), rng.permutation(n)
        score[rng.random(n) < 0.1] = np.nan
        want = sorted((i for i in range(n) if not np.isnan(score[i])), key=lambda i: (-score[i], names[i]))[:5]
        assert vector._kept(names, score, 5).tolist() == want


# --- postings in blocks -------------------------------------------------------------------------------------------------


def asked_and_postings(spark, seed, n_docs=600, n_terms=30):
    rng = random.Random(seed)
    postings = [(d, f"t{t}", round(rng.random() ** 4 * 5 + 0.01, 3)) for d in range(n_docs) for t in rng.sample(range(n_terms), rng.randint(1, 8))]
    asked = [(q, f"t{t}", round(rng.random() + 0.1, 2)) for q in range(12) for t in rng.sample(range(n_terms + 5), rng.randint(1, 5))]
    return spark.createDataFrame(asked, "query_id long, term string, weight double"), spark.createDataFrame(postings, "id long, term string, weight double")


@pytest.mark.parametrize(("seed", "block_docs"), [(1, 4), (2, 16), (3, 1000)])
def test_block_search_is_exact(spark, seed, block_docs):
    asked, postings = asked_and_postings(spark, seed)
    index = BlockIndex.build(postings, block_docs=block_docs)
    assert sorted(map(tuple, index.search(asked, 5).collect())) == sorted(map(tuple, vector.sparse_top_k(postings, asked, 5).collect()))
    counts = index.read_counts(asked, 5).first()
    held = postings.join(asked.drop("weight"), "term").count()
    assert counts.postings == held and counts.read <= held and (block_docs > 4 or counts.read < 0.5 * held)


def test_block_search_with_few_documents_and_none(spark):
    asked, postings = asked_and_postings(spark, 4, n_docs=3)
    index = BlockIndex.build(postings)
    assert sorted(map(tuple, index.search(asked, 50).collect())) == sorted(map(tuple, vector.sparse_top_k(postings, asked, 50).collect()))
    assert BlockIndex.build(postings.limit(0)).search(asked, 5).count() == 0 == index.search(asked.limit(0), 5).count()


def test_block_search_reads_fewer_postings_of_the_corpus(spark):
    model = retrieval._model(spark, "/root/testdata/sf0.01").kept()
    asked = model.query_terms(retrieval._asked(spark, "/root/testdata/sf0.01")).select("query_id", "term", F.col("qtf").cast("double").alias("weight"))
    counts = BlockIndex.build(model.weights(), block_docs=8).read_counts(asked, 3).first()
    assert counts.read < 0.75 * counts.postings


def test_kept_model_is_the_same(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "doc_id long, text string")
    plain = bm25.Bm25Model.fit(docs, bm25.Bm25Config(charset="unicode"))
    kept = plain.kept()
    for name in ("terms", "postings", "stats"):
        columns = sorted(getattr(plain, name).columns)
        assert sorted(map(tuple, getattr(kept, name).select(*columns).collect())) == sorted(map(tuple, getattr(plain, name).select(*columns).collect()))


# --- scans --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def one_book(spark):
    """One key with nearly all rows, a null key, ties in the order, null values."""
    rng = random.Random(7)
    rows = [(1, rng.randrange(3000), rng.choice(["a", "a", "a", "b", None]), rng.randrange(100), i) for i in range(4000)]
    rows += [(k, rng.randrange(50), rng.choice(["a", "b"]), 1, 10_000 + i) for i, k in enumerate([2, 3, None] * 20)] + [(4, None, "a", 2, 20_000)]
    return spark.createDataFrame(rows, "book long, page int, mark string, n int, tie int").repartition(3)


def test_scans_equal_windows(spark, one_book):
    window = Window.partitionBy("book").orderBy("page", "tie")
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    want = one_book.select(
        "tie", F.sum("n").over(so_far).alias("total"), F.count("*").over(so_far).alias("place"), F.last("mark", ignorenulls=True).over(so_far).alias("last"), F.lag("mark").over(window).alias("before"), F.row_number().over(window).alias("r")
    )
    for n in (1, 2, 7, 64):
        walked = scans.running(scans.dealt(one_book, "page", n), ["book"], ["page", "tie"], {"total": F.col("n").cast("long"), "place": F.lit(1).cast("long")}, {"last": F.col("mark")}, {"before": "mark"})
        got = walked.select("tie", "total", "place", "last", "before.v", F.col("before").isNull().alias("first"))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([(*tuple(r)[:5], r.r == 1) for r in want.collect()], key=repr)


def test_one_key_is_spread(spark, one_book):
    dealt = scans.dealt(one_book.where("book = 1"), "page", 16)
    sizes = [r["count"] for r in dealt.groupBy(scans.RANGE).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 2 * 4000 / 16
    for kind, c in (("string", "lpad(page, 6, '0')"), ("timestamp", "timestamp_seconds(page)"), ("date", "date_add(date'2020-01-01', page)"), ("double", "page / 7")):
        ranged = scans.dealt(one_book.where("book = 1").select(F.expr(c).cast(kind).alias("o")), "o", 8).groupBy(scans.RANGE).agg(F.min("o").alias("low"), F.max("o").alias("high"), F.count("*").alias("n")).orderBy(scans.RANGE).collect()
        assert all(a.high < b.low for a, b in zip(ranged, ranged[1:])) and len(ranged) >= (7 if kind != "string" else 1)


def test_islands_of_one_book(spark, one_book):
    window = Window.partitionBy("book").orderBy("page", "mark")
    rows = one_book.dropDuplicates(["book", "page", "mark"])
    changed = (~F.lag("mark").over(window).eqNullSafe(F.col("mark")) | (F.row_number().over(window) == 1)).cast("long")
    want = rows.withColumn("c", changed).select("tie", (F.sum("c").over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("island"))
    rows = rows.cache()
    assert sorted(map(tuple, pages.islands(rows, "book", "page", "mark").select("tie", "island").collect())) == sorted(map(tuple, want.collect()))


def test_islands_split_only_large_keys(spark, one_book, monkeypatch):
    """Small keys are whole: one shuffle, into as many tasks as rows need, and nothing passed on. Only a large key is cut."""
    small = spark.range(3000).select(F.expr("nullif(id div 4, 9)").alias("book"), (F.col("id") % 4).alias("page"), F.expr("id * 7 % 3").alias("mark"))
    plan = pages.islands(small, "book", "page", "mark")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    monkeypatch.setattr(scans, "TASK_ROWS", 100)
    runs = pages.islands(small, "book", "page", "mark")
    assert max(r["count"] for r in runs.groupBy(F.spark_partition_id()).count().collect()) < 3 * 100
    assert pages.islands(small.limit(0), "book", "page", "mark").count() == 0
    assert scans.sized(small, ["book"]) == (30, None)
    with monkeypatch.context() as bounds:  # no more parts than go unsorted, until these are too large
        bounds.setattr(scans, "UNSORTED", 8)
        for most, parts in ((1000, 8), (200, 15)):
            bounds.setattr(scans, "MOST_ROWS", most)
            assert scans.sized(small, ["book"]) == (parts, None)
    tasks, large = scans.sized(one_book, ["book"])
    assert tasks == 41 and [r.book for r in one_book.where(large).select("book").distinct().collect()] == [1]
    window = Window.partitionBy("book").orderBy("page", "mark")
    for rows in (small, one_book.select("book", "page", "mark").distinct()):
        changed = (~F.lag("mark").over(window).eqNullSafe(F.col("mark")) | (F.row_number().over(window) == 1)).cast("long")
        want = rows.withColumn("c", changed).select("book", "page", "mark", (F.sum("c").over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("island"))
        got = pages.islands(rows, "book", "page", "mark")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_as_of_in_one_book(spark):
    rng = random.Random(5)
    entries = [(i, rng.randrange(2000), i) for i in range(300)]
    probes = [(k, rng.randrange(-5, 2100)) for k in range(3000)]
    got = pages.as_of(spark.createDataFrame(probes, "k long, active int"), spark.createDataFrame(entries, "id int, page_id int, pos int"), "k", "active").collect()
    best = lambda a: min(((-p, pos, i) for i, p, pos in entries if p <= a), default=(0, 0, None))[2]
    assert {r.k: r.entry for r in got} == {k: best(a) for k, a in probes}


def test_budget_of_one_conversation(spark):
    rng = random.Random(2)
    rows = [(c, t, "x" * rng.randrange(0, 40)) for c, n in ((1, 301), (2, 4), (3, 3), (None, 9)) for t in range(n)]
    got = chat.budgeted(spark.createDataFrame(rows, "conv long, turn int, content string"), "conv", "turn", chat.chat_size(F.col("content")), budget=200)
    want = []
    for c in (1, 2, 3, None):
        own = [r for r in rows if r[0] == c]
        cut = next((i for i in range(0, len(own), 2) if sum(len(r[2]) for r in own[i:]) <= 200 or i >= len(own) - 4), 0)
        want += own[cut:]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


# --- trees --------------------------------------------------------------------------------------------------------------


def test_depths_of_deep_chains_and_cycles(spark):
    """Ten chains of 10,000 entries, whose depth is beyond any recursion limit, and two cycles with what hangs on them."""
    chain = spark.range(100_000).select((F.col("id") + 1).alias("id"), F.when(F.col("id") % 10_000 == 0, 0).otherwise(F.col("id")).alias("parent"))
    loops = spark.createDataFrame([(200_001, 200_002), (200_002, 200_001), (200_003, 200_002), (200_004, 200_004)], "id long, parent long")
    got = pages.depths(chain.unionByName(loops), path=False).agg(F.count("*").alias("n"), F.max("depth").alias("most"), F.sum((F.col("depth") == F.pmod(F.col("id") - 1, F.lit(10_000))).cast("int")).alias("right")).first()
    assert (got.n, got.most, got.right) == (100_000, 9_999, 100_000)
    assert {r.id for r in pages.cycles(loops).collect()} == {200_001, 200_002, 200_003, 200_004}
    few = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (8, 9), (9, 8)], "id long, parent long")
    assert {r.id: (r.depth, r.path) for r in pages.depths(few).collect()} == {1: (0, "1"), 2: (1, "1/2"), 3: (2, "1/2/3")}
    assert pages.depths(few.limit(0)).count() == 0 == pages.cycles(few.where("id < 4")).count()


def test_scores_of_a_task_are_tiles(spark, monkeypatch):
    """However many vectors and queries: no more than TILE scores at once, k rows a query and task, and no row for each pair."""
    rng = np.random.default_rng(8)
    v, q, seen = rng.normal(size=(900, 4)), rng.normal(size=(40, 4)), []
    monkeypatch.setattr(vector, "TILE", 1000)
    tile = vector._Best._tile
    monkeypatch.setattr(vector._Best, "_tile", lambda self, names, v, asked: (seen.append(len(names) * len(asked)), tile(self, names, v, asked)))
    for metric in vector.METRICS:
        best = vector._Best(np.arange(40), q, 3, metric)
        for part in np.array_split(np.arange(900), 4):
            best.add(part, v[part])
        score = {"ip": q @ v.T, "l2": -np.linalg.norm(q[:, None] - v[None], axis=2), "cosine": q @ v.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)}[metric]
        assert best.found().column("id").to_pylist() == np.argsort(-score, axis=1)[:, :3].ravel().tolist()
    assert max(seen) <= 1000 and len(seen) >= 3 * 36
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:50])], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    assert "NestedLoop" not in vector.dense_top_k_columns(rows, asked, 2)._jdf.queryExecution().executedPlan().toString()
    odd = rows.unionByName(spark.createDataFrame([(90, [float("nan"), 1.0, 1.0, 1.0]), (91, [None, 1.0, 1.0, 1.0])], rows.schema))
    assert [r.id for r in vector.dense_top_k_columns(odd, asked, 1).collect()] == [90] * 3 and 90 not in {r.id for r in vector.dense_top_k(odd, asked, 9).collect()}


def _written(monkeypatch, module):
    """The tables that a module stores from here on."""
    seen, store = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df: (seen.append(df.columns), store(df))[1])
    return seen


def test_costly_steps_run_once(spark, monkeypatch):
    """Sentences and cut blocks of chunks, hits that fill up, weights of a sparse search: written, as they are read again."""
    seen = _written(monkeypatch, pages)
    docs = spark.createDataFrame([(1, "One two. Three four! Five six?"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pages.chunks(docs).collect()] == ["One two. Three four! Five six?"]
    assert ["doc_id", "at", "sentence", "n"] in seen and ["doc_id", "at", "sentence", "n", "starts"] in seen
    seen = _written(monkeypatch, bm25)
    model = bm25.Bm25Model.fit(docs, bm25.Bm25Config(charset="unicode"))
    asked = spark.createDataFrame([(7, "two"), (8, "none")], "query_id long, text string")
    assert sorted((r.query_id, r.doc_id) for r in model.search_filled(asked, 2).collect()) == [(7, 1), (7, 2), (8, 1), (8, 2)]
    assert ["query_id", "doc_id", "score"] in seen


def test_block_index_is_one_shuffle(spark, monkeypatch):
    """Weights are dealt by term once, which counts, join and blocks share; postings are not sorted to meet their idf."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common") for i in range(50)], "doc_id long, text string")
    weights = bm25.Bm25Model.fit(docs, bm25.Bm25Config(charset="unicode")).kept().weights()
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    asked = spark.createDataFrame([(1, "w1", 1.0), (1, "common", 1.0)], "query_id long, term string, weight double")
    found = BlockIndex.build(weights, block_docs=4, n_docs=50).search(asked, 5)
    assert sorted(found.collect()) == sorted(BlockIndex.build(weights, block_docs=4).search(asked, 5).collect())
