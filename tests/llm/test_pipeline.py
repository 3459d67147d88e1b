"""The pipeline against a plain version of its stages."""

import corpus_pipeline
from shelfmark.llm import mixing, pii
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = []
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF).cache()
        stages.append({r.doc_id: r for r in table.collect()})
        assert table.columns == columns or name == "mixing"
    rules, classes, clean, redacted, mixed = stages

    assert set(rules) == {i for i, r in docs.items() if brute.kept(r.text)}
    want = brute.classes([(i, r.text) for i, r in rules.items()])
    assert set(classes) == {i for i, (_, c) in want.items() if c == i}
    assert set(clean) == {i for i, r in classes.items() if not any(x in r.text for x in items)}
    assert set(redacted) == set(clean)
    for i, r in redacted.items():
        assert r.text == pii.redact(clean[i].text, pii.find(clean[i].text)) and r.n_chars == len(r.text)
        assert not [s for s in brute.personal(r.text)]
    sizes = {i: len(brute.WORD.findall(r.text)) for i, r in redacted.items()}
    assert all(r.size == sizes[i] and 0 < r.taken <= 3 * r.size for i, r in mixed.items())
    for source in {r.source for r in redacted.values()}:
        taken = sum(r.taken for r in mixed.values() if r.source == source)
        assert abs(taken - next(r.target for r in mixed.values() if r.source == source)) <= 1
    assert mixing.MAX_EPOCHS == 3


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "taken"} <= set(out.columns) and out.count() > 50


def test_rows_without_ids_and_with_repeated_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    text = {k: " ".join(f"{k}{i % (37 + n)}" for i in range(80)) for n, k in enumerate("abcdefg")}
    rows = [(None, text["a"]), (5, text["a"]), (5, text["b"]), (None, text["c"]), (None, text["c"]), (6, text["d"]), (6, text["d"]), (None, f"{text['e']} {item} {text['f']}"), (7, f"{text['f']} {item} {text['g']}"), (7, text["g"]), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema).repartition(3).cache()
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    want = lambda keep: sorted((r for k, r in enumerate(rows) if k in keep), key=repr)

    assert plain(corpus_pipeline.near_duplicates(spark, docs, SF)) == want({1, 2, 3, 5, 7, 8, 9, 10, 11})
    assert plain(corpus_pipeline.decontaminated(spark, docs, SF)) == want(set(range(12)) - {7, 8})
    mixed = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert len(mixed) == 10 and all(r.size == len(r.text.split()) for r in mixed) and sum(r.taken for r in mixed) == round(mixed[0].target)


def settings_of_reads(spark):
    """Ways to cut the same files into other partitions, as executors that come and go do."""
    for n, most in (("3", "128m"), ("24", "128m"), ("1", "64k")):
        spark.conf.set("spark.sql.files.minPartitionNum", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        yield n
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_stay(spark, tmp_path):
    """However many partitions a read makes of the files, and whichever columns it reads."""
    spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(6).write.option("parquet.block.size", 1 << 18).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    seen = []
    for _ in settings_of_reads(spark):
        rows = corpus_pipeline.numbered(spark.read.parquet(str(tmp_path / "d")))
        seen += [{tuple(r) for r in rows.select(corpus_pipeline.ROW, *c).select(corpus_pipeline.ROW, "doc_id").collect()} for c in (["doc_id"], ["text", "n_chars", "doc_id"])]
    assert all(x == seen[0] for x in seen) and len({k for k, _ in seen[0]}) == docs.count() == len(seen[0])
    for other in (docs.repartition(3), docs.union(docs), docs.withColumn("_metadata", docs["doc_id"]), docs.limit(0)):
        rows = corpus_pipeline.numbered(other)
        assert rows.columns == [*other.columns, corpus_pipeline.ROW] and "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString() and rows.select(corpus_pipeline.ROW).distinct().count() == other.count()


def test_row_numbers_of_very_many_files(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.common, "FILE_NAMES", 3)
    rows = corpus_pipeline.numbered(spark.read.parquet(f"{SF}/documents.parquet"))
    seen = [{tuple(r) for r in rows.select(corpus_pipeline.ROW, "doc_id").collect()} for _ in settings_of_reads(spark)]
    assert len(seen[0]) == 200 and all(x == seen[0] for x in seen)


def test_stages_keep_their_rows_when_reads_change(spark, monkeypatch):
    """The number of partitions changes between a stage's search and its join back to the documents."""
    plain = {name: sorted(map(repr, stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect())) for name, stage in corpus_pipeline.STAGES}
    stored, ways = corpus_pipeline.common.stored, []

    def moved(df):
        if not ways:
            ways.extend(["1", "7", "13", "40"])
        spark.conf.set("spark.sql.files.minPartitionNum", ways.pop())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        return stored(df)

    monkeypatch.setattr(corpus_pipeline.common, "stored", moved)
    monkeypatch.setattr(corpus_pipeline.common, "checkpointed", moved)
    try:
        for name, stage in corpus_pipeline.STAGES:
            assert sorted(map(repr, stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect())) == plain[name], name
    finally:
        for k in ("minPartitionNum", "maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{k}")


def test_what_is_stored_goes_with_its_run(spark):
    """Two threads at once: the end of one's block leaves the other's tables."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    common, wait = corpus_pipeline.common, Barrier(2, timeout=120)

    def run(n):
        with common.temporary(spark):
            df = common.stored(spark.range(n))
            wait.wait()
            if n == 9:
                wait.wait()
                return df.count(), df.inputFiles()
            files = df.inputFiles()
        wait.wait()
        return n, files

    with ThreadPoolExecutor(2) as pool:
        (a, files), (b, _) = pool.map(run, [5, 9])
    assert (a, b) == (5, 9)
    import os

    assert not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in files)
    assert common.stored(spark.range(3)).count() == 3


def test_stages_on_odd_and_empty_tables(spark):
    """Empty, null and very long texts, clashing and extra columns, and no rows at all."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, None, "s", None, 5, "x"), (2, "", "en", None, 0, 6, None), (3, long, "en", "s", len(long), 7, "y"), (4, long, "en", "s", len(long), 8, "z"), (5, " ".join(f"v{i}" for i in range(90)), None, None, 9, 9, "y")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, target string")
    want = [{3, 4, 5}, {1, 2, 3, 5}, {1, 2, 3, 4, 5}, {1, 2, 3, 4, 5}, {3, 4, 5}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        got, none = stage(spark, odd, SF), stage(spark, odd.limit(0), SF)
        assert {r.doc_id for r in got.collect()} == ids and none.count() == 0, name
        assert set(odd.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
        assert name == "mixing" or got.columns == odd.columns
    assert {r.doc_id: r.size for r in got.collect()} == {3: 60_000, 4: 60_000, 5: 90}
