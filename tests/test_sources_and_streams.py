"""Files in and out, and replies as streams."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.sources import files
from shelfmark.streaming import replies


def test_ndjson_skips_what_it_cannot_read(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.txt").write_text('{"id": 1, "name": "é"}\n\n{broken\n   \n{"id": 2}\n', encoding="utf-8")
    rows = files.read_ndjson(spark, str(path), "id long, name string")
    assert sorted(map(tuple, rows.collect())) == [(1, "é"), (2, None)]
    files.write_ndjson(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_ndjson(spark, str(tmp_path / "out"), "id long, name string").collect())) == [(1, "é"), (2, None)]
    assert any("é" in p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))


def test_stream_in_pieces(spark):
    rows = spark.createDataFrame([("a", 0, '{"x'), ("a", 1, '":1}\n\n{"x":2}'), ("b", 0, "q\n")], "id string, o int, chunk string")
    got = [(r.id, r.value) for r in files.split_stream(rows, "id", "o").orderBy("id", "line_no").collect()]
    assert got == [("a", '{"x":1}'), ("a", '{"x":2}'), ("b", "q")]


def test_keyed_json(spark):
    lines = spark.createDataFrame([('{"3": {"name": "n", "x": 1}, "4": {"name": "m"}}',)], "value string")
    assert sorted(map(tuple, files.keyed_json(lines, "struct<name:string,x:int>").collect())) == [(3, "n", 1), (4, "m", None)]


def test_request_csv(spark, tmp_path):
    (tmp_path / "what is it.csv").write_text('score,id,text,page_num_range\n0.5,1,"a, b","[3, 4]"\n0.9,2,c,"[5]"\n', encoding="utf-8")
    rows = files.read_request_csv(spark, str(tmp_path))
    assert {(r.query, r.id, tuple(r.page_num_range)) for r in rows.collect()} == {("what is it", 1, (3, 4)), ("what is it", 2, (5,))}
    doc = files.requests(rows).first()
    assert doc.query == "what is it" and doc.value.index('"id":2') < doc.value.index('"id":1')


def test_collection_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "t"), (2, "y", "u"), (3, "x", "v")], "id long, category string, text string")
    files.write_collection(rows, str(tmp_path))
    assert files.read_collection(spark, str(tmp_path), ["x"]).count() == 2 and files.read_collection(spark, str(tmp_path)).count() == 3
    plan = files.read_collection(spark, str(tmp_path), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan
    with pytest.raises(ValueError):
        files.read_collection(spark, str(tmp_path), ["z"])
    files.write_collection(rows.limit(0), str(tmp_path), name="none")
    assert files.partition_names(spark, str(tmp_path), "none") == ["_default"]


def test_template(spark):
    assert spark.range(1).select(files.fill_template("Q: {query} {x}", query=F.lit("why"))).first()[0] == "Q: why {x}"


def test_reply_round_trip(spark):
    asked = spark.createDataFrame([("r", "one two  three", "[1]")], "request_id string, reply string, s string")
    lines = replies.reply_lines(asked, sources="s")
    assert [r.type for r in lines.orderBy("seq").collect()] == ["metadata", *["content"] * 4, "done"]
    got = replies.assembled(lines).first()
    assert (got.content, got.sources, got.phase, got.complete) == ("one two  three ", "[1]", "done", True)
    cut = lines.where("seq < 2")
    assert replies.incomplete(cut).count() == 1 and replies.stopped(replies.assembled(cut)).first().content == "one "


def ndjson(*rows):
    names = ("request_id", "seq", "type", "delta", "message", "sources", "is_triage")
    return "".join(json.dumps({k: v for k, v in zip(names, r) if v is not None}) + "\n" for r in rows)


@pytest.fixture
def accumulation(spark, tmp_path):
    """Feeds files of lines to the accumulation, one batch each, and waits until something is so."""
    source, made = tmp_path / "in", []
    source.mkdir()
    for k, v in replies.STORE.items():
        spark.conf.set(k, v)
    runs = []

    def start(**how):
        stream = spark.readStream.schema(replies.LINE).option("maxFilesPerTrigger", 1).json(str(source))
        out = replies.accumulated(stream, **how).writeStream.outputMode("append").foreachBatch(lambda df, _: made.extend(df.collect()))
        runs.append(out.option("checkpointLocation", str(tmp_path / "c")).start())

    def feed(name, *rows, until=None):
        (tmp_path / name).write_text(ndjson(*rows))
        (tmp_path / name).rename(source / name)
        read = sum(p.numInputRows for run in runs for p in run.recentProgress) + len(rows)
        wait(until or (lambda: sum(p.numInputRows for run in runs for p in run.recentProgress) >= read))

    def wait(done):
        end = time.monotonic() + 90
        while not done() and runs[-1].isActive and time.monotonic() < end:
            time.sleep(0.1)
        assert runs[-1].exception() is None

    yield start, feed, wait, made
    for run in runs:
        run.stop()
    for k in replies.STORE:
        spark.conf.unset(k)


def test_accumulation_with_state(accumulation):
    """Lines out of order, sent again before and after the end, a triage reply, and a request that never ends."""
    start, feed, _, made = accumulation
    start()
    feed("1.json", ("r", 1, "content", "a "), ("r", 0, "metadata", None, None, "[7]"), ("q", 0, "metadata"), ("t", 0, "metadata", None, None, None, True))
    assert not made
    feed("2.json", ("r", 1, "content", "again "), ("r", 2, "content", "b"), ("r", 3, "done"), ("t", 2, "done"), until=lambda: made)
    feed("3.json", ("r", 1, "content", "a "), ("r", 4, "content", "more"), ("r", 3, "done"), ("t", 1, "content", "hello"), until=lambda: len(made) > 1)
    feed("4.json", ("r", 0, "metadata"), ("t", 1, "content", "hello"))
    assert [tuple(m) for m in made] == [("r", "a b", "[7]", "done", None, True, False), ("t", "hello", None, "done", None, True, True)]


def test_silence_ends_a_message(accumulation):
    """With what there is, over gaps; what comes after that opens no new message."""
    start, feed, wait, made = accumulation
    start(timeout_ms=1500)
    feed("1.json", ("a", 0, "metadata"), ("a", 1, "content", "x"), ("a", 3, "content", "z"), ("b", 0, "metadata"))
    wait(lambda: len(made) >= 2)
    feed("2.json", ("a", 2, "content", "y"), ("b", 1, "content", "late"))
    time.sleep(3)
    assert sorted(tuple(m) for m in made) == [("a", "xz", None, "done", None, False, False), ("b", replies.STOPPED, None, "done", None, False, False)]


def test_lines_in_their_turn():
    line = lambda kind, delta=None, sources=None, flag=None: (kind, delta, None, sources, flag)
    waiting = {0: line("metadata", sources="[7]"), 2: line("content", "two"), 3: line("done")}
    found, done = replies._walked(("", None, "searching", None, False, 0), waiting, False)
    assert (found, done, list(waiting)) == (("", "[7]", "reading", None, False, 1), False, [2, 3])
    waiting[1] = line("content", "one ")
    assert replies._walked(found, waiting, False) == (("one two", "[7]", "done", None, False, 4), True)
    assert replies._walked(("", None, "searching", None, False, 0), {0: line("metadata", flag=True)}, False)[0][2] == "generating"


def test_lines_that_come_twice(spark):
    """In tables: equal places count once, lines after the end don't, and a triage reply is never read for."""
    rows = [("r", 0, "metadata", None, None, "[1]", None), ("r", 1, "content", "a", None, None, None), ("r", 1, "content", "a", None, None, None), ("r", 2, "done", None, None, None, None), ("r", 3, "content", "b", None, None, None), ("t", 0, "metadata", None, None, None, True)]
    got = {m.request_id: (m.content, m.phase, m.complete, m.is_triage) for m in replies.assembled(spark.createDataFrame(rows, replies.LINE)).collect()}
    assert got == {"r": ("a", "done", True, False), "t": ("", "generating", False, True)}


def test_bursts(spark):
    rows = spark.sql("SELECT 'u' AS k, timestamp_millis(t) AS at, v FROM VALUES (0L, 1), (200L, 2), (1000L, 3) AS x(t, v)")
    assert sorted(r.v for r in replies.settled(rows, "k", "at", "v").collect()) == [2, 3]


def test_a_whole_reply_takes_few_calls_to_the_store():
    """A request whose lines come at once has no message, nothing that waits and no timer to look up or clear."""
    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *a: (calls.append(f"{self.name}.{call}"), [] if call in ("iterator", "listTimers") else None)[1]

    made = replies._Message(1000, 1000)
    made.handle, made.message, made.early, made.ended = (State(n) for n in ("handle", "message", "early", "ended"))
    lines = pd.DataFrame([("r", i, kind, delta, None, None, False) for i, (kind, delta) in enumerate([("metadata", None), ("content", "a "), ("done", None)])], columns=[c.split()[0] for c in replies.LINE.split(", ")])
    out = list(made.handleInputRows(("r",), iter([lines]), None))
    assert out[0].content.tolist() == ["a "] and calls == ["ended.exists", "message.get", "ended.update"]
