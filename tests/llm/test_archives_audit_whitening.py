"""Operators 11 to 13 against brute force, and their edge cases."""

import base64
import gzip
import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import filter_audit, queries, warc, whitening

SF = "/root/testdata/sf0.001"


# --- archives ---------------------------------------------------------------------------------------------------------


def payloads(rows):
    """What round_trip should give, by hand: the least key of equal payloads is the response, null keys last."""
    groups = {}
    for key, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(key)
    out = []
    for raw, keys in groups.items():
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        keys.sort(key=lambda k: (k is None, k or 0))
        out += [(k, len(raw), digest, "response" if not i else "revisit", keys[0] if i else None, True) for i, k in enumerate(keys)]
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.collect())


ODD = [
    (3, "http://a/x", "same"), (1, "http://a/y", "same"), (2, None, "same"), (4, "http://a/ ü\r\nX: y", ""), (5, "u", None), (6, "u", "äöü ß é" * 9),
    (7, "u", "two"), (7, "u", "two"), (7, "u", "two"), (8, "u", "one"), (8, "u", "other"), (None, "u", "alone"), (None, "v", "two"), (None, "v", "lost"), (None, "v", "lost"), (9, "u", "x\r\n\r\n" * 5),
]


def odd_pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "page_id long, url string, html string, digest string, copies double").repartition(3)


def test_round_trip_of_odd_pages(spark):
    r = warc.round_trip(spark, odd_pages(spark, ODD))
    assert r.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    assert got(r) == payloads(ODD)


def test_round_trip_of_an_empty_table(spark):
    assert warc.round_trip(spark, odd_pages(spark, ODD).limit(0)).count() == 0


def test_round_trip_of_text_keys(spark):
    rows = [("a b", "u", "x"), ("ü%41", "u", "x"), (None, "u", "y")]
    assert got(warc.round_trip(spark, spark.createDataFrame(rows, "page_id string, url string, html string"))) == payloads([(k, u, h) for k, u, h in rows])


@pytest.mark.parametrize("sizes", [(0, 1, 6, 7, 8, 13, 14, 15, 500), (70_000,)])
def test_chunks_of_any_size(spark, tmp_path, sizes):
    """Small chunks, segments and files: payloads are the same byte for byte, whatever the cuts."""
    rng = np.random.default_rng(4)
    rows = [(i, "u", bytes(rng.integers(0, 256, n, dtype=np.uint8))) for i, n in enumerate(sizes)] + [(100 + i, "u", b"\r\n\r\nWARC/1.1\r\n" * i) for i in range(1, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    chunks = warc.chunked(pages, "html", 7).orderBy("page_id", "chunk").collect()
    assert all(len(c.data) <= 7 for c in chunks) and {k: b"".join(bytes(c.data) for c in chunks if c.page_id == k) for k, _, _ in rows} == {k: b for k, _, b in rows}
    digests = {r.page_id: r.digest for r in warc.digested(warc.chunked(pages, "html", 7)).collect()}
    assert digests == {k: base64.b32encode(hashlib.sha1(b).digest()).decode() for k, _, b in rows}
    segments = warc.archive(pages, f"file://{tmp_path}/w", segment_bytes=300, file_bytes=700)
    held = segments.collect()
    assert sum(s.records for s in held) == len(rows) and all(s.end - s.begin >= 100 for s in held)
    back = warc.read_chunks(segments, 64).orderBy("record_id", "chunk").collect()
    read = {}
    for c in back:
        assert len(c.data) <= 64 and (c.chunk == 0) == (c.record_id not in read)
        read.setdefault(c.record_id, [c.key, c.record_type, b""])[2] += bytes(c.data)
    assert {int(k): b for k, kind, b in read.values() if kind == "response"} == {k: b for k, _, b in rows}


def test_archives_are_standard(spark, tmp_path):
    """Each file is gzip members with one WARC record each; lengths and digests hold."""
    warc.archive(odd_pages(spark, ODD), str(tmp_path / "w"))
    seen = Counter()
    for file in (tmp_path / "w" / "archives").iterdir():
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode("ascii").split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
            block, data = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            body = block.partition(b"\r\n\r\n")[2]
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            else:
                assert body == b"" and fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To"] != fields["WARC-Record-ID"]
            seen[fields["WARC-Record-ID"]] += 1
    assert len(seen) == len(ODD) and set(seen.values()) == {1}


def test_small_payloads_are_never_revisits(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (2, "u", "abc"), (3, "u", "long enough"), (4, "u", "long enough")]
    r = warc.round_trip(spark, odd_pages(spark, rows), least_bytes=5)
    assert sorted((x.page_id, x.record_type, x.refers_to) for x in r.collect()) == [(1, "response", None), (2, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_damaged_archives(spark, tmp_path):
    segments = warc.archive(odd_pages(spark, [(1, "u", "text " * 50)]), str(tmp_path / "w"))
    row = segments.first()
    short = spark.createDataFrame([(row.path, row.begin, row.end - 12, 1)], warc._SEGMENT)
    with pytest.raises(Exception, match="cut short|ends early"):
        warc.read_records(short).collect()
    found = warc.read_records(segments).withColumn("declared", F.lit("X"))
    assert [r.intact for r in warc.resolved(found).collect()] == [False]


def test_chunks_that_are_apart(spark):
    rows = [(1, 0, 2, b"a"), (2, 0, 1, b"b"), (1, 1, 2, b"c")]
    apart = spark.createDataFrame(rows, "key long, chunk long, n_chunks long, data binary").coalesce(1)
    with pytest.raises(Exception, match="apart or out of order"):
        warc.digested(apart).collect()


def test_memory_of_an_oversized_record(tmp_path):
    """A record of 64 MB is read with a few blocks held at a time."""
    import tracemalloc

    block = bytes(1 << 20)
    writer = warc._Writer(f"file://{tmp_path}")
    record = {"record_id": "urn:uuid:x", "record_type": "response", "key": "1", "uri": None, "refers_id": None, "refers_uri": None, "n_bytes": 64 << 20, "digest": base64.b32encode(hashlib.sha1(bytes(64 << 20)).digest()).decode()}
    writer.begin(record)
    for _ in range(64):
        writer.add(block)
    writer.end(True)
    writer.close()
    ((path, begin, end, _),) = writer.segments
    tracemalloc.start()
    assert sum(len(data) for *_, data in warc._read(path, begin, end)) == 64 << 20
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


# --- filter audit -------------------------------------------------------------------------------------------------------

NAMES = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audited(rows, labels):
    """(part, order, step) -> counts, document by document, for rows (doc_id, source, text)."""
    failed = []
    for i, (key, part, text) in enumerate(rows):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        f["E"] = key is not None and any(k is not None and k < key and (t or "") == text for k, _, t in rows)
        own = [x for x in labels if x[0] is not None and x[0] == key]
        failed.append((part or "", {k for k, v in f.items() if v}, any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failed}:
        for order in itertools.permutations("ABCDE"):
            left, gone = [x for x in failed if x[0] == part], []
            everything = list(left)
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + hit
                unique = sum(x[1] == {f} for x in everything)
                out[part, "".join(order), step] = [len(left), len(hit), redundant, unique, sum(x[2] for x in hit), sum(x[3] for x in hit)]
                shapley[part, f] += len(hit)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audit_of(df):
    assert df.columns == NAMES
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_audit_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    rows = [(d, s, t) for d, s, t in zip(docs.doc_id, docs.source, docs.text)]
    assert audit_of(queries.op12_filter_audit(spark, SF)) == audited(rows, list(labels.itertuples(index=False, name=None)))


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    good = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "a", good), (2, "a", good), (2, "a", good), (3, None, good), (4, "", "SHOUT # " * 60), (5, "b", None), (6, "b", ""), (None, "b", ""), (None, "b", None),
        (7, "c", long), (8, "c", long + " $"), (9, None, "é É " * 40), (10, "a", "A B\x0bC\x1cD"), (0, "d", good + " "), (11, "a", "x" * 99 + "A" * 5), (12, "a", "x" * 95 + "A" * 5),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (4, 1, None), (5, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, True, 1.0) for r in rows], "doc_id long, source string, text string, A boolean, n double")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_of(filter_audit.audit(filter_audit.flagged(docs, given))) == audited(rows, labels)
    assert audit_of(filter_audit.audit(filter_audit.flagged(docs.limit(0), given))) == {}
    assert audit_of(filter_audit.audit(filter_audit.flagged(docs, given.limit(0)))) == audited(rows, [])


# --- whitening ----------------------------------------------------------------------------------------------------------


def whitened_by_hand(vectors, components=16):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = (e > max(e[0], 0) * len(e) * np.finfo(float).eps).nonzero()[0][:components]
    deviation = [sum(int(n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, ((n * x - s) / n) @ u[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(v)


def compared(df, ids, vectors, components=16):
    r = df.orderBy("vec_id", "component").toPandas()
    n, deviation, values, explained = whitened_by_hand(vectors, components)
    k = values.shape[1]
    assert r.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(r) == k * len(ids) and (r.n == n).all() and r.component.tolist() == list(range(1, k + 1)) * len(ids)
    order = np.argsort(ids, kind="stable")
    assert r.vec_id.tolist() == np.repeat(np.array(ids)[order], k).tolist() and r.deviation.tolist() == np.repeat(np.array(deviation, object)[order], k).tolist()
    found, wanted = r.whitened.to_numpy().reshape(-1, k), values[order]
    signs = np.sign((found * wanted).sum(0))
    assert np.abs(found - wanted * signs).max() < 1e-8
    assert np.abs(r.explained.to_numpy()[:k] - explained).max() < 1e-12 and r.identity_error.nunique() == 1 and r.identity_error[0] < 1e-10


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    compared(queries.op13_whitening(spark, SF), table.vec_id.tolist(), table.embedding.tolist())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(np.float32(v)) for v in rng.normal(0, 10, 3)]) for i in range(40)]
    good += [(50, good[0][1]), (51, good[0][1]), (52, [300.0, -300.0, 0.0])]
    bad = [(60, None), (61, [1.0, None, 2.0]), (62, [1.0, float("nan"), 2.0]), (63, [float("inf"), 0.0, 0.0]), (64, []), (65, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 7, 0.5) for r in good + bad], "vec_id long, embedding array<float>, n int, x double")
    compared(whitening.whitened(df), [k for k, _ in good], [v for _, v in good])
    compared(whitening.whitened(df, components=2), [k for k, _ in good], [v for _, v in good], 2)
    twice = whitening.whitened(df.unionByName(df.where("vec_id = 51"))).where("vec_id in (50, 51)").groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in twice} == {50: 3, 51: 6}
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id in (50, 51) and embedding[0] < 1000")).count() == 0  # one vector has no variance
    flat = spark.createDataFrame([(None, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.component) for r in whitening.whitened(flat).collect()] == [(None, 1)] * 9  # one direction
    huge = spark.createDataFrame([(1, [2.0**45, 0.0]), (2, [-(2.0**45), 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitened(huge).collect()} == {None}
