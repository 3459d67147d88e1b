"""Chunks by cohesion against a plain version, ids, and the BM25 record."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import arabic, text
from shelfmark.operators import bm25, pages


def plain_chunks(whole, least, most, block_words):
    """Sentence numbers of each chunk, without and with the overlap, and their words."""
    sentences = [s for s in re.split(r"(?<=[.!?؟])\s+", whole) if s.strip()]
    sizes, blocks, words = [len(s.split()) for s in sentences], {}, 0
    for i, n in enumerate(sizes):
        blocks.setdefault(words // block_words, []).append(i)
        words += n
    own = []
    for block in blocks.values():
        left = list(block)
        while left:
            size = lambda part: sum(sizes[i] for i in part)
            if size(left) <= most:
                own.append(left)
                break
            gaps = [g for g in range(1, len(left)) if least <= size(left[:g]) <= most]
            gaps = [g for g in gaps if size(left[g:]) >= least] or gaps

            def shared(g):
                at = block.index(left[g])
                before, after = ({w for i in part for w in sentences[i].lower().split()} for part in (block[max(0, at - 3) : at], block[at : at + 3]))
                return len(before & after) / max(1, len(before | after))

            g = min(gaps, key=lambda g: (shared(g), g)) if gaps else next((g for g in range(1, len(left)) if size(left[:g]) >= least), len(left))
            own.append(left[:g])
            left = left[g:]
    out = []
    for k, part in enumerate(own):
        both = (own[k - 1][-2:] if k else []) + part
        out.append((k, k // 8, both[0], sum(sizes[i] for i in both), sum(sizes[i] for i in part), " ".join(sentences[i] for i in both)))
    return out


@pytest.mark.parametrize(("least", "most", "block_words"), [(10, 30, 8000), (10, 30, 100), (100, 400, 8000)])
def test_chunks_equal_a_plain_version(spark, least, most, block_words):
    rng = random.Random(least + block_words)
    topics = [[f"{t}{i}" for i in range(30)] for t in "abcdef"]

    def document(n):
        out = []
        for _ in range(n):
            topic = rng.choice(topics)
            out += [" ".join(rng.choice(topic) for _ in range(rng.choice([1, 3, 8, 15, 60 if rng.random() < 0.1 else 5]))) + rng.choice([". ", "! ", ".\n", "? "]) for _ in range(rng.randint(1, 8))]
        return "".join(out)

    docs = [(i, document(rng.randint(0, 60))) for i in range(12)] + [(100, None), (101, ""), (102, "one. "), (None, document(30)), (103, "x " * 900)]
    got = pages.chunks(spark.createDataFrame(docs, "doc_id long, text string"), least=least, most=most, block_words=block_words).collect()
    want = [(i, *c) for i, t in docs for c in plain_chunks(t or "", least, most, block_words)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_chunks_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = pages.chunks(docs).collect()
    want = [(r.doc_id, *c) for r in docs.collect() for c in plain_chunks(r.text, 100, 400, pages.BLOCK_WORDS)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_long_document_is_cut_in_many_groups(spark):
    whole = " ".join(f"w{i % 70} w{i % 11} end." for i in range(20_000))
    got = pages.chunks(spark.createDataFrame([(1, whole)], "doc_id long, text string")).select("chunk", "n_own", "batch").collect()
    assert sum(r.n_own for r in got) == 60_000 and all(100 <= r.n_own <= 400 for r in got) and max(r.batch for r in got) == max(r.chunk for r in got) // 8


def test_chunks_are_cut_where_documents_are_read(spark, monkeypatch):
    """No text is shuffled or stored, as each copy of it takes its share of the disk."""
    monkeypatch.setattr(pages, "stored", lambda df: pytest.fail("stored"))
    docs = spark.range(0, 40, 1, 16).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('a', id, ' b c. '), 200)").alias("text"))
    got = pages.chunks(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.sum("n_own")).first()[0] == 40 * 600


@pytest.mark.parametrize("overlap", [0, 2])
def test_blocks_of_long_documents_are_dealt(spark, overlap):
    rng = random.Random(overlap)
    texts = [" ".join(f"w{rng.randrange(40)}" + rng.choice(["", "", "", "."]) for _ in range(n)) for n in (900, 30, 2000, 700, 700)]
    texts += ["x " * 900 + ". a. b " + "y " * 300 + ". c. d.", " . ! ", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).select(F.lit(7).cast("long").alias("doc_id"), "text")
    whole = pages.chunks(docs, least=10, most=30, block_words=100, overlap=overlap)
    dealt = pages.chunks(docs, least=10, most=30, block_words=100, overlap=overlap, whole_chars=300)
    assert whole.dtypes == dealt.dtypes == [("doc_id", "bigint"), ("chunk", "bigint"), ("batch", "bigint"), ("first_sentence", "int"), ("n_words", "bigint"), ("n_own", "bigint"), ("text", "string")]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.collect()))
    if overlap:
        assert sorted(map(tuple, dealt.collect())) == sorted((7, *c) for t in texts for c in plain_chunks(t, 10, 30, 100))
    else:
        assert dealt.where("n_words <> n_own").isEmpty()


def test_ids(spark):
    rows = spark.range(500).select(text.random_id(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("r"), text.uuid4().alias("u")).collect()
    assert all(re.fullmatch(r"1714979289000-[0-9a-z]{7}", r.r) and re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", r.u) for r in rows)
    assert len({r.r for r in rows}) == len({r.u for r in rows}) == 500


def test_bm25_record(spark):
    config = bm25.Bm25Config(k1=1.2, min_stem_length=4, normalize=False, custom_stopwords=("x",))
    assert config.to_dict() == {"k1": 1.2, "b": 0.75, "charset": "arabic", "apply_stemming": True, "remove_stopwords": True, "min_token_length": 2, "delta": 0.5, "method": "lucene", "normalize": False, "remove_diacritics": True, "min_stem_length": 4}
    assert bm25.Bm25Config.from_dict(config.to_dict() | {"custom_stopwords": ("y",)}).custom_stopwords == ()
    with pytest.raises(ValueError, match="lucene"):
        bm25.Bm25Config(method="other")
    row = spark.createDataFrame([("والكتاب إِنَّمَا",)], "t string")
    tokens = lambda **how: row.select(arabic.arabic_tokens(F.col("t"), stops=(), **how)).first()[0]
    assert tokens() == ["كتاب", "انم"] and tokens(min_stem=6) == ["والكتاب", "انما"] and tokens(normalized=False, stemmed=False) == ["والكتاب", "إِنَّمَا"]


def test_bm25_encodes_any_texts(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "")], "doc_id long, text string")
    model = bm25.Bm25Model.fit(docs, bm25.Bm25Config(charset="unicode"))
    shown = lambda df: {r[0]: r[1] and {k: round(v, 6) for k, v in r[1].items()} for r in df.collect()}
    assert shown(model.encode(docs, key="doc_id")) == {0: {0: 1.114579, 1: 0.345591}, 1: {1: 0.431196, 2: 0.899843}, 2: None} == shown(model.encode_documents())
    asked = spark.createDataFrame([(5, "a b b"), (6, "zz")], "text_id long, text string")
    assert shown(model.encode(asked, True)) == {5: {0: 0.980829, 1: 0.940007}, 6: None}
