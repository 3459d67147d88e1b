"""Retrieval queries: BM25 over ``documents``, neighbours in ``embeddings``, and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import fusion, vector
from shelfmark.operators.blockmax import BlockIndex
from shelfmark.operators.bm25 import Bm25Config, Bm25Model, fit_per_request, term_frequencies
from shelfmark.plans.base import Queries
from shelfmark.session import new_folder, stored, table
from shelfmark.sources import files

query = Queries()
K = 10
CONFIG = Bm25Config(charset="unicode")

TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
BM25 = f"""
WITH toks AS (SELECT doc_id, {TOKENS} AS t FROM documents),
docs AS (SELECT doc_id, len(t) AS dl FROM toks),
stats AS (SELECT count(*) AS n, sum(dl)::BIGINT AS total, sum(dl)::DOUBLE / greatest(count(*), 1) AS avgdl FROM docs),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
terms AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, row_number() OVER (ORDER BY term) - 1 AS idx FROM df, stats),
weighted AS (SELECT doc_id, p.term, idx, idf, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS tf_norm
             FROM post p JOIN docs USING (doc_id) JOIN terms USING (term), stats),
asked AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf_norm), 6) AS score FROM asked JOIN weighted USING (term) GROUP BY 1, 2)
"""
QUERIES = "queries AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)"


def _ranked(source: str, k: int = K, by: str = "query_id", order: str = "score DESC, id", columns: str = "query_id, id, score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


def _knn(score: str, where: str = "true", k: int = K) -> str:
    return f"WITH {QUERIES}, scored AS (SELECT query_id, vec_id AS id, round({score}, 6) AS score FROM queries, embeddings WHERE {where}) {_ranked('scored', k)}"


DOT = "list_dot_product(q::DOUBLE[], embedding::DOUBLE[])"
LEGS = f"""{BM25}, {QUERIES},
dense AS ({_ranked("(SELECT query_id, vec_id AS id, round(" + DOT + ", 6) AS score FROM queries, embeddings)")}),
sparse AS ({_ranked("(SELECT query_id, doc_id AS id, score FROM scored)")}),
hits AS (SELECT *, 'dense' AS leg FROM dense UNION ALL SELECT *, 'sparse' AS leg FROM sparse)"""


def _model(spark: SparkSession, sf: str) -> Bm25Model:
    return Bm25Model.fit(table(spark, sf, "documents"), CONFIG)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("agg_3_term_frequencies", f"{BM25} SELECT doc_id, term, tf FROM post")
def _(spark, sf):
    return term_frequencies(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", CONFIG.tokens(F.col("text"))).select("doc_id", "term", "tf")


@query("agg_5_corpus_stats", f"{BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def _(spark, sf):
    return _model(spark, sf).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("agg_4_fn_7_idf", f"{BM25} SELECT term, df, round(idf, 9) AS idf FROM terms")
def _(spark, sf):
    return _model(spark, sf).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query("win_2_vocabulary_index", f"{BM25} SELECT term, idx FROM terms")
def _(spark, sf):
    return _model(spark, sf).vocab()


@query("bm_2_search", f"{BM25} {_ranked('scored', columns='query_id, doc_id, score', order='score DESC, doc_id')}")
def _(spark, sf):
    return _model(spark, sf).search(_asked(spark, sf), K).select("query_id", "doc_id", "score", "rank")


@query(
    "top_8_search_filled",
    f"""{BM25}, few AS (SELECT * FROM asked UNION ALL SELECT 1000, 'zzzznothing', 1),
    filled AS (SELECT q.query_id, d.doc_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM few) q CROSS JOIN docs d LEFT JOIN scored s ON s.query_id = q.query_id AND s.doc_id = d.doc_id)
    {_ranked('filled', columns='query_id, doc_id, score', order='score DESC, doc_id')}""",
)
def _(spark, sf):
    asked = _asked(spark, sf).unionByName(spark.createDataFrame([(1000, "zzzznothing")], "query_id long, text string"))
    return _model(spark, sf).search_filled(asked, K).select("query_id", "doc_id", "score", "rank")


@query("bm_3_encode_documents", f"{BM25} SELECT doc_id, idx, round(idf * tf_norm, 6) AS weight FROM weighted WHERE idf * tf_norm > 0")
def _(spark, sf):
    return _model(spark, sf).kept().encode_documents().select("doc_id", F.explode("sparse_vector").alias("idx", "weight")).withColumn("weight", F.round("weight", 6))


@query("bm_4_encode_queries", f"{BM25} SELECT query_id, idx, round(qtf * idf, 6) AS weight FROM asked JOIN terms USING (term) WHERE qtf * idf > 0")
def _(spark, sf):
    return _model(spark, sf).encode_queries(_asked(spark, sf)).select("query_id", F.explode("sparse_vector").alias("idx", "weight")).withColumn("weight", F.round("weight", 6))


@query(
    "bm_8_fit_per_request",
    f"""WITH toks AS (SELECT conv_id, turn, {TOKENS} AS t FROM conversations),
    tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3),
    n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
    terms AS (SELECT conv_id, term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, row_number() OVER (PARTITION BY conv_id ORDER BY term) - 1 AS idx
              FROM (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY 1, 2) JOIN n USING (conv_id))
    SELECT conv_id, turn, idx, round(tf * idf, 6) AS weight FROM tf JOIN terms USING (conv_id, term)""",
)
def _(spark, sf):
    vectors = fit_per_request(table(spark, sf, "conversations"), CONFIG, "conv_id", "turn")
    return vectors.select("conv_id", "turn", F.explode("sparse_vector").alias("idx", "weight")).withColumn("weight", F.round("weight", 6))


@query("vec_1_dense_knn", _knn(DOT))
def _(spark, sf):
    return vector.dense_top_k(*_vectors(spark, sf), K)


@query("vec_1_dense_knn_by_columns", _knn(DOT))
def _(spark, sf):
    return vector.dense_top_k_columns(*_vectors(spark, sf), K)


@query("vec_1_dense_knn_cosine", _knn("list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[])"))
def _(spark, sf):
    return vector.dense_top_k(*_vectors(spark, sf), K, "cosine")


@query("vec_1_dense_knn_l2", _knn("0.0 - list_distance(q::DOUBLE[], embedding::DOUBLE[])"))
def _(spark, sf):
    return vector.dense_top_k_columns(*_vectors(spark, sf), K, "l2")


@query("flt_1_filtered_knn", _knn(DOT, "label IN (1, 3, 5)"))
def _(spark, sf):
    return vector.dense_top_k(*_vectors(spark, sf), K, where=F.expr("label IN (1, 3, 5)"))


@query("vec_1_inverted_file", f"WITH {QUERIES} SELECT query_id, 10::BIGINT AS n, true AS recalled FROM queries")
def _(spark, sf):
    """The stored index: of each query, how many it finds, and whether all queries together get 0.9 of the exact ones."""
    rows, asked = _vectors(spark, sf)
    found = vector.InvertedFile.build(rows).search(asked, K)
    best = vector.dense_top_k(rows, asked, K).select("query_id", "id", F.lit(1).alias("hit"))
    met = found.join(best, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    recall = met.agg((F.sum("hits") >= 0.9 * F.sum("n")).alias("recalled"))
    return met.select("query_id", "n").crossJoin(F.broadcast(recall))


@query("vec_1_inverted_file_exact", _knn(DOT))
def _(spark, sf):
    """The stored index, with all cells that could hold a better vector."""
    rows, asked = _vectors(spark, sf)
    return vector.InvertedFile.build(rows).search(asked, K, share=0.25, exact=True)


@query("bm_2_block_max", f"{BM25} {_ranked('scored', columns='query_id, id, score', order='score DESC, id').replace('FROM scored', 'FROM (SELECT query_id, doc_id AS id, score FROM scored)')}")
def _(spark, sf):
    """The same search over stored blocks, most of which are left out by their bounds."""
    model = _model(spark, sf).kept()
    asked = model.query_terms(_asked(spark, sf)).select("query_id", "term", F.col("qtf").cast("double").alias("weight"))
    return BlockIndex.build(model.weights(), n_docs=model.postings.select("doc_id").distinct().count()).search(asked, K)


@query(
    "vec_2_sparse_inner_product",
    f"""{BM25}, q AS (SELECT query_id, term, round(qtf * idf, 9) AS w FROM asked JOIN terms USING (term)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w, term) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM q),
    ip AS (SELECT query_id, doc_id AS id, round(sum(w * idf * tf_norm), 6) AS score FROM (SELECT * FROM placed WHERE place > floor(n * 0.2)) JOIN weighted USING (term) GROUP BY 1, 2)
    {_ranked('ip')}""",
)
def _(spark, sf):
    model = _model(spark, sf)
    terms = model.query_terms(_asked(spark, sf))
    weighted = stored(model.weighted(terms))
    asked = terms.join(weighted.select("term", "idf").distinct(), "term").select("query_id", "term", F.round(F.col("qtf") * F.col("idf"), 9).alias("weight"))
    return vector.sparse_top_k(weighted.select(F.col("doc_id").alias("id"), "term", (F.col("idf") * F.col("tf_norm")).alias("weight")), asked, K, drop_ratio=0.2)


def _legs(spark: SparkSession, sf: str) -> DataFrame:
    dense = vector.dense_top_k(*_vectors(spark, sf), K)
    sparse = _model(spark, sf).search(_asked(spark, sf), K).withColumnRenamed("doc_id", "id")
    return fusion.legs(dense=dense, sparse=sparse)


@query("vec_4_hybrid_rrf", f"{LEGS}, fused AS (SELECT query_id, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM hits GROUP BY 1, 2) {_ranked('fused')}")
def hybrid_rrf(spark, sf):
    return fusion.rrf(_legs(spark, sf), K)


@query(
    "vec_5_hybrid_weighted",
    f"{LEGS}, fused AS (SELECT query_id, id, round(sum(score * CASE leg WHEN 'dense' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END), 7) AS score FROM hits GROUP BY 1, 2) {_ranked('fused')}",
)
def _(spark, sf):
    return fusion.weighted(_legs(spark, sf), K, {"dense": 0.7, "sparse": 0.3}, digits=7)


@query(
    "vec_7_cross_query_rrf",
    f"""{LEGS}, listed AS (SELECT query_id // 4 AS request_id, query_id AS passage_id, id, rank, -score AS distance FROM hits WHERE leg = 'sparse'),
    fused AS (SELECT request_id, id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score, min(distance) AS distance, min(passage_id * 1000 + rank) AS first FROM listed GROUP BY 1, 2)
    {_ranked('fused', 5, 'request_id', 'score DESC, first, id', 'request_id, id, score, distance')}""",
)
def _(spark, sf):
    hits = _model(spark, sf).search(_asked(spark, sf), K)
    listed = hits.select(F.expr("query_id div 4").alias("request_id"), F.col("query_id").alias("passage_id"), F.col("doc_id").alias("id"), "rank", (-F.col("score")).alias("distance"))
    return fusion.cross_query_rrf(listed, 5).select("request_id", "id", "score", "kept.distance", "rank")


@query("set_1_batch_union", f"{LEGS} SELECT query_id, id, score, leg, count(*) OVER () AS processed FROM hits")
def _(spark, sf):
    hits = _legs(spark, sf)
    return hits.select("query_id", "id", "score", "leg").crossJoin(F.broadcast(hits.agg(F.count("*").alias("processed"))))


@query("flt_5_vec_8_chunk_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (3, 5, 8, 13, 1000000)")
def _(spark, sf):
    return table(spark, sf, "documents").where(F.col("doc_id").isin(3, 5, 8, 13, 1_000_000)).select("doc_id", "lang", "source")


def _collection(spark: SparkSession, sf: str) -> str:
    """The documents as a collection with a partition for each language."""
    root = new_folder(spark)
    files.write_collection(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), root, "lang")
    return root


@query("src_3_partitions", "SELECT lang AS partition, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return files.partitions_of(spark, _collection(spark, sf))


@query("src_2_partition_scan", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def _(spark, sf):
    """Only the folders of two partitions are read."""
    return files.read_collection(spark, _collection(spark, sf), ["de", "fr"], "lang").select(F.col("id").alias("doc_id"), "lang")


@query("prj_2_flattened_hits", "SELECT n_chars / 7.0 AS distance, doc_id AS id, lang, source FROM documents")
def _(spark, sf):
    rows = table(spark, sf, "documents")
    return fusion.flattened(rows.select((F.col("n_chars") / 7.0).alias("distance"), F.col("doc_id").alias("id"), F.struct("lang", "source").alias("entity")))


@query("flt_4_conjunction", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2')")
def _(spark, sf):
    where = fusion.conjunction([F.col("lang").isin("en", "de"), None, F.col("source").isin("src1", "src2")])
    return table(spark, sf, "documents").where(where).select("doc_id")


@query("flt_3_author_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")
