"""Stored postings in blocks with their largest weight, and an exact top-k search that leaves out blocks by their bounds.

Documents are dealt into blocks of about BLOCK_DOCS by a hash of their id. The postings of a term in a block are one row:
their largest weight, and the list of (id, weight), which is read only for blocks that are scored. A search

1. adds up, for each query and block, the query's weights times the largest weights: no document of the block has more;
2. scores the blocks with the highest bounds, FIRST of them, which gives each query a floor: its k-th best score so far;
3. scores those other blocks whose bound reaches the floor. What is left out cannot be among the k best.

Each file of the table is sorted by term, so that the terms of a few queries are found by the statistics of its row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.bm25 import is_small, small, top_k
from shelfmark.session import new_folder, stored

BLOCK_DOCS = 64
#: Blocks that each query scores before it has a floor, for each of the k hits asked for.
FIRST = 2


class BlockIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.blocks = spark.read.schema("term string, block long, most double, n long, entries array<struct<id:bigint,weight:double>>").parquet(path)

    @classmethod
    def build(cls, postings: DataFrame, path: str | None = None, block_docs: int = BLOCK_DOCS, n_docs: int | None = None) -> BlockIndex:
        """From ``postings(id, term, weight)`` with weights above 0, one for each id and term; with about ``n_docs`` ids,
        which are counted if not given."""
        spark = postings.sparkSession
        path = path or new_folder(spark)
        postings = postings.where("weight > 0").select(F.col("id").cast("long").alias("id"), "term", F.col("weight").cast("double").alias("weight"))
        if n_docs is None:
            postings = stored(postings)
            n_docs = postings.agg(F.approx_count_distinct("id")).first()[0]
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_docs // block_docs))))
        entries = F.collect_list(F.struct("id", "weight"))  # as many as a block has documents
        made = postings.repartition("term").groupBy("term", block.alias("block")).agg(F.max("weight").alias("most"), F.count("*").alias("n"), entries.alias("entries"))
        # each file is sorted by term: its row groups are ranges of terms
        made.sortWithinPartitions("term", "block").write.parquet(path)
        return cls(spark, path)

    def _met(self, asked: DataFrame, few: bool) -> DataFrame:
        """Blocks of the queries' terms; where there are few, their least and greatest prune the scan."""
        terms = small(asked.select("query_id", "term", F.col("weight").alias("asked")), few)
        return self.blocks.join(terms, "term")

    def _scores(self, asked: DataFrame, chosen: DataFrame, few: bool) -> DataFrame:
        each = self._met(asked, few).join(chosen.select("query_id", "block"), ["query_id", "block"]).select("query_id", "asked", F.explode("entries").alias("e"))
        return each.groupBy("query_id", F.col("e.id").alias("id")).agg(F.sum(F.col("asked") * F.col("e.weight")).alias("score"))

    def chosen(self, asked: DataFrame, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """``query_id, block`` of all blocks that must be scored, and the scores of the first of them."""
        few = is_small(asked)
        bounds = stored(self._met(asked, few).groupBy("query_id", "block").agg(F.sum(F.col("asked") * F.col("most")).alias("bound")))
        first = stored(top_k(bounds, FIRST * k, "query_id", [F.desc("bound"), F.asc("block")]).select("query_id", "block"))
        scored = stored(self._scores(asked, first, few))
        floors = top_k(scored, k, "query_id", [F.desc("score"), F.asc("id")]).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        reach = bounds.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + 10.0**-digits >= F.col("floor")))
        more = stored(reach.select("query_id", "block").join(first, ["query_id", "block"], "left_anti"))
        return first.withColumn("first", F.lit(True)).unionByName(more.withColumn("first", F.lit(False))), scored

    def search(self, asked: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """``query_id, id, score, rank`` for ``asked(query_id, term, weight)`` with weights above 0; ties by id."""
        asked = stored(asked)
        chosen, scored = self.chosen(asked, k, digits)
        more = self._scores(asked, chosen.where("not first"), is_small(asked))
        rounded = scored.unionByName(more).withColumn("score", F.round("score", digits))
        return top_k(rounded, k, "query_id", [F.desc("score"), F.asc("id")])

    def read_counts(self, asked: DataFrame, k: int) -> DataFrame:
        """``postings, read``: of all queries, the postings of their terms, and those of blocks that a search scores."""
        met = self._met(asked, is_small(asked)).select("query_id", "block", "n")
        chosen = self.chosen(asked, k)[0].select("query_id", "block", F.lit(1).alias("__chosen"))
        return met.join(chosen, ["query_id", "block"], "left").agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.col("__chosen") == 1, F.col("n"))), F.lit(0)).alias("read"))
