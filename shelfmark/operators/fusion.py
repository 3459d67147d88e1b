"""Fusion of ranked lists: reciprocal ranks, weights, and fusion over the passages of a request. Queries are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.bm25 import top_k
from shelfmark.operators.vector import check_k

RRF_K, MAX_RRF_K = 60, 16_384
MAX_EMBEDDINGS = 10
#: Fields of a chunk that a search may return.
OUTPUT_FIELDS = ("id", "book_id", "book_name", "order", "author", "category", "part_title", "start_page_id", "page_offset", "page_num_range", "text")


def check_ranker(name: str, params: list[float]) -> None:
    """One whole number in (0, 16384] for RRF; two weights in [0, 1] for Weighted."""
    if name == "RRF":
        if len(params) != 1 or params[0] != int(params[0]) or not 0 < params[0] <= MAX_RRF_K:
            raise ValueError(f"RRF takes one whole number above 0, at most {MAX_RRF_K}")
    elif name == "Weighted":
        if len(params) != 2 or not all(0 <= p <= 1 for p in params):
            raise ValueError("Weighted takes two weights from 0 to 1")
    else:
        raise ValueError("the ranker must be RRF or Weighted")


def check_embeddings(embeddings: list[dict]) -> list[dict]:
    """1 to 10 embeddings, each with a dense or a sparse vector."""
    if not 1 <= len(embeddings) <= MAX_EMBEDDINGS or not all(e.get("dense") or e.get("sparse") for e in embeddings):
        raise ValueError(f"1 to {MAX_EMBEDDINGS} embeddings with a vector each")
    return embeddings


def check_fields(fields: list[str]) -> list[str]:
    if unknown := [f for f in fields if f not in OUTPUT_FIELDS]:
        raise ValueError(f"unknown output fields: {unknown}")
    return fields


def legs(**named: DataFrame) -> DataFrame:
    """Ranked lists ``query_id, id, score, rank`` one under the other, each with its leg's name."""
    return reduce(DataFrame.unionByName, (df.select("query_id", "id", "score", "rank", F.lit(name).alias("leg")) for name, df in named.items()))


def rrf(hits: DataFrame, k: int, constant: float = RRF_K, digits: int = 9) -> DataFrame:
    """``query_id, id, score, rank``: the sum of 1 / (constant + rank) over the legs of each query; ties by id."""
    check_k(k)
    fused = hits.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), digits).alias("score"))
    return top_k(fused, k, "query_id", [F.desc("score"), F.asc("id")])


def weighted(hits: DataFrame, k: int, weights: dict[str, float], norm: str = "none", digits: int = 6) -> DataFrame:
    """The sum of weight times score over the legs; a leg that lacks an id adds nothing.

    norm: none, or minmax inside each query's leg.
    """
    check_k(k)
    score = F.col("score")
    if norm == "minmax":
        leg = Window.partitionBy("query_id", "leg")
        low, high = F.min("score").over(leg), F.max("score").over(leg)
        score = F.coalesce((score - low) / F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    elif norm != "none":
        raise ValueError("norm must be none or minmax")
    weight = F.coalesce(*(F.when(F.col("leg") == name, F.lit(float(w))) for name, w in weights.items()), F.lit(0.0))
    fused = hits.withColumn("s", score * weight).groupBy("query_id", "id").agg(F.round(F.sum("s"), digits).alias("score"))
    return top_k(fused, k, "query_id", [F.desc("score"), F.asc("id")])


def cross_query_rrf(hits: DataFrame, k: int, constant: float = RRF_K, request: str = "request_id", passage: str = "passage_id", payload: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Fusion over all passages of a request: an id that is twice in a list counts twice, and the row that is kept of
    an id is that with the least distance (then the earlier list, then the earlier rank).

    hits: request, passage, id, rank (from 1), distance and payload. Ties go to what was seen first.
    """
    check_k(k)
    kept = F.struct(*([F.col(c) for c in payload] if payload else [F.col("distance")]))
    fused = hits.groupBy(request, "id").agg(
        F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), digits).alias("score"),
        F.min_by(kept, F.struct("distance", passage, "rank")).alias("kept"),
        F.min(F.struct(passage, "rank")).alias("first"),
    )
    return top_k(fused, k, request, [F.desc("score"), F.asc("first"), F.asc("id")]).drop("first")


def flattened(hits: DataFrame) -> DataFrame:
    """``distance, id`` and the fields of ``entity`` in one row."""
    return hits.select("distance", "id", "entity.*")


def aligned(dense: Column, sparse: Column) -> tuple[Column, Column]:
    """Both lists cut to the shorter one's length."""
    n = F.least(F.size(dense), F.size(sparse))
    return F.slice(dense, F.lit(1), n), F.slice(sparse, F.lit(1), n)


def conjunction(filters: list[Column | None]) -> Column | None:
    """All filters that are there; none: no filter."""
    given = [f for f in filters if f is not None]
    return reduce(lambda a, b: a & b, given) if given else None


def check_partitions(requested: list[str], available: list[str]) -> list[str]:
    """An error names the partitions that do not exist."""
    if missing := [p for p in requested if p not in set(available)]:
        raise ValueError(f"unknown partitions: {missing}; there are {sorted(available)}")
    return requested
