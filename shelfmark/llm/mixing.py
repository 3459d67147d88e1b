"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

The mix has the size of the whole input. Each source gets its weight's share of it, but no more than MAX_EPOCHS times
its own size; what is cut off goes to the other sources by weight, until none is above. With sources ordered by
(cap / weight), those that are clamped come first, so one pass of running sums over the sources finds all of them.

A source whose target is r times its size takes every document floor(r) times whole; the rest of its target goes to
documents in a seeded order until it is used up, the last of them in part (its first words), so that what a source
takes is its target, rounded. The running sum over a source's documents is made in two steps, over BUCKETS ranges of
the seeded order and then inside each range, so that a source with a third of all rows is no hot key.

Defined results: a null source is a source of its own, last in order; a null or empty text has size 0 and takes 0; a
null doc_id has a place in the seeded order like any other; rows with equal ids are ordered by size, and equal rows are
interchangeable; an empty table gives an empty table; extra columns are kept (``taken`` and the like are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import common

#: A source is repeated at most so often.
MAX_EPOCHS = 3
#: Ranges of the seeded order that a source's documents are dealt over.
BUCKETS = 4096
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def cycling_weights(n: int = 3) -> Column:
    """Weights 1, 2, ..., n, repeating, by the position of the source."""
    return F.pmod(F.col("position"), F.lit(n)) + 1


def targets(sizes: DataFrame, weight: Column, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source, however many there are."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("position", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", weight.cast("long"))
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        ranked.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    share = (F.col("total") - F.col("cap_before")).cast("double") * F.col("weight") / (F.col("all_weight") - F.col("weight_before"))
    clamped = spread.withColumn("clamped", F.col("cap") < share)
    rest = clamped.withColumn("cap_clamped", F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0))).withColumn(
        "weight_free", F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything)
    )
    free = (F.col("total") - F.col("cap_clamped")).cast("double") * F.col("weight") / F.col("weight_free")
    return rest.select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.least(free, F.col("cap").cast("double"))).alias("target"))


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weight: Column | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """Each document's key with its size, its source's size and target, and the words that the mix takes of it.

    ``row``: a column that tells rows apart where keys do not; it is carried, and orders rows of equal key and size.
    """
    own = [row] if row else []
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    narrow = df.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("h"), *own
    ).withColumn("bucket", F.floor(F.col("h") / ((1 << 32) // BUCKETS)))
    narrow = common.checkpointed(narrow)  # the texts are read and counted once
    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    wanted = targets(sizes, cycling_weights() if weight is None else weight, max_epochs)
    wanted = wanted.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    wanted = wanted.withColumn("part", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    placed = buckets.alias("b").join(wanted.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source"))).select("b.source", "b.bucket", "bucket_before", "source_size", "target", "epochs", "part")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    dealt = narrow.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = dealt.alias("d").join(placed.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("bucket_before") - F.col("before")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), *own)


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS position FROM sources),
weighted AS (SELECT *, position % 3 + 1 AS weight, source_size * {MAX_EPOCHS} AS cap FROM ranked),
spread AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS all_weight,
         coalesce(sum(cap) OVER before, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before
  FROM weighted WINDOW before AS (ORDER BY cap::DOUBLE / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
clamped AS (SELECT *, cap < (total - cap_before)::DOUBLE * weight / (all_weight - weight_before) AS clamped FROM spread),
rest AS (
  SELECT *, coalesce(sum(cap) FILTER (clamped) OVER (), 0)::BIGINT AS cap_clamped, (sum(weight) FILTER (NOT clamped) OVER ())::BIGINT AS weight_free
  FROM clamped),
targets AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap::DOUBLE ELSE least((total - cap_clamped)::DOUBLE * weight / weight_free, cap::DOUBLE) END AS target
  FROM rest),
parts AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM targets),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, round(p.target - p.epochs * p.source_size)::BIGINT AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, part - before)))::BIGINT AS taken
FROM placed
"""
