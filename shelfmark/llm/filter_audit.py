"""How filters interact: what each filter removes at each step of each order, from one CUBE over failure flags and part.

Each document gets a failure flag for each filter. Flags are counted by part, and a CUBE over the counted rows (there are
2^n for each part at most) makes all grouping sets of the flags: in the row of a set of flags that are all false
stand the documents that survive just these filters. A step of an order compares the survivors of the filters before it
with those of the filters up to it, so that steps are a join of pairs of subsets, and no document is read twice.

Filter E, a copy of a text with a smaller id, compares ids with the least id of a text's SHA-256; both sides of that
join, and of the join with the labels, can be split where one text is a third of all rows. Null ids are
salted, so that they are no hot key.

Defined results: a null text counts as empty, and empty texts are copies of each other; a null doc_id is neither smaller
nor larger than another, so that it neither fails E nor makes others fail it, and has no labels; rows with equal ids and
equal texts are not copies of each other; several labels of one id count as quality or toxic if any of them is; a null
part is the empty string, together with empty ones; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common

WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 50, 65, 5

_COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text; ``words`` is its array of words."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < LEAST_WORDS,
        "B": distinct.cast("long") * 100 < n.cast("long") * LEAST_DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITAL_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """``part, A, B, C, D, E, good, toxic`` of each document."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    split = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    failures = [condition.alias(name) for name, condition in text_failures(F.col("text")).items()]
    narrow = common.stored(split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *failures))
    least = narrow.groupBy("digest").agg(F.min("doc_id").alias("least"))
    copies = narrow.join(common.stored(least), "digest").withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", F.rand(7))).otherwise(0)
    met = copies.withColumn("__salt", salt).join(judged.withColumn("__salt", F.lit(0).cast("long")), ["doc_id", "__salt"], "left")
    return met.select("part", *"ABCDE", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def survivors(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """``part, mask, n, good, toxic`` for each part and each set of filters (bit i of mask: filter i), zeros included.

    ``flags`` has a boolean column for each filter, and ``part, good, toxic``.
    """
    counted = flags.groupBy("part", *filters).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    chosen = sum(((1 - F.grouping(f)) * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    cube = counted.cube("part", *filters).agg(*(F.sum(c).alias(c) for c in _COUNTS), F.grouping("part").alias("no_part"), chosen.alias("mask"))
    passed = cube.where("no_part = 0")
    for f in filters:
        passed = passed.where(F.coalesce(~F.col(f), F.lit(True)))  # null: the flag isn't in this grouping set
    masks = F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask")
    every = counted.select("part").distinct().select("part", masks)
    found = every.join(passed.select("part", "mask", *_COUNTS), ["part", "mask"], "left")
    return found.select("part", "mask", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS))


def audit(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``shapley`` is what the step's filter removes, summed over all orders.
    """
    spark, size = flags.sparkSession, len(filters)
    bit, all_of = {f: 1 << i for i, f in enumerate(filters)}, (1 << size) - 1
    sets = common.stored(survivors(flags, filters))
    steps = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(order), k + 1, f, before, before | bit[f]))
            before |= bit[f]
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int")

    was = sets.select("part", F.col("mask").alias("before"), *(F.col(c).alias(f"{c}_was") for c in _COUNTS))
    now = sets.select("part", F.col("mask").alias("after"), *_COUNTS)
    pairs = [(f, m, m | bit[f], factorial(bin(m).count("1")) * factorial(size - 1 - bin(m).count("1"))) for f in filters for m in range(all_of + 1) if not m & bit[f]]
    pairs = spark.createDataFrame(pairs, "filter string, before int, after int, orders long")
    by_pair = was.join(F.broadcast(pairs), "before").join(now, ["part", "after"]).withColumn("gone", F.col("n_was") - F.col("n"))
    alone, last = F.col("before") == 0, F.col("after") == all_of
    of_filter = by_pair.groupBy("part", "filter").agg(
        F.sum(F.col("gone") * F.col("orders")).alias("shapley"), F.max(F.when(alone, F.col("gone"))).alias("fails"), F.max(F.when(last, F.col("gone"))).alias("unique_fails")
    )
    by_step = by_pair.select("part", "filter", "before", F.col("n").alias("kept"), F.col("gone").alias("removed"), (F.col("good_was") - F.col("good")).alias("good_lost"), (F.col("toxic_was") - F.col("toxic")).alias("toxic_lost"))
    joined = by_step.join(of_filter, ["part", "filter"]).join(F.broadcast(steps.drop("after")), ["filter", "before"])
    return joined.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
judged AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM sized d LEFT JOIN judged USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
counted AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
               || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM flags GROUP BY ALL),
placed AS (
  SELECT part, filter_order, step, substr(filter_order, step::INT, 1) AS f, failed, n, good, toxic,
         len(regexp_extract_all(failed, '[' || substr(filter_order, 1, step::INT) || ']')) > 0 AS gone_after,
         step > 1 AND len(regexp_extract_all(failed, '[' || substr(filter_order, 1, greatest(step::INT - 1, 1)) || ']')) > 0 AS gone_before
  FROM counted, orders, (SELECT unnest(range(1, 6)) AS step)),
steps AS (
  SELECT part, filter_order, step::INT AS step, f,
         coalesce(sum(n) FILTER (NOT gone_after), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (gone_after AND NOT gone_before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (contains(failed, f) AND gone_before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (gone_after AND NOT gone_before), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (gone_after AND NOT gone_before), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM steps
"""
