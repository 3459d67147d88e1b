"""Running sums, last values and previous rows of ordered groups, where one group may hold all rows.

A window over a group is one task. Here rows are dealt by (group, range), where ranges cut the order at quantiles of all
rows. What a range passes on (its sum, its last value) is aggregated before the shuffle, added up over the few ranges of each
group, and put before the range's own rows; a window over (group, range) then sees what a window over the group would.
Rows that share a place in the first order column are in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "__range"
_FIRST = "__first"
#: Rows that a task sorts at a time, and that it sorts at most where a shuffle would have more than UNSORTED parts: up to these
#: (spark.shuffle.sort.bypassMergeThreshold) the tasks that write it hold no rows. Hashes that groups are counted by.
TASK_ROWS, MOST_ROWS, UNSORTED, BUCKETS = 500_000, 2_000_000, 200, 65_536


def sized(rows: DataFrame, by: list[str]) -> tuple[int, Column | None]:
    """Into how many tasks rows are dealt (about TASK_ROWS each, MOST_ROWS where that takes more than UNSORTED, and one for
    each core at least), and which rows may be of groups larger than a task's share; None if there are none.

    Rows are counted by BUCKETS hashes of their group. Hashes above the share, no more than there are tasks, are split: only
    these groups need ranges, and what ranges pass on grows with tasks, not with groups. Found by one aggregation.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("total"), F.collect_list(F.struct("bucket", "n")).alias("each"))  # BUCKETS at most
    total = F.coalesce("total", F.lit(0))
    parts = F.least(F.ceil(total / TASK_ROWS), F.greatest(F.lit(UNSORTED), F.ceil(total / MOST_ROWS)))
    dealt_over = every.withColumn("tasks", F.greatest(F.lit(cores), parts))
    large = F.filter("each", lambda e: e["n"] * F.col("tasks") > F.col("total"))
    found = dealt_over.select("tasks", large["bucket"].alias("large")).first()
    return int(found.tasks), bucket.isin(found.large) if found.large else None


def _ordinal(rows: DataFrame, order: str) -> Column:
    """A number that never falls where the order rises."""
    kind, c = dict(rows.dtypes)[order], F.col(order)
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return c.cast("int") if kind == "boolean" else c


def cuts_of(rows: DataFrame, order: str, n: int | None = None) -> list:
    """Where the order is cut into up to n stretches (as many as shuffle partitions): about n quantiles of all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n is None else n
    cuts = rows.agg(F.percentile_approx(_ordinal(rows, order), [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    return sorted(set(cuts or ()))


def dealt(rows: DataFrame, order: str, n: int | None = None, cuts: list | None = None) -> DataFrame:
    """Rows with RANGE: which stretch of the order they are in; nulls come first. The cuts are found by one aggregation."""
    cuts = cuts_of(rows, order, n) if cuts is None else cuts
    ordinal = _ordinal(rows, order)

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(ordinal > F.lit(cuts[middle]), place(middle + 1, high)).otherwise(place(low, middle))

    return rows.withColumn(RANGE, place(0, len(cuts)))


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, previous: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``dealt`` with new columns, in the order of ``order`` inside each group: ``sums`` up to and with the row,
    ``lasts`` the last value so far that is not null, ``previous`` the row before's column as a struct ``v``, null for
    the first row of a group. The first column of ``order`` is the one that rows were dealt by."""
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    measured = rows.withColumns({f"__{n}": c for n, c in {**sums, **lasts}.items()} | {f"__{n}": F.struct(F.col(c).alias("v")) for n, c in previous.items()})
    place = F.struct(*order)
    passed = [F.sum(f"__{n}").alias(f"__{n}") for n in sums]
    passed += [F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), place)).alias(f"__{n}") for n in lasts]
    passed += [F.max_by(f"__{n}", place).alias(f"__{n}") for n in previous]
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = measured.groupBy(*by, RANGE).agg(*passed)
    kinds = dict(measured.dtypes)
    carried = [F.sum(f"__{n}").over(earlier).cast(kinds[f"__{n}"]).alias(f"__{n}") for n in sums]
    carried += [F.last(f"__{n}", ignorenulls=True).over(earlier).alias(f"__{n}") for n in (*lasts, *previous)]
    carries = ends.select(*by, RANGE, *carried, F.row_number().over(Window.partitionBy(*by).orderBy(RANGE)).alias("__k")).where("__k > 1").drop("__k")

    both = measured.withColumn(_FIRST, F.lit(1)).unionByName(carries.withColumn(_FIRST, F.lit(0)), allowMissingColumns=True)
    walk = Window.partitionBy(*by, RANGE).orderBy(_FIRST, *order)
    so_far = walk.rowsBetween(Window.unboundedPreceding, 0)
    made = {n: F.sum(f"__{n}").over(so_far) for n in sums} | {n: F.last(f"__{n}", ignorenulls=True).over(so_far) for n in lasts} | {n: F.lag(f"__{n}").over(walk) for n in previous}
    walked = both.withColumns(made).where(F.col(_FIRST) == 1)
    return walked.select(*(c for c in rows.columns if c not in made), *made)


def pieces(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Rows with ``piece``: the first ``size`` rows of each group are piece 0, the next ones 1, and so on."""
    placed = running(dealt(rows, order[0]), by, order, {"__n": F.lit(1).cast("long")})
    return placed.withColumn("piece", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n", RANGE)
