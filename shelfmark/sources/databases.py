"""Tables of databases, read in ranges of a key; filters, columns and limits go to the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, name: str, key: str, tasks: int | None = None, **options: str) -> DataFrame:
    """A table over JDBC, in as many ranges of a whole-number key as there are tasks (by default shuffle partitions).

    The key's bounds come from the database; rows without a key are in the first range.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if tasks is None else tasks
    bounds = spark.read.jdbc(url, f"(SELECT MIN({key}) AS low, MAX({key}) AS high FROM {name}) bounds", properties=options).first()
    low, high = (0, 0) if bounds[0] is None else (int(bounds[0]), int(bounds[1]))
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high + 1, numPartitions=min(tasks, high - low + 1), properties=options)
