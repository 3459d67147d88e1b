"""File sources and sinks: NDJSON, keyed JSON objects, request tables in CSV, partitioned chunk collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from shelfmark.operators import scans
from shelfmark.operators.fusion import check_partitions

#: The columns of a chunk collection.
CHUNK = "id BIGINT, book_id BIGINT, book_name STRING, `order` INT, author STRING, category STRING, part_title STRING, start_page_id INT, page_offset INT, page_num_range ARRAY<INT>, text STRING"
DEFAULT_COLLECTION = "library"
DEFAULT_PARTITION = "_default"


def write_collection(chunks: DataFrame, root: str, partition: str = "category", name: str = DEFAULT_COLLECTION) -> None:
    """Chunks as Parquet, one folder for each partition value, and beside it a table of the values and their numbers of rows.

    Rows of a partition are gathered before writing; one with very many is split.
    """
    chunks.hint("rebalance", partition).sortWithinPartitions(partition, "id").write.mode("overwrite").partitionBy(partition).parquet(f"{root}/{name}")
    counted = chunks.sparkSession.read.schema(chunks.schema).parquet(f"{root}/{name}").groupBy(F.col(partition).cast("string").alias("partition")).agg(F.count("*").alias("n"))  # from the files' footers
    counted.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}.partitions")


def read_collection(spark: SparkSession, root: str, partitions: list[str] | None = None, partition: str = "category", name: str = DEFAULT_COLLECTION) -> DataFrame:
    """The collection, or only some of its partitions; other folders are not read. Unknown partitions are an error."""
    rows = spark.read.parquet(f"{root}/{name}")
    if not partitions:
        return rows
    check_partitions(partitions, partition_names(spark, root, name))
    return rows.where(F.col(partition).isin(partitions))


def partitions_of(spark: SparkSession, root: str, name: str = DEFAULT_COLLECTION) -> DataFrame:
    """``partition, n``: a collection's partition values and their numbers of rows, as it was written; no chunk is read."""
    return spark.read.schema("partition string, n long").parquet(f"{root}/{name}.partitions")


def partition_names(spark: SparkSession, root: str, name: str = DEFAULT_COLLECTION) -> list[str]:
    """Partition values, in order; a collection without any has the default one."""
    return [r[0] for r in partitions_of(spark, root, name).select("partition").orderBy("partition").collect()] or [DEFAULT_PARTITION]


def to_ndjson(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON object a row (null fields left out), as ``value``."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("value"))


def write_ndjson(rows: DataFrame, path: str) -> None:
    to_ndjson(rows).write.mode("overwrite").text(path)


def parse_ndjson(lines: DataFrame, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines in ``value``; blank lines and lines that are no JSON object are skipped."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    probe = StructType([*kind.fields]).add("_bad", "string")
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", probe, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select(*(F.col(f"r.`{f.name}`") for f in kind.fields))


def read_ndjson(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return parse_ndjson(spark.read.text(path), schema)


def split_stream(buffers: DataFrame, key: str, order: str, chunk: str = "chunk") -> DataFrame:
    """Lines of a text that came in pieces: pieces are joined in order and cut at line ends; the tail counts as a line."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(chunk).alias("c"))))
    whole = buffers.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("whole"))
    return whole.select(key, F.posexplode(F.split("whole", "\n")).alias("line_no", "value")).where(F.trim("value") != "")


def keyed_json(lines: DataFrame, value: str | DataType, column: str = "value", key: str = "id") -> DataFrame:
    """Rows of one JSON object whose keys are ids: ``id`` and the fields of each value."""
    kind = value if isinstance(value, str) else value.simpleString()
    parsed = lines.select(F.explode(F.from_json(column, f"map<string,{kind}>")).alias("k", "v"))
    return parsed.select(F.col("k").try_cast("bigint").alias(key), "v.*")


def read_request_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hits of queries, one file a query; the file's stem is the query and page ranges are parsed lists."""
    rows = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1)), r"\.csv$", "")
    return rows.withColumn("page_num_range", F.from_json("page_num_range", "array<int>")).withColumn("query", stem)


#: Sources that one request document holds.
MOST_SOURCES = 1000


def requests(hits: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """``query, piece, value``: JSON documents of each query, with its sources by falling score, ``most`` in each."""
    source = F.struct(*[F.col(c) for c in hits.columns if c != "query"])
    placed = scans.pieces(hits.select("query", (-F.col("score")).alias("__s"), F.col("id").alias("__i"), source.alias("__source")), ["query"], ["__s", "__i"], most)
    ordered = F.array_sort(F.collect_list(F.struct("__s", "__i", "__source")))
    grouped = placed.groupBy("query", "piece").agg(F.transform(ordered, lambda x: x["__source"]).alias("sources"))
    return grouped.select("query", "piece", F.to_json(F.struct("query", "sources")).alias("value"))


def fill_template(template: str, **values) -> object:
    """A template with ``{name}`` places as a Column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
