"""Reply lines as a stream of NDJSON files that hold each line once, whatever is started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from shelfmark.sources import files
from shelfmark.streaming.replies import LINE


def ndjson_sink(lines: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that puts each micro-batch into a folder of its own, named by the batch's id.

    A batch that ran before it was noted as done runs again after a restart, with the same id and the same rows, and
    replaces its folder. Lines of a request stand in one file, in the order of seq; files that are not finished are not seen.
    """

    def put(batch: DataFrame, number: int) -> None:
        ordered = batch.repartition("request_id").sortWithinPartitions("request_id", "seq")
        files.to_ndjson(ordered).write.mode("overwrite").text(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """All lines that the sink has finished."""
    return files.parse_ndjson(spark.read.schema("value string, batch long").text(path).select("value"), LINE)
