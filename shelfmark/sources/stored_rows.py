"""Rows that change, by key: an appended log, and snapshots that rewrite only those buckets that the log touched.

Every change is a batch of rows under ``log``. A read takes the newest snapshot and the batches after it; of each key the last
batch counts. ``compact`` writes the buckets of the new batches once more, under ``state``, and then a list that says in
which snapshot each bucket stands now. A reader goes by the newest finished list, whose files are never changed, and so sees
the state before or after a change, whole. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.session import finished_folders

_BUCKET, _SEQ, _GONE = "__bucket", "__seq", "__gone"


class StoredRows:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)
        self._kept = StructType([*self.schema.fields, *StructType.fromDDL(f"{_GONE} boolean, {_SEQ} long, {_BUCKET} int").fields])

    def append(self, rows: DataFrame) -> None:
        """New rows, and new states of rows that are there; one row for each key."""
        self._log(rows.select(*self.schema.names), False)

    def delete(self, keys: DataFrame) -> None:
        """The rows with these keys go."""
        self._log(keys.select(*(F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema)), True)

    def _log(self, rows: DataFrame, gone: bool) -> None:
        n = max([-1, *finished_folders(self.spark, f"{self.path}/log")]) + 1
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        marked = rows.withColumns({_GONE: F.lit(gone), _SEQ: F.lit(n).cast("long"), _BUCKET: bucket})
        marked.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/log/{n}")

    def _snapshot(self) -> tuple[int, dict[int, int]]:
        """The last batch of the newest list, and in which snapshot each bucket stands; a row for each bucket at most."""
        lists = finished_folders(self.spark, f"{self.path}/lists")
        if not lists:
            return -1, {}
        return max(lists), {r["bucket"]: r["at"] for r in self.spark.read.parquet(f"{self.path}/lists/{max(lists)}").collect()}

    def _parts(self, buckets: list[int] | None = None) -> tuple[list[int], dict[int, int], DataFrame]:
        """Batches that no snapshot holds, the snapshot's buckets, and the rows of both, in some buckets or all."""
        upto, places = self._snapshot()
        batches = [n for n in finished_folders(self.spark, f"{self.path}/log") if n > upto]
        found = [self._part(f"log/{n}") for n in batches]
        for at in sorted(set(places.values())):
            found.append(self._part(f"state/{at}").where(F.col(_BUCKET).isin([b for b, a in places.items() if a == at])))
        rows = self.spark.createDataFrame([], self._kept)
        for part in found:
            rows = rows.unionByName(part if buckets is None else part.where(F.col(_BUCKET).isin(buckets)))
        return batches, places, rows

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._kept).parquet(f"{self.path}/{name}").select(*self._kept.names)

    def _last(self, rows: DataFrame) -> DataFrame:
        whole = F.struct(*self._kept.names)
        return rows.groupBy(self.key).agg(F.max_by(whole, F.col(_SEQ)).alias("r")).select("r.*").where(~F.col(_GONE))

    def read(self) -> DataFrame:
        """All rows as they are now; what is read does not change when the table does."""
        return self._last(self._parts()[2]).select(*self.schema.names)

    def compact(self) -> list[int]:
        """A new snapshot of the buckets that were touched since the last one; returns them."""
        batches, places, rows = self._parts()
        if not batches:
            return []
        touched = sorted(r[0] for r in rows.where(F.col(_SEQ).isin(batches)).select(_BUCKET).distinct().collect())  # as many as buckets
        upto = max(batches)
        self._last(self._parts(touched)[2]).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/state/{upto}")
        now = places | dict.fromkeys(touched, upto)
        self.spark.createDataFrame(list(now.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{upto}")
        return touched
