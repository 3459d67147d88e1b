"""What the training-data operators share: text passes over Arrow batches, hashing in numpy, shared folders, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfmark.session import remove, shared_dir, stored, temporary

__all__ = ["remove", "shared_dir", "stored", "temporary"]  # and all that is defined here

#: Bytes of text that one numpy pass holds at a time; a longer document is a pass of its own.
PASS_BYTES = 2 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: A random odd-free 64-bit value for each byte, from a fixed seed, so that all executors agree.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared folders -------------------------------------------------------------------------------------------------


def checkpointed(df: DataFrame) -> DataFrame:
    """A small or narrow table, written to the shared folder, so that a lost executor costs no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_tasks(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key for costly work in Python: over all partitions, which small sizes shall not make fewer."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Bytes of file names that are broadcast to number rows by.
FILE_NAMES = 16 << 20


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own, which is the same in each read, however the files are cut into partitions.

    The number is made of the row's file, by the order of the files' names, and its place in it, which the Parquet reader
    knows. Rows that don't come straight from files (a join, a shuffle, a table in memory) are written once, and numbered so;
    and so are, with their numbers, those of so many files that the names are over FILE_NAMES bytes, and no broadcast.
    """
    try:
        file, row = _place(df)
    except AnalysisException:
        df = stored(df)
        file, row = _place(df)
    names = sorted(r[0] for r in df.select(file).distinct().collect())  # as many as files, which the driver lists anyway
    if sum(map(len, names)) > FILE_NAMES:
        return stored(df.withColumn(name, F.monotonically_increasing_id()))
    ordinals = df.sparkSession.createDataFrame(list(enumerate(names)), "__ordinal long, __file string")
    placed = df.withColumns({"__file": file, "__at": row}).join(F.broadcast(ordinals), "__file")
    return placed.select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col("__ordinal") * (1 << 40) + F.col("__at")).alias(name))


def _place(df: DataFrame) -> tuple[Column, Column]:
    """The file and the place in it of each row."""
    found = df.metadataColumn("_metadata")
    file, row = found["file_path"], found["row_index"]
    df.select(file, row).schema  # noqa: B018  an error for rows that have none
    return file, row


# --- text passes ----------------------------------------------------------------------------------------------------


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), and where each begins and ends in them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def passes(batch: pa.RecordBatch, text: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if len(sizes) > begin:
        yield batch.slice(begin)


def map_texts(df: DataFrame, fn: Callable[[pa.Array], dict], fields: list[StructField], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and what ``fn`` makes of each text, row by row, without a shuffle.

    ``fn`` takes an Arrow array of texts and returns a column for each field. An input column with the name of a
    result column is replaced by it.
    """
    made = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    own = text if text in keep and dict(df.dtypes)[text] == "string" else "__text"  # a kept text is not sent twice
    source = df.select(*(F.col(f"`{c}`") for c in keep), *([] if own == text else [F.col(f"`{text}`").cast("string").alias(own)]))
    schema = StructType([f for f in source.schema.fields if f.name != "__text"] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for part in passes(batch, own):
                found = fn(part.column(own))
                columns = [part.column(c) for c in keep] + [found[f.name] for f in fields]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return source.mapInArrow(run, schema)


# --- hashing --------------------------------------------------------------------------------------------------------


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial hashes of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


def space_bytes(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross documents: begin, end and document of each."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


# --- leaving out what is not asked for ------------------------------------------------------------------------------

#: Bits of the filter that is broadcast: 2 MB at most, however many keys are wanted.
FILTER_BITS = 1 << 24
_BUCKET_BITS = 32_768  # of one bitmap of bitmap_construct_agg


def narrowed(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among those of ``wanted``, before a join that tells for sure and shuffles.

    Hashes of the wanted keys are bits of FILTER_BITS; the bitmaps of those buckets that have any are broadcast, and so
    at most FILTER_BITS / 8 bytes. Of keys that are not wanted a share passes, as large as the share of bits that are set.
    """
    place = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("bit")).select(F.bitmap_bucket_number("bit").alias("__bucket"), F.bitmap_bit_position("bit").alias("at"))
    filters = bits.groupBy("__bucket").agg(F.bitmap_construct_agg("at").alias("__bitmap"))
    met = rows.withColumn("__bit", place).withColumn("__bucket", F.bitmap_bucket_number("__bit")).join(F.broadcast(filters), "__bucket")
    at = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.substring("__bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*(F.col(f"`{c}`") for c in rows.columns))


# --- connected components -------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge list of longs; component is its smallest node.

    Contraction: in each round every node goes to the neighbour (or itself) of least priority, and on to that one's, and
    edges are rewritten between what is left. In even rounds the priority is the node itself, which ends stars and
    groups of copies at once; in odd rounds it is a hash that changes from round to round, so that a constant share of
    the nodes of any graph goes and the rounds grow with the logarithm of the input. Minima are combined before they
    are shuffled, so that a node with a third of all edges is no hot key, and are written before they are joined back, so
    that adaptive execution can split such a node's rows. Rounds end in a written table; the driver only learns whether
    edges are left.
    """
    ends = (F.col(a).cast("long"), F.col(b).cast("long"))
    left = stored(edges.select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).where("a <> b").distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        priority = (lambda c: F.xxhash64(c, F.lit(len(moves)))) if len(moves) % 2 else F.col
        least = both.groupBy("a").agg(F.min(F.struct(priority("b").alias("h"), F.col("b").alias("v"))).alias("l"))
        one = stored(least.select(F.col("a").alias("old"), F.least("l", F.struct(priority("a").alias("h"), F.col("a").alias("v")))["v"].alias("new")))
        on = one.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        to = stored(one.join(on, "new").select("old", F.col("newer").alias("new")))
        moves.append(to)
        joined = left.join(to.select(F.col("old").alias("a"), F.col("new").alias("na")), "a").join(to.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b")
        left = stored(joined.select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).where("a <> b").distinct())
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = moves[0].select(F.col("old").alias("node"), F.col("new").alias("now"))
    for to in moves[1:]:
        label = label.join(to.where("old <> new"), label["now"] == to["old"], "left").select("node", F.coalesce("new", "now").alias("now"))
    label = stored(label)
    smallest = stored(label.groupBy("now").agg(F.min("node").alias("component")))
    return stored(label.join(smallest, "now").select("node", "component"))
