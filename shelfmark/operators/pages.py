"""Pages of books: groups of equal page numbers, tables of contents as of a page, trees of entries, chunks of text."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from shelfmark.functions.text import SPACE, clean_html, spliced_html, stripped
from shelfmark.operators import scans
from shelfmark.session import spread, stored


def islands(pages: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows with ``island``, the 0-based number of the run of equal values they are in; a later run is another one.

    Rows with the same place in the order count as sorted by value. Keys are dealt whole, over tasks of bounded size; the
    rows of a key that is larger than a task's share are dealt by ranges of the order.
    """
    tasks, large = scans.sized(pages, [key])
    if large is None:
        return _whole(pages, tasks, key, order, value)
    return _whole(pages.where(~large), tasks, key, order, value).unionByName(_ranged(pages.where(large), tasks, key, order, value))


def _runs(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows with ``__changed``, 1 where another value begins inside the group, and ``__run``, its sum so far."""
    walk = Window.partitionBy(*by).orderBy(order, value)
    changed = F.when(F.row_number().over(walk) > 1, (~F.lag(value).over(walk).eqNullSafe(F.col(value))).cast("long")).otherwise(0)
    inside = rows.withColumn("__changed", changed)
    return inside.withColumn("__run", F.sum("__changed").over(walk.rowsBetween(Window.unboundedPreceding, 0)))


def _whole(pages: DataFrame, tasks: int, key: str, order: str, value: str) -> DataFrame:
    """``islands`` of keys that a task holds."""
    return _runs(pages.repartition(tasks, key), [key], order, value).select(*pages.columns, F.col("__run").alias("island"))


def _ranged(pages: DataFrame, tasks: int, key: str, order: str, value: str) -> DataFrame:
    """``islands`` of keys that no task holds."""
    rows = scans.dealt(pages, order, tasks).repartition(tasks, key, scans.RANGE)
    counted = _runs(rows, [key, scans.RANGE], order, value)

    # each range's changes, and whether it begins with another value than the range before it ended with
    place = F.struct(order, value)
    passed = [F.sum("__changed").alias("__n"), F.min_by(F.struct(value), place).alias("__head"), F.max_by(F.struct(value), place).alias("__tail")]
    ends = counted.groupBy(F.col(key).alias("__k"), F.col(scans.RANGE).alias("__r")).agg(*passed)
    ranges = Window.partitionBy("__k").orderBy("__r")
    begins = (~F.lag("__tail").over(ranges).eqNullSafe(F.col("__head"))).cast("long")
    upto = F.sum(F.col("__n") + F.col("__begins")).over(ranges.rowsBetween(Window.unboundedPreceding, 0))
    before = ends.select("__k", "__r", "__n", begins.alias("__begins")).select("__k", "__r", (upto - F.col("__n") - 1).alias("__before"))
    met = counted.join(before, F.col(key).eqNullSafe(F.col("__k")) & (F.col(scans.RANGE) == F.col("__r")))
    return met.withColumn("island", F.col("__before") + F.col("__run")).select(*pages.columns, "island")


def page_groups(pages: DataFrame, key: str = "book_id", order: str = "page_id", number: str = "page_num", title: str = "part_title", html: str = "display_elem") -> DataFrame:
    """One row for each run of pages with one number: joined html, the last title that is not empty, the first page."""
    runs = islands(pages, key, order, number)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), clean_html(F.coalesce(F.col(html), F.lit(""))).alias("h"))))
    grouped = runs.groupBy(key, "island").agg(
        F.first(number).alias(number), F.min(order).alias("first_page"), F.count("*").alias("n_pages"),
        F.max_by(title, F.when(F.coalesce(F.col(title), F.lit("")) != "", F.col(order))).alias(title), parts.alias("parts"),
    )
    placed = scans.running(scans.dealt(grouped, "island"), [key], ["island"], previous={"__before": title})
    shown = (F.coalesce(F.col(title), F.lit("")) != "") & ~F.col("__before.v").eqNullSafe(F.col(title))
    return placed.withColumn("html", spliced_html(F.transform("parts", lambda p: p["h"]))).withColumn("show_title", shown).drop("parts", "__before", scans.RANGE)


def as_of(probes: DataFrame, entries: DataFrame, probe_key: str, active: str, entry_key: str = "id", at: str = "page_id", order: str = "pos", by: str | None = None) -> DataFrame:
    """For each probe the entry with the greatest ``at`` that is not after it; of equals, the first in list order.

    Entries and probes are merged and walked once in order, so that no pair is formed; ``by`` keeps books apart. A book
    is dealt by ranges of its pages, so that one with all probes is no single task.
    """
    group = [by] if by else []
    heads = entries.groupBy(*group, at).agg(F.min_by(entry_key, order).alias(entry_key))
    left = heads.select(*group, F.col(at).cast("long").alias("__at"), F.lit(0).alias("__probe"), F.col(entry_key).alias("__entry"), F.lit(None).cast("long").alias("__key"))
    right = probes.select(*group, F.col(active).cast("long").alias("__at"), F.lit(1).alias("__probe"), F.lit(None).cast(entries.schema[entry_key].dataType).alias("__entry"), F.col(probe_key).cast("long").alias("__key"))
    merged = scans.running(scans.dealt(left.unionByName(right), "__at"), group, ["__at", "__probe"], lasts={"entry": F.col("__entry")})
    return merged.where("__probe = 1").select(*group, F.col("__key").alias(probe_key), F.col("__at").alias(active), "entry")


def as_of_clicked(probes: DataFrame, entries: DataFrame, probe_key: str, active: str, clicked: str, entry_key: str = "id", at: str = "page_id", order: str = "pos", by: str | None = None) -> DataFrame:
    """As ``as_of``, but the entry that was clicked stays active as long as it stands on the active page."""
    group = [by] if by else []
    found = as_of(probes, entries, probe_key, active, entry_key, at, order, by)
    own = entries.select(*group, F.col(entry_key).alias("__clicked"), F.col(at).cast("long").alias(active))
    asked = probes.select(*group, F.col(probe_key).cast("long").alias(probe_key), F.col(active).cast("long").alias(active), F.col(clicked).alias("__clicked"))
    held = asked.join(own, [*group, "__clicked", active]).select(probe_key, "__clicked").distinct()
    return found.join(held, probe_key, "left").withColumn("entry", F.coalesce("__clicked", "entry")).drop("__clicked")


def tree(entries: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """Entries with ``root`` set where the parent is 0, null or unknown, else with their parent."""
    ids = entries.select(F.col(key).alias("__parent")).distinct()
    joined = entries.join(ids, entries[parent] == ids["__parent"], "left")
    root = F.col("__parent").isNull() | (F.coalesce(F.col(parent), F.lit(0)) == 0)
    return joined.withColumn("root", root).withColumn("parent_id", F.when(~root, F.col(parent))).drop("__parent")


def depths(entries: DataFrame, key: str = "id", parent: str = "parent", path: bool = True) -> DataFrame:
    """``id, depth, path`` of every entry that hangs on a root, however deep, by pointer doubling.

    Each entry points at its parent. In each round it points on to where its target points, so that a chain of depth d
    takes log2(d) joins, each a written table. Entries that never reach a root are in ``cycles``. Without ``path``, which
    is as long as an entry is deep, only depths are made.
    """
    found, apart = _climbed(entries, key, parent, False)
    if not path:
        return found.select("id", "depth")
    # paths only of what ends: those of a cycle would double in each round
    below = entries if apart.isEmpty() else entries.join(apart.select(F.col("id").alias(key)), key, "left_anti")
    return _climbed(below, key, parent, True)[0].select("id", "depth", "path")


def cycles(entries: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """``id`` of the entries that no root is above: those of a cycle, and those that hang on one."""
    return _climbed(entries, key, parent, False)[1].select("id")


def _climbed(entries: DataFrame, key: str, parent: str, path: bool) -> tuple[DataFrame, DataFrame]:
    """Entries with a root above them, and those without."""
    own = [F.col(key).cast("string").alias("path")] if path else []
    rows = tree(entries, key, parent).select(F.col(key).alias("id"), F.col("parent_id").alias("up"), F.when(F.col("root"), 0).otherwise(1).cast("long").alias("depth"), *own)
    rows = stored(rows)
    rounds = max(1, rows.count()).bit_length()  # a chain is no longer than there are entries
    for _ in range(rounds):
        left = rows.where("up is not null")
        if left.isEmpty():
            break
        on = rows.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), *([F.col("path").alias("__path")] if path else []))
        longer = [F.concat("__path", F.lit("/"), "path").alias("path")] if path else []
        moved = left.join(on, "up").select("id", F.col("__up").alias("up"), (F.col("depth") + F.col("__depth")).alias("depth"), *longer)
        rows = stored(rows.where("up is null").unionByName(moved))
    return rows.where("up is null"), rows.where("up is not null")


#: Words of a chunk, sentences that chunks share, chunks that are embedded at a time.
LEAST_WORDS, MOST_WORDS, OVERLAP, BATCH = 100, 400, 2, 8
#: Sentences on either side of a gap that are compared; words after which a block ends; characters above which
#: a document is dealt over tasks by blocks; characters of chunks that a task holds before it passes them on.
SIDE, BLOCK_WORDS, WHOLE_CHARS, PASS_CHARS = 3, 8000, 4_000_000, 4_000_000


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int | None = None, most: int = MOST_WORDS, overlap: int = OVERLAP, block_words: int = BLOCK_WORDS, whole_chars: int = WHOLE_CHARS) -> DataFrame:
    """``key, chunk, batch, first_sentence, n_words, n_own, text``: runs of whole sentences, each after the last
    ``overlap`` sentences of the one before; ``n_own`` are the words without those.

    A chunk has ``least`` (a quarter of ``most`` by default) to ``most`` words of its own, where sentences allow it, and ends where its text coheres least: of
    the gaps that leave such sizes, the one with the fewest words in common between the SIDE sentences before and after it
    (Jaccard; the first of equal ones). The rest of a block may be shorter. Each row is a document of its own, which is
    walked block by block where it is read, without a shuffle; chunks don't cross blocks of about ``block_words`` words.
    The blocks of documents of more than ``whole_chars`` are dealt, so that a very long one is cut by many tasks.
    """
    least = most * LEAST_WORDS // MOST_WORDS if least is None else least
    head, sizes = StructType([docs.schema[key]]), [StructField(n, LongType()) for n in ("n_words", "n_own")]
    schema = StructType(head.fields + [StructField("chunk", LongType()), StructField("batch", LongType()), StructField("first_sentence", IntegerType()), *sizes, StructField("text", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for name, first, sentences, words in _blocks(batches, block_words):
                if first == 0:
                    chunk, before = 0, ([], [])
                for begin, *made, before in _cut(sentences, words, least, most, overlap, before):
                    yield name, chunk, chunk // BATCH, first + begin, *made
                    chunk += 1

        yield from _record_batches(rows(), schema)

    long = F.length(text) > whole_chars
    found = _sentences(spread(docs.where(~long).select(key, text)), key, text).mapInArrow(cut, schema)
    rest = docs.where(long).select(F.struct(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key")).alias("doc"), text)
    return found if rest.isEmpty() else found.unionByName(_dealt_chunks(rest, text, least, most, overlap, block_words).select(F.col("key").alias(key), *schema.names[1:]))


def _dealt_chunks(docs: DataFrame, text: str, least: int, most: int, overlap: int, block_words: int) -> DataFrame:
    """``chunks`` of ``doc``, a struct of the row's own id and its key: blocks are cut by themselves, anywhere. What a block
    passes on, the number of its chunks and its last sentences, is added up over the blocks of the document."""
    doc = docs.schema["doc"]
    block = StructType([doc, StructField("block", IntegerType()), StructField("sentences", ArrayType(StringType())), StructField("sizes", ArrayType(LongType()))])
    tail = StructType([StructField("n", IntegerType()), StructField("words", LongType()), StructField("text", StringType())])
    piece = StructType([doc, block["block"], StructField("at", LongType()), StructField("first", IntegerType()), StructField("n_words", LongType()), StructField("n_own", LongType()), StructField("text", StringType()), StructField("tail", tail)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for name, first, sentences, words in _rows(batches):
                made = list(_cut(sentences, words, least, most, overlap, ([], [])))
                for i, (begin, *counts, joined, (last, sizes)) in enumerate(made):
                    after = {"n": len(last), "words": sum(sizes), "text": " ".join(last) if last else None}
                    yield name, first, i, first + begin, *counts, joined, after if i + 1 == len(made) else None

        yield from _record_batches(rows(), piece)

    blocks = _sentences(docs, "doc", text).mapInArrow(lambda batches: _record_batches(_blocks(batches, block_words), block), block)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(blocks.repartition(parts, "doc.id", "block").mapInArrow(cut, piece)).withColumn("id", F.col("doc.id"))
    walk = Window.partitionBy("id").orderBy("block")  # a row for each block
    earlier = F.coalesce(F.sum(F.col("at") + 1).over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = pieces.where("tail is not null").select("id", "block", earlier.alias("earlier"), F.lag("tail").over(walk).alias("before"))
    placed = pieces.join(carried, ["id", "block"]).withColumn("chunk", F.col("earlier") + F.col("at")).withColumn("before", F.when(F.col("at") == 0, F.col("before")))
    n_words, first = (F.coalesce(F.col(f"before.{c}"), F.lit(0)) for c in ("words", "n"))
    return placed.select(
        F.col("doc.key").alias("key"), "chunk", F.floor(F.col("chunk") / BATCH).alias("batch"), (F.col("first") - first).alias("first_sentence"),
        (n_words + F.col("n_words")).alias("n_words"), "n_own", F.concat_ws(" ", "before.text", "text").alias("text"),
    )


def _sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, sentence, n``: sentences that are not blank, numbered in each row, with their words."""
    pieces = F.filter(F.split(F.col(text), r"(?<=[.!?؟])\s+"), lambda s: F.rlike(s, F.lit(f"[^{SPACE[1:-1]}]")))
    placed = docs.select(key, F.posexplode(pieces).alias("at", "sentence"))
    return placed.withColumn("n", F.size(F.split(stripped(F.col("sentence")), r"\s+")).cast("long"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _record_batches(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about PASS_CHARS characters of text, whose column is named text or sentences."""
    out, held, size = to_arrow_schema(schema), [], 0
    measured = next(i for i, n in enumerate(schema.names) if n in ("text", "sentences"))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)

    for row in rows:
        held.append(row)
        size += len(row[measured]) if isinstance(row[measured], str) else sum(map(len, row[measured]))
        if size > PASS_CHARS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple]:
    """Key, place of the first sentence, sentences and their words of each block, of rows of ``_sentences`` in their order."""
    held, block, words = None, 0, 0
    for name, at, sentence, n in _rows(batches):
        words = words if at else 0
        if at == 0 or words // block_words != block:
            if held:
                yield held
            held, block = (name, at, [], []), words // block_words
        held[2].append(sentence)
        held[3].append(n)
        words += n
    if held:
        yield held


def _cut(sentences: list[str], sizes: list[int], least: int, most: int, overlap: int, before: tuple[list[str], list[int]]) -> Iterator[tuple]:
    """Of each chunk of a block: place of its first sentence, words with and without the overlap, text, and its last
    sentences with their words, which the next one begins with; ``before`` are those that the block begins with."""
    starts = chunk_starts(sentences, sizes, least, most)
    for begin, end in zip(starts, [*starts[1:], len(sentences)]):
        own, last = sum(sizes[begin:end]), slice(max(begin, end - overlap), end)
        shared, words = before
        before = sentences[last], sizes[last]
        yield begin - len(shared), sum(words) + own, own, " ".join(shared + sentences[begin:end]), before


def chunk_starts(sentences: list[str], sizes: list[int], least: int, most: int) -> list[int]:
    """Places of the sentences that chunks begin with."""
    cohesion = _Cohesion(sentences)
    upto = [0, *accumulate(sizes)]
    starts, n = [0], len(sentences)
    while upto[n] - upto[starts[-1]] > most:
        at = starts[-1]
        after = max(at + 1, bisect_left(upto, upto[at] + least))
        fitting = range(after, min(n, bisect_right(upto, upto[at] + most)))
        whole = range(after, min(fitting.stop, bisect_right(upto, upto[n] - least))) or fitting
        if whole:
            starts.append(min(whole, key=cohesion.__getitem__))
        else:  # one sentence leads from too few words to too many
            if after >= n:
                break
            starts.append(after)
    return starts


class _Cohesion(dict):
    """The share of words that the SIDE sentences before a gap and those after it have in common; each found once."""

    def __init__(self, sentences: list[str]):
        self.sentences, self.words, self.sides = sentences, {}, {}

    def side(self, begin: int, end: int) -> set[str]:
        if (begin, end) not in self.sides:
            for i in range(begin, min(end, len(self.sentences))):
                if i not in self.words:
                    self.words[i] = set(self.sentences[i].lower().split())
            self.sides[begin, end] = set().union(*(self.words[i] for i in range(begin, min(end, len(self.sentences)))))
        return self.sides[begin, end]

    def __missing__(self, gap: int) -> float:
        before, after = self.side(max(0, gap - SIDE), gap), self.side(gap, gap + SIDE)
        common = len(before & after)
        self[gap] = common / max(1, len(before) + len(after) - common)
        return self[gap]
