"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists, inside groups that cannot lose a link.

Two documents link when 100 * |intersection| >= PERCENT * |union| of their sets of word shingles. Steps:

1. Each text becomes its sorted set of 64-bit shingle hashes. Documents with equal sets are one node from here on.
2. Sets whose sizes may link fall into the same or neighbouring size classes. For each pair of classes the space of
   hashes is cut into more segments than two linking sets can have differences, so that two linking sets agree in at
   least one whole segment (a few segments are added for empty ones; a set with more empty segments than that also
   emits the empty ones). Each segment's content, hashed, is a signature. Each node with a signature is a neighbour of
   the least node that has it, and so two nodes that link have a neighbour in common, or are neighbours.
3. First search: the set of each node that is someone's least neighbour is the query, and the sets of those, in blocks of
   BLOCK, are the inverted lists. Sets that occur in at least T of the query's lists are found by DivideSkip: the short
   lists are merged by a heap, the long ones are probed by binary search. This costs as much as there are nodes, and in a
   family of copies nearly all are in one component after it.
4. Second search: neighbours that are still in different components may hide links between them. Components that such
   neighbours connect make a group; a component of BLOCK nodes or more is cut into blocks of its own, the others share
   blocks, and each pair of blocks that are not of one component is a task: it walks its sets in order of size, asks
   the lists of the smaller ones, and adds its own entries to the lists. Sets already in one component are not probed.
5. The components of all links give each document its class.

Nothing but the fact whether edges are left comes to the driver. The sets of nodes with neighbours are made in a second
pass over those texts that a filter of bounded size lets through.

Defined results: a null or empty text has an empty set and is linked with nothing; a null doc_id has no links and a
null component; rows with equal ids are one node with several sets; repeated rows get equal results; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from shelfmark.llm import common

SHINGLE_WORDS, PERCENT = 3, 90
BLOCK = 256
#: Weight of a probe against a step of the merge, in the choice of how many lists count as long.
PROBE_COST = 0.01

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- sets -----------------------------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = common.buffers(texts)
    data = _LOWER[data]
    starts, ends, doc = common.word_spans(~common.space_bytes(data), offsets)
    n = len(offsets) - 1
    if not len(starts):
        return [np.zeros(0, common.U64)] * n
    rolling = common.Rolling(common.Rolling(common.BYTE_VALUES[data]).spans(starts, ends))
    windows = rolling.windows(words)
    first = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(np.unique(windows[a : b - words + 1]))
        elif b > a:
            out.append(common.mix(rolling.spans(np.array([a]), np.array([b])) ^ common.U64(b - a)))
        else:
            out.append(np.zeros(0, common.U64))
    return out


def may_link(a: int, b: int, percent: int = PERCENT) -> int:
    """Fewest common shingles of two linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


class SizeClasses:
    """Classes of set sizes such that linked sets are in the same or neighbouring classes, and their segments."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.begin = percent, [1]

    def of(self, size: int) -> int:
        while self.begin[-1] <= size:
            self.begin.append(self.begin[-1] * 100 // self.percent + 1)
        return bisect_left(self.begin, size + 1) - 1

    def differences(self, level: int) -> int:
        """Most differences between two linked sets of classes ``level`` and ``level + 1``."""
        while len(self.begin) < level + 3:
            self.begin.append(self.begin[-1] * 100 // self.percent + 1)
        both = 2 * (self.begin[level + 2] - 1)
        return both * (100 - self.percent) // (100 + self.percent)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        own = self.of(len(s)) if len(s) else 0
        sums = np.concatenate([np.zeros(1, common.U64), np.cumsum(common.mix(s), dtype=common.U64)])
        out = []
        for level in (own, own - 1):
            most = self.differences(level) if level >= 0 and len(s) else 0
            if most == 0:
                continue  # only equal sets link, and they are one node
            spare = min(2, most // 8)
            m = most + 1 + spare
            cuts = np.concatenate([[0], np.searchsorted(s, np.arange(1, m, dtype=common.U64) * common.U64((1 << 64) // m)), [len(s)]]).astype(np.int64)
            sizes = np.diff(cuts)
            sig = common.mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ common.mix(np.arange(m, dtype=common.U64) + common.U64(level << 32)) ^ sizes.astype(common.U64))
            out.append(sig if (sizes == 0).sum() > spare else sig[sizes > 0])
        return np.concatenate(out) if out else np.zeros(0, common.U64)


_DESCRIBED = [StructField("n_shingles", LongType()), StructField("d1", LongType()), StructField("d2", LongType()), StructField("signatures", ArrayType(LongType()))]


def _described(words: int, percent: int):
    def run(texts: pa.Array) -> dict:
        classes, sets = SizeClasses(percent), shingle_sets(texts, words)
        digests = _digests(sets)
        signatures = [classes.signatures(s).view(np.int64) for s in sets]
        values = np.concatenate(signatures) if signatures else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum([len(s) for s in signatures])]).astype(np.int32)
        return {"n_shingles": np.array([len(s) for s in sets], np.int64), "d1": digests[:, 0], "d2": digests[:, 1], "signatures": pa.ListArray.from_arrays(ends, values)}

    return run


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)


def _set_bytes(words: int):
    def run(texts: pa.Array) -> dict:
        sets = shingle_sets(texts, words)
        return {"own": _digests(sets)[:, 0], "shingles": [s.tobytes() for s in sets]}

    return run


# --- T-occurrence search --------------------------------------------------------------------------------------------


def divide_skip(lists: list[list[int]], needed: int, known: Callable[[int], bool] = lambda i: False) -> Iterator[tuple[int, int]]:
    """Ids in at least ``needed`` of the sorted lists, with the number of lists that hold each.

    An id that is known by the time it comes up is left out before it is probed.
    """
    lists = sorted(filter(None, lists), key=len)
    if len(lists) < needed:
        return
    long = min(needed - 1, int(needed / (PROBE_COST * np.log2(len(lists[-1]) + 1) + 1)))
    short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
    for i, same in groupby(heapq.merge(*short)):
        count = sum(1 for _ in same)
        if count >= needed - long and not known(i):
            left = len(probed)
            for p in probed:
                if count + left < needed:
                    break
                left -= 1
                k = bisect_left(p, i)
                count += k < len(p) and p[k] == i
            if count >= needed:
                yield i, count


class Search:
    """Sets by increasing size; lists of the earlier sets by shingle, for each side of a pair of blocks."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root: list[int] = []

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def links(self, sets: list[np.ndarray], sides: list[int], known: list[int] | None = None) -> list[tuple[int, int]]:
        """What joins the components of the sets; sides: 0 for a block by itself, else 1 or 2; known: components so far."""
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        first: dict[int, int] = {}
        self.root = list(range(len(sets))) if known is None else [first.setdefault(c, i) for i, c in enumerate(known)]
        index: dict[int, dict[int, list[int]]] = {side: defaultdict(list) for side in (0, 1, 2)}
        out = []
        for at, i in enumerate(order):
            size, shingles = len(sets[i]), sets[i].tolist()
            other = index[{0: 0, 1: 2, 2: 1}[sides[i]]]
            lists = [other[s] for s in shingles if s in other]
            # the smallest partner has PERCENT of this set's size, and all earlier ones are no larger than it
            needed = may_link(size, -(-self.percent * size // 100), self.percent)
            # lists hold places in the order, so they grow sorted
            if len(lists) >= needed:

                def linked(j: int, i: int = i) -> bool:
                    return self._find(order[j]) == self._find(i)

                for j, n in divide_skip(lists, needed, linked):
                    k = order[j]
                    if 100 * n >= self.percent * (size + len(sets[k]) - n):
                        self.root[self._find(i)] = self._find(k)
                        out.append((i, k))
            own = index[sides[i]]
            for s in shingles:
                own[s].append(at)
        return out


def star_links(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of the sets link with the query."""
    lists: dict[int, list[int]] = {s: [] for s in query.tolist()}
    for i, own in enumerate(sets):
        for s in own[np.isin(own, query, assume_unique=True)].tolist():
            lists[s].append(i)
    size = len(query)
    needed = may_link(size, -(-percent * size // 100), percent)
    return [i for i, n in divide_skip(list(lists.values()), needed) if 100 * n >= percent * (size + len(sets[i]) - n)]


def _grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come together, by their first columns."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names))

    for key, group in groupby(rows(), key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in group]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _first_search(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, ("rep", "block", "is_rep", "doc_id", "shingles"), 2):
            queries = [(i, np.frombuffer(s, common.U64)) for is_rep, i, s in group if is_rep]
            members = sorted((i, s) for is_rep, i, s in group if not is_rep)
            sets = [np.frombuffer(s, common.U64) for _, s in members]
            for q, shingles in queries:
                if found := [(members[i][0], q) for i in star_links(shingles, sets, percent)]:
                    yield _edges(found)

    return run


def _second_search(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), group in _grouped(batches, ("cluster", "low", "high", "block", "doc_id", "component", "shingles"), 3):
            members = sorted(group, key=lambda r: r[1])
            sets = [np.frombuffer(r[3], common.U64) for r in members]
            sides = [0 if low == high else 1 if r[0] == low else 2 for r in members]
            if links := Search(percent).links(sets, sides, [r[2] for r in members]):
                yield _edges([(members[i][2], members[j][2]) for i, j in links])

    return run


# --- the join -------------------------------------------------------------------------------------------------------


_EDGE = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _stars(nodes: DataFrame) -> DataFrame:
    """``a, b``: each node's digest with that of the least node of each signature that it shares with another."""
    emitted = nodes.select(F.explode("signatures").alias("signature"), "d1")
    least = emitted.groupBy("signature").agg(F.min("d1").alias("least"), F.max("d1").alias("most")).where("least < most").select("signature", "least")
    # written, so that the rows of a signature that very many copies have can be split
    shared = common.stored(least)
    return common.checkpointed(emitted.join(shared, "signature").where("d1 <> least").select(F.col("d1").alias("a"), F.col("least").alias("b")).distinct())


def _searched_first(stars: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of nodes with their least neighbour."""
    rep_of = common.checkpointed(stars.groupBy("a").agg(F.min("b").alias("rep")))
    blocks = common.checkpointed(rep_of.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    placed = rep_of.join(blocks, "rep").select(F.col("a").alias("d1"), "rep", F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("block"))
    members = sets.join(placed, "d1").select("rep", "block", F.lit(False).alias("is_rep"), "doc_id", "shingles")
    queries = sets.join(blocks.withColumnRenamed("rep", "d1"), "d1").select(
        F.col("d1").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_rep"), "doc_id", "shingles"
    )
    dealt = common.in_tasks(members.unionByName(queries), "rep", "block").sortWithinPartitions("rep", "block")
    return dealt.mapInArrow(_first_search(percent), _EDGE)


def _searched_second(stars: DataFrame, sets: DataFrame, component: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links between components, by their names, that the first search did not see; None if no neighbours are apart."""
    own = common.checkpointed(sets.select("d1", "doc_id").join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("d1", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    of = own.select("d1", "component")
    named = stars.join(of.withColumnRenamed("d1", "a"), "a").withColumnRenamed("component", "ca").join(of.withColumnRenamed("d1", "b"), "b").withColumnRenamed("component", "cb")
    apart = common.checkpointed(named.where("ca <> cb").select("ca", "cb").distinct())
    if apart.isEmpty():
        return None
    groups = common.components(apart, "ca", "cb")
    left = common.checkpointed(own.join(groups.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component"))

    # Blocks: a large component has its own, all small ones of a group share the others.
    sizes = left.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cluster").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = sizes.where(F.col("n") >= block).withColumn("own", F.ceil(F.col("n") / block).cast("int")).withColumn("first", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int"))
    large = common.checkpointed(large.select("cluster", "component", "own", "first"))
    shared = sizes.where(F.col("n") < block).groupBy("cluster").agg(F.ceil(F.sum("n") / block).cast("int").alias("shared"))
    all_blocks = large.groupBy("cluster").agg(F.sum("own").cast("int").alias("large")).join(shared, "cluster", "full")
    all_blocks = common.checkpointed(all_blocks.select("cluster", F.coalesce("large", F.lit(0)).alias("large"), F.coalesce("shared", F.lit(0)).alias("shared")))
    placed = left.join(all_blocks, "cluster").join(large, ["cluster", "component"], "left")
    number = F.pmod(F.xxhash64("doc_id", "d1"), F.coalesce("own", "shared")).cast("int") + F.coalesce("first", "large")
    placed = placed.withColumn("block", number).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("large") + F.col("shared") - 1)))
    placed = placed.where(F.col("own").isNull() | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("own")))
    pairs = placed.select("d1", "doc_id", "component", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")
    dealt = common.in_tasks(pairs.join(sets, ["d1", "doc_id"]), "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    return dealt.mapInArrow(_second_search(percent), _EDGE)


def jaccard_classes(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the size of each document's set, and the least id that links reach."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    described = common.stored(common.map_texts(docs, _described(words, percent), _DESCRIBED, keep=["doc_id"]))
    nodes = described.where("n_shingles > 0 and doc_id is not null")
    node = common.checkpointed(nodes.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")))
    stars = _stars(nodes)

    # The sets of nodes that have neighbours.
    near = stars.select(F.col("a").alias("d1")).union(stars.select(F.col("b").alias("d1"))).distinct()
    wanted = common.checkpointed(near.join(node, "d1").select(F.col("node").alias("doc_id"), "d1"))
    asked = common.narrowed(docs, wanted, ["doc_id"]).join(wanted, "doc_id")
    made = common.map_texts(asked, _set_bytes(words), [StructField("own", LongType()), StructField("shingles", BinaryType())], keep=["doc_id", "d1"])
    sets = common.stored(made.where("own = d1").dropDuplicates(["doc_id", "d1"]).select("doc_id", "d1", "shingles"))

    component = common.components(_searched_first(stars, sets, percent, block))
    linked = node.join(component, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("linked"))
    if (second := _searched_second(stars, sets, component, percent, block)) is not None:
        linked = _relabelled(linked, common.components(second))
    linked = common.checkpointed(linked)

    # Rows with equal ids are one node: sets of one id are linked through it.
    of_id = F.struct("n_shingles", "d1", "d2")
    several = described.where("doc_id is not null").groupBy("doc_id").agg(F.min(of_id).alias("lo"), F.max(of_id).alias("hi")).where("lo <> hi").select("doc_id")
    shared = common.checkpointed(nodes.join(several, "doc_id", "left_semi").join(linked, ["d1", "d2"]).select("linked", "doc_id").distinct())
    through = None if shared.isEmpty() else common.components(shared, "linked", "doc_id")
    if through is not None:
        linked = common.checkpointed(_relabelled(linked, through))
    joined = described.select("doc_id", "n_shingles", "d1", "d2").join(linked, ["d1", "d2"], "left")
    own = joined.withColumn("linked", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("linked")), "doc_id"))
    own = own if through is None else _relabelled(own, through)  # of rows without words, by their id
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("linked")).alias("component_id"))


def _relabelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``linked`` replaced by its component, where it has one."""
    to = components.select(F.col("node").alias("linked"), F.col("component").alias("__to"))
    return rows.join(to, "linked", "left").withColumn("linked", F.coalesce("__to", "linked")).drop("__to")
