"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every text is cut into passages that overlap by half: of PASSAGE words for items of at most half as many, and of twice
as many words for each doubling of an item's length. What an item is compared with so depends on itself alone. Each
passage is a query against the index of test items. An item's term weights are BM25 contributions (idf times saturated
frequency) divided by the item's sum, so that a score is the share of the item's weight that the passage holds, and one
threshold serves all items. Items are kept in blocks; each term has its largest weight in each of its blocks and over
all. Block-max WAND walks the lists of a passage's terms: the pivot is where the largest weights reach the threshold, the
blocks' largest weights are summed to skip whole blocks, and what is left is scored in full. All items at or above the
threshold are retrieved. Before that, a bound for all passages of a batch at once leaves out those that cannot reach the
threshold: common terms are taken to match wholly, up to half of the threshold for any item, and only the lists of the
other terms are summed.

Retrieved pairs are verified on word grams: the share of the item's distinct SHINGLE-word grams that the document holds
must reach VERIFIED, and where an item has a question and an answer (text after ``ANSWER``), both must overlap. A
document is verified once, in whole, for each item that any of its passages retrieved.

The index is made in Spark: document frequencies are a grouped count over all items, and each part of the index (items of
one passage length, about PART_WORDS words) is built in a task of its own and stored. Parts go out in broadcasts of at
most SENT_BYTES (or one part); a pass over the documents searches all parts of a broadcast, so that only a benchmark with
an index beyond SENT_BYTES needs a second pass. Scores do not depend on how items are dealt into parts.

Defined results: a null or empty text or item matches nothing; items below SHINGLE words are compared as one gram;
repeated rows get equal results; equal items are all reported; an empty table on either side gives an empty result;
extra columns are ignored; null ids are carried as they are.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from shelfmark.llm import common

K1, B = 1.5, 0.75
#: Words of a passage for items of at most half as many; passages overlap by half.
PASSAGE = 128
#: Share of an item's weight that a passage must hold to be retrieved; share of its word grams that verifies it.
THRESHOLD, VERIFIED, SHINGLE = 0.4, 0.5, 5
#: Items in a block; words of items in a part of the index, on average; bytes of the parts that are broadcast together.
BLOCK_ITEMS, PART_WORDS, SENT_BYTES = 16, 400_000, 64 << 20
#: Bounds are compared with this slack, as sums in another order may round another way.
SLACK = 1e-9
ANSWER = re.compile(r"\bAnswer:\s*", re.IGNORECASE)

_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

MATCH = StructType([StructField("doc_id", LongType()), StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("overlap", DoubleType())])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lowered, punctuation left out), and the text it is in."""
    starts, ends, doc = common.word_spans(_INSIDE[data], offsets)
    return (common.Rolling(common.BYTE_VALUES[_LOWER[data]]).spans(starts, ends) if len(starts) else np.zeros(0, common.U64)), doc


def grams(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all stretches of ``size`` words, or of all words if there are fewer."""
    if not len(words):
        return np.zeros(0, common.U64)
    return common.Rolling(words).windows(min(size, len(words)))


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def _flat(lists: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one after the other, and where each begins."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return starts, np.concatenate(lists).astype(kind) if lists else np.zeros(0, kind)


@dataclass
class Index:
    """One part: by term (item, weight) lists and their largest weights, over all and by block; grams of each item."""

    passage: int
    ids: list[int | None]
    vocabulary: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    largest: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_largest: np.ndarray
    parts: list[list[np.ndarray]]
    sizes: list[list[int]]
    # Terms that the bound sums, with their lists one after the other; what all other terms can add to each item.
    sum_starts: np.ndarray
    sum_items: np.ndarray
    sum_weights: np.ndarray
    rest: np.ndarray
    met: dict[int, tuple] = field(default_factory=dict)

    @classmethod
    def of(cls, passage: int, rows: list[tuple[int | None, str, list[int], list[float]]]) -> Index:
        """rows: id, text, and the item's terms with their BM25 weights, from the statistics of all items."""
        lists: dict[int, list[tuple[int, float]]] = {}
        parts, sizes = [], []
        for at, (_, text, terms, weights) in enumerate(rows):
            total = math.fsum(weights)
            for t, w in zip(terms, weights):
                lists.setdefault(t, []).append((at, w / total))
            words = [_words(p) for p in ANSWER.split(text, maxsplit=1)]
            parts.append([np.unique(grams(w)) for w in words if len(w)])
            sizes.append([min(SHINGLE, len(w)) for w in words if len(w)])
        vocabulary = np.array(sorted(lists, key=lambda t: t & (2**64 - 1)), np.int64).view(common.U64)
        by_term = [lists[t] for t in vocabulary.view(np.int64).tolist()]
        items, weights = [np.array([i for i, _ in x]) for x in by_term], [np.array([w for _, w in x]) for x in by_term]
        blocks = [np.unique(i // BLOCK_ITEMS) for i in items]
        most = [np.zeros(len(b)) for b in blocks]
        for i, w, b, m in zip(items, weights, blocks, most):
            np.maximum.at(m, np.searchsorted(b, i // BLOCK_ITEMS), w)
        rest, summed = np.zeros(len(rows)), np.ones(len(by_term), bool)
        for k in sorted(range(len(by_term)), key=lambda k: -len(items[k])):
            more = rest[items[k]] + weights[k]
            if more.max() >= THRESHOLD / 2:
                break
            rest[items[k]], summed[k] = more, False
        chosen = [x if y else x[:0] for x, y in zip(items, summed)], [x if y else x[:0] for x, y in zip(weights, summed)]
        return cls(
            passage, [r[0] for r in rows], vocabulary, *_flat(items, np.int32), _flat(weights, float)[1], np.array([w.max() for w in weights]),
            *_flat(blocks, np.int32), _flat(most, float)[1], parts, sizes, *_flat(chosen[0], np.int64), _flat(chosen[1], float)[1], rest,
        )

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.items[part], self.weights[part]

    def walked(self, term: int) -> tuple[list[int], list[float], dict[int, float], float]:
        """A term's items and weights, its largest weight by block and over all, made once for each term that is met."""
        if term not in self.met:
            items, weights = self.list_of(term)
            a, b = self.block_starts[term], self.block_starts[term + 1]
            by_block = dict(zip(self.blocks[a:b].tolist(), self.block_largest[a:b].tolist()))
            self.met[term] = items.tolist(), weights.tolist(), by_block, float(self.largest[term])
        return self.met[term]

    def may_reach(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Passages, of (passage, term) pairs, that may hold an item's share of ``threshold``."""
        if self.rest.max(initial=0) >= threshold - SLACK:
            return np.unique(passage)
        counts = self.sum_starts[term + 1] - self.sum_starts[term]
        pairs = np.unique(passage[counts > 0] * len(self.vocabulary) + term[counts > 0])
        passage, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        counts = self.sum_starts[term + 1] - self.sum_starts[term]
        steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(self.sum_starts[term], counts) + steps
        cell, inverse = np.unique(np.repeat(passage, counts) * len(self.ids) + self.sum_items[at], return_inverse=True)
        bound = np.bincount(inverse, weights=self.sum_weights[at], minlength=len(cell)) + self.rest[cell % len(self.ids)]
        return np.unique(cell[bound >= threshold - SLACK] // len(self.ids))


def wand(index: Index, terms: list[int], threshold: float) -> dict[int, float]:
    """All items whose score for these distinct terms reaches the threshold (block-max WAND)."""
    end = len(index.ids)
    lists = {t: index.walked(t) for t in terms}
    cursor = {t: 0 for t in terms}
    here = {t: lists[t][0][0] for t in terms}
    found = {}
    live = list(terms)
    while live:
        live.sort(key=here.__getitem__)
        bound, pivot = 0.0, -1
        for k, t in enumerate(live):
            bound += lists[t][3]
            if bound >= threshold - SLACK:
                pivot = k
                break
        if pivot < 0:
            break
        item = here[live[pivot]]
        while pivot + 1 < len(live) and here[live[pivot + 1]] == item:
            pivot += 1
        block = item // BLOCK_ITEMS
        if sum(lists[t][2].get(block, 0.0) for t in live[: pivot + 1]) >= threshold - SLACK:
            if here[live[0]] == item:
                score = math.fsum(lists[t][1][cursor[t]] for t in live[: pivot + 1])
                if score >= threshold:
                    found[item] = score
                goal, moved = item + 1, live[: pivot + 1]
            else:
                goal, moved = item, [t for t in live[:pivot] if here[t] < item]
        else:  # no item of this block, up to where the next list goes on
            goal = (block + 1) * BLOCK_ITEMS
            if pivot + 1 < len(live):
                goal = min(goal, here[live[pivot + 1]])
            goal, moved = max(goal, item + 1), live[: pivot + 1]
        for t in moved:
            items = lists[t][0]
            cursor[t] = bisect_left(items, goal, cursor[t])
            here[t] = items[cursor[t]] if cursor[t] < len(items) else end
        live = [t for t in live if here[t] < end]
    return found


def search(indexes: list[Index], texts: pa.Array, threshold: float = THRESHOLD, verified: float = VERIFIED) -> list[list[tuple[int | None, float, float]]]:
    """For each text the items that a passage of it retrieves and that its word grams verify: id, score, overlap."""
    data, offsets = common.buffers(texts)
    n = len(offsets) - 1
    out: list[list[tuple[int | None, float, float]]] = [[] for _ in range(n)]
    words, doc = word_hashes(data, offsets)
    if not len(words):
        return out
    first = np.searchsorted(doc, np.arange(n + 1))
    held: dict[tuple[int, int], np.ndarray] = {}

    def grams_of(i: int, size: int) -> np.ndarray:
        if (i, size) not in held:
            held[i, size] = np.unique(common.Rolling(words[first[i] : first[i + 1]]).windows(size))
        return held[i, size]

    for index in indexes:
        for i, found in _retrieved(index, words, doc, first, threshold).items():
            for item, score in sorted(found.items()):
                shares = [float(np.isin(part, grams_of(i, size), assume_unique=True).mean()) for part, size in zip(index.parts[item], index.sizes[item])]
                if shares and min(shares) >= verified:
                    out[i].append((index.ids[item], score, min(shares)))
    return out


def _retrieved(index: Index, words: np.ndarray, doc: np.ndarray, first: np.ndarray, threshold: float) -> dict[int, dict[int, float]]:
    """Texts with the items that a passage of theirs retrieves, and the best score of each."""
    if not len(index.vocabulary):
        return {}
    place = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    term = np.where(index.vocabulary[place] == words, place, -1)
    # Passages are numbered through all texts; each word is in one or two of them.
    half = index.passage // 2
    number = np.maximum(1, -(-(np.diff(first) - half) // half))
    base = np.concatenate([[0], np.cumsum(number)])
    known = np.flatnonzero(term >= 0)
    own = (known - first[doc[known]]) // half
    later, earlier = own < number[doc[known]], own > 0
    passage = np.concatenate([(base[doc[known]] + own)[later], (base[doc[known]] + own - 1)[earlier]])
    left = index.may_reach(passage, np.concatenate([term[known][later], term[known][earlier]]), threshold)
    found: dict[int, dict[int, float]] = {}
    for p, i in zip(left.tolist(), (np.searchsorted(base, left, "right") - 1).tolist()):
        a, b = int(first[i]), int(first[i + 1])
        begin = a + (p - int(base[i])) * half
        terms = np.unique(term[begin : min(b, begin + index.passage)])
        for item, score in wand(index, terms[terms >= 0].tolist(), threshold).items():
            best = found.setdefault(i, {})
            best[item] = max(score, best.get(item, 0.0))
    return found


# --- the index, made in Spark ---------------------------------------------------------------------------------------

_TERMS = [StructField("terms", ArrayType(LongType())), StructField("counts", ArrayType(LongType())), StructField("n_words", LongType())]


def _term_counts(texts: pa.Array) -> dict:
    words, doc = word_hashes(*common.buffers(texts))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    found = [np.unique(words[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
    return {"terms": [t.view(np.int64) for t, _ in found], "counts": [n for _, n in found], "n_words": np.diff(first)}


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come part by part; each part becomes one index."""

    def index(key: tuple[int, int], rows: list[tuple]) -> pa.RecordBatch:
        made = pickle.dumps(Index.of(key[0], rows), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["part"])

    held, last = [], None
    for batch in batches:
        for passage, part, *row in zip(*(batch.column(c).to_pylist() for c in ("passage", "part", "item_id", "text", "terms", "weights"))):
            if last not in (None, (passage, part)):
                yield index(last, held)
                held = []
            last = (passage, part)
            held.append(tuple(row))
    if held:
        yield index(last, held)


def index_parts(items: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``part``: the parts of the index, one row each, stored."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    described = common.stored(common.map_texts(rows, _term_counts, _TERMS))
    facts = described.agg(F.count("*").alias("n"), F.avg("n_words").alias("mean"))
    each = described.select("item", "n_words", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("item", "n_words", "x.*")
    df = each.groupBy("terms").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(facts)).select("terms", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    norm = K1 * (1 - B + B * F.col("n_words") / F.col("mean"))
    weight = F.col("idf") * F.col("counts") * (K1 + 1) / (F.col("counts") + norm)
    weighted = each.join(idf, "terms").groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("terms").alias("t"), weight.alias("w")))).alias("tw"))
    length = F.greatest(F.lit(0), F.ceil(F.log2(2 * F.col("n_words") / PASSAGE))).cast("int")
    placed = described.where("n_words > 0").select("item", "item_id", "text", "n_words", length.alias("doublings"))
    totals = placed.groupBy("doublings").agg(F.ceil(F.sum("n_words") / part_words).alias("n_parts"))
    placed = placed.join(F.broadcast(totals), "doublings").select(
        "item", "item_id", "text", F.expr(f"shiftleft({PASSAGE}, doublings)").alias("passage"), F.pmod(F.xxhash64("item"), "n_parts").alias("part")
    )
    whole = placed.join(weighted, "item").select("passage", "part", "item", "item_id", "text", F.transform("tw", lambda x: x["t"]).alias("terms"), F.transform("tw", lambda x: x["w"]).alias("weights"))
    dealt = whole.repartition("passage", "part").sortWithinPartitions("passage", "part", "item")
    return common.stored(dealt.mapInArrow(_built, StructType([StructField("part", BinaryType())])))


def _sent_together(parts: DataFrame, most: int) -> Iterator[list[Index]]:
    """Parts in groups of at most ``most`` bytes (or one part); only one group at a time is in the driver."""
    held, size = [], 0
    for row in parts.toLocalIterator():
        if held and size + len(row["part"]) > most:
            yield held
            held, size = [], 0
        held.append(pickle.loads(row["part"]))
        size += len(row["part"])
    if held:
        yield held


def contaminated(
    df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, verified: float = VERIFIED, part_words: int = PART_WORDS, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """``doc_id, item_id, score, overlap``: every document and test item that the search finds and the grams verify."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    spark, out = df.sparkSession, None
    for group in _sent_together(index_parts(items, part_words), sent_bytes):
        sent = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.passes(batch, "text"):
                    rows = [(d, i, s, o) for d, found in zip(part.column("doc_id").to_pylist(), search(sent.value, part.column("text"), threshold, verified)) for i, s, o in found]
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=MATCH.names)

        found = docs.mapInArrow(run, MATCH)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCH) if out is None else out
