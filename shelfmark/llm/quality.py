"""Quality classifier by hierarchical empirical Bayes: document evidence, shrunk host and path posteriors.

A document is good if its label says quality and not toxic. A logistic model over words (present or not) and a few
shape features, fitted in numpy on at most SAMPLE labelled documents (the least by a seeded hash of the id) and
calibrated on a part of them that it was not fitted on, gives each document its evidence: the log-odds that its text
adds to the base rate. Sites are judged by all documents: a labelled one counts with its label, any other with the
model's probability. A host's posterior mean is shrunk towards the global mean, and a path's towards its host's, with
concentrations estimated from the spread of the groups (method of moments), so that sparse sites stay near the prior.
A document's own share is taken out of its site's sums. The final log-odds are the evidence plus those of the path.

Sites are grouped and joined in Spark; only the sample's features (bounded), the global mean and the two concentrations
come to the driver.

Defined results: a null or empty text has no words and is judged by its shape and site; a null host or path is a group
of its own; a document with several labels counts as good if all of them are; labels of unknown documents are ignored;
without labels of both kinds evidence is 0 and everything has the prior 0.5; an empty table gives an empty table;
repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from shelfmark.llm import common

#: Labelled documents that the model is fitted on, at most; hashed word features, and those of them that are used.
SAMPLE, BITS, USED, SEED = 8000, 18, 2000, 29
HELD_OUT, MIN_DOCS, RIDGE, STEPS = 0.25, 4, 3e-3, 400
#: A document is kept if its probability of being good is at least this.
THRESHOLD = 0.5

_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\~^@_=+")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
N_SHAPE = 6


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word feature) pairs in order of the text, and the shape features of each text."""
    data, offsets = common.buffers(texts)
    n = len(offsets) - 1
    starts, ends, doc = common.word_spans(_INSIDE[data], offsets)
    words = common.Rolling(common.BYTE_VALUES[_LOWER[data]]).spans(starts, ends) if len(starts) else np.zeros(0, common.U64)
    pairs = np.unique((doc << BITS) | (words >> common.U64(64 - BITS)).astype(np.int64))
    count, chars = np.bincount(doc, minlength=n), np.maximum(np.diff(offsets), 1)
    distinct = np.bincount(pairs >> BITS, minlength=n)
    shape = np.stack([
        np.log1p(count) / 5, distinct / np.maximum(count, 1), *(np.minimum(1, 5 * common.per_document(t[data], offsets) / chars) for t in (_UPPER, _SYMBOL, _SHOUT)),
        np.minimum(2, chars / np.maximum(count, 1) / 10),
    ], 1)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), shape


class DocumentModel:
    """Weights of hashed words and shape features, with Platt's two parameters."""

    def __init__(self):
        self.words, self.shape, self.bias = np.zeros(1 << BITS), np.zeros(N_SHAPE), 0.0
        self.slope, self.shift, self.base = 1.0, 0.0, 0.0

    def raw(self, row: np.ndarray, word: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=self.words[word], minlength=len(shape)) + shape @ self.shape + self.bias

    def evidence(self, row: np.ndarray, word: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(row, word, shape) + self.shift, -30, 30) - self.base

    def fit(self, words: list[np.ndarray], shape: np.ndarray, y: np.ndarray) -> DocumentModel:
        held = np.arange(len(y)) % round(1 / HELD_OUT) == 0
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            return self
        fit = [w for w, h in zip(words, held) if not h]
        target = y[~held]
        row, word = np.repeat(np.arange(len(fit)), [len(w) for w in fit]), np.concatenate(fit)
        total = np.bincount(word, minlength=1 << BITS).astype(float)
        good = np.bincount(word, weights=target[row], minlength=1 << BITS)
        rate = target.mean()
        z = np.abs(good - total * rate) / np.sqrt(total * rate * (1 - rate) + 1e-9)
        z[total < MIN_DOCS] = 0
        used = np.argsort(-z, kind="stable")[:USED]
        used = used[z[used] > 3]
        column = np.full(1 << BITS, -1)
        column[used] = np.arange(len(used))
        x = np.zeros((len(fit), len(used) + N_SHAPE + 1))
        hit = column[word] >= 0
        x[row[hit], column[word[hit]]] = 1
        x[:, len(used) : -1], x[:, -1] = shape[~held], 1
        w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        balance = np.where(target == 1, 0.5 / rate, 0.5 / (1 - rate))
        for t in range(1, STEPS + 1):
            d = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target) * balance
            g = x.T @ d / len(target) + RIDGE * w * (np.arange(len(w)) < len(w) - 1)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.words[used], self.shape, self.bias = w[: len(used)], w[len(used) : -1], float(w[-1])
        kept = [x for x, h in zip(words, held) if h]
        s = self.raw(np.repeat(np.arange(len(kept)), [len(x) for x in kept]), np.concatenate(kept), shape[held])
        for _ in range(500):
            d = 1 / (1 + np.exp(-np.clip(self.slope * s + self.shift, -30, 30))) - y[held]
            self.slope, self.shift = self.slope - 0.05 * float((d * s).mean()), self.shift - 0.05 * float(d.mean())
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        return self


def _good(labels: DataFrame) -> DataFrame:
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("good"))


def fitted(docs: DataFrame, good: DataFrame) -> DocumentModel:
    """The model, from a bounded sample of labelled documents."""
    sample = good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE)
    texts = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.passes(batch, "text"):
                row, word, shape = features(part.column("text"))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(word.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), lists, pa.array(list(shape), pa.list_(pa.float64()))], names=["doc_id", "good", "words", "shape"])

    schema = StructType([StructField("doc_id", LongType()), StructField("good", IntegerType()), StructField("words", ArrayType(IntegerType())), StructField("shape", ArrayType(DoubleType()))])
    rows = texts.mapInArrow(run, schema).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return DocumentModel()
    words = [np.array(w, np.int64) for w in rows.column("words").to_pylist()]
    return DocumentModel().fit(words, np.array(rows.column("shape").to_pylist()), np.array(rows.column("good").to_pylist(), float))


def _concentration(groups: DataFrame, mean: Column | float) -> float:
    """Strength of the prior, from the spread of group means around their prior means; groups: sum, n (and prior)."""
    spread = groups.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("sum") / F.col("n") - mean, 2)).alias("s"), F.sum(mean * (1 - mean) if isinstance(mean, Column) else F.lit(mean * (1 - mean))).alias("noise"), F.sum(F.col("n") * (mean * (1 - mean) if isinstance(mean, Column) else F.lit(mean * (1 - mean)))).alias("v")
    ).first()
    if not spread["v"]:
        return 100.0
    between = max((spread["s"] - spread["noise"]) / spread["v"], 1e-3)  # intra-class correlation
    return float(min(1 / between - 1 if between < 1 else 0.5, 1000.0)) or 0.5


def judged(df: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, quality, kept, evidence, host, path, host_quality, path_quality`` of each document."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    good = _good(labels)
    model = fitted(docs, good)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> dict:
        return {"evidence": sent.value.evidence(*features(texts))}

    scored = common.map_texts(docs, run, [StructField("evidence", DoubleType())], keep=["doc_id", "host", "path"])
    known = scored.join(good, "doc_id", "left")
    chance = F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.base)))))
    known = common.stored(known.select("doc_id", "host", "path", "evidence", chance.alias("chance")))

    paths = common.checkpointed(known.groupBy("host", "path").agg(F.sum("chance").alias("sum"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("sum").alias("host_sum"), F.sum("n").alias("host_n"))
    everything = hosts.agg(F.sum("host_sum"), F.sum("host_n")).first()
    mean = float(everything[0] / everything[1]) if everything[1] else 0.5
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    k_host = _concentration(hosts.select(F.col("host_sum").alias("sum"), F.col("host_n").alias("n")), mean)
    prior = (F.col("host_sum") + k_host * mean) / (F.col("host_n") + k_host)
    sites = common.checkpointed(paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "path", "sum", "n", "host_sum", "host_n"))
    k_path = _concentration(sites.select("sum", "n", "host_sum", "host_n"), prior)

    joined = known.alias("d").join(sites.alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")))
    host_quality = (F.col("host_sum") - F.col("chance") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    path_quality = (F.col("sum") - F.col("chance") + k_path * F.col("host_quality")) / (F.col("n") - 1 + k_path)
    bounded = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = joined.withColumn("host_quality", host_quality).withColumn("path_quality", path_quality)
    odds = F.col("evidence") + F.log(bounded("path_quality") / (1 - bounded("path_quality")))
    out = out.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "quality", (F.col("quality") >= threshold).alias("kept"), "evidence", F.col("d.host").alias("host"), F.col("d.path").alias("path"), "host_quality", "path_quality")
