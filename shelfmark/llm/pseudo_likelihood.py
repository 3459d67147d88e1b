"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are words. The vocabulary is made from counts over all documents: the KNOWN most frequent words; all others are
rare. The network sees SIDE words on either side of a token (not the token), and gives the probability of a known word as
that of its class times that in its class, so that a token costs the square root of the vocabulary. Rare words are the
last class. Each has a code of three digits below DIGIT, from its hash, and the network predicts one digit after the
other, each given those before it, so that the context tells rare words apart by 4,096 codes. The words of one code
share its probability by their counts over all documents, which a join brings to the tokens. A rare word beside a token
is seen by its first two digits. A document's score is the sum of the log-probabilities of its tokens.

Training is distributed and grows with the input: every document is trained on once, in one of ROUNDS rounds. Documents
are dealt by hash into parts of about PART_TOKENS tokens, whatever files they came from; each part is walked in numpy
in the order of its documents' hashes, from the round's common start, and the parts' parameters are averaged. They are
summed inside tasks and then over a tree of tasks, in steps of 2**-24, so that sums are exact and no order shows: reruns
and other layouts of the files give the same model; it scores with rounded parameters, whose sums are exact. Only the averaged parameters (N_PARAMETERS numbers) and the
vocabulary (KNOWN rows) come to the driver, and go to the executors with the tasks.

Defined results: a null or empty text has 0 tokens, log_prob 0 and a null mean; repeated rows get equal scores; an empty
table gives an empty table; extra columns are ignored; a null doc_id is carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from shelfmark.llm import common

CLASSES, IN_CLASS = 32, 64
#: Digits of a rare word's code, and how many bits of its hash they take.
DIGIT, CODE_BITS = 16, 12
#: Ids of known words come first, then the codes of rare ones; the id after them stands where a document has no word.
KNOWN = (CLASSES - 1) * IN_CLASS
NOTHING = KNOWN + DIGIT**3
#: What a token is seen as from beside it: known words, two digits, no word.
SEEN = KNOWN + DIGIT**2 + 1
SIDE, EMBED, HIDDEN = 2, 16, 32
ROUNDS, STEP_TOKENS, RATE, SEED = 2, 4096, 0.05, 5
#: Tokens of a part, on average; parameters are summed over so many tasks at a time, until so few rows are left.
PART_TOKENS, FAN_IN, LAST_ROWS = 500_000, 64, 16
#: Tokens that one forward pass holds: its arrays stay in a core's cache.
PASS_TOKENS = 4096

_SHAPES = {
    "e": (SEEN, EMBED), "w": (2 * SIDE * EMBED, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "o": (CLASSES - 1, HIDDEN, IN_CLASS), "ob": (CLASSES - 1, IN_CLASS),
    "r": (HIDDEN, 3 * DIGIT), "rb": (DIGIT,), "sb": (DIGIT, DIGIT), "tb": (DIGIT**2, DIGIT),
}
_ZERO = ("b", "cb", "ob", "rb", "sb", "tb")
#: Digits after the point (binary) and the limit of rounded parameters: products and their sums fit 24 bits, so that single
#: precision adds them without error, in whichever order a matrix product does.
_GRID, _LIMIT = {"e": 7, "w": 7, "b": 7}, {"e": 4, "w": 4}
_GRID_ELSE, _LIMIT_ELSE, _HIDDEN_GRID = 8, 8, 8
N_PARAMETERS = int(sum(np.prod(s) for s in _SHAPES.values()))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    data, offsets = common.buffers(texts)
    starts, ends, doc = common.word_spans(~common.space_bytes(data), offsets)
    hashes = common.Rolling(common.BYTE_VALUES[data]).spans(starts, ends) if len(starts) else np.zeros(0, common.U64)
    return hashes, doc, len(offsets) - 1


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: the hash of every word of all documents, and how often it occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.passes(batch, "text", 8 << 20):
                words, n = np.unique(_word_hashes(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = docs.select("text").mapInArrow(counted, StructType([StructField("word", LongType()), StructField("n", LongType())]))
    return common.stored(counts.groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, by rank."""
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN)
    return np.array([r["word"] for r in top.collect()], np.int64).view(common.U64)


def rare_shares(counts: DataFrame, known: np.ndarray) -> DataFrame:
    """``word, log_share``: of every rare word, the logarithm of its share of all words with its code."""
    top = counts.sparkSession.createDataFrame([(w,) for w in known.view(np.int64).tolist()], "word long")
    rest = counts.join(F.broadcast(top), "word", "left_anti").withColumn("code", F.shiftrightunsigned("word", 64 - CODE_BITS))
    of_code = rest.groupBy("code").agg(F.sum("n").alias("all"))  # DIGIT**3 rows at most
    return rest.join(F.broadcast(of_code), "code").select("word", F.log(F.col("n") / F.col("all")).alias("log_share"))


def _on_grid(x: np.ndarray, places: int) -> np.ndarray:
    return np.round(x * np.float32(2**places)) * np.float32(2.0**-places)


def _digits(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return code // DIGIT**2, code // DIGIT % DIGIT, code % DIGIT


class WindowNetwork:
    def __init__(self, words: np.ndarray, flat: np.ndarray | None = None):
        self.words = words
        self.order = np.argsort(words)
        self.rounded = False
        if flat is None:
            rng = np.random.default_rng(SEED)
            flat = np.concatenate([np.zeros(int(np.prod(s))) if k in _ZERO else rng.normal(0, 0.1, int(np.prod(s))) for k, s in _SHAPES.items()])
        self.load(flat)

    def load(self, flat: np.ndarray) -> None:
        """Parameters by name are views of one array."""
        self.all = flat.astype(np.float32)
        self.p, at = {}, 0
        for k, shape in _SHAPES.items():
            size = int(np.prod(shape))
            self.p[k] = self.all[at : at + size].reshape(shape)
            at += size

    def flat(self) -> np.ndarray:
        return self.all.copy()

    def exact(self) -> WindowNetwork:
        """The network with rounded parameters and hidden values: which tokens share a matrix product does not show in its
        scores."""
        net = WindowNetwork(self.words, self.flat())
        net.rounded = True
        for k, v in net.p.items():
            limit = _LIMIT.get(k, _LIMIT_ELSE) - 2.0 ** -_GRID.get(k, _GRID_ELSE)
            v[...] = _on_grid(np.clip(v, -limit, limit), _GRID.get(k, _GRID_ELSE))
        return net

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        ids = KNOWN + (hashes >> common.U64(64 - CODE_BITS)).astype(np.int64)
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words[self.order], hashes), len(self.words) - 1)
            hit = self.words[self.order][place] == hashes
            ids[hit] = self.order[place[hit]]
        return ids

    @staticmethod
    def windows(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """What each token's neighbours are seen as; the last place where there is none in its document."""
        out = np.full((len(ids), 2 * SIDE), SEEN - 1, np.int64)
        seen = np.where(ids < KNOWN, ids, KNOWN + (ids - KNOWN) // DIGIT)
        for k, by in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            a, b = (slice(0, len(ids) - by), slice(by, None)) if by > 0 else (slice(-by, None), slice(0, len(ids) + by))
            out[a, k] = np.where(doc[a] == doc[b], seen[b], SEEN - 1)
        return out

    @staticmethod
    def steps(ids: np.ndarray, doc: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Stretches of ``size`` tokens with their neighbours, which may lie outside the stretch."""
        for a in range(0, len(ids), size):
            b = min(a + size, len(ids))
            low, high = max(0, a - SIDE), min(len(ids), b + SIDE)
            yield slice(a, b), WindowNetwork.windows(ids[low:high], doc[low:high])[a - low : b - low]

    def _forward(self, ids: np.ndarray, near: np.ndarray):
        """Input, hidden layer, probabilities of classes; and in the order of the tokens' classes: that order, where
        each class begins, of known words the hidden layer with a one after it (for the bias), what the words of the
        class weigh and their sum, and of rare words the hidden layer, the code, what all digits weigh and three sums."""
        x = self.p["e"][near].reshape(len(ids), -1)
        h = np.tanh(x @ self.p["w"] + self.p["b"])
        h = _on_grid(h, _HIDDEN_GRID) if self.rounded else h
        of_class = h @ self.p["c"]
        of_class += self.p["cb"]
        np.exp(np.minimum(of_class, 60, out=of_class), out=of_class)
        of_class /= self._sums(of_class)[:, None]
        kind = np.minimum(ids // IN_CLASS, CLASSES - 1).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        known = cuts[CLASSES - 1]
        sorted_h = np.ones((known, HIDDEN + 1), np.float32)
        sorted_h[:, :-1] = h[order[:known]]
        weights = np.concatenate([self.p["o"], self.p["ob"][:, None]], 1)
        z = np.empty((known, IN_CLASS), np.float32)
        for k in range(CLASSES - 1):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                np.matmul(sorted_h[a:b], weights[k], out=z[a:b])
        np.exp(np.minimum(z, 60, out=z), out=z)
        code = ids[order[known:]] - KNOWN
        rare_h = h[order[known:]]
        y = (rare_h @ self.p["r"]).reshape(-1, 3, DIGIT)
        y[:, 0] += self.p["rb"]
        y[:, 1] += self.p["sb"][code // DIGIT**2]
        y[:, 2] += self.p["tb"][code // DIGIT]
        np.exp(np.minimum(y, 60, out=y), out=y)
        return x, h, of_class, order, cuts, sorted_h, z, self._sums(z), rare_h, code, y, y.sum(2)

    def _sums(self, weights: np.ndarray) -> np.ndarray:
        """Sums over rows; with a product, which is faster and depends on the pass in the last bit, only in training."""
        return weights.sum(1) if self.rounded else weights @ np.ones(weights.shape[1], np.float32)

    def log_probs(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The log-probability of each token, given the tokens around it in its document."""
        out = np.zeros(len(ids))
        for stretch, near in self.steps(ids, doc, PASS_TOKENS):
            part = ids[stretch]
            _, _, of_class, order, _, _, z, sums, _, code, y, y_sums = self._forward(part, near)
            got = of_class[np.arange(len(part)), np.minimum(part // IN_CLASS, CLASSES - 1)].astype(np.float64)
            known, rare, every = order[: len(z)], order[len(z) :], np.arange(len(y))
            got[known] *= z[np.arange(len(z)), part[known] % IN_CLASS] / sums
            for k, digit in enumerate(_digits(code)):
                got[rare] *= y[every, k, digit] / y_sums[:, k]
            out[stretch] = np.log(np.maximum(got, 1e-30))
        return out

    def gradients(self, ids: np.ndarray, near: np.ndarray) -> dict[str, np.ndarray]:
        x, h, d_class, order, cuts, sorted_h, z, sums, rare_h, code, y, y_sums = self._forward(ids, near)
        n, every = np.float32(len(ids)), np.arange(len(ids))
        d_class[every, np.minimum(ids // IN_CLASS, CLASSES - 1)] -= 1
        d_class /= n
        z *= (1 / (sums * n))[:, None]
        z[every[: len(z)], ids[order[: len(z)]] % IN_CLASS] -= 1 / n
        rare = every[: len(y)]
        y *= (1 / (y_sums * n))[:, :, None]
        for k, digit in enumerate(_digits(code)):
            y[rare, k, digit] -= 1 / n
        ones = np.ones(len(ids), np.float32)
        g = {"c": h.T @ d_class, "cb": ones @ d_class, "o": np.zeros_like(self.p["o"]), "ob": np.zeros_like(self.p["ob"])}
        inner = np.zeros_like(h)
        flat_y = y.reshape(-1, 3 * DIGIT)
        g["r"], g["rb"] = rare_h.T @ flat_y, ones[: len(y)] @ y[:, 0]
        for k, (name, before) in enumerate((("sb", code // DIGIT**2), ("tb", code // DIGIT)), 1):
            place = (before[:, None] * DIGIT + np.arange(DIGIT)).ravel()
            g[name] = np.bincount(place, y[:, k].ravel(), self.p[name].size).astype(np.float32).reshape(self.p[name].shape)
        np.matmul(flat_y, self.p["r"].T, out=inner[len(z) :])
        for k in range(CLASSES - 1):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                both = sorted_h[a:b].T @ z[a:b]
                g["o"][k], g["ob"][k] = both[:-1], both[-1]
                np.matmul(z[a:b], self.p["o"][k].T, out=inner[a:b])
        dh = d_class @ self.p["c"].T
        back = np.empty_like(order)
        back[order] = every
        dh += inner[back]
        dh *= 1 - h * h
        g["w"], g["b"] = x.T @ dh, ones @ dh
        dx = (self.p["w"] @ dh.T).reshape(2 * SIDE, EMBED, len(ids)).transpose(1, 0, 2).reshape(EMBED, -1)  # by dimension
        flat = near.T.ravel()
        g["e"] = np.stack([np.bincount(flat, weights=row, minlength=SEEN) for row in dx], 1).astype(np.float32)
        return g

    def train(self, ids: np.ndarray, doc: np.ndarray) -> None:
        """Adam over steps of STEP_TOKENS tokens."""
        m, v, x = (np.zeros_like(self.all) for _ in range(3))
        for t, (stretch, near) in enumerate(self.steps(ids, doc, STEP_TOKENS), 1):
            found = self.gradients(ids[stretch], near)
            g = np.concatenate([found[k].ravel() for k in _SHAPES])
            np.subtract(g, m, out=x)
            x *= np.float32(0.1)
            m += x
            g *= g
            g -= v
            g *= np.float32(0.01)
            v += g
            np.multiply(v, np.float32(1 / (1 - 0.99**t)), out=x)
            np.sqrt(x, out=x)
            x += np.float32(1e-6)
            np.divide(m, x, out=x)
            x *= np.float32(RATE / (1 - 0.9**t))
            self.all -= x


# --- training -------------------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, words: np.ndarray, n_parts: int, keep: list[str]) -> DataFrame:
    """Kept columns, ``row``, the text's tokens as 16-bit ids, hashes of its rare words, and its part.

    Copies of one text have different ids and so go to different parts; a row keeps its number once it is written.
    """
    sent = docs.sparkSession.sparkContext.broadcast(WindowNetwork(words))

    def run(texts: pa.Array) -> dict:
        hashes, doc, n = _word_hashes(texts)
        ids = sent.value.tokens(hashes)
        cuts = np.searchsorted(doc, np.arange(n + 1))
        other = ids >= KNOWN
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc[other], minlength=n))]).astype(np.int32)
        tokens = [ids[a:b].astype("<i2").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return {"tokens": pa.array(tokens, pa.binary()), "others": pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[other].view(np.int64)))}

    place = F.xxhash64("text", F.lit(SEED))
    rows = docs.select("*", F.monotonically_increasing_id().alias("row"), place.alias("place"), F.pmod(F.xxhash64("text", *keep), F.lit(n_parts)).alias("part"))
    fields = [StructField("tokens", BinaryType()), StructField("others", ArrayType(LongType()))]
    return common.map_texts(rows, run, fields, keep=[*keep, "row", "place", "part"])


def joined_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens, and the row each is in."""
    sizes = np.array([len(x) // 2 for x in column.to_pylist()], np.int64) if len(column) else np.zeros(0, np.int64)
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, "<i2").astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


_SUMS = StructType([StructField("n", LongType()), StructField("p", ArrayType(DoubleType()))])


def _sum_row(n: int, p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([p], pa.list_(pa.float64()))], names=_SUMS.names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, p = 0, np.zeros(N_PARAMETERS)
    for batch in batches:
        for i in range(batch.num_rows):
            n += batch.column("n")[i].as_py()
            p += batch.column("p")[i].values.to_numpy()
    if n:
        yield _sum_row(n, p)


def trained(rows: DataFrame, words: np.ndarray) -> WindowNetwork:
    """The network after ROUNDS rounds, which share all rows of ``encoded``."""
    net = WindowNetwork(words)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(ROUNDS):
        flat = net.flat()

        def run(batches: Iterator[pa.RecordBatch], flat=flat) -> Iterator[pa.RecordBatch]:
            """Rows come part by part; each part is walked from the same start."""
            n, p = 0, np.zeros(N_PARAMETERS)

            def walked(held: list[pa.RecordBatch]) -> np.ndarray:
                own = WindowNetwork(words, flat)
                own.train(*joined_tokens(pa.concat_arrays([b.column("tokens") for b in held])))
                return np.round(own.flat().astype(np.float64) * 2**24)

            held: list[pa.RecordBatch] = []
            for batch in batches:
                parts = batch.column("part").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if held and held[-1].column("part")[0].as_py() != parts[a]:
                        n, p, held = n + 1, p + walked(held), []
                    held.append(batch.slice(a, b - a))
            if held:
                n, p = n + 1, p + walked(held)
            if n:
                yield _sum_row(n, p)

        chosen = rows.where((F.pmod("place", F.lit(ROUNDS)) == k) & (F.length("tokens") > 0)).select("part", "place", "tokens")
        made = common.in_tasks(chosen, "part").sortWithinPartitions("part", "place").select("part", "tokens").mapInArrow(run, _SUMS)
        n = tasks
        while n > LAST_ROWS:
            n = -(-n // FAN_IN)
            made = made.repartition(n).mapInArrow(_summed, _SUMS)
        found = made.collect()
        if total := sum(r["n"] for r in found):
            net.load(sum(np.array(r["p"]) for r in found) / total / 2**24)
    return net


_SCORES = [StructField("n_tokens", LongType()), StructField("log_prob", DoubleType())]


def class_scores(rows: DataFrame, net: WindowNetwork, keep: list[str]) -> DataFrame:
    """Kept columns, the number of tokens, and the log-probability of the tokens' ids."""
    sent = rows.sparkSession.sparkContext.broadcast(net.exact())
    source = rows.select(*keep, "tokens")
    schema = StructType([*source.schema.fields[:-1], *_SCORES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.passes(batch, "tokens"):
                ids, doc = joined_tokens(part.column("tokens"))
                each, n = sent.value.log_probs(ids, doc), part.num_rows
                scores = [np.bincount(doc, minlength=n).astype(np.int64), np.bincount(doc, weights=each, minlength=n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, scores)], names=schema.names)

    return source.mapInArrow(run, schema)


def scored(df: DataFrame, text: str = "text", key: str = "doc_id", net: WindowNetwork | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of each document.

    With a network of the caller's own, which has no counts of words, a rare word stands for all with its code.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    if net is not None:
        out = class_scores(encoded(docs, net.words, 1, ["doc_id"]), net, ["doc_id"])
    else:
        counts = word_counts(docs)
        total = counts.agg(F.sum("n")).first()[0] or 0
        words = vocabulary(counts)
        rows = common.stored(encoded(docs, words, max(1, -(-total // PART_TOKENS)), ["doc_id"]))
        found = class_scores(rows, trained(rows, words), ["doc_id", "row"])
        shares = rows.select("row", F.explode("others").alias("word")).join(rare_shares(counts, words), "word")
        inside = shares.groupBy("row").agg(F.sum("log_share").alias("inside"))
        out = found.join(inside, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("inside", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
