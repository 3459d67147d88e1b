"""Secret scans: a character convolutional network in numpy judges every candidate and its surrounding context.

Fixed patterns give the base findings (assign, access, hex), which stay whatever the network says. Candidates are all of
these and every other token of 16 characters or more. The network sees the characters before a candidate, the
candidate and those after it; a candidate longer than BODY is seen whole, through windows that overlap by half, and has
the largest of their logits. Every finding carries the network's probability as its score, and candidates that are no
base findings become findings of kind ``cnn`` at or above the threshold.

The labelled findings come from ``labelled_findings``: N_FINDINGS secrets and look-alikes (digests, paths, ids, numbers,
names, long words) in configuration lines and prose; this bounded set is all that the model is fitted on, as no table has labels of
secrets. They are dealt into three: one trains the network, one calibrates its logits (Platt), and one sets the threshold:
of those that keep ``RECALL`` of its secrets, the strictest, moved down to the middle of the gap below it. Training takes
some 20 seconds in the driver; the model (about 80 kB) goes to the executors with the task. It is trained in double
precision, and weights and scores are rounded, so that machines whose sums differ in the last bits find the same.

Defined results: a null or empty text has no findings; ties and repeated rows are scanned alike; an empty table gives an
empty table; extra columns are kept unless they have the name of the result column ``secrets``.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from shelfmark.llm import common

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "cnn")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_SIGN = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 or more; shorter runs hold no match of their own
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")

#: Characters that one window shows: before the candidate, its first ones, a stretch of it, and after that.
BEFORE, HEAD, BODY, AFTER = 16, 8, 40, 8
WIDTH = BEFORE + HEAD + BODY + AFTER
#: A window of a labelled secret counts as one if it shows so many characters of it.
SHOWN = 12
N_FINDINGS, CALIBRATION, THRESHOLDS, RECALL, SEED = 12000, 0.2, 0.2, 0.97, 17
EMBED, FILTERS, KERNEL = 8, 32, 5
WEIGHT_DIGITS, SCORE_DIGITS = 6, 4

_ALPHABET = string.ascii_letters + string.digits + "+/_=-.:\"' \n,;()[]{}<>@#$%&*!?|\\~^`"
_CODE = np.full(128, 1, np.int64)  # 0: nothing there, 1: another character
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(2, 2 + len(_ALPHABET))
N_CODES = 2 + len(_ALPHABET)

FINDINGS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())]))


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes == 0, 0, _CODE[np.minimum(codes, 127)]).astype(np.int16)


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows over a candidate begin; the last one ends with it."""
    return [start] if end - start <= BODY else [*range(start, end - BODY, BODY // 2), end - BODY]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """The windows over a candidate, one row each; all of them show what stands before it and how it begins."""
    lead = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start : min(end, start + HEAD)].ljust(HEAD, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    if end - start <= BODY:
        return _codes(lead + text[start:end].ljust(BODY, "\0") + after)[None]
    body = _codes(text[start:end] + after)[np.array(window_starts(0, end - start))[:, None] + np.arange(BODY + AFTER)]
    return np.concatenate([np.broadcast_to(_codes(lead), (len(body), BEFORE + HEAD)), body], 1)


@dataclass
class Labelled:
    """A candidate in its text; secret: where in it the secret stands, if there is one."""

    text: str
    start: int
    end: int
    secret: tuple[int, int] | None


def labelled_findings(n: int = N_FINDINGS, seed: int = SEED) -> list[Labelled]:
    """Half secrets, half look-alikes, each in a line of its kind."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    syllables = "the of and er on an re he in ed nd ha at en es or ti hi st ent ing tion ble ly ou wh sh th der ein de la os un ment".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    alnum, digits = string.ascii_letters + string.digits, string.digits
    base64, lower, upper, hexa = alnum + "+/", string.ascii_lowercase + digits, string.ascii_uppercase + digits, "0123456789abcdef"
    keys = "auth access credential bearer client_secret private_key pwd session_key signing_key key Authorization x-api-key token secret password passwd api_key apikey".split()
    plain = "see file page id name title path note commit sha256 md5 checksum digest etag blob revision build version image uuid url href ref".split()

    def secret() -> str:
        return rng.choice([
            lambda: pick(base64, 20, 64) + rng.choice(["", "=", "=="]),
            lambda: rng.choice(["ghp_", "gho_", "glpat-", "npm_", "sk_live_", "sk-", "pk_test_", "AIza", "ya29.", "SG.", "hf_", ""]) + pick(rng.choice([alnum, alnum, lower, hexa + "ABCDEF"]), 24, 40),
            lambda: ".".join(["eyJ" + pick(alnum + "-_", 15, 40), "eyJ" + pick(alnum + "-_", 20, 80), pick(alnum + "-_", 24, 43)]),
            lambda: "eyJ" + pick(base64, 20, 50), lambda: pick(lower, 24, 40), lambda: pick(upper, 20, 32),
            lambda: "xoxb-" + "-".join(pick(alnum, 10, 14) for _ in range(3)), lambda: pick(hexa, 24, 64),
            lambda: rng.choice(["sk_live_", "ghp_", "pk_test_", "", ""]) + pick(string.ascii_letters, 24, 40),
            lambda: rng.choice(["sk_live_", "sk_test_", "pk_live_", "ghp_", ""]) + "".join(rng.choice([str.lower, str.upper])(pick(string.ascii_lowercase, 2, 5)) for _ in range(rng.randint(5, 9))),
        ])()

    def other() -> str:
        return rng.choice([
            lambda: "-".join([word() for _ in range(rng.randint(2, 5))] + [str(rng.randint(1, 2030))]),
            lambda: f"/{word()}/{word()}/{word()}{rng.randint(0, 99)}", lambda: f"{word()}_{word()}_{word()}_{rng.randint(0, 999)}",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}",
            lambda: "".join(word().capitalize() for _ in range(4)) + str(rng.randint(0, 99)), lambda: rng.choice("-=_.") * rng.randint(12, 20) + str(rng.randint(0, 99)) + "a",
            lambda: f"isbn-{pick(digits, 10, 13)}-x", lambda: f"version_{rng.randint(1, 9)}_{rng.randint(0, 20)}_{word()}{word()}", lambda: (word() + str(rng.randint(0, 9))) * 4,
            lambda: f"{word()}{word()}{word()}{word()}{rng.randint(1, 99)}", lambda: "/".join(["", str(rng.randint(1990, 2030)), f"{rng.randint(1, 12):02}", *(word() for _ in range(rng.randint(2, 6)))]),
            lambda: "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12)), lambda: f"{word()}.{word()}.{word()}.v{rng.randint(1, 9)}.{rng.randint(0, 30)}-{word()}.{rng.randint(0, 9)}",
            lambda: "".join(word() for _ in range(rng.randint(4, 9))), lambda: "".join(word() for _ in range(rng.randint(4, 9))).capitalize() + rng.choice(["", "."]), lambda: pick(digits, 16, 30),
            lambda: "-".join(word() for _ in range(rng.randint(4, 7))), lambda: pick(digits, 16, 16),
            lambda: f"{rng.choice(['mail', 'www', 'ftp', word()])}{rng.choice(['', str(rng.randint(0, 99))])}.{rng.choice([word, word, lambda: 'example'])()}{rng.choice(['', word()])}.{rng.choice(['com', 'org', 'net', 'co.uk'])}",
            lambda: "/".join(word() for _ in range(rng.randint(4, 9))) + f".{rng.choice(['py', 'txt', 'mp4', 'h5'])}", lambda: "_".join(word().upper() for _ in range(rng.randint(3, 7))) + f"_V{rng.randint(1, 9)}",
        ])().ljust(16, "0")

    out = []
    for i in range(n):
        lead = rng.choice([lambda: prose(4) + " ", lambda: f"{prose(2)}\n"])()
        sign, quote = rng.choice([" = ", ": ", "=", " ", ":"]), rng.choice(["", '"', "'"])
        tail = rng.choice(['"', "'", "", " ", "\n", ",", "."]) + " " + prose(2)
        if i % 2 == 0:
            digest = rng.random() < 0.25  # looks like a secret; only what stands before it tells
            of_content = digest and rng.random() < 0.3  # a digest that says so itself
            body = f"sha{rng.choice([256, 384, 512])}-{pick(base64, 43, 86)}{rng.choice(['=', '=='])}" if of_content else pick(hexa, 24, 64) if digest else other()
            before = lead + (rng.choice(plain[8:]) + sign + quote if digest else rng.choice(["", rng.choice(plain) + sign + quote, rng.choice(keys) + " ", word() + rng.choice("@#(")]))
            out.append(Labelled(before + body + tail, len(before), len(before) + len(body), None))
            continue
        body, kind = secret(), rng.random()
        body = pick(hexa, 24, 64) if kind >= 0.85 else body  # with a name before it, as below
        if kind < 0.15:  # a name and its value are one token, or a path ends in a key
            joined = rng.choice([lambda: "_".join(word().upper() for _ in range(rng.randint(1, 7))) + "=", lambda: "".join(f"/{word()}" for _ in range(rng.randint(2, 9))) + "/"])()
            start, before = len(lead), lead + joined
        elif kind < 0.4:  # what the pattern of assignments finds, from its keyword on
            before = lead + (name := rng.choice(keys[-6:])) + sign + quote
            start = len(lead) if name else len(before)
        else:
            names = [rng.choice(keys) + sign + quote, rng.choice(keys).upper() + sign + quote]
            before = lead + rng.choice(names if kind >= 0.85 else ["", *names])
            start = len(before)
        out.append(Labelled(before + body + tail, start, len(before) + len(body), (len(before), len(before) + len(body))))
    return out


def window_labels(f: Labelled) -> np.ndarray:
    """Which windows over a labelled candidate show its secret."""
    if f.secret is None:
        return np.zeros(len(window_starts(f.start, f.end)), np.float32)
    shown = [min(f.end, at + BODY, f.secret[1]) - max(at, f.secret[0]) for at in window_starts(f.start, f.end)]
    return np.array([x >= min(SHOWN, f.secret[1] - f.secret[0]) for x in shown], np.float32)


class CharCnn:
    """Embedding, one convolution with ReLU, largest and mean response of each filter, logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (N_CODES, EMBED)), "w": rng.normal(0, 0.2, (KERNEL * EMBED, FILTERS)), "b": np.zeros(FILTERS),
            "v": rng.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        x = self.p["e"][codes]
        cols = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), WIDTH - KERNEL + 1, -1)
        h = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return cols, h, top, pooled, pooled @ self.p["v"] + self.p["c"]

    def logits(self, codes: np.ndarray, finding: np.ndarray, n: int) -> np.ndarray:
        """The largest logit of each finding's windows."""
        out = np.full(n, -np.inf)
        for i in range(0, len(codes), 1024):
            np.maximum.at(out, finding[i : i + 1024], self._forward(codes[i : i + 1024])[-1].astype(np.float64))
        return out

    def probability(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """The calibrated probability of each candidate (text, start, end)."""
        windows = [encode(*f) for f in found]
        if not windows:
            return np.zeros(0)
        z = self.logits(np.concatenate(windows), np.repeat(np.arange(len(found)), [len(w) for w in windows]), len(found))
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500))), SCORE_DIGITS)

    def _gradients(self, codes: np.ndarray, y: np.ndarray) -> dict:
        cols, h, top, pooled, z = self._forward(codes)
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {"v": pooled.T @ d, "c": d.sum(keepdims=True)}
        back = d[:, None] * self.p["v"]
        dh = np.repeat(back[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
        rows, filters = np.arange(len(y))[:, None], np.arange(FILTERS)[None]
        dh[rows, top, filters] += back[:, :FILTERS]
        dh *= h > 0
        g["w"], g["b"] = cols.reshape(-1, KERNEL * EMBED).T @ dh.reshape(-1, FILTERS), dh.sum((0, 1))
        dcols = (dh @ self.p["w"].T).reshape(len(y), -1, KERNEL, EMBED)
        dx = np.zeros((len(y), WIDTH, EMBED))
        for k in range(KERNEL):
            dx[:, k : k + dcols.shape[1]] += dcols[:, :, k]
        flat = codes.ravel()
        g["e"] = np.stack([np.bincount(flat, weights=x, minlength=N_CODES) for x in dx.reshape(-1, EMBED).T], 1)
        return g

    def fit(self, found: list[Labelled], epochs: int = 9, rate: float = 0.01, seed: int = SEED) -> CharCnn:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(found))
        at = np.cumsum([round(len(found) * share) for share in (CALIBRATION, THRESHOLDS)])
        calibration, held, train = np.split(order, at)
        codes = np.concatenate([encode(f.text, f.start, f.end) for f in (found[i] for i in train)])
        y = np.concatenate([window_labels(found[i]) for i in train])
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        steps = max(1, len(y) // 128)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(y)), steps):
                t += 1
                now = rate * (1 - t / (epochs * steps + 1))  # falls to zero, so that the last steps settle
                for k, g in self._gradients(codes[batch], y[batch]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        self.p = {k: np.round(x, WEIGHT_DIGITS) for k, x in self.p.items()}
        self.calibrate([found[i] for i in calibration])
        self.set_threshold([found[i] for i in held])
        return self

    def calibrate(self, found: list[Labelled]) -> None:
        """Platt's slope and shift of the findings' logits."""
        windows = [encode(f.text, f.start, f.end) for f in found]
        z = self.logits(np.concatenate(windows), np.repeat(np.arange(len(found)), [len(w) for w in windows]), len(found))
        target = np.array([f.secret is not None for f in found], float)
        n = np.array([(target == 0).sum(), (target == 1).sum()])
        goal = np.where(target == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))  # no finding is wholly certain
        scale = max(1e-6, float(np.abs(z).mean()))
        slope, shift = 1.0, 0.0
        for _ in range(2000):
            d = 1 / (1 + np.exp(-np.clip(slope * z / scale + shift, -60, 60))) - goal
            slope, shift = slope - 0.5 * float((d * z / scale).mean()), shift - 0.5 * float(d.mean())
        self.slope, self.shift = round(slope / scale, WEIGHT_DIGITS), round(shift, WEIGHT_DIGITS)

    def set_threshold(self, found: list[Labelled]) -> None:
        """Of the thresholds that keep RECALL of the secrets, the strictest, moved to the middle of the gap below it."""
        p = self.probability([(f.text, f.start, f.end) for f in found])
        real = np.array([f.secret is not None for f in found])
        strictest = np.sort(p[real])[int((1 - RECALL) * real.sum())]
        below = p[~real & (p < strictest)].max(initial=0.0)
        self.threshold = float(np.round((strictest + below) / 2, SCORE_DIGITS + 1))


@lru_cache(maxsize=1)
def trained_model() -> CharCnn:
    return CharCnn().fit(labelled_findings())


def base_findings(text: str) -> list[tuple[int, str, int]]:
    """Start, kind and end of the fixed patterns' findings."""
    found = []
    if _SIGN.search(text):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Long tokens that no base finding touches."""
    taken = sorted((a, b) for a, _, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def touched(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    return [m.span() for m in _CANDIDATE.finditer(text) if not touched(*m.span())]


def find(texts: list[str | None], model: CharCnn) -> list[list[dict]]:
    """The findings of each text, by start and then by kind as listed; code points, end exclusive."""
    proposed = []
    for i, text in enumerate(texts):
        base = base_findings(text) if text else []
        proposed += [(i, a, b, k) for a, k, b in base] + [(i, a, b, "cnn") for a, b in (candidates(text, base) if text else ())]
    out: list[list[dict]] = [[] for _ in texts]
    for begin in range(0, len(proposed), 1024):
        part = proposed[begin : begin + 1024]
        for (i, a, b, kind), p in zip(part, model.probability([(texts[i], a, b) for i, a, b, _ in part])):
            if kind != "cnn" or p >= model.threshold:
                out[i].append({"kind": kind, "start": a, "end": b, "score": float(p)})
    for found in out:
        found.sort(key=lambda f: (f["start"], KINDS.index(f["kind"])))
    return out


def secret_findings(df: DataFrame, text: str = "text", keep: list[str] | None = None, model: CharCnn | None = None) -> DataFrame:
    """The kept columns and ``secrets``, an array of (kind, start, end, score)."""
    model = model or trained_model()

    def scan(texts: pa.Array) -> dict:
        return {"secrets": find(texts.to_pylist(), model)}

    return common.map_texts(df, scan, [StructField("secrets", FINDINGS)], text, keep)
