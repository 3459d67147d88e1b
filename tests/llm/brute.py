"""Plain restatements of the contracts, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(texts, span=200):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, n=3):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def classes(rows, percent=90):
    """doc_id -> (set size, smallest id that links reach)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def covered(text, n):
    """Characters of words inside n-word windows that occur twice or more."""
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return sum(map(len, (words[k] for k in {i + j for i in range(len(words) - n + 1) if windows[tuple(words[i : i + n])] > 1 for j in range(n)})))


def kept(text):
    """The verdict of the quality rules."""
    text = text or ""
    n, chars, symbols, _, _, failed = rules(text)
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += sum(map(len, WORD.findall(line))) if line in lines else 0
            lines.add(line)
    most = {5: 0.30, 7: 0.26, 10: 0.20}
    return not failed and symbols <= 0.5 * n and again <= 0.2 * chars and all(covered(text, k) <= m * chars for k, m in most.items())


def luhn(digits):
    values = [int(d) for d in digits][::-1]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in patterns.items() for m in re.finditer(p, text) if ok(m[0])]


def secret(text):
    text, found = text or "", []
    keyword = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def contaminated(docs, items, threshold=0.4, verified=0.5):
    """(doc, item) -> (score, overlap), by scoring every passage against every item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    tokens = [words(t) for _, t in items]
    df = Counter(w for t in tokens for w in set(t))
    mean = sum(map(len, tokens)) / max(1, len(tokens))
    found = {}
    for at, (item_id, text) in enumerate(items):
        own = tokens[at]
        if not own:
            continue
        weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(own) / mean)) for w, n in Counter(own).items()}
        total, passage = sum(weight.values()), 128
        while passage < 2 * len(own):
            passage *= 2
        for doc_id, doc in docs:
            w = words(doc)
            starts = range(0, max(1, len(w) - passage // 2), passage // 2)
            score = max(sum(weight[x] for x in set(w[a : a + passage]) if x in weight) / total for a in starts) if w else 0
            if score >= threshold:
                parts = [p for p in map(words, re.split(r"\bAnswer:\s*", text, maxsplit=1, flags=re.I)) if p]
                overlap = min(len((g := grams(p, min(5, len(p)))) & grams(w, min(5, len(p)))) / len(g) for p in parts)
                if overlap >= verified:
                    found[doc_id, item_id] = (score, overlap)
    return found
