"""Quality rules by repetition coverage: characters inside duplicated n-grams of several lengths and duplicated lines.

All texts of an Arrow batch are measured at once in numpy: words and lines are stretches of one byte buffer, their
hashes come from rolling sums, and a window that occurs twice in its document is found by sorting (document, hash).
Hashes have 64 bits; two different windows of one document are mistaken for each other with odds below 1e-9 for a
document of 100,000 words.

Defined results: a null or empty text has zero in all counts, base_failed true and kept false (fewer than 50 words);
ties and repeated rows are measured alike, each by itself; an empty table gives an empty table; extra columns are kept
unless they have the name of a result column, which replaces them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from shelfmark.llm import common

#: Fewest words, and most percent of words in repeated 3-word windows, of a document that passes the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Largest share of word characters inside n-grams that occur twice or more, by n; and inside lines seen before. For
#: n-grams twice the limits published with the Gopher rules (0.15, 0.13, 0.10), as a gram's first place counts here too.
MAX_COVERED = {5: 0.30, 7: 0.26, 10: 0.20}
MAX_LINE_CHARS = 0.20
#: Largest number of symbols per word.
MAX_SYMBOLS_PER_WORD = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = (
    [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")]
    + [StructField(f"covered_{n}", DoubleType()) for n in MAX_COVERED]
    + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())]
)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    found = np.zeros(len(keys), bool)
    found[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return found


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = common.buffers(texts)
    n = len(offsets) - 1
    inside = ~common.space_bytes(data)
    starts, ends, doc = common.word_spans(inside, offsets)
    chars = inside & ((data & 0xC0) != 0x80)
    char_sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(chars, out=char_sums[1:])
    out = {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": char_sums[offsets[1:]] - char_sums[offsets[:-1]],
        "n_symbols": common.per_document(_SYMBOL[data], offsets),
    }
    rolling = common.Rolling(common.BYTE_VALUES[data])

    # Lines: stretches between line feeds and ends of documents, if they hold a word.
    feeds = np.flatnonzero(data == 10)
    line_ends = np.sort(np.concatenate([feeds, offsets[1:]]))
    line_starts = np.sort(np.concatenate([feeds + 1, offsets[:-1]]))
    line_chars = char_sums[line_ends] - char_sums[line_starts]
    real = line_chars > 0
    line_starts, line_ends, line_chars = line_starts[real], line_ends[real], line_chars[real]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    later = _later(common.mix(line_doc.astype(common.U64)) ^ rolling.spans(line_starts, line_ends)) if len(line_doc) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=line_chars[later], minlength=n).astype(np.int64)

    # Windows of words.
    words = common.Rolling(rolling.spans(starts, ends)) if len(starts) else None
    lengths = char_sums[ends] - char_sums[starts]
    salt = common.mix(doc.astype(common.U64))
    total = np.maximum(out["word_chars"], 1)

    def covered(size: int) -> np.ndarray:
        if len(doc) < size:
            return np.zeros(len(doc), bool)
        at = np.flatnonzero(doc[size - 1 :] == doc[: len(doc) - size + 1])
        at = at[_repeated(words.windows(size)[at] ^ salt[at])]
        steps = np.zeros(len(doc) + 1, np.int64)
        steps[at] += 1
        np.subtract.at(steps, at + size, 1)
        return np.cumsum(steps[:-1]) > 0

    out["n_repeat_words"] = np.bincount(doc[covered(3)], minlength=n).astype(np.int64)
    kept = out["n_symbols"] <= MAX_SYMBOLS_PER_WORD * out["n_words"]
    kept &= out["dup_line_chars"] <= MAX_LINE_CHARS * total
    for size, most in MAX_COVERED.items():
        inside_again = covered(size)
        out[f"covered_{size}"] = np.bincount(doc[inside_again], weights=lengths[inside_again], minlength=n) / total
        kept &= out[f"covered_{size}"] <= most
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = kept & ~out["base_failed"]
    return out


def repetition_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, with the counts, coverages and verdict of each text."""
    return common.map_texts(df, measure, FIELDS, text, keep)
