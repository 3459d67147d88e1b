"""License scans by template markup: optional and replaceable regions become token automata over the words of a text.

A template is text with ``[[ ... ]]`` around a region that may be absent and ``{{n}}`` for up to n words of any kind.
``compile_template`` turns it into a nondeterministic automaton; a text is accepted from some word on if its mandatory
wording matches exactly, word by word. Base labels come from fixed phrases, found wherever their words stand
consecutively; templates add labels of their own.

Words are found in the UTF-8 bytes of a whole batch in numpy; only texts that hold a trigger are walked word by word.

Defined results: a null or empty text has no words, no labels, null first and last word, and score 0; ties and repeated
rows are scanned alike; an empty table gives an empty table; extra columns are kept unless they have the name of a
result column.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from shelfmark.llm import common

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public license wordings as templates: label, weight of a match in the score, markup.
TEMPLATES = [
    ("mit-notice", 0.9, "[[this {{3}} is]] released under [[the terms of]] the mit license"),
    ("mit-notice", 0.9, "licensed under [[the terms of]] the mit license"),
    ("apache-2.0-notice", 0.9, "licensed under the apache license [[version]] 2 0"),
    ("gpl-3.0-notice", 0.9, "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2.0-notice", 0.9, "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("cc-by-4.0-notice", 0.9, "licensed under [[a]] [[the]] [[creative commons]] [[attribution]] cc by [[international]] 4 0"),
    ("cc-by-4.0-notice", 0.9, "licensed under a creative commons attribution 4 0 international license"),
    ("mit", 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{6}} disclaims all warranties with regard to this software"),
    ("bsd-2-clause", 1.0, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", 1.0, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", 1.0, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mpl-2.0-notice", 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"),
    ("lgpl-header", 1.0, "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {{2}} of the license or [[at your option]] any later version"),
    ("agpl-header", 1.0, "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {{2}} of the license or [[at your option]] any later version"),
    ("unlicense", 1.0, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("bsl-1.0-notice", 1.0, "distributed under the boost software license version 1 0"),
    ("zlib", 1.0, "this software is provided as is without any express or implied warranty in no event will {{6}} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("gpl-header", 1.0, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1}} of the license or [[at your option]] any later version"),
]

#: A text with the longer wording has the shorter one in it; it gets the first label only.
INSTEAD = {"bsd-3-clause": "bsd-2-clause"}

_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_INSIDE[128:] = True
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TRIGGER = re.compile(rb"licen|permission|unencumbered|redistribution|cc[^a-z0-9\x80-\xff]+by")
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")

FIELDS = [
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()),
]


class Automaton:
    """States 0..n with word, any-word and empty moves; state n accepts."""

    def __init__(self, markup: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int] = [-1]
        self.empty: list[list[int]] = [[]]
        self.mandatory: set[bytes] = set()
        at, opened = 0, []
        for token in _MARKUP.findall(markup):
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                self.empty[opened.pop()].append(at)
            elif token.startswith("{{"):
                begin, n = at, int(token[2:-2])
                for _ in range(n):
                    self.any[at] = at = self._state()
                    self.empty[begin].append(at)
            else:
                new = self._state()
                self.words[at][token.encode()] = new
                if not opened:
                    self.mandatory.add(token.encode())
                at = new
        self.accept = at
        self.first = {w for s in self._closure({0}) for w in self.words[s]}

    def _state(self) -> int:
        self.words.append({})
        self.any.append(-1)
        self.empty.append([])
        return len(self.words) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def accepts_from(self, words: list[bytes], at: int) -> bool:
        states = self._closure({0})
        while states:
            if self.accept in states:
                return True
            if at == len(words):
                return False
            word = words[at]
            moved = {t for s in states if (t := self.words[s].get(word)) is not None} | {self.any[s] for s in states if self.any[s] >= 0}
            states, at = self._closure(moved), at + 1
        return False

    def found_in(self, words: list[bytes], held: set[bytes]) -> bool:
        return self.mandatory <= held and any(w in self.first and self.accepts_from(words, i) for i, w in enumerate(words))


@lru_cache
def compile_template(markup: str) -> Automaton:
    return Automaton(markup)


def places(words: list[bytes], phrase: str) -> list[int]:
    """Where the phrase's words begin to stand consecutively."""
    line, wanted, found = b" " + b" ".join(words) + b" ", b" " + phrase.encode() + b" ", []
    at, last, index = line.find(wanted), 0, 0
    while at >= 0:
        index += line.count(b" ", last, at)
        last = at
        found.append(index)
        at = line.find(wanted, at + 1)
    return found


def match(words: list[bytes]) -> tuple:
    """n_base, first and last word, base labels, all labels, score."""
    by_phrase = {p: places(words, p) for p in PHRASES}
    at = sorted(i for found in by_phrase.values() for i in found)
    base = {PHRASES[p] for p, found in by_phrase.items() if found}
    held, labels, score = set(words), set(base), 0.6 if base else 0.0
    for label, weight, markup in TEMPLATES:
        if label not in labels and compile_template(markup).found_in(words, held):
            labels.add(label)
            score = max(score, weight)
    labels -= {short for long, short in INSTEAD.items() if long in labels}
    return len(at), (at or [None])[0], (at or [None])[-1], ",".join(sorted(base)), ",".join(sorted(labels)), score


def _scan(texts: pa.Array) -> dict:
    data, offsets = common.buffers(texts)
    starts, _, doc = common.word_spans(_INSIDE[data], offsets)
    n = len(offsets) - 1
    rows = [(0, None, None, "", "", 0.0)] * n
    whole = data.tobytes()
    for i in range(n):
        text = whole[offsets[i] : offsets[i + 1]].lower()  # of bytes: A-Z only
        if _TRIGGER.search(text):
            rows[i] = match(_WORD.findall(text))
    columns = list(zip(*rows)) if rows else [[]] * 6
    out = {f.name: list(c) for f, c in zip(FIELDS[1:], columns)}
    return out | {"n_words": np.bincount(doc, minlength=n).astype(np.int64)}


def license_labels(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, with the number of words, phrase places, labels and score of each text."""
    return common.map_texts(df, _scan, FIELDS, text, keep)
