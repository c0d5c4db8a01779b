"""Operator 1: license scans by template-markup matching.

A template is license wording with two kinds of markup: ``[[ ... ]]`` encloses words that
may be left out, ``<<n>>`` stands for up to n words of any wording. Every template is
compiled into a bit-parallel token automaton: one bit a token, shifted by each word that
the text offers, with skip edges over optional regions. A text is accepted where the
automaton's last bit is reached, that is where all mandatory words stand exactly, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import id_and_text, map_arrow, read_table, text_bytes

#: The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label -> template, wording of public license notices.
TEMPLATES = {
    "apache-2.0-notice": "licensed under [[the]] apache license [[version]] 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at <<12>> unless required by applicable law or agreed to in writing [[software]] distributed under the license is distributed on an as is basis",
    "gpl-2.0-notice": "gnu general public license [[as published by the free software foundation]] [[either]] version 2",
    "gpl-3.0-notice": "gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu [[lesser]] general public license as published by the free software foundation",
    "cc-by-4.0-notice": "[[creative commons]] cc by 4 0",
    "cc-by-nc-4.0-notice": "cc by nc 4 0",
    "cc-by-sa-4.0-notice": "cc by sa 4 0",
    "mit-notice": "[[released]] under [[the terms of]] the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of <<8>> and associated documentation files [[the <<2>>]] to deal in <<4>> without restriction",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-3-clause-endorsement": "neither the name of <<12>> nor the names of <<3>> contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-disclaimer": "this software is provided by <<12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mit-condition": "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement [[of third party rights]]",
    "isc-grant": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib-grant": "this software is provided as is without any express or implied warranty in no event will the <<3>> be held liable for any damages arising from the use of this software",
    "boost-1.0-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at <<6>>]]",
    "epl-2.0-header": "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] 2 0 [[which [[accompanies this distribution and]] is available at <<6>>]]",
    "agpl-3.0-notice": "gnu affero general public license [[as published by the free software foundation]] [[either]] version 3",
    "lgpl-notice": "gnu [[library]] lesser general public license [[as published by the free software foundation]] [[either]] version <<2>> of the license",
    "gpl-no-warranty": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "unlicense-grant": "this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile sell or distribute this software]]",
    "cc0-1.0-notice": "[[creative commons]] cc0 1 0 [[universal]]",
    "wtfpl-grant": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}

#: Bytes of words, lower-cased; all others become spaces. Bytes of non-ASCII characters belong to words.
_WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, ASCII letters (lower-cased) and non-ASCII characters."""
    return text.translate(_WORD_TABLE).split()


def _places(line: bytes, needle: bytes) -> Iterator[int]:
    """Numbers of the words at which the needle stands; the line is counted once."""
    at, seen, word = line.find(needle), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        yield word
        at = line.find(needle, at + 1)


class TokenAutomaton:
    """A template as bit masks: bit i is set while the first i tokens are behind us."""

    def __init__(self, template: str) -> None:
        tokens: list[bytes | None] = []
        skips: list[tuple[int, int]] = []
        open_at: list[int] = []
        self.mandatory: set[bytes] = set()
        for mark in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", template):
            if mark == "[[":
                open_at.append(len(tokens))
            elif mark == "]]":
                skips.append((open_at.pop(), len(tokens)))
            elif mark.startswith("<<"):
                for _ in range(int(mark[2:-2])):
                    skips.append((len(tokens), len(tokens) + 1))
                    tokens.append(None)
            else:
                word = mark.lower().encode()
                tokens.append(word)
                if not open_at:
                    self.mandatory.add(word)
        if open_at:
            raise ValueError(f"an optional region is not closed: {template}")
        if not self.mandatory:
            raise ValueError(f"no mandatory word: {template}")
        self.any = sum(1 << i for i, x in enumerate(tokens) if x is None)
        self.masks: dict[bytes, int] = {}
        for i, x in enumerate(tokens):
            if x is not None:
                self.masks[x] = self.masks.get(x, 0) | 1 << i
        self.skips = sorted(skips)
        self.final = 1 << len(tokens)
        self.start = self._closed(1)
        self.first = {x for x, m in self.masks.items() if m & self.start}
        if self.start & self.final:
            raise ValueError(f"it accepts no words at all: {template}")

    def _closed(self, state: int) -> int:
        for a, b in self.skips:  # by start, so one pass reaches all
            if state >> a & 1:
                state |= 1 << b
        return state

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the shortest match that starts at word `at`, or None."""
        state, n = self.start, len(words)
        while state and at < n:
            state = (state & (self.masks.get(words[at], 0) | self.any)) << 1
            at += 1
            if state:
                state = self._closed(state)
                if state & self.final:
                    return at
        return None


class LicenseScanner:
    """All templates and base phrases over one text."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]) -> None:
        self.automata = {label: TokenAutomaton(t) for label, t in templates.items()}
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.needles = {label: [b" " + w + b" " for w in a.mandatory] for label, a in self.automata.items()}

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]]]:
        """Number of words; (word, label) of base places; (label, start, end) of template matches."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        base = []
        for needle, label in self.phrases:
            base += [(k, label) for k in _places(line, needle)]
        found = []
        for label, automaton in self.automata.items():
            if all(needle in line for needle in self.needles[label]):
                for first in automaton.first:
                    for start in _places(line, b" " + first + b" "):
                        end = automaton.match(words, start)
                        if end is not None:
                            found.append((label, start, end))
        return len(words), sorted(base), sorted(found)


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long>>"


def _scan(batches: Iterator[pa.RecordBatch], templates: dict, phrases: dict) -> Iterator[pa.RecordBatch]:
    scanner = LicenseScanner(templates, phrases)
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = []
        for text in text_bytes(batch):
            n, base, found = scanner.scan(text)
            mine = sorted({x for _, x in base})
            labels = sorted({*mine, *(x for x, _, _ in found)})
            longest = max((end - start for _, start, end in found), default=0)
            score = longest / (longest + 1) if longest else 0.5 * bool(base)
            rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(mine), ",".join(labels), score, [dict(zip(("label", "start", "end"), x)) for x in found]))
        cols = list(zip(*rows)) if rows else [()] * 8
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """License labels of every whole text.

    One row per input row: doc_id, n_words, base places (n_base, first_word, last_word,
    base_labels), labels of base and templates, score and the template matches with their
    word spans. score: L / (L + 1) for the longest accepted template span of L words, 0.5
    where only a base phrase stands, else 0. Null and empty texts: no words, no labels, score 0.
    Null ids stay null, repeated rows give repeated results, other columns are left behind.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(id_and_text(docs), _scan, f"doc_id {id_type}, {_SCHEMA}", templates=templates or TEMPLATES, phrases=phrases or BASE_PHRASES)


def op1_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("matches")
