"""Licence scan: identifier tags and notice phrases by Aho-Corasick, licence expressions by a shunting-yard parser.

Two automata read each text once. One reads the words, with one space before each and after the last: its patterns are
the base phrases and the notices. The other reads the lower-cased text as it is: its patterns are the tags that announce
a licence expression, such as `spdx-license-identifier:`. The rest of the tag's line is parsed: operators and brackets
go through the shunting-yard algorithm into reverse Polish order, which a stack evaluates to licences and to how much
they restrict: the least of the two sides for `or`, the most for `and`; an exception behind `with` takes some away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from polderlake.llm.frames import Sent, chunks, without
from polderlake.llm.words import LOWER, byte_class

IN_WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
CHUNK_BYTES = 1_000_000
# The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases of licence notices, as words, and the licence each stands for.
NOTICES = {
    "licensed under the apache license": "apache-2",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "cc0",
    "cc0 1 0 universal": "cc0",
    "creative commons zero": "cc0",
    "creative commons attribution 4 0": "cc-by",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "gnu free documentation license": "gfdl",
    "all rights reserved": "all-rights-reserved",
}
#: What announces a licence expression; the expression goes to the end of the line.
TAGS = ("spdx-license-identifier:", "license-expression:", "spdx-licence-identifier:")
#: How much a licence restricts what may be done with a text; unknown names have `UNKNOWN`.
RESTRICTION = {
    "cc0": 0.05, "unlicense": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache-2": 0.15, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5,
    "eupl": 0.5, "cc-by-sa": 0.6, "gfdl": 0.6, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.9, "cc-by-nc": 0.9, "all-rights-reserved": 1.0,
}
UNKNOWN = 0.5
EXCEPTION = 0.2
_EXPRESSION = re.compile(r"[()]|[a-z0-9.+-]*[a-z0-9+]")
_VERSION = re.compile(r"(-only|-or-later|\+)$|-v?\d+(\.\d+)*(-(clause|only|or-later|universal))?\+?$")
_BINDING = {"or": 1, "and": 2, "with": 3}


def licence(name: str) -> str:
    """The label of an identifier: its family without version; `apache-2.0` and `apache-2.0-only` are `apache-2`."""
    family = name
    while (shorter := _VERSION.sub("", family)) != family and shorter:
        family = shorter
    return "apache-2" if family == "apache" and re.search(r"-2(\.0)?\b", name) else family


def expression_tokens(line: str) -> list[str]:
    """Names, operators and brackets of a lower-cased line, as far as they make an expression.

    It ends where a name follows a name, a bracket that was never opened closes, or another character stands (`*/`).
    """
    out: list[str] = []
    depth, at = 0, 0
    while True:
        rest = line[at:]
        at += len(rest) - len(rest.lstrip(" \t"))
        found = _EXPRESSION.match(line, at)
        if not found:
            return out
        token, at = found.group(), found.end()
        operand_before = bool(out) and out[-1] not in _BINDING and out[-1] != "("
        depth += (token == "(") - (token == ")")
        if depth < 0 or operand_before != (token in _BINDING or token == ")"):
            return out
        out.append(token)


def reverse_polish(tokens: list[str]) -> list[str]:
    """Dijkstra's shunting yard: `with` binds before `and`, `and` before `or`; all group from the left."""
    out: list[str] = []
    yard: list[str] = []
    for token in tokens:
        if token == "(":
            yard.append(token)
        elif token == ")":
            while yard and yard[-1] != "(":
                out.append(yard.pop())
            if yard:
                yard.pop()
        elif token in _BINDING:
            while yard and _BINDING.get(yard[-1], 0) >= _BINDING[token]:
                out.append(yard.pop())
            yard.append(token)
        else:
            out.append(token)
    return out + [token for token in reversed(yard) if token != "("]


@dataclass(frozen=True)
class Terms:
    labels: frozenset[str]
    restriction: float


def evaluate(polish: list[str]) -> Terms | None:
    """Licences and restriction of an expression; None if there is none. An operator without two sides is left out."""
    stack: list[Terms | str] = []
    for token in polish:
        if token not in _BINDING:
            stack.append(token)
            continue
        if len(stack) < 2:
            continue
        right, left = stack.pop(), _terms(stack.pop())
        if token == "with":
            stack.append(Terms(left.labels, max(0.0, round(left.restriction - EXCEPTION, 6))))
            continue
        right = _terms(right)
        pick = min if token == "or" else max
        stack.append(Terms(left.labels | right.labels, pick(left.restriction, right.restriction)))
    return _terms(stack[0]) if stack else None


def _terms(value: Terms | str) -> Terms:
    if isinstance(value, Terms):
        return value
    label = licence(value)
    return Terms(frozenset([label]), RESTRICTION.get(label, UNKNOWN))


def trimmed(tokens: list[str]) -> list[str]:
    """The tokens without operators and open brackets at their end."""
    end = len(tokens)
    while end and (tokens[end - 1] in _BINDING or tokens[end - 1] == "("):
        end -= 1
    return tokens[:end]


@dataclass
class Finding:
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: set[str]
    labels: set[str]
    score: float


class Scanner:
    """The two automata with what their patterns mean."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]):
        self.base, self.notices, self.tags = base, notices, tags
        self.open()

    def open(self) -> None:
        self.phrases = ahocorasick.Automaton()
        for phrase in {*self.base, *self.notices}:
            self.phrases.add_word(f" {phrase} ", (len(phrase) + 1, self.base.get(phrase), self.notices.get(phrase)))
        self.phrases.make_automaton()
        self.marks = ahocorasick.Automaton()
        for tag in self.tags:
            self.marks.add_word(tag, tag)
        self.marks.make_automaton()

    def __getstate__(self) -> dict:
        return {"base": self.base, "notices": self.notices, "tags": self.tags}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.open()

    def scan(self, raw: bytes) -> Finding:
        """One text as UTF-8 bytes."""
        lowered = LOWER[np.frombuffer(raw, dtype=np.uint8)]
        inside = np.zeros(len(lowered) + 1, dtype=bool)
        inside[1:] = IN_WORD[lowered]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        found = Finding(len(starts), 0, None, None, set(), set(), 0.0)
        if not len(starts):
            return found
        # A space before each word: what isn't in a word goes but for the byte before a word's start.
        kept = inside[1:].copy()
        spaced = np.concatenate([[np.uint8(0x20)], lowered])
        spaced[1:][~kept] = 0x20
        take = np.concatenate([[False], kept])
        take[starts] = True
        words = spaced[take].tobytes().decode("utf-8", "replace") + " "
        places = []
        for end, (back, base, notice) in self.phrases.iter(words):
            if base:
                places.append(end - back)
                found.base_labels.add(base)
            if notice:
                found.labels.add(notice)
        if places:
            # A word's number is the number of spaces before it; the texts between places are counted once.
            places.sort()
            number, at, numbers = 0, 0, []
            for place in places:
                number += words.count(" ", at, place)
                at = place
                numbers.append(number)
            found.n_base, found.first_word, found.last_word = len(places), numbers[0], numbers[-1]
        found.labels |= found.base_labels
        found.score = max((RESTRICTION.get(label, UNKNOWN) for label in found.labels), default=0.0)
        text = lowered.tobytes().decode("utf-8", "replace")
        for end, _ in self.marks.iter(text):
            line_end = text.find("\n", end + 1)
            line = text[end + 1 : line_end if line_end >= 0 else len(text)]
            terms = evaluate(reverse_polish(trimmed(expression_tokens(line))))
            if terms:
                found.labels |= terms.labels
                found.score = max(found.score, terms.restriction)
        return found


RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(docs: DataFrame, column: str = "text", *, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """`docs` with what each whole text says about its licence, instead of the text.

    `n_words`; `n_base`, the places of all base phrases, overlaps included; `first_word` and `last_word`, the smallest
    and largest of their first words (from 0; null without any); `base_labels` and `labels`, distinct, sorted and joined
    by commas (empty string if none); `score`, the restriction of the strictest licence found, 0 without one. Columns of
    these names are replaced, whatever their case. Null and empty texts have no words. Repeated rows are kept. An expression that is broken off counts as far as it
    goes; names are compared without case and version. One pass without a shuffle; a task holds about `CHUNK_BYTES` of
    text, or one text if that is longer.
    """
    source = without(docs, *RESULT)
    kept = [name for name in source.columns if name != column]
    schema = T.StructType([source.schema[name] for name in kept])
    for name in RESULT:
        schema = schema.add(name, "double" if name == "score" else "string" if "labels" in name else "long")
    sent = Sent(docs.sparkSession, Scanner(dict(base), dict(notices), tuple(tags)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.get()
        for piece in chunks(batches, column, CHUNK_BYTES):
            texts = piece.column(column).cast(pa.binary()).to_pylist()
            found = [scanner.scan(text or b"") for text in texts]
            out = [
                pa.array([f.n_words for f in found], pa.int64()),
                pa.array([f.n_base for f in found], pa.int64()),
                pa.array([f.first_word for f in found], pa.int64()),
                pa.array([f.last_word for f in found], pa.int64()),
                pa.array([",".join(sorted(f.base_labels)) for f in found], pa.string()),
                pa.array([",".join(sorted(f.labels)) for f in found], pa.string()),
                pa.array([f.score for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(piece.column(name) for name in kept), *out], schema.names)

    return source.select(*kept, column).mapInArrow(run, schema)
