"""BPE encoding and decoding by a tokenization automaton.

`MergeAutomaton.compile` adds one gadget for every merge, in order. The automaton starts with one state that has an arc
to itself for every base symbol. The gadget of the merge (u, v)

* gives every state that now has an arc u into a state with an arc v one arc uv more, which ends in a copy of the state
  that v ends in, and
* takes the arc v from the state that u ends in.

After all gadgets the automaton is deterministic and accepts exactly the token sequences that the merges make. All arcs
of one label end in one state, so a state is named by the label that leads to it. Written out, nearly every state would
have an arc for nearly every token. The table therefore holds what the gadgets did, by label: the two parts of a token,
the step at which it was made, and the step at which an arc was taken from a state. Whether a state has an arc is read
off that table along the right parts of the state's label and the left parts of the arc's label.

A word is encoded by running the automaton over its symbols. Every prefix of a word has one accepted path, so one state
is held for each position. Decoding emits the labels of the path's arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from polderlake.llm.frames import Sent, chunks, without

WORD_END = "</w>"
#: Stands for the word end in the transition table; no byte has it as its symbol.
END = "\n"
# The pre-split of the tokenizer file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# Code points whose case or class depends on the Unicode version: such texts are normalised and split by the library.
# So are those above U+FFFF, and the seven that normalise to such. A test compares all code points.
RARE = "[\ufa6c\ufacf-\ufad1\ufad5-\ufad7\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u1c80-\u1cff\u208f\u209d-\u209f\ua640-\uabff\U00010000-\U0010ffff]"
#: Encoded words that a task keeps; when it is full it starts anew.
KEPT_WORDS = 300_000
#: Looked-up transitions that a task keeps.
KEPT_PAIRS = 500_000
NEVER = 1 << 60
CHUNK_BYTES = 1_000_000


@functools.cache
def split_pattern() -> re.Pattern:
    """`SPLIT` with the code points of its classes written out, which `re` finds faster than `regex` finds the classes.

    Only for texts without `RARE` code points: those above U+FFFF are left out.
    """
    points = "".join(chr(point) for point in range(0x10000) if not 0xD800 <= point < 0xE000)
    pattern = SPLIT.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(_ranges(kind, points) for kind in (r"\s", r"\p{L}", r"\p{N}")) + "]")
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{_ranges(kind, points)}]")
    return re.compile(pattern)


def _ranges(kind: str, points: str) -> str:
    """The code points of a class, as the inside of a set."""
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{kind}+", points))


def byte_symbols() -> list[str]:
    """The printable symbol of every byte: itself where it is printable Latin-1, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(byte) if byte in printable else chr(next(spare)) for byte in range(256)]


class MergeAutomaton:
    """The compiled merges of one tokenizer; see the module text."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.arcs: dict[str, int] = {}
        self.state_parts: list[list[tuple[int, int]]] = [[(token * len(labels), NEVER)] for token in range(len(labels))]
        self.arc_parts: list[list[tuple[int, int]]] = [[(token, NEVER)] for token in range(len(labels))]
        self.taken: dict[int, int] = {}
        self.known: dict[int, bool] = {}

    @classmethod
    def compile(cls, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> MergeAutomaton:
        """One gadget for each merge, in order. Raises if a merge uses a token that no earlier merge made."""
        labels = [""] * (max(vocabulary.values(), default=-1) + 1)
        for label, token in vocabulary.items():
            labels[token] = label
        made_by_merge = {u + v for u, v in merges}
        automaton = cls(labels)
        automaton.arcs = {label: token for label, token in vocabulary.items() if label not in made_by_merge}
        present = set(automaton.arcs)
        for step, (u, v) in enumerate(merges):
            if u not in present or v not in present or u + v in present:
                raise ValueError(f"merge {step} ({u!r}, {v!r}) does not build on earlier ones")
            present.add(u + v)
            if u not in automaton.arcs or v not in automaton.arcs:
                continue  # a part that never occurs: nothing to merge
            automaton._gadget(step, automaton.arcs[u], automaton.arcs[v], u + v, vocabulary[u + v])
        automaton.open()
        return automaton

    def open(self) -> None:
        """The transition table over symbols: the trie of all arcs' labels with its fallback links."""
        self.table = ahocorasick.Automaton()
        for label, token in self.arcs.items():
            symbols = label.removesuffix(WORD_END) + END if label.endswith(WORD_END) else label
            self.table.add_word(symbols, (token, len(symbols)))
        self.table.make_automaton()

    def _gadget(self, step: int, u: int, v: int, label: str, token: int) -> None:
        if not self._has_arc(u, v):
            return  # an earlier gadget took the arc: this merge never applies
        self.arcs[label] = token
        # Along the right parts of a state's label, and the left parts of an arc's: each part, and the step at which
        # the next larger one was made. Until then, what a gadget took from the part's state was taken here too.
        self.state_parts[token] = [(token * len(self.labels), NEVER), (self.state_parts[v][0][0], step), *self.state_parts[v][1:]]
        self.arc_parts[token] = [(token, NEVER), (u, step), *self.arc_parts[u][1:]]
        self.taken[u * len(self.labels) + v] = step

    def _has_arc(self, state: int, arc: int) -> bool:
        taken = self.taken.get
        arc_parts = self.arc_parts[arc]
        for a, until in self.state_parts[state]:
            for b, limit in arc_parts:
                step = taken(a + b)
                if step is not None and step < until and step <= limit:
                    return False
        return True

    def has_arc(self, state: int, arc: int) -> bool:
        """Whether the state that `state` leads to has an arc `arc`; kept for the next time."""
        if len(self.known) >= KEPT_PAIRS:
            self.known.clear()
        answer = self.known[state * len(self.labels) + arc] = self._has_arc(state, arc)
        return answer

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given as byte symbols without the word end."""
        size = len(word) + 1
        known, has_arc, many = self.known.get, self.has_arc, len(self.labels)
        state, came_from = [-1] * (size + 1), [0] * (size + 1)
        # All labels that end at each symbol, the longest first.
        for last, (arc, length) in self.table.iter(word + END):
            end = last + 1
            if state[end] < 0:
                start = end - length
                if start:
                    ok = known(state[start] * many + arc)
                    if ok is None:
                        ok = has_arc(state[start], arc)
                    if not ok:
                        continue
                state[end], came_from[end] = arc, start
        path = []
        while size:
            path.append(state[size])
            size = came_from[size]
        path.reverse()
        return path

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "table": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.open()


class Encoder:
    """Texts to tokens and back with one tokenizer file: special tokens, normalisation, pre-split, automaton."""

    def __init__(self, source: str):
        model = json.loads(source)
        self.source = source
        self.special = {token["content"]: token["id"] for token in model["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.automaton = MergeAutomaton.compile(model["model"]["vocab"], merges)
        self.open()

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        return cls(Path(path).read_text(encoding="utf-8"))

    def open(self) -> None:
        self.symbols = byte_symbols()
        #: Encoded words as they stand in a text, and those that the library has split and spelled in symbols.
        self.words: dict[str, tuple[bytes, str]] = {}
        self.spelled: dict[str, tuple[bytes, str]] = {}
        self.split = split_pattern().findall
        self.rare = re.compile(RARE).search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.library = None

    def __getstate__(self) -> dict:
        return {"source": self.source, "special": self.special, "automaton": self.automaton}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.open()

    def _word(self, kept: dict[str, tuple[bytes, str]], word: str, symbols: str) -> tuple[bytes, str]:
        tokens = self.automaton.encode(symbols)
        if len(kept) >= KEPT_WORDS:
            kept.clear()
        made = kept[word] = (struct.pack(f"<{len(tokens)}I", *tokens), " ".join([self.automaton.labels[t] for t in tokens]))
        return made

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        if not text.isascii() and self.rare(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.source)
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [self.spelled.get(word) or self._word(self.spelled, word, word) for word, _ in split]
        # The library lower-cases character by character: no final sigma.
        words = self.split(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        kept, symbols = self.words, self.symbols
        made = list(map(kept.get, words))
        at = -1
        for _ in range(made.count(None)):
            at = made.index(None, at + 1)
            # A new word that comes again in this text has been made by then.
            word = words[at]
            # Printable ASCII stands for itself.
            made[at] = kept.get(word) or self._word(kept, word, word if word.isascii() and word.isprintable() else "".join([symbols[b] for b in word.encode()]))
        return made

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """(tokens as little-endian unsigned 32-bit integers, decoded text) of one whole text."""
        made: list[tuple[bytes, str]] = []
        for part in self.cut(text or ""):
            if part in self.special:
                made.append((np.array([self.special[part]], "<u4").tobytes(), part))
            elif part:
                made += self._plain(part)
        ids, labels = zip(*made, strict=True) if made else ((), ())
        return b"".join(ids), " ".join(filter(None, labels))

    def decode(self, tokens: list[int]) -> str:
        """The labels of the path's arcs. Unknown numbers emit nothing, as in the library."""
        names = {number: name for name, number in self.special.items()}
        labels = self.automaton.labels
        found = (names.get(t) or (labels[t] if 0 <= t < len(labels) else "") for t in tokens)
        return " ".join([label for label in found if label])


RESULT = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")


def encode_documents(docs: DataFrame, encoder: Encoder, column: str = "text", *, ids: bool = True) -> DataFrame:
    """`docs` with the tokens of the whole `column` and the digests of tokens and decoded text.

    Adds `ids` (array of int; left out with `ids=False`), `n_tokens`, `ids_sha256` and `decoded_sha256`, which replace
    columns of those names. Null and empty texts have no tokens. Rows are kept one by one, repeated ones too; an empty
    table gives an empty result. The encoder is broadcast: its size is that of the vocabulary. One pass, no shuffle.
    """
    own = RESULT if ids else RESULT[1:]
    docs_in = without(docs, *own)
    schema = T.StructType(docs_in.schema.fields[:])
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    sent = Sent(docs.sparkSession, encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sent.get()
        for part in chunks(batches, column, CHUNK_BYTES):
            tokens, sizes, hashes, decoded = [], [], [], []
            for text in part.column(column).to_pylist():
                packed, labels = coder.encode(text)
                sizes.append(len(packed) // 4)
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(labels.encode()).hexdigest())
                if ids:
                    tokens.append(packed)
            arrays = [*part.columns]
            if ids:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
                arrays.append(pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(tokens), "<i4")))
            arrays += [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs_in.mapInArrow(run, schema)
