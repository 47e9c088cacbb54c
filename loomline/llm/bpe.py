"""Byte-pair encoding of whole corpora in linear time.

The vocabulary is mapped byte for byte to Latin-1 strings and put into an Aho-Corasick automaton. For each
pre-token the automaton gives the longest vocabulary entry at each position; the encoding is found by
walking from longest match to longest match and backing up to shorter ones whenever two neighbours could
not stand side by side in the result of the merges. Whether two ids are compatible is decided by undoing
their merges and is remembered per pair; positions from which no encoding can be completed are remembered
per pre-token, so each is visited once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomline.operators.skew import spread

TOKENIZERS = os.environ.get("LOOMLINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the tokenizer byte_bpe_50k splits a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens up to this many bytes are remembered, so many at most.
CACHED_BYTES, CACHED = 64, 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte that byte-level vocabularies are written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Encodes text by a byte-level vocabulary file (`vocab` and `merges` of its `model`)."""

    def __init__(self, spec: str | bytes):
        model = json.loads(spec)["model"]
        stand_in = byte_alphabet()
        latin = lambda s: bytes(stand_in[c] for c in s).decode("latin-1")
        self.ids: dict[str, int] = {}
        for word, i in model["vocab"].items():
            if all(c in stand_in for c in word):
                self.ids[latin(word)] = i
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: rank of the merge that makes an id (bytes: -1), its two parts, and the merged id of a pair.
        self.rank, self.parts, self.pair = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            x, y = latin(a), latin(b)
            made = self.ids[x + y]
            self.pair[self.ids[x], self.ids[y]] = made
            if made not in self.rank:
                self.rank[made], self.parts[made] = r, (self.ids[x], self.ids[y])
        made = set(self.rank)
        self.ids = {w: i for w, i in self.ids.items() if i in made or len(w) == 1}
        for i in self.ids.values():
            self.rank.setdefault(i, -1)
        self.length = {i: len(w) for w, i in self.ids.items()}
        self.word = {i: w for w, i in self.ids.items()}
        self.machine = ahocorasick.Automaton()
        for w, i in self.ids.items():
            self.machine.add_word(w, (len(w), i))
        self.machine.make_automaton()
        self.split = regex.compile(PATTERN)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _next_shorter(self, i: int) -> int:
        """The longest vocabulary entry that is a proper prefix of an entry, -1 for a single byte."""
        found = self.shorter.get(i)
        if found is None:
            w, found = self.word[i], -1
            for n in range(len(w) - 1, 0, -1):
                if (found := self.ids.get(w[:n], -1)) >= 0:
                    break
            self.shorter[i] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave `left` and `right` side by side when they encode the two texts joined.

        Both are taken apart, the part of the later merge first. If the pieces that touch at the border would
        have been merged before the piece last taken apart was made, the border does not hold.
        """
        key = (left, right)
        answer = self.compatible.get(key)
        if answer is not None:
            return answer
        rank, parts, pair = self.rank, self.parts, self.pair
        # `before`: merges at the border count only if they come earlier than this (rank, and on
        # equal ranks the left side goes first).
        before, answer = None, True
        while True:
            joined = pair.get((left, right))
            if joined is not None and (before is None or rank[joined] < before):
                answer = False
                break
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                break
            if a > b:
                before, left = a, parts[left][1]
            else:
                before, right = b + 1, parts[right][0]
        if len(self.compatible) >= 4_000_000:
            self.compatible.clear()
        self.compatible[key] = answer
        return answer

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token, given as Latin-1 string of its UTF-8 bytes."""
        whole = self.ids.get(word)
        if whole is not None and self._whole(whole):
            return (whole,)
        n = len(word)
        longest = [-1] * n
        reach = [0] * n
        for end, (size, i) in self.machine.iter(word):
            start = end - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            size = self.length[token]
            if not dead[at + size] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at += size
                if at == n:
                    return tuple(out)
                token = longest[at]
                continue
            token = self._next_shorter(token)
            while token < 0:  # nothing fits here after what stands before: give up this position
                dead[at] = 1
                last = out.pop()
                at -= self.length[last]
                token = self._next_shorter(last)

    def _whole(self, i: int) -> bool:
        """Whether the merges make this entry from its own bytes (an entry another merge shadows is never made)."""
        if self.rank[i] < 0:
            return True
        a, b = self.parts[i]
        return self._whole(a) and self._whole(b) and self._made_of(a, b)

    def _made_of(self, a: int, b: int) -> bool:
        key = (a, b, 0)
        answer = self.compatible.get(key)  # type: ignore[call-overload]
        if answer is None:
            # the two parts stay apart until their own merge comes up
            made = self.rank[self.pair[a, b]]
            answer, left, right, before = True, a, b, made
            while True:
                joined = self.pair.get((left, right))
                if joined is not None and self.rank[joined] < before:
                    answer = False
                    break
                x, y = self.rank[left], self.rank[right]
                if x < 0 and y < 0:
                    break
                if x > y:
                    before, left = x, self.parts[left][1]
                else:
                    before, right = y + 1, self.parts[right][0]
            self.compatible[key] = answer  # type: ignore[index]
        return answer

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts give no ids."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.split.findall(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = self.encode_word(raw.decode("latin-1"))
                if len(raw) <= CACHED_BYTES:
                    if len(known) >= CACHED:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return "".join(self.word[i] for i in ids).encode("latin-1").decode("utf-8", "replace")


_held: dict[int, BytePairEncoder] = {}


def encoder(spec: bytes) -> BytePairEncoder:
    """The encoder of a vocabulary, built once in each Python worker."""
    key = hash(spec)
    if key not in _held:
        _held.clear()
        _held[key] = BytePairEncoder(spec)
    return _held[key]


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ids_col: str = "ids"
) -> DataFrame:
    """One row (id, ids) for each row of `docs`: its text as token ids, without special tokens.

    Null and empty texts give the empty list; repeated rows stay repeated; strings that look like special
    tokens are ordinary text; a text of any length is encoded whole, in time proportional to its length. The
    vocabulary file (about 1.5 MB, whatever the corpus) is broadcast. Other columns are ignored.
    """
    path = vocabulary or os.path.join(TOKENIZERS, "byte_bpe_50k.json")
    with open(path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    key = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            # small pieces keep the lists of ids, the largest thing held, within bounds
            begin = 0
            for k, text in enumerate(batch.column(1)):
                flat.extend(enc.encode(text.as_py()))
                ends.append(len(flat))
                if len(flat) > 2_000_000 or k == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, k + 1 - begin), lists], [id_col, ids_col])
                    begin, flat, ends = k + 1, [], [0]

    out = T.StructType([T.StructField(id_col, key), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return spread(docs.select(id_col, text_col)).mapInArrow(run, out)
