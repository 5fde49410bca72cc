"""Byte-pair encoding by backtracking, and decoding by an offset table.

Merging pair by pair is not needed to find what it ends in. A sequence of tokens is that result exactly if every two
neighbours are compatible: encoding their joined text gives these two again. So the encoder goes from left to
right, takes the longest token that starts at a place (all found in one pass of an Aho-Corasick automaton), and
steps back to shorter ones when a pair is not compatible. Places where no encoding goes on are marked and not
tried again, so a piece takes linear time.

Compatibility of two tokens follows from the table of merges: undo the later merge on either side of the border,
and look whether an earlier merge would have joined what then meets there. Answers are kept by pair.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.shared import map_batches, text_bytes
from subsetlab.llm.wordbpe import Cores, PieceEncoder, flat
from subsetlab.llm.words import ragged

#: Pairs whose compatibility one worker keeps.
PAIRS = 1_000_000


def byte_letters() -> list[str]:
    """Return the printable character that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + other.index(b)) for b in range(256)]


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary whose words end in a marked symbol.

    Tokens are numbered anew by the order of merges: first the symbols, then what each merge makes. Inside, a word
    is a string of symbols in which the last one is shifted by 512, so that a token with a word end is a string too.
    """

    names: list[str]
    outer: list[int]
    halves: list[tuple[int, int]]
    merged: dict[tuple[int, int], int]
    automaton: ahocorasick.Automaton
    shorter: list[int]
    sizes: list[int]
    special: dict[str, int]
    pattern: regex.Pattern
    split_special: regex.Pattern
    known: dict[int, bool] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, suffix = parts["model"], parts["model"]["end_of_word_suffix"]
        letters = byte_letters()
        names = [c + end for end in ("", suffix) for c in letters]
        number = {x: i for i, x in enumerate(names)}
        halves, merged = [(i, i) for i in range(len(names))], {}
        for left, right in model["merges"]:
            pair = number[left], number[right]
            name = left + right
            merged[pair] = number.setdefault(name, len(names))
            if merged[pair] == len(names):
                names.append(name)
                halves.append(pair)
        code = {c: chr(b) for b, c in enumerate(letters)}

        def inner(name: str) -> str:
            stem = name.removesuffix(suffix)
            text = "".join(map(code.__getitem__, stem))
            return text if stem == name else text[:-1] + chr(ord(text[-1]) + 512)

        texts = [inner(x) for x in names]
        special = {x["content"]: x["id"] for x in parts["added_tokens"]}
        splits = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        anyone = "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)"
        out = cls(
            names, [model["vocab"][x] for x in names], halves, merged, ahocorasick.Automaton(), [-1] * len(names),
            [len(x) for x in texts], special, regex.compile(splits), regex.compile(f"({anyone})"),
        )
        # A token that merging its own text doesn't give can't occur.
        usable = [i for i, (a, b) in enumerate(halves) if a == b == i or out._whole(i)]
        found = {texts[i]: i for i in usable}
        for i in usable:
            out.automaton.add_word(texts[i], i)
            out.shorter[i] = next((found[x] for k in range(out.sizes[i] - 1, 0, -1) if (x := texts[i][:k]) in found), -1)
        out.automaton.make_automaton()
        return out

    def _whole(self, token: int) -> bool:
        """Tell whether merging the token's text gives the token: nothing joins its halves' edges before its own merge does."""
        left, right = self.halves[token]
        return self._meet(left, right, token)

    def _meet(self, left: int, right: int, limit: int) -> bool:
        """Tell whether no merge below ``limit`` joins symbols over the border of ``left`` and ``right``."""
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        answer = self.known.get(key)
        if answer is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            answer = self.known[key] = self._meet(left, right, 1 << 62)
        return answer

    def encode_word(self, word: str) -> list[int]:
        """Return the ids of a pre-token, given as characters that stand for bytes."""
        text = word[:-1] + chr(ord(word[-1]) + 512)
        n = len(text)
        longest = [-1] * n
        sizes, shorter = self.sizes, self.shorter
        for end, token in self.automaton.iter(text):
            start = end + 1 - sizes[token]
            if longest[start] < 0 or sizes[longest[start]] < sizes[token]:
                longest[start] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            previous = out[-1] if out else -1
            while token >= 0:
                end = at + sizes[token]
                if not dead[end] and (previous < 0 or self.compatible(previous, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
        return [self.outer[x] for x in out]

    def encode_piece(self, piece: str) -> list[int]:
        """Return the ids of a text without white space, special tokens in it included."""
        out: list[int] = []
        for k, part in enumerate(self.split_special.split(piece)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                # Lower case is taken letter by letter: no rule for the end of a word.
                lower = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
                for word in self.pattern.findall(lower):
                    out += self.encode_word(word.encode().decode("latin-1"))
        return out

    def encode_cores(self, cores: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Return the ids of all cores in turn, and how many each has."""
        if plain:
            return flat([self.encode_word(x.encode().decode("latin-1")) for x in cores])
        return flat([self.encode_piece(x) for x in cores])


class OffsetTable:
    """Strings by id in one array; joining those of many ids is one gather."""

    def __init__(self, strings: list[bytes]) -> None:
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.stop = np.cumsum([len(x) for x in strings])
        self.size = np.diff(self.stop, prepend=0)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return ragged(self.blob, self.stop[ids] - size, size)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary.load(path)
        self.encoder = PieceEncoder(Cores(v.encode_cores))
        names = {**dict(zip(v.outer, v.names, strict=True)), **{i: x for x, i in v.special.items()}}
        n = max(names) + 1
        #: Each string ends in the space that joins it to the next.
        self.strings = OffsetTable([names.get(i, "").encode() + b" " for i in range(n)])
        self.numbers = OffsetTable([b"%d " % i for i in range(n)])

    def decode(self, ids: np.ndarray) -> bytes:
        """Return the text of ``ids``. Without a decoder in its file, the vocabulary joins tokens by spaces."""
        return self.strings.join(ids)[:-1].tobytes()


_workers: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _workers:
        _workers[path] = Codec(path)
    return _workers[path]


def encode_decode(docs: DataFrame, vocabulary: str, with_text: bool = False) -> DataFrame:
    """Encode whole texts and decode their ids again.

    Return doc_id, n_tokens, ids_sha256 (of decimal ids, joined by a space), decoded_sha256; with ``with_text`` also
    ids (array of int) and decoded. A null text is empty and has no ids. Null doc_ids and repeated rows stay.
    Texts of any length are taken whole: a worker's memory grows with the longest one. An empty table gives no rows.
    Further columns are left out.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else "")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(vocabulary)
        ids, count = own.encoder.encode(text_bytes(batch.column(1)))
        stop = np.cumsum(count)
        parts = [ids[b - n : b] for b, n in zip(stop.tolist(), count.tolist(), strict=True)]
        decoded = [own.decode(x) for x in parts]
        columns = [
            batch.column(0), pa.array(count),
            pa.array([hashlib.sha256(own.numbers.join(x)[:-1].tobytes()).hexdigest() for x in parts]),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_text:
            columns += [pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded])]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, schema)
