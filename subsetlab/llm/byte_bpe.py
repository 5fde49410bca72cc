"""Byte-level BPE by the tokenizers library, from a file of ranks.

The ranks' tokens are written with one character a byte, and every pair of tokens whose join is a token is a merge
with that token's rank, so that the library merges what the ranks merge; a match that is a token stays whole.

Texts are taken apart where white space follows a character that is none: no match of the pattern crosses such a
place, and what follows it doesn't depend on what is before. The library encodes each different portion once while it
is in a worker's table (by its bytes). Ids of byte-level BPE spell the text's bytes, so the offsets of tokens are sums of
their lengths; a map from bytes to characters turns them into places in the text. A token that holds a part of a
character only gets that character's place.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.bpe import OffsetTable, byte_letters
from subsetlab.llm.shared import map_batches, text_bytes
from subsetlab.llm.wordbpe import PieceEncoder, flat
from subsetlab.llm.words import SPACE, Words, ragged

#: Bytes after which a text is never taken apart: ASCII white space, and last bytes of other white space (U+0085,
#: U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000), which other characters may end in too.
TIED = SPACE.copy()
TIED[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True

#: Portions that one call of the library encodes.
TOGETHER = 1000


def portions(texts: list[bytes]) -> Words:
    """Take ``texts`` apart into portions that can be encoded alone; together they are the whole texts."""
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = SPACE[data[1:]] & ~TIED[data[:-1]]
    edge[np.append(0, stop)] = True
    edges = np.flatnonzero(edge)
    first = np.searchsorted(edges, np.append(0, stop))
    return Words(raw, data, np.append(0, stop[:-1])[: len(texts)], edges[:-1], edges[1:], first)


def read_ranks(path: str) -> dict[bytes, int]:
    """Read lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteCodec:
    """Encoder and decoder of one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, letters = read_ranks(path), byte_letters()
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids don't fit into 16 bits")
        names = {token: "".join(letters[b] for b in token) for token in ranks}
        merges = [(names[x[:k]], names[x[k:]]) for x in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(x)) if x[:k] in ranks and x[k:] in ranks]
        vocabulary = {names[x]: i for x, i in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encoder = PieceEncoder(self._library, split=portions)
        byte = {c: b for b, c in enumerate(letters)}
        tokens = {i: bytes(map(byte.__getitem__, x)) for x, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.strings = OffsetTable([tokens.get(i, b"") for i in range(max(tokens) + 1)])
        self.numbers = OffsetTable([b"%d " % i for i in range(max(tokens) + 1)])

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Return the ids of all portions in turn, and how many each has.

        Portions that may stand before and after others are encoded as one text, as a call costs more than a short
        portion; their lengths in bytes tell whose the ids are.
        """
        raw = [x.encode() for x in texts]
        free = [k for k, x in enumerate(raw) if x and SPACE[x[0]] and not TIED[x[-1]]]
        alone = sorted(set(range(len(raw))) - set(free))
        calls = [self._call(["".join(texts[i] for i in free[k : k + TOGETHER])])[0] for k in range(0, len(free), TOGETHER)]
        ids = np.concatenate([*calls, np.zeros(0, np.uint16)])
        length = np.fromiter((len(raw[i]) for i in free), np.int64, len(free))
        stop = np.searchsorted(np.cumsum(self.strings.size[ids]), np.cumsum(length)) + 1
        more, count = self._call([texts[i] for i in alone])
        size, at, place = np.concatenate([np.diff(stop, prepend=0), count]), np.empty(len(raw), np.int64), [*free, *alone]
        by_text = np.empty(len(raw), np.int64)
        by_text[place], at[place] = size, np.cumsum(size) - size
        return ragged(np.concatenate([ids, more]), at, by_text), by_text

    def _call(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Return the ids of each text (UTF-8)."""
        ids, count = self.encoder.encode(texts)
        stop = np.cumsum(count)
        return [ids[b - n : b] for b, n in zip(stop.tolist(), count.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Return the bytes that ``ids`` spell, whole characters or not."""
        return self.strings.join(ids).tobytes()

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return where in ``text``, in characters, each of its ids begins and ends (exclusive)."""
        stop = np.cumsum(self.strings.size[ids])
        # Characters that have begun by each byte.
        begun = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        start = stop - self.strings.size[ids]
        return begun[start + 1] - 1 if len(ids) else start, begun[stop]

    def portions_of_text(self, ids: Sequence[int | None]) -> list[str]:
        """Return what each id adds to the text: a character that several ids share comes with the last of them.

        Bytes that no id completes are U+FFFD, at the place where that is known, at last with the last id.
        """
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        if any(i is None or not 0 <= i < len(self.strings.size) or not self.strings.size[i] for i in ids):
            raise ValueError("an id that the ranks don't have")
        tokens = [self.decode(np.array([i])) for i in ids]
        return [decoder.decode(x, final=k == len(tokens)) for k, x in enumerate(tokens, 1)]


_workers: dict[tuple[str, str], ByteCodec] = {}


def codec(path: str, pattern: str) -> ByteCodec:
    if (path, pattern) not in _workers:
        _workers[path, pattern] = ByteCodec(path, pattern)
    return _workers[path, pattern]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, with_text: bool = False) -> DataFrame:
    """Encode whole texts by the file ``ranks``, each match of ``pattern`` for itself, and decode the ids again.

    Return doc_id, n_tokens, ids_sha256 (of decimal ids, joined by a space), decoded_sha256 (of the decoded bytes);
    with ``with_text`` also ids, starts and ends (their places in characters; arrays of int) and decoded. A null or
    empty text has no ids. Null doc_ids and repeated rows stay, further columns are left out, an empty table gives no
    rows. Texts of any length are taken whole: a worker's memory grows with the longest one.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, starts array<int>, ends array<int>, decoded string" if with_text else ""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = codec(ranks, pattern), text_bytes(batch.column(1))
        ids = own.encode(texts)
        decoded = [own.decode(x) for x in ids]
        columns = [
            batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(own.numbers.join(x)[:-1].tobytes()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
        ]
        if with_text:
            places = [own.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
            lists = [ids, [a for a, _ in places], [b for _, b in places]]
            columns += [pa.array([x.astype(np.int32) for x in values], pa.list_(pa.int32())) for values in lists]
            columns.append(pa.array([x.decode() for x in decoded]))
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, work, schema)


def decode_ids(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Decode ``rows`` (doc_id, ids): return doc_id, decoded, and portions, what each id adds to the text.

    Bytes that are no whole character (ids of a part of a text) become U+FFFD. Null ids are none; an id that is null or
    that the ranks don't have raises. Null doc_ids and repeated rows stay, further columns are left out.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks, pattern)
        every = [own.portions_of_text(x or []) for x in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array(["".join(x) for x in every], pa.string()), pa.array(every, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "decoded", "portions"])

    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids"))
    return map_batches(own, work, "doc_id long, decoded string, portions array<string>")
