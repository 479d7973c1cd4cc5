"""Operator 8: byte-level BPE encoding and decoding by sentencepiece.

The vocabulary is a public rank file (token bytes and rank), whose path is a parameter; nothing is trained. From it a
sentencepiece BPE model is serialised directly: each token's bytes are mapped to printable characters, one for
a byte, its score is its negative rank, normalisation is the identity. Merging the pair of the best score is then
merging the pair of the lowest rank. Texts are split by the vocabulary's pattern; every distinct pre-token is
encoded once for each Python worker (the table is emptied at ``KEPT`` entries) and texts are put together with
numpy. The split is vectorised too: it follows from the classes of neighbouring characters. Pre-tokens are looked up by a
64-bit hash; a text whose tokens don't give its own bytes back, as a collision would have it, is encoded again
by their strings. Decoding gathers the tokens' bytes.

One pass, no shuffle; the model, about 1 MB, is broadcast.

Defined results: a null text has null tokens, an empty one none; other columns and repeated rows pass through one by one;
ids outside the vocabulary raise an error on decoding; bytes that aren't UTF-8 decode to U+FFFD.
The result has the id and own columns, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowick.llm import _text as tx

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits texts before the merges; pre_tokens() computes the same.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
KEPT = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f) if t)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes by length, floats as 32 bits, whole numbers as varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of these tokens; id 0 is the unknown piece that it requires, so a token's id is its rank + 1."""
    of = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(of[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


def _classes() -> np.ndarray:
    """By code point: 1 a letter, 2 a number, 3 white space, 0 another."""
    out = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            a, b = (i if i < 0xD800 else i + 0x800 for i in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    return out


def pre_tokens(cp: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin, in code points of texts end to end, which begin at ``rows``."""
    n = len(cp)
    kind = classes[cp]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    first[n] = True
    space = kind == 3
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = space[:-1]
    before &= ~first[:-1]
    after[:-1] = space[1:]
    after |= first[1:]
    blank, changed = np.zeros(n, bool), np.ones(n, bool)
    blank[1:] = cp[:-1] == 32
    changed[1:] = kind[1:] != kind[:-1]
    start = first[:-1] | np.where(space, np.where(before, ~after, True), np.where(before, ~blank, changed))
    marks = np.flatnonzero(start & (cp == 39) & ~first[1:])
    if len(marks):
        one = cp[marks + 1]
        reach = marks + 2 < n
        two = np.where(reach & ~first[np.minimum(marks + 2, n)], cp[np.minimum(marks + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)), 3, 0))
        marks, size = marks[size > 0], size[size > 0]
        start[marks + 1] = False
        ends = marks + size
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Codec:
    """Encodes and decodes; one for each Python worker."""

    def __init__(self, tokens: list[bytes], model: bytes | None = None) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model or serialise(tokens))
        self.classes = _classes()
        self.of = byte_characters()
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if tokens else np.zeros(0, np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._empty()

    def _empty(self) -> None:
        self.hashes, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, words: list[str]) -> list[list[int]]:
        """The token ids of each pre-token."""
        of = self.of
        return [[i - 1 for i in ids] for ids in self.processor.encode(["".join([of[b] for b in w.encode()]) for w in words], out_type=int, num_threads=1)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        coded = self.pieces(words)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        self.index = np.concatenate([self.index, np.arange(len(words)) + len(self.at) - 1])
        self.hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.index = self.hashes[order], self.index[order]
        self.flat = np.concatenate([self.flat, np.fromiter((i for c in coded for i in c), np.int32, int(sizes.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids end to end, and their offsets by text."""
        ids, offsets, _ = self.encode_checked(texts)
        return ids, offsets

    def encode_checked(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, their offsets by text, and the bytes that they decode to."""
        if len(self.hashes) > KEPT:
            self._empty()
        whole = "".join([t or "" for t in texts])
        rows = np.concatenate([[0], np.cumsum([len(t or "") for t in texts], dtype=np.int64)])
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = pre_tokens(cp, rows[:-1], self.classes)
        ends = np.append(starts[1:], len(cp))
        hashes = tx.code_hashes(cp)(starts, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            self._learn(distinct[new], [whole[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        index = self.index[at][back]
        sizes = self.at[index + 1] - self.at[index]
        ids = self.flat[_ranges(self.at[index], sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, rows)]
        data = self.bytes_of(ids)
        if data.tobytes() != whole.encode():
            words = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            known = dict(zip(once := list(set(words)), self.pieces(once), strict=True))
            ids = np.fromiter((i for w in words for i in known[w]), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(known[w]) for w in words])])[np.searchsorted(starts, rows)]
            data = self.bytes_of(ids)
        return ids, offsets, data

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_ranges(self.starts[ids], self.sizes[ids])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts from ids end to end and their offsets."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes)):
            raise ValueError("an id outside the vocabulary")
        data = self.bytes_of(ids).tobytes()
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_codecs: list[tuple[object, Codec]] = []


def _codec(shared) -> Codec:
    """The codec of a broadcast vocabulary, made once by each Python worker; the value is held, so another cannot take its place in memory."""
    if not _codecs or _codecs[0][0] is not shared.value:
        _codecs[:] = [(shared.value, Codec(*shared.value))]
    return _codecs[0][1]


def _groups(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _list_array(ids: np.ndarray, offsets: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(missing))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, decode_too: bool = False) -> DataFrame:
    """(id, token_ids, n_tokens) of every row; ``decode_too`` adds decoded: the text made from the ids alone."""
    tokens = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, serialise(tokens)))  # of the vocabulary's size, whatever the corpus
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, token_ids array<int>, n_tokens int" + ", decoded string" * decode_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for first, end in _groups(sizes):
                part = b.column(1).slice(first, end - first)
                ids, offsets, data = codec.encode_checked(part.to_pylist())
                missing = part.is_null().to_numpy(zero_copy_only=False)
                out = [b.column(0).slice(first, end - first), _list_array(ids, offsets, missing), pa.array(np.diff(offsets).astype(np.int32), mask=missing)]
                if decode_too:
                    at = np.concatenate([[0], np.cumsum(codec.sizes[ids])])[offsets].astype(np.int32)
                    text = pa.StringArray.from_buffers(len(part), pa.py_buffer(at), pa.py_buffer(data))
                    out.append(pc.if_else(pa.array(missing), pa.scalar(None, pa.string()), text))
                yield pa.RecordBatch.from_arrays(out, [id_col, "token_ids", "n_tokens", "decoded"][: len(out)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(coded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, decoded) of every row."""
    tokens = read_ranks(vocabulary)
    shared = coded.sparkSession.sparkContext.broadcast((tokens, serialise(tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            lists = b.column(1).to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists], dtype=np.int64)])
            ids = np.fromiter((i for x in lists for i in x or ()), np.int64, int(offsets[-1]))
            texts = codec.decode(ids, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t for x, t in zip(lists, texts, strict=True)], pa.string())], [id_col, "decoded"])

    return coded.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` {coded.schema[id_col].dataType.simpleString()}, decoded string")
