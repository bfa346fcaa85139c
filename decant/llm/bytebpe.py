"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary itself.

A rank file lists byte strings with their ranks. Every byte stands for one character (printable bytes for themselves),
so the vocabulary is a list of pieces, and a piece with rank r scores -r. Written as a sentencepiece BPE model with
identity normalisation, its best-scored merge is the lowest rank, the left one first among equals. Texts are cut by the
vocabulary's pattern, each part is encoded on its own, and a part that is a token as a whole is that token. Decoding
maps ids back to pieces and pieces to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decant.llm.common import few

#: Parts whose ids a worker keeps at a time; the memo only saves work.
MEMO = 200_000
#: Field numbers and kinds of the model format (pieces, trainer, normaliser; BPE; normal and unknown pieces).
PIECES, TRAINER, NORMALISER = 1, 2, 3
BPE, NORMAL, UNKNOWN = 2, 1, 2
#: Fixed value: bytes that are shown as the character of the same number; the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def alphabet() -> dict[int, int]:
    """Code point that shows each byte."""
    odd = [b for b in range(256) if b not in PRINTABLE]
    return {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(odd)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64, blank, number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def model_bytes(ranks: Mapping[bytes, int]) -> bytes:
    """The vocabulary as a sentencepiece model whose piece numbers are the ranks; the number after the last is unknown."""
    shown = alphabet()
    size = max(ranks.values()) + 1
    if sorted(ranks.values()) != list(range(size)) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2, ... and hold every single byte")
    pieces = [b""] * size
    for token, rank in ranks.items():
        text = token.decode("latin-1").translate(shown).encode()
        pieces[rank] = _block(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, NORMAL)
    pieces.append(_block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, UNKNOWN))
    trainer = _number(3, BPE) + _number(4, size + 1) + _number(40, size)
    # identity: no character map, no space in front, white space neither squeezed nor escaped
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_block(PIECES, p) for p in pieces) + _block(TRAINER, trainer) + _block(NORMALISER, normaliser)


class Codec(dict):
    """Ids of parts (little-endian unsigned 32-bit), remembered, and bytes of ids."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.ranks, self.shown = ranks, alphabet()
        self.parts = regex.compile(pattern).findall
        back = {c: b for b, c in self.shown.items()}
        self.tokens = [bytes(back[ord(c)] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        raw = part.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.shown))
        out = self[part] = np.array(ids, dtype="<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.parts(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(read_ranks(path), pattern)


def defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _text(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers) of each document's whole text.

    Null and empty texts have no ids. Bytes that are no UTF-8 become U+FFFD. Strings of special tokens are ordinary
    text. Repeated rows and null keys are kept; other columns are not read; empty input gives no rows. ``path`` must be
    readable on every executor.
    """
    where = defaults(path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*where)
        for b in few(batches):
            ids = [c.encode(_text(t)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["key", "n_tokens", "ids"])

    d = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    return d.mapInArrow(run, "key bigint, n_tokens bigint, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``decoded``: the bytes that ids stand for; null ids give null. An id beyond the vocabulary is an error."""
    where = defaults(path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*where)
        for b in few(batches):
            out = [c.decode(i.as_py()) if i.is_valid else None for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["key", "decoded"])

    return encoded.select(F.col(key).cast("bigint").alias("key"), F.col(ids).alias("ids")).mapInArrow(run, "key bigint, decoded binary").withColumnRenamed("key", key)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and give the number of tokens with checksums of both; see ``encode``.

    Both ways run in one pass, so neither ids nor decoded bytes leave the task.
    """
    where = defaults(path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*where)
        for b in few(batches):
            n, of_ids, of_bytes = [], [], []
            for t in b.column(1):
                ids = c.encode(_text(t))
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    return d.mapInArrow(run, "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
