"""Problem 6: token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file (ranks of byte strings) is turned into a sentencepiece BPE model: every byte is
one character, a piece's score is its negative rank, the normalizer is the identity and no white
space is added, dropped or escaped. Merging the pair of best score is then merging the pair of
least rank, and piece numbers are the ranks. Texts are cut into pre-tokens by the vocabulary's
pattern; each different pre-token is encoded once a task (a bounded memory) and looked up after.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern that cuts texts into pre-tokens for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Byte b is written as the character FIRST + b: 256 letters that nothing treats as white space.
FIRST = 0x100
#: Pre-tokens a task remembers.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file in the order of their ranks."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field: bytes and strings by length, ints as varints, floats in 32 bits."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def written(data: bytes) -> str:
    """Bytes as the characters the model knows."""
    return data.decode("latin-1").translate(_UP)


def unwritten(text: str) -> bytes:
    return bytes(ord(c) - FIRST for c in text)


_UP = {b: FIRST + b for b in range(256)}


def model_of(ranks: list[bytes]) -> bytes:
    """The serialised sentencepiece model; the piece for the unknown comes last and is never met."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, written(t)) + _field(2, -float(i)) + _field(3, normal)) for i, t in enumerate(ranks)]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder(dict):
    """Pre-token -> ids; encodes what it has not met."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.pattern = regex.compile(PATTERN)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.model.unk_id()

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.model.encode(written(piece.encode("utf-8", "surrogatepass")))
        if self.unknown in ids:
            raise ValueError(f"the vocabulary lacks a byte of {piece!r}")
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text)))) if text else []

    def decode(self, ids: list[int]) -> str:
        """Inverse mapping: pieces back to bytes, bytes to text."""
        return b"".join(unwritten(self.model.id_to_piece(i)) for i in ids).decode("utf-8", "replace")


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, path: str = TOKENIZERS) -> DataFrame:
    """(id_col, ids) for every row: the ids of the whole text, without special tokens.

    Null and empty texts have the empty list of ids. Rows with a null id keep it; repeated rows
    come out as often as they go in; an empty table gives no rows; other columns are ignored. The
    vocabulary file is read on the driver and its model sent to the tasks (a fixed size).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model_of(read_ranks(f"{path}/{vocabulary}.tiktoken")))

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for t in batches(rows, 512):
            encoder = encoder or Encoder(shared.value)
            pieces = [encoder.pattern.findall(x) if x else () for x in t.column(1).to_pylist()]
            parts = [list(chain.from_iterable(map(encoder.__getitem__, p))) for p in pieces]
            off = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=off[1:])
            flat = np.fromiter(chain.from_iterable(parts), np.int32, int(off[-1]))
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))
