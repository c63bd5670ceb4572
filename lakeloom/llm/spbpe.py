"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

The model file is serialised here, field by field: one piece for each rank, its bytes written as
printable characters, its score the negative rank, so that sentencepiece joins the pair of the lowest
rank first, the leftmost among equals, as the vocabulary asks.  Normalisation is the identity.  Every
pre-token is encoded by itself; ids are ranks.  Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

_models: dict[str, BytePieces] = {}


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a .tiktoken file; ranks are 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    out: list = [None] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: length-delimited, varint, or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranked: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer spec (2) of type BPE, normaliser spec (3)."""
    char = {b: c for c, b in tokens.byte_of_char().items()}
    pieces = [_field(1, _field(1, "".join(char[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(ranked)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, float(-len(ranked))) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranked)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class BytePieces(tokens.CachedPieces):
    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import regex
        import sentencepiece

        self.ranked = load_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranked))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        char = {b: c for c, b in tokens.byte_of_char().items()}
        self.table = {b: ord(char[b]) for b in range(256)}

    def pieces(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.pattern.findall, pieces))
        distinct = list(set().union(*found)) if found else []
        mapped = [p.encode().decode("latin-1").translate(self.table) for p in distinct]
        ids = dict(zip(distinct, (array("I", x).tobytes() for x in self.model.encode(mapped, num_threads=1)), strict=True)) if mapped else {}
        return [b"".join(map(ids.__getitem__, parts)) for parts in found]

    library = pieces  # any text is its pre-tokens, one after the other

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranked.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def pieces_of(path: str) -> BytePieces:
    if path not in _models:
        _models[path] = BytePieces(path)
    return _models[path]


@common.tidy
def _batches(batches: Iterator[pa.RecordBatch], path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    model = pieces_of(path)
    for piece in common.slices(batches, "text"):
        encoded = [ids.tobytes() for ids in model.encode(piece.column("text"))]
        counts = pa.array([len(e) // 4 for e in encoded], pa.int64())
        if digests:
            made = [pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()), pa.array([hashlib.sha256(model.decode(e)).hexdigest() for e in encoded], pa.string())]
        else:
            made = [pa.array(encoded, pa.binary()), pa.array([model.decode(e) for e in encoded], pa.binary())]
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), counts, *made], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as bytes and the bytes they decode to, or the digests of both.

    Null and empty texts give no ids.  Repeated rows give a row each; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    kind = "string" if digests else "binary"
    return docs.select("doc_id", "text").mapInArrow(lambda b: _batches(b, path, digests), f"doc_id long, n_tokens long, ids {kind}, decoded {kind}")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = encode_documents(docs, tokens.tokenizer_path("byte_bpe_50k.tiktoken"), digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


SQL = None
