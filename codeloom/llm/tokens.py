"""Encoding with a public byte-level BPE vocabulary through a serialised model.

The vocabulary file is turned directly into a sentencepiece BPE model: every
token's bytes are written as the usual one-character-per-byte alphabet, its score
is the negative rank, and normalisation is the identity.  Merging the pair with
the highest score is then merging the pair with the lowest rank.  Texts are cut
into pre-tokens first, and merges never cross them.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

#: Folder of the vocabulary files; pass another where they lie elsewhere.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of this vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens whose ids a worker remembers.
CACHE_SIZE = 200_000
#: Characters of a pre-token up to which it is remembered.
CACHE_LENGTH = 64


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is visible, else the next one from 256 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + payload


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model file of a vocabulary; the last piece is the unknown one and is never used."""
    letters = byte_alphabet()
    pieces = sorted((rank, "".join(letters[b] for b in token)) for token, rank in ranks.items())
    if [rank for rank, _ in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for rank, piece in pieces:
        out += _message(1, _message(1, piece.encode()) + _field(2, 5, struct.pack("<f", -float(rank))))
    out += _message(1, _message(1, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(pieces) + 1)) + _field(40, 0, _varint(len(pieces)))
    trainer += b"".join(_field(n, 0, _varint((1 << 64) - 1)) for n in (41, 42, 43))  # no begin, end or padding piece
    plain = _message(1, b"identity") + b"".join(_field(n, 0, b"\0") for n in (3, 4, 5))
    return bytes(out + _message(2, trainer) + _message(3, plain))


class Encoder:
    """Texts to ids and back."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self._find = regex.compile(PRE_TOKEN).findall
        letters = byte_alphabet()
        self._letters = letters
        self._table = {b: letters[b] for b in range(256)}
        self._bytes = {c: b for b, c in enumerate(letters)}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(read_ranks(path)))
        self._known: dict[str, list[int]] = {}

    def _mapped(self, piece: str) -> str:
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._table)

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        cut = [self._find(t) if t else [] for t in texts]
        known = self._known
        new = [p for p in dict.fromkeys(p for pieces in cut for p in pieces) if p not in known]
        fresh = dict(zip(new, self._model.encode([self._mapped(p) for p in new], num_threads=1), strict=True)) if new else {}
        out = []
        for pieces in cut:
            ids: list[int] = []
            for p in pieces:
                ids += known[p] if p in known else fresh[p]
            out.append(ids)
        if len(known) + len(fresh) > CACHE_SIZE:
            known.clear()
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= CACHE_LENGTH)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        letters = "".join(self._model.id_to_piece(list(ids))) if ids else ""
        return bytes(self._bytes[c] for c in letters).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def vocabulary_path(directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> str:
    """Path of the vocabulary file, read on every executor."""
    return f"{directory}/{name}"


def _encode(path: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            step = 512
            for start in range(0, max(1, batch.num_rows), step):
                piece = batch.slice(start, step)
                ids = own.encode_batch(piece["__text"].to_pylist())
                sizes = np.array([len(i) for i in ids], np.int64)
                if counts:
                    last = pa.array(sizes)
                else:
                    flat = np.fromiter((i for row in ids for i in row), np.int32, int(sizes.sum()))
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                kept = [piece[n] for n in piece.schema.names if n != "__text"]
                names = [n for n in piece.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays([*kept, last], names=[*names, "__out"])

    return run


def encode_texts(df: DataFrame, text: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with the list of token ids.

    Null and empty texts both give an empty list.  Special tokens written in a
    text are ordinary text.  Texts are encoded whole, whatever their length;
    repeated rows are encoded and kept one by one.
    """
    return _apply(df, text, ids, path or vocabulary_path(), counts=False)


def count_tokens(df: DataFrame, text: str, count: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with its number of tokens (0 for null and empty)."""
    return _apply(df, text, count, path or vocabulary_path(), counts=True)


def _apply(df: DataFrame, text: str, out: str, path: str, counts: bool) -> DataFrame:
    kept = [c for c in df.columns if c not in (text, out)]
    renamed = [f"c{i}" for i in range(len(kept))]
    work = df.select(*[F.col(f"`{c}`").alias(r) for c, r in zip(kept, renamed, strict=True)], F.col(f"`{text}`").cast("string").alias("__text"))
    fields = [f"{r} {work.schema[r].dataType.simpleString()}" for r in renamed]
    schema = ", ".join([*fields, "__out " + ("bigint" if counts else "array<int>")])
    done = spread(work).mapInArrow(_encode(path, counts), schema)
    return done.select(*[F.col(r).alias(c) for c, r in zip(kept, renamed, strict=True)], F.col("__out").alias(out))
