"""Problem 6: encode texts with a byte-level BPE vocabulary through a sentencepiece model.

The model is serialised here from the vocabulary file, nothing is trained: every token
becomes a piece spelt with one printable character per byte, scored by its negative rank,
so that the merge of lowest rank is always done first; normalisation is the identity. Texts
are cut into pre-tokens by the vocabulary's pattern, each is spelt in byte characters and
encoded by itself. Decoding maps ids back to pieces, characters back to bytes.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every function here, this is its default.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"

#: Fixed value: the pre-token pattern of this vocabulary (contractions, letters, digits, other signs, white space).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose ids a worker remembers; beyond it the memory starts anew. Only speed depends on it.
REMEMBERED = 300_000
#: Pre-tokens handed to the model in one call.
CHUNK = 20_000


def _byte_letters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


LETTERS = _byte_letters()
BYTES = {c: b for b, c in enumerate(LETTERS)}
_SPELL = {b: c for b, c in enumerate(LETTERS)}


def spell(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_SPELL)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of a byte-level BPE vocabulary with ranks 0..n-1.

    Piece ids are the ranks; the piece that stands for the unknown, which the format asks
    for, comes last and can't occur, as every byte is a piece.
    """
    pieces = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in pieces] != list(range(len(pieces))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be 0..n-1 and hold every byte")
    normal, unknown, bpe = 1, 2, 2
    out = [_field(1, _field(1, spell(p)) + _field(2, float(-rank)) + _field(3, normal)) for rank, p in enumerate(pieces)]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encode and decode texts; one per worker process."""

    def __init__(self, serialised: bytes):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialised)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for c in cut for p in c if p not in self.known})
        for i in range(0, len(new), CHUNK):
            part = new[i : i + CHUNK]
            self.known.update(zip(part, self.processor.encode([spell(p.encode()) for p in part], num_threads=1)))
        known = self.known
        return [[i for p in c for i in known[p]] for c in cut]

    def decode(self, ids: list[int | None]) -> str:
        """Bytes that are no whole character, as of a list cut within one, and ids that are null or no token's become U+FFFD."""
        known = len(self.processor) - 1  # the last piece stands for the unknown
        pieces = (self.processor.id_to_piece(int(i)) if i is not None and 0 <= i < known else None for i in ids)
        return b"".join(b"\xff" if p is None else bytes(BYTES[c] for c in p) for p in pieces).decode(errors="replace")


@lru_cache(maxsize=2)
def encoder(serialised: bytes) -> Encoder:
    return Encoder(serialised)


def vocabulary(name: str = BYTE_BPE, directory: str | None = None) -> str:
    return os.path.join(directory or VOCABULARIES, name)


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): each row's text encoded without special tokens, in one pass without a shuffle.

    A null or empty text has an empty list; strings that spell a special token are ordinary
    text. Rows stay as they are, repeated or with a null key; other columns are ignored.
    ``path`` is of the vocabulary file, which only the driver reads: executors get the
    serialised model, whose size (about 1 MB) depends on the vocabulary alone.
    """
    shared = df.sparkSession.sparkContext.broadcast(model(read_ranks(path or vocabulary())))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(shared.value)
        for texts in batches:
            yield pd.Series(own.encode(texts.tolist()), dtype=object)

    return df.select(F.col(key), ids(F.coalesce(F.col(text), F.lit(""))).alias("ids"))


def decode(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text STRING): the inverse of :func:`encode`; an empty list gives an empty text, null gives null.

    What isn't the encoding of a text is decoded as :meth:`Encoder.decode` says.
    """
    shared = df.sparkSession.sparkContext.broadcast(model(read_ranks(path or vocabulary())))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(shared.value)
        for lists in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in lists], dtype=object)

    return df.select(F.col(key), text(F.col(ids)).alias("text"))
