"""Splitting long texts into overlapping chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: context window in tokens, characters per token, fill factor, overlap, separators
WINDOW_TOKENS = 512
CHARS_PER_TOKEN = 3.5
CHAR_LIMIT = 1792        # 512 * 3.5
CHUNK_SIZE = 1612        # int(0.9 * 512 * 3.5)
CHUNK_OVERLAP = 32
SEPARATORS = ("\n\n", "\n", " ", "")


def is_long(text: Column) -> Column:
    return F.length(text) > CHAR_LIMIT


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of ``size``-character pieces, each starting ``size - overlap`` after the previous one.

    Built-in expressions only; the last piece ends with the text.
    """
    stride = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / stride), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.substring(text, i * stride + 1, F.lit(size)))


def recursive_chunks(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     separators: tuple[str, ...] = SEPARATORS):
    """Arrow function text -> array of chunks no longer than ``size``.

    Cuts at the coarsest separator that occurs, keeps each separator at the start of the piece it
    precedes, cuts longer pieces with the next separators, packs pieces greedily and repeats up to
    ``overlap`` characters of whole pieces at the start of the next chunk. Chunks are stripped.
    """

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunk_text(t, size, overlap, separators))

    return run


def chunk_text(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """One text of ``recursive_chunks``."""
    level = next((i for i, sep in enumerate(separators) if sep == "" or sep in text),
                 len(separators) - 1)
    finer = separators[level + 1:]
    chunks: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        chunks += _pack(short, size, overlap)
        short = []
        chunks += chunk_text(piece, size, overlap, finer) if finer else [piece]
    return chunks + _pack(short, size, overlap)


def _pieces(text: str, sep: str) -> list[str]:
    if sep == "":
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in (head, *(sep + r for r in rest)) if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, lo, length = [], 0, 0          # the open chunk is pieces[lo:hi]
    for hi, piece in enumerate(pieces):
        if length + len(piece) > size and hi > lo:
            out.append("".join(pieces[lo:hi]).strip())
            while length > overlap or (length and length + len(piece) > size):
                length -= len(pieces[lo])
                lo += 1
        length += len(piece)
    out.append("".join(pieces[lo:]).strip())
    return [c for c in out if c]
