"""Encoding of texts with a public byte-pair vocabulary, and decoding back.

The ranks are read from a local file whose path is a parameter; each Python worker builds the encoder once.  Long texts are cut
at places where the pre-splitting pattern always ends a token, so the pieces' ids joined are the ids of the whole text, and
no single call holds a whole giant text's matches.

Defined results: null and empty texts have the empty list of ids; texts that spell special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: The pre-splitting pattern of the byte-pair vocabularies (a fixed value of the files' description).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in pieces of about so many characters.
PIECE_CHARS = 65_536

_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")
_encoders: dict = {}


def ranks_path(folder: str = "/opt/tokenizers", name: str = RANKS) -> str:
    """Path of a rank file in the folder of public tokenizers."""
    return os.path.join(folder, name)


def encoder(path: str):
    """The encoder of a rank file, built once in a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text where a token always ends: before white space, between letters and digits, or before other signs.

    The next safe place from ``size`` characters on is taken; a stretch without any stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, path: str, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    encode = encoder(path).encode_ordinary
    if len(text) <= size:
        return encode(text)
    return [i for piece in safe_pieces(text, size) for i in encode(piece)]


def token_ids(path: str) -> Callable[[Column | str], Column]:
    """Column function: the ids of a text column as ``array<int>``."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([encode_text(t, path) for t in texts], dtype=object)

    return ids


def token_count(path: str) -> Callable[[Column | str], Column]:
    """Column function: the number of ids of a text column, without moving the ids to the JVM."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode_text(t, path)) for t in texts], dtype="int64")

    return count


def token_bytes(path: str) -> Callable[[Column | str], Column]:
    """Column function: the raw bytes that a list of ids stands for; null stays null.

    Any slice of ids has defined bytes, also one that cuts a character; ``cast('string')`` of whole texts' bytes gives the text.
    """

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([None if x is None else e.decode_bytes(_plain(x)) for x in ids], dtype=object)

    return raw


def _plain(ids: Iterable) -> list[int]:
    return [int(i) for i in ids]


def encode_table(documents: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids) of every row; one narrow pass without a shuffle."""
    return documents.select(id_column, token_ids(path)(F.col(text)).alias("ids"))
