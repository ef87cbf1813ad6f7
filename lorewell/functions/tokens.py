"""Token counts, cuts and slices over a pluggable encoder.

An encoder turns a text into tokens and back (``encode`` and ``decode``).  The default one takes four characters
as a token, the last token what is left over, so that its count is that of ``functions.text.token_count``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a model's own tokenizer for each counted one, where a context budget is estimated (fixed value).
ESTIMATE = 1.5


class Encoder(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class FourCharacters:
    """About four characters a token; one token at least for any text."""

    def encode(self, text: str) -> list[str]:
        n = max(1, len(text) // 4) if text else 0
        return [text[4 * i : 4 * i + 4 if i + 1 < n else None] for i in range(n)]

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


class TokenizerFile:
    """An encoder from a tokenizer's JSON file, loaded once in each Python worker."""

    _loaded: dict = {}

    def __init__(self, path: str):
        self.path = path

    def _own(self):
        if self.path not in self._loaded:
            from tokenizers import Tokenizer

            self._loaded[self.path] = Tokenizer.from_file(self.path)
        return self._loaded[self.path]

    def encode(self, text: str) -> list[int]:
        return self._own().encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list[int]) -> str:
        return self._own().decode(tokens)


DEFAULT = FourCharacters()


def truncate(text: str, most: int, encoder: Encoder = DEFAULT) -> tuple[str, bool]:
    """The first ``most`` tokens, and whether anything was cut."""
    tokens = encoder.encode(text) if text else []
    return (text or "", False) if len(tokens) <= most else (encoder.decode(tokens[:most]), True)


def cut_out(text: str, offset: int, most: int, encoder: Encoder = DEFAULT) -> tuple[str, int, bool]:
    """Tokens offset to offset + most, the number of all tokens, and whether more follow."""
    tokens = encoder.encode(text) if text else []
    if offset >= len(tokens):
        return "", len(tokens), False
    end = min(offset + most, len(tokens))
    return encoder.decode(tokens[offset:end]), len(tokens), end < len(tokens)


def _rows(fn: Callable, schema: str) -> Callable:
    @F.pandas_udf(schema)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split(":")[0].strip() for x in schema.removeprefix("struct<").removesuffix(">").split(",")]
        for texts in parts:
            yield pd.DataFrame([fn(t if isinstance(t, str) else "") for t in texts], columns=names)

    return run


def count_tokens(text: Column, encoder: Encoder = DEFAULT) -> Column:
    """Tokens of a text; none of an empty or null one."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([len(encoder.encode(t)) if isinstance(t, str) and t else 0 for t in texts], dtype="int64")

    return run(text)


def estimate_tokens(text: Column, encoder: Encoder = DEFAULT) -> Column:
    """The tokens that a model is likely to see: half as many again, rounded down."""
    return F.floor(count_tokens(text, encoder) * ESTIMATE).cast("long")


def truncate_to_tokens(text: Column, most: int, encoder: Encoder = DEFAULT) -> Column:
    """struct<content, truncated>"""
    return _rows(lambda t: truncate(t, most, encoder), "struct<content:string,truncated:boolean>")(text)


def slice_tokens(text: Column, offset: int, most: int, encoder: Encoder = DEFAULT) -> Column:
    """struct<content, total, more>"""
    return _rows(lambda t: cut_out(t, offset, most, encoder), "struct<content:string,total:long,more:boolean>")(text)
