"""Tokens, phrases and sentences."""

from __future__ import annotations

import re
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A phrase with the mark that closes it; ASCII question and exclamation marks close none.
PHRASE = r"[^,.;。？！]+[,.;。？！]?|[,.;。？！]"
#: A sentence with its mark and a closing quote.
SENTENCE = r"[^.!?。！？]+[.!?。！？]?[\"'」』]?"
#: A token of the built-in tokenizer.
TOKEN = r"\w+|[^\w\s]"
#: What is trimmed from sentences.
BLANK = " \n\t\r"


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, tokens: list[int]) -> str: ...

    def count(self, text: str) -> int: ...


class RegexTokenizer:
    """Words and marks.  Numbers of tokens are stable hashes, so ``decode`` isn't offered."""

    _token = re.compile(TOKEN, re.ASCII)

    def encode(self, text: str) -> list[int]:
        import zlib

        return [zlib.crc32(t.encode()) & 0x7FFFFFFF for t in self._token.findall(text)]

    def decode(self, tokens: list[int]) -> str:
        raise NotImplementedError("tokens of the regular-expression tokenizer don't give the text back")

    def count(self, text: str) -> int:
        return sum(1 for _ in self._token.finditer(text))


class ByteTokenizer:
    """The bytes of the UTF-8 text: any text goes there and back."""

    def encode(self, text: str) -> list[int]:
        return list(text.encode())

    def decode(self, tokens: list[int]) -> str:
        return bytes(tokens).decode()

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Tokens of a batch, without a Python object for each."""
        raw = texts.cast(pa.binary())
        _, ends, data = raw.buffers()
        ends = np.frombuffer(ends, np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
        values = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(values), mask=raw.is_null())

    def decode_all(self, tokens: pa.Array) -> pa.Array:
        """Texts of a batch; an error where tokens are no bytes of UTF-8."""
        ends = tokens.offsets.to_numpy()
        values = tokens.values.slice(ends[0], ends[-1] - ends[0])
        if values.null_count:
            raise ValueError("a token is null")
        values = values.to_numpy()
        if len(values) and not 0 <= values.min() <= values.max() < 256:
            raise ValueError("tokens must be in range(0, 256)")
        known = np.packbits(tokens.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
        data = [pa.py_buffer(known), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(values.astype(np.uint8))]
        return pa.Array.from_buffers(pa.binary(), len(tokens), data).cast(pa.string())

    def count(self, text: str) -> int:
        return len(text.encode())


class RankTokenizer:
    """A byte-pair encoding from a file of base64 tokens and ranks, by tiktoken; one for each process."""

    _open: dict[str, object] = {}

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def _encoding(self):
        if self.path not in self._open:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._open[self.path] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._open[self.path]

    def encode(self, text: str) -> list[int]:
        return self._encoding().encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        return self._encoding().decode(tokens)

    def count(self, text: str) -> int:
        return len(self.encode(text))


#: Texts whose tokens are Python lists at the same time, where a tokenizer has no way for whole batches.
_AT_ONCE = 64


def encode_batch(texts: pa.Array, tokenizer: Tokenizer) -> pa.Array:
    if isinstance(tokenizer, ByteTokenizer):
        return tokenizer.encode_all(texts)
    kind = pa.list_(pa.int32())
    parts = (texts.slice(i, _AT_ONCE).to_pylist() for i in range(0, len(texts), _AT_ONCE))
    return pa.concat_arrays([pa.array([], kind), *(pa.array([None if t is None else tokenizer.encode(t) for t in part], kind) for part in parts)])


def decode_batch(tokens: pa.Array, tokenizer: Tokenizer) -> pa.Array:
    if isinstance(tokenizer, ByteTokenizer):
        return tokenizer.decode_all(tokens)
    parts = (tokens.slice(i, _AT_ONCE).to_pylist() for i in range(0, len(tokens), _AT_ONCE))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else tokenizer.decode(t) for t in part], pa.string()) for part in parts)])


def encoded(text: Column, tokenizer: Tokenizer) -> Column:
    """Token numbers of each text, in Arrow batches."""
    return F.arrow_udf(lambda batch: encode_batch(batch, tokenizer), T.ArrayType(T.IntegerType()))(text)


def decoded(tokens: Column, tokenizer: Tokenizer) -> Column:
    """The texts that token numbers stand for."""
    return F.arrow_udf(lambda batch: decode_batch(batch, tokenizer), T.StringType())(tokens)


def token_count(text: Column) -> Column:
    """Tokens of the built-in tokenizer, in the JVM."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed sentences that aren't empty, in order."""
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s, F.lit(BLANK)))
    return F.filter(trimmed, lambda s: s != "")
