"""Language models and embedders: protocols, deterministic stand-ins, remote adapters, and how they run over rows.

A model runs in batches inside tasks.  Replies can be kept in a table by the
prompt's hash, so a prompt is sent once however many rows have it.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as TX


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...

    def stream_complete(self, prompt: str) -> Iterator[str]: ...


class _Whole:
    """A model that has its reply whole: the stream is one part."""

    def stream_complete(self, prompt: str) -> Iterator[str]:
        yield self.complete(prompt)


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Echo(_Whole):
    """Replies with its prompt."""

    def complete(self, prompt: str) -> str:
        return prompt


@dataclass(frozen=True)
class Fixed(_Whole):
    """Replies with one text."""

    reply: str

    def complete(self, prompt: str) -> str:
        return self.reply


@dataclass(frozen=True)
class Scripted(_Whole):
    """Replies by a function, which must be importable where tasks run."""

    reply: Callable[[str], str]

    def complete(self, prompt: str) -> str:
        return self.reply(prompt)


@dataclass(frozen=True)
class ChatEndpoint:
    """A chat service that takes a list of messages and answers with choices."""

    url: str
    model: str
    key: str = ""
    timeout: float = 60.0

    def _ask(self, prompt: str, **more):
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], **more}).encode()
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        return urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout)

    def complete(self, prompt: str) -> str:
        with self._ask(prompt) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    def stream_complete(self, prompt: str) -> Iterator[str]:
        """The reply's parts as the service sends them, as events of a line each."""
        with self._ask(prompt, stream=True) as reply:
            for line in reply:
                event = line.decode().strip().removeprefix("data:").strip()
                if event == "[DONE]":
                    return
                if event.startswith("{") and (part := json.loads(event)["choices"][0].get("delta", {}).get("content")):
                    yield part


@dataclass(frozen=True)
class GenerateEndpoint(_Whole):
    """A generation service that takes contents of parts and answers with candidates."""

    url: str
    key: str = ""
    timeout: float = 60.0

    def complete(self, prompt: str) -> str:
        body = json.dumps({"contents": [{"parts": [{"text": prompt}]}]}).encode()
        headers = {"Content-Type": "application/json", **({"x-goog-api-key": self.key} if self.key else {})}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as reply:
            return json.load(reply)["candidates"][-1]["content"]["parts"][-1]["text"]


class HashedBag:
    """Counts of token hashes with signs, scaled to length one: deterministic, and near for texts that share words."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        tok = TX.RegexTokenizer()
        for i, t in enumerate(texts):
            for h in tok.encode(t.lower()):
                out[i, h % self.dimension] += 1.0 if (h >> 16) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


def complete(df: DataFrame, prompt: str, model: LanguageModel, out: str = "reply", errors: str = "raise") -> DataFrame:
    """``df`` with the model's reply to each row's prompt.  ``errors='null'`` gives a null reply where the model fails."""
    if errors not in ("raise", "null"):
        raise ValueError("errors must be raise or null")
    at = df.columns.index(prompt)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(p: str | None) -> str | None:
            if p is None:
                return None
            try:
                return model.complete(p)
            except Exception:
                if errors == "raise":
                    raise
                return None

        for b in it:
            yield pa.record_batch([*b.columns, pa.array([ask(p) for p in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` string")


def complete_once(df: DataFrame, prompt: str, model: LanguageModel, memo: DataFrame | None = None, out: str = "reply", errors: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(``df`` with replies, new memo rows): distinct prompts that ``memo`` (prompt_hash, reply) lacks are sent, once each."""
    hashed = df.withColumn("prompt_hash", prompt_hash(F.col(prompt)))
    wanted = hashed.where(F.col(prompt).isNotNull()).select("prompt_hash", F.col(prompt).alias("_prompt")).dropDuplicates(["prompt_hash"])
    if memo is not None:
        wanted = wanted.join(memo.select("prompt_hash"), "prompt_hash", "left_anti")
    new = complete(wanted, "_prompt", model, "_reply", errors).select("prompt_hash", F.col("_reply").alias(out))
    known = new if memo is None else memo.select("prompt_hash", F.col("reply").alias(out)).unionByName(new)
    return hashed.join(known, "prompt_hash", "left"), new.withColumnRenamed(out, "reply")


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 32) -> DataFrame:
    """``df`` with a vector for each row's text (a null text counts as empty)."""
    at = df.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(at).to_pylist()]
            rows = [v for k in range(0, len(texts), batch) for v in embedder.embed(texts[k : k + batch])]
            yield pa.record_batch([*b.columns, pa.array([np.asarray(r, np.float32) for r in rows], pa.list_(pa.float32()))], names=[*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` array<float>")


def audit(prompt: str) -> str:
    """What an audit log says of a prompt."""
    return hashlib.sha256(prompt.encode()).hexdigest()
