"""Settings of the operators, as frozen records."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SplitterConfig:
    chunk_size: int = 1024
    chunk_overlap: int = 200
    paragraph_separator: str = "\n\n\n"
    word_separator: str = " "
    #: Whether paragraph and word separators are kept in the pieces; dropped by default.
    preserve_separators: bool = False

    def __post_init__(self) -> None:
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap:
            raise ValueError("chunk_size must be positive and chunk_overlap not negative")


@dataclass(frozen=True)
class IndexConfig:
    batch_size: int = 32
    dimension: int = 384


@dataclass(frozen=True)
class SynthesizerConfig:
    max_tokens: int = 4096
    max_response: int = 512

    @property
    def limit(self) -> int:
        left = self.max_tokens - self.max_response
        return left if left > 0 else 512


@dataclass(frozen=True)
class WebConfig:
    delay_ms: int = 1000
    jitter_ms: int = 500
    concurrency: int = 1
    user_agent: str = "quernstone"


@dataclass(frozen=True)
class ReaderConfig:
    concurrency: int = 4
