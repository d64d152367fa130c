"""Policies and parameters, with the defaults that the registered queries use."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

SPLITS = ("test", "validation", "train")


@dataclass(frozen=True)
class QualityPolicy:
    """Thresholds of the quality flags, and what the flags mean for selection; fixed values."""

    short_words: int = 40
    short_bytes: int = 50
    long_line: int = 2000
    repeated_lines: float = 0.5
    repeated_lines_from: int = 10
    minified_lines: int = 10
    minified_line: int = 1000
    url_density: float = 0.05
    generated_head: int = 100_000
    secret_head: int = 1_000_000
    hard: tuple[str, ...] = (
        "empty", "high_line_repetition", "high_url_density", "null_character", "possible_secret", "replacement_character", "too_short",
    )
    hard_code: tuple[str, ...] = ("likely_minified",)
    soft: dict[str, int] = field(default_factory=lambda: {"possible_generated": 8, "very_long_line": 4})


@dataclass(frozen=True)
class Bucket:
    """A source of documents: its category, and whether its documents are code."""

    name: str
    category: str
    code: bool = False


@dataclass(frozen=True)
class SplitPolicy:
    """Shares of the splits; the first ones get the first ranges of the digest."""

    seed: str = "textmill-v1"
    shares: tuple[tuple[str, int], ...] = (("test", 5), ("validation", 5), ("train", 90))

    def thresholds(self) -> list[tuple[str, int]]:
        """Exclusive ends of the 64-bit ranges, in whole numbers; the last takes the rest."""
        total, end, out = sum(n for _, n in self.shares), 0, []
        for name, n in self.shares:
            end += (1 << 64) * n // total
            out.append((name, end))
        return out[:-1] + [(out[-1][0], 1 << 64)]


@dataclass(frozen=True)
class LshTable:
    hash_seed: int
    densify_seed: int
    bins: int = 72
    bands: int = 12

    @property
    def rows(self) -> int:
        return self.bins // self.bands


@dataclass(frozen=True)
class LshConfig:
    """Near-duplicate parameters. The seeds are fixed values."""

    width: int = 5
    tables: tuple[LshTable, ...] = (
        LshTable(1691086982835599081, 7841199801642290067),
        LshTable(11694633085474628617, 13787848793156543929),
    )
    key_seed: int = 507867018506514414
    shingle_seed: int = 104729
    jaccard: Fraction = Fraction(4, 5)
    #: A posting or a number of pairs beyond these is an error, never cut short.
    max_posting: int = 5000
    max_pairs: int = 250_000_000


@dataclass(frozen=True)
class PackConfig:
    """Rows hold length + 1 tokens and advance by length; eos ends every document."""

    length: int = 256
    eos: int = 0
    vocabulary: int = 65536


@dataclass(frozen=True)
class SftPolicy:
    """What an instruction conversation must satisfy."""

    seed: str = "textmill-sft-v1"
    validation_per_million: int = 100_000
    max_prompt_bytes: int = 2000
    max_completion_bytes: int = 2000
    min_score: float = 0.0
    max_tokens: int = 600
    domains: tuple[str, ...] = ("generic", "algorithmic")
    algorithms: tuple[str, ...] = ("self-instruct", "evol-instruct")


QUALITY = QualityPolicy()
SPLIT = SplitPolicy()
LSH = LshConfig()
PACK = PackConfig()
SFT = SftPolicy()
