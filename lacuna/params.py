"""Immutable parameter sets of the three commands, with the bounds the commands enforce."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# SAM flag bits that the pairing rules touch.
FLAG_REVERSE = 16
FLAG_MATE_REVERSE = 32

# Geometry of the profile and of the calling grid, in base pairs.
PROFILE_WINDOW = 256
GRID_STEP = 30

# Fixed value: 99 % quantile of the chi-squared distribution with one degree of freedom.
CHI2_Q99 = 6.6349

# Accepted names of reference builds.
REFERENCE_BUILDS = ("t2t", "grch38", "grch37", "hg38", "hg19")


class ParameterError(ValueError):
    """An option has a value the commands do not accept."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ParameterError(message)


@dataclass(frozen=True)
class ReadQuality:
    """Quality gate for one read of a pair."""

    flags_set: int = 33
    flags_unset: int = 3868
    same_contig: bool = True
    min_mapq: int = 1
    min_unclipped: int = 50
    min_rel_score: float = 0.8

    def forward(self) -> ReadQuality:
        """Gate for the leftmost read: mate reversed, itself not."""
        return self._oriented(must=FLAG_MATE_REVERSE, must_not=FLAG_REVERSE)

    def reverse(self) -> ReadQuality:
        """Gate for the rightmost read: itself reversed, mate not."""
        return self._oriented(must=FLAG_REVERSE, must_not=FLAG_MATE_REVERSE)

    def _oriented(self, must: int, must_not: int) -> ReadQuality:
        return ReadQuality(
            (self.flags_set | must) & ~must_not,
            (self.flags_unset | must_not) & ~must,
            self.same_contig,
            self.min_mapq,
            self.min_unclipped,
            self.min_rel_score,
        )


@dataclass(frozen=True)
class ProfileParams:
    """Options of the ``profile`` command."""

    reference: str = "GRCh38"
    max_deletion: int = 10_000
    merge_read_groups: bool = False
    min_pairs: int = 50_000
    max_size: int = 20_000
    quality: ReadQuality = field(default_factory=ReadQuality)

    def __post_init__(self) -> None:
        _require(
            self.reference.lower() in REFERENCE_BUILDS,
            f"reference build must be one of {', '.join(REFERENCE_BUILDS)}, got {self.reference!r}",
        )
        _require(self.max_deletion > 0, "max_deletion must be positive")
        _require(self.min_pairs >= 0, "min_pairs must not be negative")


@dataclass(frozen=True)
class CallParams:
    """Options of the ``call`` command.

    ``max_deletion`` is accepted for compatibility and has no effect. ``max_load`` of 0 means
    unlimited. ``strict_parity`` switches the accidental behaviours listed in the README back on.
    """

    max_load: int = 100
    max_deletion: int = 10_000
    per_sample_rg: bool = False
    min_init_len: int | None = None
    min_len: int | None = None
    min_sample_fraction: float = 0.1
    cell_population: bool = False
    segment_size: int = 200_000
    min_rel_window_cover: float = 0.5
    pseudocount_fraction: int = 500
    output_failed: bool = False
    window_wise: bool = False
    prior: float = 1e-4
    iterations: int = 15
    smoothing: bool = True
    strict_parity: bool = False
    # Overrides the threshold derived from ``prior``; used where the default would select nothing.
    min_lr: float | None = None

    def __post_init__(self) -> None:
        _require(self.max_load >= 0, "max_load must not be negative")
        _require(0.0 <= self.min_sample_fraction <= 1.0, "min_sample_fraction must lie in [0, 1]")
        _require(self.segment_size >= 10_000, "segment_size must be at least 10000")
        _require(0.0 <= self.min_rel_window_cover <= 2.0, "min_rel_window_cover must lie in [0, 2]")
        _require(self.pseudocount_fraction >= 50, "pseudocount_fraction must be at least 50")
        _require(0.0 < self.prior <= 0.9999, "prior must lie in (0, 0.9999]")
        _require(self.iterations >= 0, "iterations must not be negative")

    @property
    def min_likelihood_ratio(self) -> float:
        if self.min_lr is not None:
            return self.min_lr
        return CHI2_Q99 / 2.0 - math.log(self.prior / (1.0 - self.prior))

    @property
    def load_limit(self) -> int:
        """``max_load`` with 0 mapped to 'no limit'."""
        return self.max_load or 2**31 - 1


@dataclass(frozen=True)
class ViewParams:
    """Options of the ``view`` command."""

    header: bool = False
    only_header: bool = False
    histograms: bool = False
    out: str | None = None
    region: str | None = None
    chunk_size: int | None = None
    padding: int | None = None

    def __post_init__(self) -> None:
        for name in ("chunk_size", "padding"):
            _require(
                getattr(self, name) is None or self.out is not None,
                f"{name} is given but no output path",
            )
        _require(
            self.padding is None or self.chunk_size is not None,
            "padding is given but no chunk_size",
        )
        _require(self.padding is None or self.padding >= 0, "padding must not be negative")
        _require(self.chunk_size is None or self.chunk_size > 0, "chunk_size must be positive")
