"""Settings of each stage."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BuildConfig:
    filer_window_days: int = 7
    fund_window_days: int = 5
    filer_types: tuple[str, ...] = ("HF",)
    fund_types: tuple[str, ...] = ("OEF", "ETF", "CEF", "VAR")
    min_issuers: int = 20
    min_investors: int = 20
    most_concentrated: float = 0.75
    context: int = 62
    overwrite: bool = False


@dataclass(frozen=True)
class EncodeConfig:
    d: int = 64
    context: int = 62
    pooling: str = "weighted"  # or mean
    coverage: str = "first-chunk"  # or paper, all-chunks, full-sequence
    weight_scheme: str = "holdings"  # or uniform, zipf, power, exp
    weight_alpha: float = 1.0
    seed: int = 42

    @property
    def tag(self) -> str:
        """The variant's name in output paths."""
        parts = [self.pooling, self.coverage] + ([f"{self.weight_scheme}{self.weight_alpha:g}"] if self.weight_scheme != "holdings" else [])
        return "_".join(parts)


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 8
    restarts: int = 4
    min_share: float = 0.01
    least_members: int = 150
    home_threshold: float = 0.75
    seed: int = 42


@dataclass(frozen=True)
class DynamicsConfig:
    stayer: float = 0.85
    least_anchors: int = 200
    hold_out: float = 0.2
    confident: float = 0.70
    horizons: int = 10
    least_common: int = 200
