"""Method parameters: plain frozen values handed to the operators."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Fixed values of the method.
APW_WINDOWS = (1, 7, 15, 30, 45)
OMEGA_PRESETS = {
    "uniform": {1: 0.20, 7: 0.20, 15: 0.20, 30: 0.20, 45: 0.20},
    "leisure_tilted": {1: 0.05, 7: 0.10, 15: 0.20, 30: 0.30, 45: 0.35},
    "business_tilted": {1: 0.30, 7: 0.30, 15: 0.20, 30: 0.15, 45: 0.05},
}
MAD_TO_SIGMA = 0.6745
SIGMA_PER_MAD = 1.4826
FARE_CEILING = 90_000.0


@dataclass(frozen=True)
class Method:
    """Choices of one computation, by the step that reads them; the defaults are fixed values of the method."""
    # the series that is computed
    variant: str = "T"
    basis: str = "book"
    omega_preset: str = "uniform"
    method_version: str = "1.0.0"
    # cleaning
    apw_windows: tuple[int, ...] = APW_WINDOWS
    jump_sigma: float = 3.0
    hampel_z: float = 3.5
    tukey_k: float = 3.0
    # cells and aggregation
    n_min: int = 5
    availability_adjustment: bool = True
    smoothing: bool = True
    dow_window: int = 7
    # intervals; draws are hashes of the seed, which is this engine's own
    ci_level: float = 0.90
    bootstrap_draws: int = 500
    bootstrap_seed: int = 7
    # publication
    base_period: str | None = None
    link_factor: float | None = None
    min_omega_covered: float = 0.60

    def __post_init__(self) -> None:
        if self.basis not in ("book", "travel"):
            raise ValueError(f"basis must be book or travel, got {self.basis!r}")
        if self.variant not in ("B", "T", "A"):
            raise ValueError(f"variant must be B, T or A, got {self.variant!r}")
        if self.dow_window % 2 == 0:
            raise ValueError("the smoothing window must be odd")
        if self.link_factor is not None:
            checked_link(self.link_factor)


def checked_link(factor: float) -> float:
    value = float(factor)
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"link factor must be positive and finite, got {factor!r}")
    return value
