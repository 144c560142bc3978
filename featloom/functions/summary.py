"""Per-feature statistics and the decisions taken from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Fixed values of the validity rule.
FLOAT32_MAX = 3.4028234663852886e38
NEAR_ZERO = 1e-4
NEAR_ZERO_SHARE = 0.8


@dataclass(frozen=True)
class FeatureStats:
    """Counts over all rows, moments over the non-null ones."""

    rows: int
    nulls: int
    zeros: int
    near_zeros: int
    mean: float
    m2: float
    lo: float
    hi: float

    @property
    def std(self) -> float:
        """Population standard deviation."""
        n = self.rows - self.nulls
        return math.sqrt(max(self.m2, 0.0) / n) if n else 0.0

    @property
    def all_zero(self) -> bool:
        return self.zeros + self.nulls == self.rows

    @property
    def valid(self) -> bool:
        """No missing value, within float32, at most four fifths nearly zero."""
        return (
            self.rows > 0
            and self.nulls == 0
            and self.hi <= FLOAT32_MAX
            and self.lo >= -FLOAT32_MAX
            and self.near_zeros <= NEAR_ZERO_SHARE * self.rows
        )
