"""Parameters of an analysis, checked like those of the command line."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: A nucleosome's core in bases, the half of it, and limits of the scoring; fixed values.
CORE = 147
HALF = 73
WEIGHT_FLOOR = 0.01
SCORE_CAP = 100.0


@dataclass(frozen=True)
class Params:
    """``flat_policy``: what a dyad with a zero sum of differences scores. ``observed``: 0 unless it is a local minimum;
    ``literal``: always the cap. ``tilt_phase`` is added to the twist where tilt is applied, in half turns."""

    curve_step: int = 15
    curve_scale: float = 0.33335
    curve_step_one: int = 6
    curve_step_two: int = 4
    symmetry_win: int = 101
    symmetry_step: int = 1
    min_linker_size: int = 30
    flat_policy: str = "observed"
    bounds: str = "legacy"
    tilt_phase: float = -0.5

    def __post_init__(self):
        for name in ("curve_step", "curve_step_one", "curve_step_two", "symmetry_win", "symmetry_step", "min_linker_size"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= 65535:
                raise ValueError(f"invalid value {value!r} for {name}: an integer from 1 to 65535 is expected")
        if self.curve_step_one < 2:
            raise ValueError("curve_step_one must be 2 at least, as the half width of the mean is one less")
        if isinstance(self.curve_scale, bool) or not isinstance(self.curve_scale, (int, float)) or not 0 <= self.curve_scale <= 1 or math.isnan(self.curve_scale):
            raise ValueError(f"invalid value {self.curve_scale!r} for curve_scale: a number from 0 to 1 is expected")
        for name, known in (("flat_policy", ("observed", "literal")), ("bounds", ("legacy", "full"))):
            if getattr(self, name) not in known:
                raise ValueError(f"invalid value {getattr(self, name)!r} for {name}: one of {', '.join(known)} is expected")

    @property
    def half_mean(self) -> int:
        """Half width of the moving mean."""
        return self.curve_step_one - 1

    @property
    def reach(self) -> int:
        """From a base to the outermost coordinate that its curvature depends on."""
        return self.half_mean + self.curve_step

    @property
    def half_window(self) -> int:
        """Bases on each side that symmetry compares."""
        return self.symmetry_win // 2

    @property
    def spacing(self) -> int:
        """Dyads at this distance or less exclude each other."""
        return self.min_linker_size + CORE


DEFAULT = Params()
