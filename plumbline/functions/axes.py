"""Axis ticks and bounds for plot tables: functions of a few numbers that Spark has aggregated."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

STEPS = (1.0, 1.25, 1.5, 2.0, 2.5, 5.0, 10.0)


def nice_step(low: float, high: float, target: int = 5, least: int = 0) -> float:
    """The step, of STEPS times a power of ten, for an axis with some target ticks, both ends counted.

    The power is that of the range cut into target - 1 parts. Of the steps with at least `least` ticks strictly inside, the one
    whose number of them is nearest target - 2 is taken, the smallest among equals; without any, the largest step.
    """
    if low > high or target < 2 or least < 0:
        raise ValueError("an axis has low <= high, two ticks or more, and no negative number inside")
    if low == high:
        return 1.0
    power = 10.0 ** math.floor(math.log10((high - low) / (target - 1)))
    off = {step * power: abs(n - (target - 2)) for step in STEPS if (n := len(strictly_inside(low, high, step * power))) >= least}
    return min(off, key=lambda step: (off[step], step)) if off else STEPS[-1] * power


def strictly_inside(low: float, high: float, step: float) -> list[float]:
    return [tick for tick in inner_ticks(low, high, step) if low < tick < high]


def linear_ticks(low: float, high: float, least: int = 5) -> list[float]:
    """Both ends and the ticks of nice_step between them; even parts join these where fewer than least are inside."""
    if low == high:
        return [low]
    inside = set(strictly_inside(low, high, nice_step(low, high, least + 3, least)))
    if len(inside) < least:
        inside |= {low + (high - low) * i / (least + 1) for i in range(1, least + 1)}
    return [low, *sorted(inside), high]


def inner_ticks(low: float, high: float, step: float) -> list[float]:
    first, last = math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9)
    return [i * step for i in range(first, last + 1)]


def decade_ticks(low: float, high: float) -> list[float]:
    """Powers of ten within [low, high], for positive ranges."""
    if high <= 0:
        return []
    return [10.0**p for p in range(math.ceil(math.log10(max(low, 1e-300)) - 1e-12), math.floor(math.log10(high) + 1e-12) + 1)]


def spaced(ticks: Sequence[float], forward: Callable[[float], float], low: float, high: float, least: float = 0.06) -> list[float]:
    """Ticks, from the first, that stand at least a share of the axis apart in transformed space."""
    width = forward(high) - forward(low) or 1.0
    out: list[float] = []
    for tick in sorted(set(ticks)):
        if not out or (forward(tick) - forward(out[-1])) / width >= least:
            out.append(tick)
    return out


def _farthest(kept: list[float], candidates: Sequence[float], ends: tuple[float, float], number: int, apart: float) -> list[float]:
    """kept, and of the candidates, one after the other, the one farthest from all ticks and ends, up to number and at least apart from them."""
    kept, left = list(kept), set(candidates) - set(kept)
    while left and len(kept) < number:
        room = {c: min(abs(c - other) for other in (*kept, *ends)) for c in left}
        best = min(left, key=lambda c: (-room[c], c))
        if room[best] < apart:
            break
        kept.append(best)
        left.remove(best)
    return sorted(kept)


#: Shares of the even spacing that ticks keep apart, the first with which there are enough.
LOOSER = (0.6, 0.45, 0.3, 0.15, 0.0)


def nonlinear_ticks(low: float, high: float, transform: str, quantiles: Sequence[float] = (), least: int = 5) -> list[float]:
    """Both ends of an axis in a transformed space, and at least `least` ticks between them that don't crowd there.

    Powers of ten come first (where low isn't negative), then the given quantiles of the data, then even parts, each the
    farthest from those before. If spacing leaves too few, it is loosened.
    """
    forward, back = FORWARD_AND_BACK[transform]
    a, b = forward(low), forward(high)
    if b <= a:
        return [low, high]
    decades = [forward(t) for t in decade_ticks(low, high)] if low >= 0 else []
    parts = (least + 2) * 4 - 1
    pools = [v for q in quantiles if a < (v := forward(q)) < b], [a + (b - a) * i / parts for i in range(1, parts)]
    found: list[float] = []
    for share in LOOSER:
        apart, found = (b - a) / (least + 1) * share, []
        for tick in decades:
            if all(abs(tick - other) >= apart for other in (*found, a, b)):
                found.append(tick)
        for pool in pools:
            found = _farthest(found, pool, (a, b), least, apart)
        if len(found) >= least:
            break
    return [back(t) for t in (a, *sorted(t for t in set(found) if a < t < b), b)]


#: By name what the transforms of columns do, for single numbers.
FORWARD_AND_BACK: dict[str, tuple[Callable[[float], float], Callable[[float], float]]] = {
    "linear": (float, float), "sqrt": (math.sqrt, lambda v: v * v), "cbrt": (math.cbrt, lambda v: v**3), "log1p": (math.log1p, math.expm1),
}


def metric_bounds(values: Sequence[float], lowest: float = 0.0, highest: float = 1.0, padding: float = 0.1) -> tuple[float, float]:
    """The range of values with padding, within what the metric allows; never empty."""
    low, high = min(values), max(values)
    pad = (high - low) * padding or 0.05
    return max(lowest, low - pad), min(highest, high + pad)
