"""Scoring as column expressions: likelihood ratios, labels, rank correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as C


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def gaussian_llr(x: Column, parameters: tuple[float, float, float, float], limit: float) -> Column:
    mean_a, dev_a, mean_h, dev_h = parameters
    a, h = (x - mean_a) / dev_a, (x - mean_h) / dev_h
    return clamp(0.5 * (h * h - a * a) + math.log(dev_h / dev_a), -limit, limit)


def binary_llr(present: Column, parameters: tuple[float, float], limit: float) -> Column:
    p, q = parameters
    yes = max(-limit, min(limit, math.log(p / q)))
    no = max(-limit, min(limit, math.log((1 - p) / (1 - q))))
    return F.when(present, F.lit(yes)).otherwise(F.lit(no))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def prior_llr(prior: float) -> float:
    """Log odds of a prior; 0 outside (0.01, 0.99) and for one half."""
    return math.log(prior / (1 - prior)) if 0.01 < prior < 0.99 and abs(prior - 0.5) > 0.001 else 0.0


def label(p: Column) -> Column:
    return F.when(p >= C.FLAGGED, "sloppy").when(p >= C.MODERATE, "moderate").when(p >= C.MILD, "mild").otherwise("clean")


def exit_code(p: Column) -> Column:
    return F.when(p >= C.FLAGGED, 2).when(p >= C.MODERATE, 1).otherwise(0)


def within(x: Column, bounds: tuple[float, float]) -> Column:
    low, width = bounds
    return 1 - clamp((x - low) / width, 0, 1)


def regularity(entropy: Column, spread: Column, ratio: Column | None = None) -> Column:
    """Mean of the parts; the compression ratio counts only when it lies in (0, 1)."""
    h, s = within(entropy, C.ENTROPY_RANGE), within(spread, C.SPREAD_RANGE)
    if ratio is None:
        return (h + s) / 2
    r = within(ratio, C.RATIO_RANGE)
    return F.when((ratio > 0) & (ratio < 1), (r + h + s) / 3).otherwise((h + s) / 2)


def ranks(values: list[Column]) -> list[Column]:
    """Ranks from 1, ties get their mean rank."""
    out = []
    for x in values:
        less = sum((F.when(y < x, 1.0).otherwise(0.0) for y in values), F.lit(0.0))
        same = sum((F.when(y == x, 1.0).otherwise(0.0) for y in values), F.lit(0.0))
        out.append(less + (same + 1) / 2)
    return out


def spearman(values: list[Column]) -> Column:
    """Rank correlation of the values with their positions."""
    n = len(values)
    total = sum(((r - (i + 1)) * (r - (i + 1)) for i, r in enumerate(ranks(values))), F.lit(0.0))
    return 1 - 6 * total / (n * (n * n - 1))


def gradient(top_lines: Column, top_comments: Column, bottom_lines: Column, bottom_comments: Column) -> Column:
    """Whether comments thin out from the first half of a body to the second."""
    enough = (top_lines >= C.GRADIENT_LINES) & (bottom_lines >= C.GRADIENT_LINES) & (top_comments + bottom_comments >= C.GRADIENT_COMMENTS)
    top, bottom = top_comments / top_lines, bottom_comments / bottom_lines
    return F.coalesce(enough & (top / F.greatest(bottom, F.lit(0.001)) > C.GRADIENT), F.lit(False))
