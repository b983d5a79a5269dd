"""Spectral score of a gap sequence.

Gaps are durations, not samples at a fixed clock. They are put on an even time grid by
linear interpolation first; the strongest frequency is then compared with the median of
the others.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

SPECTRUM_TYPE = "period double, score double"
NO_PEAK = (0.0, 0.0)
MINIMUM_GAPS = 8
# Values handled at once when sequences of one length are stacked.
STACK_VALUES = 4_000_000


def peak_score(
    peak: float, background: float, frequency: float, noise: float, full: float
) -> tuple[float, float]:
    """(period, score) of a peak over its background."""
    if not background > 0 or peak < noise * background:
        return NO_PEAK
    period = 1.0 / frequency if frequency > 0 else 0.0
    score = (peak / (background + 1e-9) - noise) / (full - noise)
    return period, float(min(1.0, max(0.0, score)))


def spectrum_scores(gaps: np.ndarray, noise: float = 3.0, full: float = 10.0) -> list[tuple]:
    """(period, score) of several gap sequences of one length, a row each, in time order."""
    n = gaps.shape[1]
    clocks = np.cumsum(gaps, axis=1)
    grids = np.linspace(clocks[:, 0], clocks[:, -1], n, axis=1)
    steps = grids[:, 1] - grids[:, 0]
    even = np.stack([np.interp(g, c, x) for g, c, x in zip(grids, clocks, gaps)])
    magnitude = np.abs(np.fft.rfft(even - even.mean(axis=1, keepdims=True), axis=1))[:, 1:]
    best = magnitude.argmax(axis=1)
    rows = np.arange(len(gaps))
    peaks = magnitude[rows, best]
    rest = np.ma.array(magnitude, mask=False)
    rest[rows, best] = np.ma.masked
    background = np.ma.median(rest, axis=1).filled(0.0) if magnitude.shape[1] > 1 else peaks
    out = []
    for peak, floor, step, k in zip(peaks, background, steps, best):
        frequency = float((k + 1) / (n * step)) if step > 0 else 0.0
        found = peak_score(float(peak), float(floor), frequency, noise, full)
        out.append(found if step > 0 else NO_PEAK)
    return out


def spectrum_score(gaps: np.ndarray, noise: float = 3.0, full: float = 10.0) -> tuple[float, float]:
    """(period, score) of one gap sequence; fewer than eight gaps have none."""
    if len(gaps) < MINIMUM_GAPS:
        return NO_PEAK
    return spectrum_scores(np.asarray(gaps, dtype=float)[None, :], noise, full)[0]


def spectrum_udf(noise: float, full: float):
    """Vectorised over rows of gap arrays; a null array means the spectrum is not needed."""

    @F.pandas_udf(SPECTRUM_TYPE)
    def spectrum(arrays: pd.Series) -> pd.DataFrame:
        rows = [NO_PEAK] * len(arrays)
        by_length: dict[int, list[int]] = {}
        for i, a in enumerate(arrays):
            if a is not None and len(a) >= MINIMUM_GAPS:
                by_length.setdefault(len(a), []).append(i)
        for length, members in by_length.items():
            height = max(1, STACK_VALUES // length)
            for start in range(0, len(members), height):
                part = members[start:start + height]
                stack = np.stack([np.asarray(arrays.iloc[i], dtype=float) for i in part])
                for i, found in zip(part, spectrum_scores(stack, noise, full)):
                    rows[i] = found
        return pd.DataFrame(rows, columns=["period", "score"])

    return spectrum


# Ship this module inside the task, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
