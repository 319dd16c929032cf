"""Rolling values over an instrument's rows, as numpy arrays in order of date; NaN stands for NULL.

The rows run along the last axis: arrays may hold several instruments, each in a row of its own, with NaN behind its last value.

A value at a row depends on that row and earlier ones alone, to the last bit: every sum is taken in order of the rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Rows of an exponential mean that share one scale; the scale of a span of 2 and more stays inside double range.
SCALED_ROWS = 512


def back(x: np.ndarray, n: int) -> np.ndarray:
    """The value of ``n`` rows earlier (of later rows if negative)."""
    if n == 0:
        return x
    out = np.empty(x.shape)
    if n > 0:
        out[..., :n] = np.nan
        out[..., n:] = x[..., :-n]
    else:
        out[..., n:] = np.nan
        out[..., :n] = x[..., -n:]
    return out


def after(n: int, x: np.ndarray) -> np.ndarray:
    """Value only once ``n`` earlier rows exist."""
    return np.where(np.arange(x.shape[-1]) >= n, x, np.nan)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(b.shape, np.nan), where=b != 0)


def near(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the values that are there among the last ``n`` rows; NaN where none is."""
    there = ~np.isnan(x)
    value, total, count, rows = np.where(there, x, 0.0), np.zeros(x.shape), np.zeros(x.shape), x.shape[-1]
    for k in range(min(n, rows) - 1, -1, -1):
        total[..., k:] += value[..., :rows - k]
        count[..., k:] += there[..., :rows - k]
    return np.where(count > 0, total, np.nan), count


def near_best(x: np.ndarray, n: int, best=np.fmax) -> np.ndarray:
    out = x.copy()
    for k in range(1, min(n, x.shape[-1])):
        out[..., k:] = best(out[..., k:], x[..., :-k])
    return out


def stacked(x: np.ndarray, shifts, combine=np.add) -> np.ndarray:
    """The values of several rows back, combined in that order."""
    first, *rest = shifts
    out = back(x, first)
    for k in rest:
        out = combine(out, back(x, k))
    return out


def running(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(np.isnan(x), 0.0, x), axis=-1)


def span_sum(sums: np.ndarray, n: int, shift: int = 0) -> np.ndarray:
    """Sum of the ``n`` rows that end ``shift`` rows back, from running sums; complete from row n-1+shift on."""
    before = back(sums, n + shift)
    return back(sums, shift) - np.where(np.arange(sums.shape[-1]) < n + shift, 0.0, before)


@lru_cache(maxsize=None)
def _scales(span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep, steps = 1.0 - 2.0 / (span + 1.0), np.arange(SCALED_ROWS)
    return keep ** -steps, keep ** steps, keep ** (steps + 1)


def exponential_means(x: np.ndarray, spans: tuple[int, ...]) -> list[np.ndarray]:
    """y_t = (1-a) y_{t-1} + a x_t with y_0 = x_0, an array for each span: scaled running sums over blocks, and the carry."""
    given, found = np.nan_to_num(x), []
    for span in spans:
        up, down, carry = _scales(span)
        fed, out, last = (2.0 / (span + 1.0)) * given, np.empty(x.shape), np.zeros((*x.shape[:-1], 1))
        fed[..., :1] = given[..., :1]
        for start in range(0, x.shape[-1], SCALED_ROWS):
            part = fed[..., start:start + SCALED_ROWS]
            n = part.shape[-1]
            out[..., start:start + n] = down[:n] * np.cumsum(part * up[:n], axis=-1) + last * carry[:n]
            last = out[..., start + n - 1:start + n]
        found.append(out)
    return found
