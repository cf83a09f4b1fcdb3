"""Value bins of one site: every number of bins and every scale from one sort.

Rows are put in value order once, so the bins of any number are slices of the
same order, found by binary search. A slice's median, its sums of squares and
of relative errors need no copy of the rows per candidate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

# Rows by scales held at once while scoring.
STEP = 65_536


def quantile_edges(v: np.ndarray, q: int) -> np.ndarray:
    """Edges of ``q`` bins of sorted values by linear interpolation, duplicates dropped.

    Interpolated edges are rounded to nine decimals; an edge that is a reading stays it.
    """
    place = np.arange(q + 1, dtype=np.int64) * (len(v) - 1)
    lo, part = place // q, (place % q) / q
    low, high = v[lo], v[np.minimum(lo + 1, len(v) - 1)]
    between = np.round((1.0 - part) * low + part * high, 9)
    return np.unique(np.where((part == 0) | (low == high), low, between))


def slice_medians(e: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Median of each slice ``e[cut[i]:cut[i + 1]]``, from one sort by (slice, value)."""
    size = np.diff(cut)
    ranked = e[np.lexsort((e, np.repeat(np.arange(len(size)), size)))]
    return (ranked[cut[:-1] + (size - 1) // 2] + ranked[cut[:-1] + size // 2]) / 2.0


def score_scales(actual, pred, shift, top, floor, scales):
    """(squared error sums, relative error sums) of each scale; capped rows bend both."""
    square, share = np.zeros(len(scales)), np.zeros(len(scales))
    heavy = np.abs(actual) >= floor
    for lo in range(0, len(actual), STEP):
        at = slice(lo, lo + STEP)
        cand = np.clip(pred[at, None] + scales[None, :] * shift[at, None], 0.0, top)
        gap = actual[at, None] - cand
        square += (gap * gap).sum(axis=0)
        known = heavy[at]
        share += (np.abs(gap[known]) / np.abs(actual[at][known])[:, None]).sum(axis=0)
    return square, share, int(heavy.sum())


def fit_site(rows: pd.DataFrame, counts: list[int], scales: list[float], headroom: float) -> list[tuple]:
    """One row per number of bins: (q, edges, shifts by bin, and the metrics of each scale).

    Rows without a value fall into the lowest bin and have no part in the edges.
    Bins between equal edges hold no rows and have no shift.
    """
    rows = rows.sort_values("value", kind="stable", na_position="first")
    value, actual, pred = (rows[c].to_numpy(dtype=float) for c in ("value", "actual", "pred"))
    known = value[np.isnan(value).sum():]
    if not len(known):
        return []
    capacity = float(rows["capacity"].iloc[0])
    top, floor = (np.inf, 1.0) if np.isnan(capacity) else (capacity * headroom, max(1.0, 0.01 * capacity))
    gap, scale = actual - pred, np.asarray(scales, dtype=float)
    spread, n = float(((actual - actual.mean()) ** 2).sum()) if np.ptp(actual) > 0 else 0.0, len(actual)
    out = []
    for q in counts:
        edges = quantile_edges(known, q)
        inner = len(value) - len(known) + np.searchsorted(known, edges[1:-1], side="left")
        cut = np.concatenate([[0], inner, [len(value)]]).astype(np.int64)
        held = np.flatnonzero(np.diff(cut))
        ends = np.append(cut[held], len(value))
        shift = slice_medians(gap, ends)
        square, share, heavy = score_scales(actual, pred, np.repeat(shift, np.diff(ends)), top, floor, scale)
        mape = 100.0 * share / heavy if heavy else np.full(len(scale), np.nan)
        fits = 1.0 - square / spread if spread > 0 else np.where(square == 0, 1.0, 0.0)
        bins = dict(zip(held.tolist(), shift.tolist()))
        out.append((q, edges.tolist(), bins, mape.tolist(), np.sqrt(square / n).tolist(), (fits if n > 1 else np.full(len(scale), np.nan)).tolist()))
    return out
