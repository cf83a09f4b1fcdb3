"""Nearest rows under missing values: bounds by chunk and exact search in a chunk.

The distance of two rows is the mean squared gap over the columns both have. A
chunk is known by its box (lowest and highest value a column) and by how many of its
rows have a column, from which no row of it can be nearer than a bound, whatever
columns the target lacks.
"""

from __future__ import annotations

import numpy as np

# Targets compared at once with pivots or donors, and cells of targets by boxes.
BLOCK = 256
CELLS = 4_000_000
# Bounds and distances add up in different orders; a bound this much above still counts.
SLACK = 1e-9


def nearest_pivot(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Number of the pivot with the smallest mean squared gap over the columns both have."""
    out = np.zeros(len(v), dtype=np.int32)
    if not len(pivots):
        return out
    p_known = ~np.isnan(pivots)
    p_zero = np.nan_to_num(pivots)
    for lo in range(0, len(v), BLOCK):
        block = v[lo : lo + BLOCK]
        known = ~np.isnan(block)
        zero = np.nan_to_num(block)
        shared = known.astype(float) @ p_known.T.astype(float)
        gap = (zero**2) @ p_known.T - 2.0 * zero @ p_zero.T + known @ (p_zero**2).T
        with np.errstate(divide="ignore", invalid="ignore"):
            out[lo : lo + BLOCK] = np.argmin(np.where(shared > 0, gap / shared, np.inf), axis=1)
    return out


def lower_bounds(t: np.ndarray, low: np.ndarray, high: np.ndarray, always: np.ndarray):
    """Targets by chunks: no donor is nearer than this, and whether all donors share a column.

    Columns that every donor has are in each mean; of those that only some have,
    the ones that lower it are.
    """
    x = t[:, None, :]
    with np.errstate(invalid="ignore"):
        gap = np.maximum(np.maximum(low[None] - x, x - high[None]), 0.0) ** 2
    shared = ~np.isnan(gap)
    must = shared & always[None]
    total, n = np.where(must, gap, 0.0).sum(axis=2), must.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, total / n, np.inf)
    if not always.all():
        some = np.cumsum(np.sort(np.where(shared & ~must, gap, np.inf), axis=2), axis=2)
        with_some = (total[:, :, None] + some) / (n[:, :, None] + np.arange(1, t.shape[1] + 1))
        mean = np.minimum(mean, with_some.min(axis=2))
    return np.sqrt(mean * t.shape[1]), n > 0


def first_chunks(bound: np.ndarray, size: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """Targets by chunks: the nearest usable chunks that together hold ``k`` donors."""
    order = np.argsort(np.where(usable, bound, np.inf), axis=1, kind="stable")
    held = np.take_along_axis(np.where(usable, size[None, :], 0), order, axis=1)
    before = np.cumsum(held, axis=1) - held
    out = np.zeros(bound.shape, dtype=bool)
    np.put_along_axis(out, order, (held > 0) & (before < k), axis=1)
    return out


def visits(t: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray, size: np.ndarray, k: int, radius: np.ndarray | None = None):
    """(target, chunk) pairs of one round; ``held`` counts a chunk's rows that have a column.

    The first round (no ``radius``) goes, for each column a target lacks, to the chunks
    of smallest bound that hold ``k`` donors of it. The second has the distance of the
    k-th donor found (missing: fewer were) and goes to every other chunk that a nearer
    or equal one may be in.
    """
    always = held == size[:, None]
    step = max(1, CELLS // max(1, low.size))
    at, to = [], []
    for lo in range(0, len(t), step):
        block = t[lo : lo + step]
        bound, sure = lower_bounds(block, low, high, always)
        first, more = np.zeros(bound.shape, dtype=bool), np.zeros(bound.shape, dtype=bool)
        for c in range(t.shape[1]):
            usable = np.isnan(block[:, c])[:, None] & (held[:, c] > 0)[None, :] & np.isfinite(bound)
            if not usable.any():
                continue
            first |= first_chunks(bound, held[:, c], usable & sure, k)
            if radius is not None:
                limit = radius[lo : lo + step, c][:, None]
                more |= usable & (np.isnan(limit) | (bound <= limit * (1.0 + SLACK) + SLACK))
        r, j = np.nonzero(first if radius is None else more & ~first)
        at.append(lo + r)
        to.append(j)
    return np.concatenate(at or [np.zeros(0, int)]), np.concatenate(to or [np.zeros(0, int)])


def nearest(t: np.ndarray, d: np.ndarray, k: int):
    """Best ``k`` donors of each (target, missing column): arrays (target, column, donor, distance).

    Donors come in the order that settles ties. Only the donors up to the k-th
    distance are sorted.
    """
    width = t.shape[1]
    d_known, d_zero = ~np.isnan(d), np.nan_to_num(d)
    parts = []
    for lo in range(0, len(t), BLOCK):
        block = t[lo : lo + BLOCK]
        known = ~np.isnan(block)
        shared = known.astype(float) @ d_known.T.astype(float)
        gap = np.zeros(shared.shape)
        for c in range(width):
            both = known[:, c, None] & d_known[None, :, c]
            gap += np.where(both, (np.nan_to_num(block[:, c, None]) - d_zero[None, :, c]) ** 2, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(shared > 0, np.sqrt(gap * width / shared), np.inf)
        for c in range(width):
            rows, has = np.flatnonzero(~known[:, c]), np.flatnonzero(d_known[:, c])
            if not len(rows) or not len(has):
                continue
            near = dist[np.ix_(rows, has)]
            last = np.partition(near, k - 1, axis=1)[:, k - 1] if len(has) > k else np.full(len(rows), np.inf)
            r, j = np.nonzero((near <= last[:, None]) & np.isfinite(near))
            order = np.lexsort((near[r, j], r))
            r, j = r[order], j[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            r, j = r[rank < k], j[rank < k]
            parts.append((lo + rows[r], np.full(len(r), c), has[j], near[r, j]))
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts))
