"""Regression trees on binned inputs, grown level by level for many trees at once.

An ensemble is a handful of flat arrays: input, threshold, children and value of
every node, and the roots of its trees; a prediction is a base plus the values of
the leaves reached. That form is stored, joined to states and read by SQL.
"""

from __future__ import annotations

import numpy as np

#: Bins of an input, and elements of a histogram or of a walk handled at once.
BINS, CHUNK = 64, 1 << 22
ARRAYS = ["feature", "threshold", "left", "right", "value", "roots"]


def cut_points(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Thresholds per column: between neighbouring values, or between quantiles where there are many."""
    out = []
    for v in x.T:
        own = np.unique(v)
        if own.size > bins:
            own = np.unique(np.quantile(own, np.linspace(0, 1, bins), method="nearest"))
        out.append((own[1:] + own[:-1]) / 2)
    return out


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)


def grow(binned: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, w: np.ndarray, depth: int | None, leaf: int, l2: float, allowed) -> dict[str, np.ndarray]:
    """Trees for weighted rows ``w`` (trees x rows) and targets ``y`` (rows, or trees x rows).

    A split maximises the second-order gain of squared error: with sums S of
    w * y and W of w, S^2 / (W + l2) left and right less that of the node. Every
    side keeps ``leaf`` rows. ``allowed(nodes)`` lists the inputs each node may
    split on, equally many and ascending. Sums of a level are taken over rows once
    per listed input and bin.
    """
    t, n = w.shape
    bins = max(2, max((c.size for c in cuts), default=0) + 1)
    tree, row = np.nonzero(w)
    node, weight = tree.copy(), w[tree, row].astype(float)
    target = (y[row] if y.ndim == 1 else y[tree, row]) * weight
    first, count, out = 0, t, {k: [] for k in ARRAYS[:5]}
    level = 0
    while count:
        s, v = np.bincount(node, target, count), np.bincount(node, weight, count)
        rows = np.bincount(node, minlength=count)
        best, split_on, split_at = np.full(count, 1e-12), np.full(count, -1), np.zeros(count, np.int64)
        if level != depth and (rows >= 2 * leaf).any():
            may = allowed(count)
            base = s * s / (v + l2 + 1e-300)
            step = max(1, min(CHUNK // max(1, node.size), CHUNK // (count * bins)))
            for a in range(0, may.shape[1], step):
                cols = may[:, a : a + step]
                k = cols.shape[1]
                key = ((node[:, None] * k + np.arange(k)) * bins + binned[row[:, None], cols[node]]).ravel()
                sums = lambda x: np.bincount(key, x, count * k * bins).reshape(count, k, bins).cumsum(-1)[..., :-1]  # noqa: B023, E731
                sl, vl, nl = sums(np.repeat(target, k)), sums(np.repeat(weight, k)), sums(None)
                sr, vr = s[:, None, None] - sl, v[:, None, None] - vl
                gain = sl * sl / (vl + l2 + 1e-300) + sr * sr / (vr + l2 + 1e-300) - base[:, None, None]
                ok = (nl >= leaf) & (rows[:, None, None] - nl >= leaf)
                gain = np.where(ok, gain, -np.inf).reshape(count, -1)
                at = gain.argmax(1)
                found = gain[np.arange(count), at]
                # Gains that differ by rounding only are ties: the earlier input and bin wins.
                better = found > best * (1 + 1e-9) + 1e-9
                best = np.where(better, found, best)
                split_on, split_at = np.where(better, cols[np.arange(count), at // (bins - 1)], split_on), np.where(better, at % (bins - 1), split_at)
        inner = split_on >= 0
        child = first + count + 2 * (np.cumsum(inner) - 1)
        out["feature"].append(split_on)
        out["threshold"].append(np.array([cuts[i][b] if i >= 0 else 0.0 for i, b in zip(split_on.tolist(), split_at.tolist(), strict=True)]))
        out["left"].append(np.where(inner, child, -1))
        out["right"].append(np.where(inner, child + 1, -1))
        out["value"].append(np.where(inner, 0.0, s / (v + l2 + 1e-300)))
        go = inner[node]
        node, row, weight, target = node[go], row[go], weight[go], target[go]
        right = binned[row, split_on[node]] > split_at[node]
        node = child[node] - first - count + right
        first, count, level = first + count, 2 * int(inner.sum()), level + 1
    return {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()} | {"roots": np.arange(t)}


def leaves(x: np.ndarray, trees: dict[str, np.ndarray]) -> np.ndarray:
    """Sum of the leaves that rows (R x inputs) reach."""
    out = np.zeros(len(x))
    roots = trees["roots"]
    step = max(1, CHUNK // max(1, roots.size))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        node = np.broadcast_to(roots, (len(part), roots.size)).copy()
        while True:
            on = trees["feature"][node]
            go = on >= 0
            if not go.any():
                break
            value = np.take_along_axis(part, np.maximum(on, 0), axis=1)
            node = np.where(go, np.where(value <= trees["threshold"][node], trees["left"][node], trees["right"][node]), node)
        out[a : a + step] = trees["value"][node].sum(1)
    return out


def arrays_of(row) -> dict[str, np.ndarray]:
    """The arrays of a stored ensemble."""
    return {k: np.asarray(row[k], dtype=float if k in ("threshold", "value") else np.int64) for k in ARRAYS}


def joined(parts: list[dict[str, np.ndarray]], scale: float) -> dict[str, np.ndarray]:
    """Several groups of trees as one, their values times ``scale``."""
    base = np.cumsum([0, *[p["feature"].size for p in parts]])[:-1]
    shift = lambda k: np.concatenate([np.where(p[k] >= 0, p[k] + b, -1) for p, b in zip(parts, base, strict=True)])
    flat = lambda k: np.concatenate([p[k] for p in parts])
    return {"feature": flat("feature"), "threshold": flat("threshold"), "left": shift("left"), "right": shift("right"), "value": flat("value") * scale, "roots": shift("roots")}


def share_of(share, inputs: int) -> int:
    """Number of inputs a split may choose from: "sqrt" or a share."""
    return max(1, int(np.sqrt(inputs) if share == "sqrt" else float(share) * inputs))


def _some(rng, rows: int, inputs: int, k: int) -> np.ndarray:
    """``k`` of all inputs, ascending, for each row."""
    if k >= inputs:
        return np.broadcast_to(np.arange(inputs), (rows, inputs))
    return np.sort(np.argpartition(rng.random((rows, inputs)), k, axis=1)[:, :k], axis=1)


def forest(x: np.ndarray, y: np.ndarray, config, rng) -> tuple[float, dict[str, np.ndarray]]:
    """Bagged trees: (trees, depth, least leaf rows, share of inputs a split may choose from)."""
    trees, depth, leaf, share = config
    cuts, n = cut_points(x), len(y)
    binned, k, parts = to_bins(x, cuts), share_of(share, x.shape[1]), []
    step = max(1, CHUNK // (8 * max(1, n)))
    for a in range(0, trees, step):
        m = min(step, trees - a)
        w = np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(m)])
        parts.append(grow(binned, cuts, y, w, depth, leaf, 0.0, lambda nodes: _some(rng, nodes, x.shape[1], k)))
    return 0.0, joined(parts, 1.0 / trees)


def boosting(x: np.ndarray, y: np.ndarray, config, rng) -> tuple[float, dict[str, np.ndarray]]:
    """Second-order boosting of squared error: (rounds, rate, depth, row share, input share, L2)."""
    rounds, rate, depth, rows, cols, l2 = config
    cuts, n = cut_points(x), len(y)
    binned, parts, base = to_bins(x, cuts), [], float(y.mean())
    at, k = np.full(n, base), max(1, int(round(cols * x.shape[1])))
    for _ in range(rounds):
        w = np.ones((1, n)) if rows >= 1 else (rng.random(n) < rows).astype(float)[None]
        if not w.any():
            continue
        may = _some(rng, 1, x.shape[1], k)
        one = grow(binned, cuts, y - at, w, depth, 1, l2, lambda nodes: np.broadcast_to(may, (nodes, may.shape[1])))  # noqa: B023
        at = at + rate * leaves(x, one)
        parts.append(one)
    empty = {k: np.zeros(0, float if k in ("threshold", "value") else int) for k in ARRAYS}
    return base, joined(parts, rate) if parts else empty


FAMILIES = {"forest": forest, "boosting": boosting}
