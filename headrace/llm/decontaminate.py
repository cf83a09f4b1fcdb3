"""Benchmark decontamination as a prefix-filtered containment join.

Every window of ``size`` consecutive item words (a shorter item is one window)
is a set of short word shingles. A text contains a window only if it contains
the window's rarest shingle, so that one necessary prefix token is all that is
looked up: shingles are ordered by their count over all documents, each window
is filed under its rarest shingle with the shingle's offset, and a match at word
position p proposes exactly one start, p minus that offset. Starts that leave no
room for the window (length and positional bounds) are discarded; the rest is
verified word by word over the window.

The benchmark is read in blocks of bounded size (``BLOCK_BYTES``), each block
being a broadcast index; several blocks are applied one after another to the
same rows, so any benchmark size works with the same memory.

Defined cases: a null or empty text has no words and no hits; an item without
words is ignored; repeated items count once per ``item_id``; a null item id
counts as an item named "" ; repeated document rows are judged row by row; an
empty benchmark hits nothing; all other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, LOWER, add_column, blocks, bounded, bytes_of, runs, shingles, word_bounds, words

#: Words per window, words per shingle, bytes of item text per broadcast block.
WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 8 << 20


def _words(texts: pa.Array):
    data, bounds = bytes_of(texts)
    h, start, _ = words(data, bounds, ALNUM, LOWER)
    return h, word_bounds(start, bounds)


@dataclass
class Windows:
    """Distinct windows of a block of items."""

    word: np.ndarray  # words of all windows, one after another
    first: np.ndarray  # their bounds
    item_first: np.ndarray  # bounds of the items of each window
    item: np.ndarray
    names: list[str]

    @property
    def length(self) -> np.ndarray:
        return np.diff(self.first)


def item_windows(ids: pd.Series, texts: pa.Array, size: int = WINDOW) -> Windows:
    h, bound = _words(texts)
    n = np.diff(bound)
    names = ["" if pd.isna(x) else str(x) for x in ids]
    order = {x: i for i, x in enumerate(sorted(set(names)))}
    owner = np.array([order[x] for x in names], np.int64)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    starts = runs(bound[:-1], count)
    of, length = np.repeat(owner, count), np.repeat(np.minimum(n, size), count)
    flat = h[runs(starts, length)] if starts.size else np.zeros(0, np.uint64)
    key = np.concatenate(([0], np.cumsum(length)))
    seen: dict[bytes, int] = {}
    where = np.array([seen.setdefault(flat[a:b].tobytes(), len(seen)) for a, b in zip(key[:-1], key[1:], strict=True)], np.int64)
    pairs = np.unique(np.stack([where, of], 1), axis=0) if starts.size else np.zeros((0, 2), np.int64)
    word = np.frombuffer(b"".join(seen), np.uint64)
    first = np.concatenate(([0], np.cumsum([len(k) // 8 for k in seen]))).astype(np.int64)
    return Windows(word, first, np.searchsorted(pairs[:, 0], np.arange(len(seen) + 1)), pairs[:, 1], list(order))


def window_shingles(w: Windows, q: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset, shingle hash, shingle words) of all shingles of all windows."""
    parts = []
    for k in range(1, q + 1):
        own = np.flatnonzero(w.length >= q if k == q else w.length == k)
        count = w.length[own] - k + 1
        at = runs(w.first[own], count)
        if at.size:
            h = shingles(np.concatenate((w.word, np.zeros(k, np.uint64))), k)[at]
            parts.append((np.repeat(own, count), runs(np.zeros(own.size, np.int64), count), h, np.full(at.size, k)))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def document_shingles(h: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of the k-word shingles inside each text."""
    at = runs(bound[:-1], np.maximum(np.diff(bound) - k + 1, 0))
    return shingles(h, k)[at] if at.size else np.zeros(0, np.uint64), at


def rarity(docs: DataFrame, text: str, tokens: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Occurrences over all documents of the given shingles (bounded by the items' block)."""
    bounded(docs)
    box = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches):
        total = {k: np.zeros(v.size, np.int64) for k, v in box.value.items()}
        for batch in batches:
            for part in blocks(batch, "t"):
                h, bound = _words(part.column(0))
                for k, known in box.value.items():
                    got, _ = document_shingles(h, bound, k)
                    if known.size and got.size:
                        at = np.minimum(np.searchsorted(known, got), known.size - 1)
                        total[k] += np.bincount(at[known[at] == got], minlength=known.size)
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(at.size, k), pa.int64()), "i": pa.array(at, pa.int64()), "n": pa.array(v[at], pa.int64())})

    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros(v.size, np.int64) for k, v in tokens.items()}
    for k, g in rows.groupby("k"):
        out[int(k)][g["i"].to_numpy()] = g["n"].to_numpy()
    return out


def prefix_index(w: Windows, counts: dict[int, np.ndarray], tokens: dict[int, np.ndarray]) -> dict[int, tuple]:
    """Each window filed under its rarest shingle: per shingle size (tokens, bounds, windows, offsets)."""
    win, off, h, size = window_shingles(w)
    n = np.zeros(h.size, np.int64)
    for k, known in tokens.items():
        own = size == k
        n[own] = counts[k][np.searchsorted(known, h[own])]
    order = np.lexsort((h, n, win))
    rare = order[np.concatenate(([True], np.diff(win[order]) > 0))] if order.size else order
    out = {}
    for k in tokens:
        own = rare[size[rare] == k]
        own = own[np.argsort(h[own], kind="stable")]
        token, first = np.unique(h[own], return_index=True)
        out[k] = (token, np.append(first, own.size), win[own], off[own])
    return out


def _find(h: np.ndarray, bound: np.ndarray, w: Windows, index: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(start word, window) of every verified occurrence."""
    last = np.repeat(bound[1:], np.diff(bound))  # end of the text of each word
    begin = np.repeat(bound[:-1], np.diff(bound))
    starts, found = [], []
    for k, (token, first, win, off) in index.items():
        if not token.size:
            continue
        got, at = document_shingles(h, bound, k)
        if not got.size:
            continue
        i = np.minimum(np.searchsorted(token, got), token.size - 1)
        hit = np.flatnonzero(token[i] == got)
        i, at = i[hit], at[hit]
        size = first[i + 1] - first[i]
        entry, at = runs(first[i], size), np.repeat(at, size)
        s, v = at - off[entry], win[entry]
        length = w.length[v]
        fits = (s >= begin[at]) & (s + length <= last[at])
        s, v, length = s[fits], v[fits], length[fits]
        if s.size:
            same = h[runs(s, length)] == w.word[runs(w.first[v], length)]
            exact = np.logical_and.reduceat(same, np.cumsum(length) - length)
            starts.append(s[exact])
            found.append(v[exact])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(found)


KIND = "struct<n_words: bigint, spans: array<struct<first: bigint, after: bigint>>, items: array<string>>"


def _apply(docs: DataFrame, name: str, text: str, w: Windows, index: dict[int, tuple], before: str | None) -> DataFrame:
    box = docs.sparkSession.sparkContext.broadcast((w, index))

    def run(batch: pa.RecordBatch) -> pa.Array:
        w, index = box.value
        h, bound = _words(batch.column(batch.schema.get_field_index(text)))
        s, v = _find(h, bound, w, index)
        e = s + w.length[v]
        doc = np.searchsorted(bound, s, "right") - 1
        count = w.item_first[v + 1] - w.item_first[v]
        pairs = np.stack([np.repeat(doc, count), w.item[runs(w.item_first[v], count)]], 1)
        if before:
            old = batch.column(batch.schema.get_field_index(before)).to_pylist()
            more = [(i, a["first"] + bound[i], a["after"] + bound[i]) for i, x in enumerate(old) for a in x["spans"]]
            s, e = np.append(s, [x[1] for x in more]).astype(np.int64), np.append(e, [x[2] for x in more]).astype(np.int64)
        depth = np.zeros(h.size + 1, np.int64)
        np.add.at(depth, s, 1)
        np.add.at(depth, e, -1)
        hit = np.cumsum(depth) > 0
        cut = np.zeros(h.size + 1, bool)
        cut[bound] = True
        prev = np.concatenate(([False], hit[:-1]))
        first = np.flatnonzero(hit & (~prev | cut))
        after = np.flatnonzero(prev & (~hit | cut))
        owner = np.searchsorted(bound, first, "right") - 1
        spans: dict[int, list] = {}
        for i, a, b in zip(owner.tolist(), first.tolist(), after.tolist(), strict=True):
            spans.setdefault(i, []).append({"first": a - int(bound[i]), "after": b - int(bound[i])})
        items: dict[int, set] = {}
        for i, j in np.unique(pairs, axis=0).tolist() if pairs.size else []:
            items.setdefault(i, set()).add(w.names[j])
        if before:
            for i, x in enumerate(old):
                if x["items"]:
                    items.setdefault(i, set()).update(x["items"])
        n = np.diff(bound).tolist()
        return pa.array([{"n_words": n[i], "spans": spans.get(i, []), "items": sorted(items.get(i, ()))} for i in range(len(n))],
                        pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), ("items", pa.list_(pa.string()))]))

    if before:
        docs = docs.withColumnRenamed(name, before)
    out = add_column(docs, name, KIND, text, run)
    return out.drop(before) if before else out


def benchmark_hits(docs: DataFrame, items: DataFrame, name: str = "hits", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with a struct column ``name``: number of words, hit word spans, items that occur.

    A column called ``name`` is replaced. See the module's text for nulls, ties
    and empty tables.
    """
    pairs = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = pairs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(n):
        own = pairs.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).toPandas() if n > 1 else pairs.toPandas()
        w = item_windows(own["i"], pa.array(own["t"], pa.string()), size)
        _, _, h, k = window_shingles(w)
        tokens = {int(x): np.unique(h[k == x]) for x in np.unique(k)}
        index = prefix_index(w, rarity(docs, text, tokens), tokens) if tokens else {}
        docs = _apply(docs, name, text, w, index, f"{name}__before" if b else None)
    return docs


def n_hit(hits: Column | str) -> Column:
    """Number of hit words."""
    hits = F.col(hits) if isinstance(hits, str) else hits
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda a, x: a + x["after"] - x["first"])
