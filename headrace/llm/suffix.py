"""Repeated 100-byte strings by merging Burrows-Wheeler transforms of shards.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts
earlier (smaller document id, or the same document at a smaller start).

1. Reads. The window of ``LENGTH`` bytes at a start belongs to the grams of
   ``GRAM`` bytes inside it through the one with the smallest hash; neighbouring
   starts that choose the same gram form a read (their windows' bytes). Equal
   windows choose the same gram at the same offset, so they meet in reads with
   the same gram. Reads are packed by a hash of their gram; equal reads are
   counted together at once, all but the earliest are repeats as a whole.
2. Reads of a gram that has several different reads, at most ``GROUP`` of them, are
   looked up again in the texts and meet in one group. The starts of a gram with
   more reads meet by a 128-bit digest of their window instead: the earliest of a
   digest is found by an aggregation that combines before the shuffle, so one
   passage in any number of documents, whatever its neighbours, is no group.
3. In a group, every shard of ``SHARD`` bytes gets its own suffix order and
   transform. The shards are merged by refining their interleave: one round
   sorts the suffixes stably by one more leading symbol, following the
   transforms' last-to-first maps, and notes where neighbours part. An interval
   left with one suffix is retired, and a suffix is followed only from the depth
   on at which a whole window can still grow from it. After ``LENGTH`` rounds the
   intervals left are the strings of that length that occur more than once; no
   suffix of the merged text is sorted again. The earliest start of an interval
   stays, the others are repeats.
4. Repeated starts are gathered per document and cover its bytes.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` stay; matches
never cross documents; a null id comes first; rows with equal ids are ordered by a
hash of the text that tells them apart, and equal rows are judged alike, as one
document; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import _BYTE, _STEP, blocks, bounded, bytes_of, mix, powers, runs

LENGTH, GRAM = 100, 37
#: Bytes of text handled at once, reads of a bucket, reads of a group, bytes merged at once, bytes of a shard.
PIECE, BUCKET, GROUP, MERGE, SHARD = 1 << 20, 1_000_000, 8_000, 3 << 19, 1 << 19
_SPAN = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM + 1) // 2
_LEAD = 6
_FIRST = -(1 << 63)

READ = np.dtype([("g", "<u4"), ("r", "<u8"), ("d", "<i8"), ("t", "<i8"), ("s", "<u4"), ("n", "u1"), ("p", "u1")])
_POWERS = [powers(PIECE + LENGTH + 1), powers(PIECE + LENGTH + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))]


def pieces(data: np.ndarray, bounds: np.ndarray):
    """(text, its offset, bytes): texts, or overlapping parts of longer ones, that hold whole windows."""
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for at in range(a, max(b - LENGTH + 1, a), PIECE):
            yield i, at - a, data[at : min(at + PIECE + LENGTH - 1, b)]


def _sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _POWERS[0][: data.size])))


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end)."""
    return mix((sums[end] - sums[start]) * _POWERS[1][start])


def reads_of(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, read hash, first start, number of starts, gram's offset in the read) of a text of at least ``LENGTH`` bytes."""
    sums = _sums(data)
    at = np.arange(data.size - GRAM + 1)
    gram = _hash(sums, at, at + GRAM)
    # Smallest hash of each window, the leftmost on a tie, by doubling.
    low = (gram & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= _SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < _SPAN:
        low = np.minimum(low[: -(_SPAN - width)], low[_SPAN - width :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(place) != 0)))
    n = np.diff(np.append(first, place.size))
    p = place[first]
    own = _hash(sums, first, first + n + LENGTH - 1) + mix((p - first).astype(np.uint64) * np.uint64(LENGTH) + n.astype(np.uint64))
    return gram[p], mix(own), first, n, p - first


def collect_reads(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, n, reads): packed reads of all texts, in buckets from ``buckets`` on those known to be repeats. ``docs``: d, t, text."""
    bounded(docs)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                data, bounds = bytes_of(part.column(2))
                ids, ties = (np.asarray(c) for c in part.columns[:2])
                found = []
                for i, base, piece in pieces(data, bounds):
                    g, r, s, n, p = reads_of(piece)
                    x = np.empty(g.size, READ)
                    x["g"], x["r"], x["d"], x["t"], x["s"], x["n"], x["p"] = g >> np.uint64(32), r, ids[i], ties[i], s + base, n, p
                    found.append((g % np.uint64(buckets), x))
                if not found:
                    continue
                bucket = np.concatenate([b for b, _ in found]).astype(np.int64)
                reads = np.concatenate([x for _, x in found])
                # A read that an earlier one of this block equals is a repeat already: large groups of copies shrink here.
                order = _order(reads, bucket)
                lead, same = _leads(reads[order], bucket[order])
                later = np.ones(order.size, bool)
                later[lead] = False
                own = order[later & ~same]
                bucket[own] = buckets + own % buckets
                order = np.argsort(bucket, kind="stable")
                bucket, reads = bucket[order], reads[order]
                first = np.flatnonzero(np.concatenate(([True], np.diff(bucket) > 0)))
                ends = np.append(first[1:], bucket.size)
                # Field by field: documents and starts are in order and compress well.
                rows = [b"".join(np.ascontiguousarray(reads[f][a:b]).tobytes() for f in READ.names) for a, b in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array(ends - first), pa.array(rows, pa.binary())], ["bucket", "n", "reads"])

    return docs.select("d", "t", "text").mapInArrow(run, "bucket long, n long, reads binary")


def _unpack(n: int, raw: bytes) -> np.ndarray:
    out, at = np.empty(n, READ), 0
    for f in READ.names:
        size = READ[f].itemsize * n
        out[f] = np.frombuffer(raw, READ[f], n, at)
        at += size
    return out


def _order(x: np.ndarray, bucket: np.ndarray | int = 0) -> np.ndarray:
    """By gram, content, document and start."""
    return np.lexsort((x["s"], x["t"], x["d"], x["r"], x["g"], np.broadcast_to(bucket, x.size)))


def _leads(x: np.ndarray, bucket: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the earliest read of each gram and content in ordered reads; which reads equal it in place too.

    Equal rows bring the same start twice: that is not a repeat of itself.
    """
    b = np.broadcast_to(bucket, x.size)
    new = np.ones(x.size, bool)
    new[1:] = (b[1:] != b[:-1]) | (x["g"][1:] != x["g"][:-1]) | (x["r"][1:] != x["r"][:-1])
    first = np.flatnonzero(new)
    lead = np.repeat(first, np.diff(np.append(first, x.size)))
    return first, (x["d"] == x["d"][lead]) & (x["t"] == x["t"][lead]) & (x["s"] == x["s"][lead])


def _fold(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(earliest read of each gram and content, all others)."""
    x = np.concatenate(held)
    x = x[_order(x)]
    first, same = _leads(x)
    later = ~same
    later[first] = False
    return x[first], x[later]


KIND = "g long, m int, d long, t long, s long, n int, p int"


def _rows(x: np.ndarray, m: np.ndarray | int, bucket: int = 0) -> pa.RecordBatch:
    m = np.broadcast_to(np.asarray(m, np.int32), x.size)
    g = x["g"].astype(np.int64) << 20 | bucket & 0xFFFFF
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(m), pa.array(x["d"]), pa.array(x["t"]), pa.array(x["s"].astype(np.int64)), pa.array(x["n"].astype(np.int32)), pa.array(x["p"].astype(np.int32))], ["g", "m", "d", "t", "s", "n", "p"])


def match_reads(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows of repeated reads (m = 0), of reads to compare with the others of their gram (m = 1), at most ``GROUP`` a gram, and of reads of other grams to compare window by window (m = 2)."""
    most = GROUP

    def run(batches):
        now, held, size, lead, often = None, [], 0, np.zeros(0, READ), np.zeros(0, np.uint32)

        def fold():
            nonlocal held, size, lead, often
            if held:
                new = np.concatenate(held)
                held, size = [], 0
                known = np.isin(new["g"], often)
                if known.any():
                    yield _rows(new[known], 2, now)
                lead, rest = _fold([lead, new[~known]])
                if rest.size:
                    yield _rows(rest, 0)
                g, count = np.unique(lead["g"], return_counts=True)
                if (many := g[count > most]).size:
                    # Not held any longer: a gram may have any number of different reads.
                    gone = np.isin(lead["g"], many)
                    yield _rows(lead[gone], 2, now)
                    lead, often = lead[~gone], np.concatenate((often, many))

        def close():
            yield from fold()
            if lead.size:
                _, of, count = np.unique(lead["g"], return_inverse=True, return_counts=True)
                several = count[of] > 1
                if several.any():
                    yield _rows(lead[several], 1, now)

        for batch in batches:
            for b, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b >= buckets:
                    yield _rows(_unpack(n, raw), 0)
                    continue
                if b != now:
                    if now is not None:
                        yield from close()
                    now, lead, often = b, np.zeros(0, READ), np.zeros(0, np.uint32)
                held.append(_unpack(n, raw))
                size += n
                if size >= BUCKET:
                    yield from fold()
        if now is not None:
            yield from close()

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, KIND)


def read_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (g, m, p, d, t, s, bytes): the wanted reads with their texts' bytes."""
    lists = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("g", "m", "s", "n", "p")).alias("w"))
    joined = docs.join(lists, ["d", "t"]).dropDuplicates(["d", "t"]).select("d", "t", "text", "w")
    bounded(joined)

    def run(batches):
        for batch in batches:
            for d, t, text, w in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                out = []
                for g, m, s, n, p in zip(*(w.values.field(f).to_pylist() for f in ("g", "m", "s", "n", "p")), strict=True):
                    out.append((g, m, p, s, data[s : s + n + LENGTH - 1].tobytes()))
                if out:
                    g, m, p, s, raw = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(m, pa.int32()), pa.array(p, pa.int32()), pa.array([d.as_py()] * len(g), pa.int64()), pa.array([t.as_py()] * len(g), pa.int64()),
                                                      pa.array(s, pa.int64()), pa.array(raw, pa.binary())], ["g", "m", "p", "d", "t", "s", "bytes"])

    return joined.mapInArrow(run, "g long, m int, p int, d long, t long, s long, bytes binary")


def windows_of(reads: DataFrame) -> DataFrame:
    """Rows (k, d, t, s): every start of the reads with a digest of its window."""

    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            n = np.array([len(x) - LENGTH + 1 for x in texts], np.int64)
            d, t, s = (np.asarray(c) for c in batch.columns[:3])
            keys = [hashlib.blake2b(x[i : i + LENGTH], digest_size=16).digest() for x in texts for i in range(len(x) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.repeat(d, n)), pa.array(np.repeat(t, n)), pa.array(runs(s, n))], ["k", "d", "t", "s"])

    return reads.select("d", "t", "s", "bytes").mapInArrow(run, "k binary, d long, t long, s long")


def later_windows(windows: DataFrame) -> DataFrame:
    """(d, t, s, n): the starts whose window also starts earlier. A frequent window is combined before the shuffle, and its join may be split."""
    least = windows.groupBy("k").agg(F.min(F.struct("d", "t", "s")).alias("e"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("k", "e")
    return windows.join(cut_lineage(least), "k").filter(F.struct("d", "t", "s") > F.col("e")).select("d", "t", "s", F.lit(1).alias("n"))


def transform(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix order, preceding symbols, last-to-first map) of a shard of reads.

    ``data`` has symbol 0 behind each read (at ``ends``) and bytes + 1 elsewhere;
    ends are ordered by read, so all suffixes differ. They are ordered by their
    first ``_LEAD`` symbols, then by doubling, where only ties are sorted again.
    """
    n = data.size
    last = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))  # the end of each suffix's read
    left = last - np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(_LEAD):
        key <<= 9
        key[: n - i] += np.where(left[: n - i] >= i, data[i:], 0)
    order = np.argsort(key, kind="stable")
    part = np.ones(n, bool)
    part[1:] = (np.diff(key[order]) != 0) | (left[order[1:]] < _LEAD)  # an end tells its suffix from all others
    # A rank is the place of the first of all suffixes tied so far.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(part, np.arange(n), 0))
    width = _LEAD
    tied = np.ones(n, bool)
    while True:
        alone = part.copy()
        alone[:-1] &= part[1:]
        tied &= ~alone
        slots = np.flatnonzero(tied)
        if slots.size == 0:
            break
        own = order[slots]
        ahead = own + width
        key = rank[own] * (n + 1) + np.where(ahead <= last[own], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        part[slots[1:]] = np.diff(key) != 0
        part[slots[0]] = True
        rank[own] = slots[np.maximum.accumulate(np.where(part[slots], np.arange(slots.size), 0))]
        width *= 2
    before = np.where(order > 0, data[order - 1], 0)
    # Stable order by preceding symbol gives the places of the suffixes one symbol longer.
    to = np.full(n, -1, np.int64)
    by = np.argsort(before, kind="stable")
    by = by[before[by] > 0]
    to[by] = ends.size + np.arange(by.size)
    return order, before, to


def merge(shards: list[tuple[np.ndarray, np.ndarray]], length: int | None = None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the transforms of shards (data, ends): (shard, position, interval) of the suffixes with a common prefix of ``length``.

    Round d refines the interleave of the shards from d - 1 leading symbols to d:
    suffixes are taken one symbol further left through their transform's map, and a
    stable sort by that symbol orders them. An interval of one suffix is
    retired: whatever is put before it stays alone. ``least`` tells for each suffix,
    shard after shard, the depth at which it is wanted first (a window of
    ``length`` is reached through ``length`` suffixes, each wanted at its own depth).
    """
    length = LENGTH if length is None else length
    parts = [transform(*x) for x in shards]
    sizes = np.array([x[0].size for x in parts])
    base = np.cumsum(sizes) - sizes
    order = np.concatenate([x[0] for x in parts])
    symbol = np.concatenate([x[1] for x in parts]).astype(np.uint16)
    to = np.concatenate([np.where(x[2] >= 0, x[2] + b, -1) for x, b in zip(parts, base, strict=True)]).astype(np.int32)
    shard = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    del parts
    # By no symbol yet: all suffixes are one interval, shard after shard.
    now, block = np.arange(order.size, dtype=np.int32), np.zeros(order.size, np.int32)
    depth_of = None if least is None else least[base[shard] + order]
    for depth in range(1, length + 1):
        s = symbol[now]
        ahead = np.flatnonzero((s > 0) if depth_of is None else (s > 0) & (depth_of[to[now]] <= depth))
        by = ahead[np.argsort(s[ahead], kind="stable")]
        s, was = s[by], block[by]
        part = np.ones(by.size, bool)
        part[1:] = (s[1:] != s[:-1]) | (was[1:] != was[:-1])
        alone = part.copy()
        alone[:-1] &= part[1:]
        stay = ~alone
        now, block = to[now[by[stay]]], np.cumsum(part[stay], dtype=np.int32)
        if now.size == 0:
            break
    return shard[now], order[now], block


def repeats(reads: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(d, t, start) of the starts in reads (d, t, s, bytes) whose window also starts earlier."""
    shards, owners, held, size = [], [], [], 0

    def close():
        nonlocal held, size
        if held:
            lens = np.array([len(reads[i][3]) + 1 for i in held])
            ends = np.cumsum(lens) - 1
            data = np.zeros(int(lens.sum()), np.int32)
            raw = np.frombuffer(b"".join(reads[i][3] for i in held), np.uint8).astype(np.int32) + 1
            inside = np.ones(data.size, bool)
            inside[ends] = False
            data[inside] = raw
            shards.append((data, ends))
            owners.append((np.array(held), ends - lens + 1))
            held, size = [], 0

    for i, x in enumerate(reads):
        held.append(i)
        size += len(x[3]) + 1
        if size >= SHARD:
            close()
    close()
    flat_owner = np.concatenate([np.repeat(o, np.diff(np.append(f, d.size))) for (o, f), (d, _) in zip(owners, shards, strict=True)])
    flat_offset = np.concatenate([np.arange(d.size) - np.repeat(f, np.diff(np.append(f, d.size))) for (_, f), (d, _) in zip(owners, shards, strict=True)])
    base = np.cumsum([0, *[d.size for d, _ in shards]])[:-1]
    shard, place, group = merge(shards, least=LENGTH - flat_offset)
    at = base[shard] + place
    owner, offset = flat_owner[at], flat_offset[at]
    d, t, s = (np.array([x[i] for x in reads], np.int64) for i in range(3))
    d, t, s = d[owner], t[owner], s[owner] + offset
    order = np.lexsort((s, t, d, group))
    group, d, t, s = group[order], d[order], t[order], s[order]
    later = np.zeros(group.size, bool)
    later[1:] = group[1:] == group[:-1]
    return list(zip(d[later].tolist(), t[later].tolist(), s[later].tolist(), strict=True))


def related(group: list[tuple]) -> list[tuple]:
    """Reads (p, d, t, s, bytes) of a gram that may share a window with another one.

    A window holds ``SIDE`` bytes before the gram or as many behind it, so reads
    whose bytes on both sides are theirs alone are left out.
    """
    sides = [(x[4][x[0] - SIDE : x[0]] if x[0] >= SIDE else b"", x[4][x[0] + GRAM : x[0] + GRAM + SIDE]) for x in group]
    sides = [(a, b if len(b) == SIDE else b"") for a, b in sides]
    left, right = Counter(a for a, _ in sides), Counter(b for _, b in sides)
    return [x[1:] for x, (a, b) in zip(group, sides, strict=True) if a and left[a] > 1 or b and right[b] > 1]


def compare(reads: DataFrame) -> DataFrame:
    """Repeated starts among reads of one gram, group by group; several small groups are merged at once."""

    def run(batches):
        key, group, held, size = None, [], [], 0
        for batch in batches:
            for g, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != key:
                    held += (more := related(group))
                    size += sum(len(y[3]) + 1 for y in more)
                    key, group = g, []
                    if size >= MERGE:
                        yield from _marks(repeats(held))
                        held, size = [], 0
                group.append(tuple(x))
        held += related(group)
        if len(held) > 1:
            yield from _marks(repeats(held))

    return reads.mapInArrow(run, "d long, t long, s long, n int")


def _marks(found: list[tuple[int, int, int]]):
    if found:
        d, t, s = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(s, pa.int64()), pa.array(np.ones(len(d), np.int32))], ["d", "t", "s", "n"])


def tie(seed: int, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), text)


def tied(rows: DataFrame) -> DataFrame:
    """Rows (id, d, t, text): ``t`` is a hash that differs between different texts of one id.

    Only rows that share an id can be mixed up. Their texts' 256-bit digests
    are held against the hash before it is used; should two ever meet in one
    hash, the next one is taken.
    """
    seed = 0
    while True:
        keyed = rows.withColumn("t", tie(seed, F.col("text")))
        sums = keyed.select("d", "t", F.sha2(F.encode("text", "UTF-8"), 256).alias("x")).groupBy("d", "t").agg(F.min("x").alias("a"), F.max("x").alias("b"))
        if sums.filter("a <> b").isEmpty():
            return keyed.select("id", "d", "t", "text")
        seed += 1


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans (byte ranges removed), n_bytes, n_removed, kept (remaining bytes), kept_sha256."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = tied(rows)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(16, -(-2 * total // (_SPAN + 1) // BUCKET))
    found = cut_lineage(match_reads(collect_reads(rows, buckets), buckets))
    wanted = found.filter("m > 0")
    size = wanted.filter("m = 1").agg(F.coalesce(F.sum(F.col("n") + LENGTH), F.lit(0)).alias("n")).first()["n"]
    reads = cut_lineage(read_bytes(rows, wanted))
    groups = reads.filter("m = 1").drop("m").repartition(max(16, -(-size // MERGE)), "g").sortWithinPartitions("g")
    marks = found.filter("m = 0").select("d", "t", "s", "n").unionByName(compare(groups))
    often = reads.filter("m = 2")
    if not often.isEmpty():
        marks = marks.unionByName(later_windows(windows_of(often)))
    lists = marks.groupBy("d", "t").agg(F.collect_list(F.struct("s", "n")).alias("w"))
    joined = rows.join(lists, ["d", "t"], "left").select("id", "text", "w")
    bounded(joined)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                data, bounds = bytes_of(part.column(1))
                out = []
                for i, w in enumerate(part.column(2)):
                    own = data[bounds[i] : bounds[i + 1]]
                    depth = np.zeros(own.size + 1, np.int64)
                    if w.is_valid:
                        s, n = (np.asarray(w.values.field(f)).astype(np.int64) for f in ("s", "n"))
                        np.add.at(depth, s, 1)
                        np.add.at(depth, s + n + LENGTH - 1, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                    spans = [{"first": a, "after": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                    kept = own[~gone].tobytes()
                    out.append((spans, own.size, int(gone.sum()), kept, hashlib.sha256(kept).hexdigest()))
                spans, n_bytes, n_removed, kept, sha = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)], ["doc_id", "spans", "n_bytes", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, spans array<struct<first: bigint, after: bigint>>, n_bytes long, n_removed long, kept binary, kept_sha256 string")
