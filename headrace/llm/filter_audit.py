"""Interaction of document filters: what each removes in every order, and its share over all orders.

Four filters look at one text, the fifth (``E``) at the whole table: a text that
a smaller id has too. Finding those must not shuffle every text, so a counting
Bloom prepass comes first:

1. one scan turns each document into a small row: id, part, a mask with a bit per
   failing filter, and the 128-bit digest of its text;
2. every task counts digests in the cells of a counting Bloom sketch (counters
   end at 2, "twice or more"); partial sketches are added block by block;
3. a text with a cell that was hit once is guaranteed unique and cleared. Only
   the others, possible repeats, are shuffled with their full text, where equal
   texts meet in a map-side ``min`` of the id;
4. the rows (id, digest) of these minima tell the first copy from the later ones;
   bits then add up to counts per (part, mask), from which all 120 orders follow.

The sketch has ``CELLS`` counters a document in blocks of 65,536 and so grows with
the table. Its size is known before it is used: up to ``SKETCH_MB`` it is sent to
every executor, beyond that it is joined by block. Rows are joined on their own
id and digest, so no group of copies, however large, meets in one task.

Defined cases: a null text is empty; a null part is the empty string; a null id
is no smaller id and has none, so its row never fails ``E`` and has no label;
rows that repeat an id are documents of their own, of which those with the
smallest id of their text pass; a labelled id that is repeated counts by its
largest labels; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quality import let
from .text import bounded

FILTERS = "ABCDE"
#: Least words, least share (per cent) of distinct words, largest share of capital letters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
#: Counters per document, counters per block, counters hit per document, largest sketch sent to executors.
CELLS, BLOCK, HITS, SKETCH_MB = 16, 1 << 16, 4, 64


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (short), B (few distinct words), C (capitals), D (symbols)."""
    bit = lambda c, i: F.when(c, F.lit(1 << i)).otherwise(0)

    def of(word: Column) -> Column:
        n = F.size(word)
        return bit(n < MIN_WORDS, 0) + bit(100 * F.size(F.array_distinct(word)) < MIN_DISTINCT * n, 1)

    word = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return let(word, of) + bit(100 * capitals > MAX_CAPITALS * F.char_length(text), 2) + bit(text.rlike(SYMBOLS), 3)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks)).cast("int")


def sketch(digests: DataFrame, digest: str, blocks: int) -> DataFrame:
    """The merged counting sketch: block, twice (1,024 longs: a bit per counter that reached 2)."""
    keys = digests.select(_block(F.col(digest), blocks).alias("block"), F.xxhash64(F.lit(1), digest).alias("cells"))

    def partial(batches):
        held, size = [], 0

        def flush():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            for own in np.split(np.arange(at.size), np.flatnonzero(np.diff(at >> 16)) + 1):
                yield int(at[own[0]] >> 16), (at[own] & (BLOCK - 1)).astype("<u2").tobytes(), np.minimum(n[own], 2).astype(np.uint8).tobytes()

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "at", "n"])

        for batch in batches:
            block, cells = (c.to_numpy() for c in batch.columns)
            for i in range(HITS):
                held.append((block.astype(np.int64) << 16) | ((cells >> (16 * i)) & (BLOCK - 1)))
            size += HITS * block.size
            if size > 1 << 20:
                yield out(list(flush()))
                held, size = [], 0
        if size:
            yield out(list(flush()))

    def merge(batches):
        block, sums = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(sums > 1, bitorder="little").view("<i8")])], ["block", "twice"])

        for batch in batches:
            for b, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if block is not None:
                        yield out()
                    block, sums = b, np.zeros(BLOCK, np.uint8)
                at = np.frombuffer(at, "<u2")
                sums[at] = np.minimum(sums[at] + np.frombuffer(n, np.uint8), 2)
        if block is not None:
            yield out()

    parts = keys.mapInArrow(partial, "block int, at binary, n binary")
    return cut_lineage(parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, twice array<long>"))


def possible_repeats(rows: DataFrame, digest: str, merged: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``possible``: whether every counter of the digest reached 2. Rows of other blocks are not lost."""
    side = F.broadcast(merged) if blocks * (BLOCK // 8) <= SKETCH_MB << 20 else merged
    spots = [f"cast(shiftrightunsigned(cells, {16 * i}) & {BLOCK - 1} as int)" for i in range(HITS)]
    hit = F.expr(" and ".join(f"(shiftright(get(twice, {p} div 64), {p} % 64) & 1) = 1" for p in spots))
    keyed = rows.withColumn("block", _block(F.col(digest), blocks)).withColumn("cells", F.xxhash64(F.lit(1), F.col(digest)))
    return keyed.join(side, "block", "left").withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", "cells", "twice")


def mask_rows(docs: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per input row: doc_id, part, mask (bits 0 to 4 for A to E)."""
    bounded(docs)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(t).alias("mask"), _digest(t).alias("d")))
    blocks = max(1, math.ceil(rows.count() * cells / BLOCK))
    merged = sketch(rows, "d", blocks)
    texts = possible_repeats(docs.select(F.col(doc_id).alias("doc_id"), t.alias("t")).withColumn("d", _digest(F.col("t"))), "d", merged, blocks)
    firsts = texts.filter("possible").groupBy("t").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    firsts = firsts.select("doc_id", _digest(F.col("t")).alias("d"), F.lit(True).alias("first"))
    marked = possible_repeats(rows, "d", merged, blocks)
    later = marked.filter("possible").join(firsts, ["doc_id", "d"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0))
    return marked.filter("not possible").select("doc_id", "part", "mask").unionByName(later.select("doc_id", "part", "mask"))


def mask_counts(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Additive counts per (part, mask): n, good (quality 1), toxic (toxic 1)."""
    same = rows.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(flag("quality"), flag("toxic"))
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return same.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """Per part, each of the 120 orders and its steps: what the step keeps and removes, and the filter's share."""
    cells, orders = [], []
    for f in range(5):
        rest = [x for x in range(5) if x != f]
        for k in range(5):
            for s in itertools.combinations(rest, k):
                cells.append((sum(1 << x for x in s), 1 << f, math.factorial(k) * math.factorial(4 - k)))
    for order in itertools.permutations(range(5)):
        for i, f in enumerate(order):
            orders.append((sum(1 << x for x in order[:i]), 1 << f, "".join(FILTERS[x] for x in order), i + 1))
    cell = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, ("before", "own", "weight"), strict=True)]) for c in cells]))
    has, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, of, name: F.sum(F.when(when, F.col(of)).otherwise(F.lit(0).cast("long"))).alias(name)
    step = counts.select("*", cell.alias("c")).select("part", "mask", "n", "good", "toxic", "c.*").groupBy("part", "before", "own", "weight").agg(
        total(~has & ~earlier, "n", "kept"), total(has & ~earlier, "n", "removed"), total(has & earlier, "n", "redundant"),
        total(F.col("mask") == F.col("own"), "n", "unique_fails"), total(has & ~earlier, "good", "good_lost"), total(has & ~earlier, "toxic", "toxic_lost"),
    )
    step = step.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "own")))
    runs = counts.sparkSession.createDataFrame(orders, "before int, own int, filter_order string, step int")
    return step.join(F.broadcast(runs), ["before", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    return interactions(cut_lineage(mask_counts(mask_rows(docs, doc_id, part, text), labels)))


#: The same in SQL over ``documents`` and ``labels``.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
m AS (
  SELECT doc_id, part, t,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, b)),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS bef FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | bef) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & bef = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & bef <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & bef = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & bef = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
