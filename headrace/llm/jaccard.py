"""Exact Jaccard join of word shingles by prefixes under several token orders.

Two sets with similarity t or more have at least o = ceil(t n) tokens in common
(n: the larger size). So, whatever the order of tokens, the first n - o + l tokens
of each share at least l, and for l = 1 at least one: the prefix filter. Longer
prefixes are used under a hash order, ordinary ones under an order by rarity, and
further orders inside groups; a pair is verified if it passes all of them.

Steps, all tables in the shared folder:

1. Hash order, l = n / 20: one pass over the texts packs these prefixes by token.
   Per text the tokens are counted that another text's prefix holds too; texts
   with fewer than l have no partner and leave (a passage that many texts share
   does not keep a text alive).
2. The sets of the others are stored, once for equal texts. Of their longer
   hash-order prefix (l = n / 4, half the tokens) the document frequencies are
   counted, and its tokens are ordered by them, rarest first. The prefix filter on
   that order links each token's texts to the smallest one: m texts give m - 1
   proposals. Components of the proposals are clusters.
3. Sets of a cluster meet in groups of at most two blocks of about ``BLOCK``
   tokens; a larger cluster is several blocks, and every pair of its blocks a
   group. There a pair must share prefix tokens under every order of ``ORDERS``
   and fit in length; the filters are intersected, then sets are compared. Links
   are counted, and a spanning forest of them goes on.
4. Components of the links are the classes.

Everything between texts travels as packed arrays by token bucket and is read in
pieces, so a token of any number of texts is handled in bounded memory. The only
broadcast is a bitmap of fixed size over hashes of the texts left by step 1; it
saves shuffling the others and decides nothing.

Defined cases: a text without words has an empty set and links with nothing, not
even another empty one; fewer words than a shingle are one shingle; rows with
equal ids are one document for links; a null id takes no part and gets no class;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .text import LOWER, NOT_SPACE, add_column, blocks, bounded, bytes_of, mix, runs, shingles, word_bounds, words

#: Words per shingle, similarity as a fraction.
SHINGLE, NUM, DEN = 5, 3, 4
#: Divisors of the set size that give l for the two hash-order prefixes; bits of the bitmap (log2).
FIRST_L, SECOND_L, BITMAP = 20, 4, 24
#: Tokens of a block in verification, tokens of a bucket, tokens handled at once.
BLOCK, BUCKET, PIECE = 1_000_000, 1_000_000, 1_000_000
#: Token orders inside groups: salts of the hash, and whether rare tokens go first.
ORDERS = ((0x51, True), (0xA7, True), (0xC3, False))


def shingle_sets(texts: pa.Array, q: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts one after another, set sizes)."""
    data, bounds = bytes_of(texts)
    h, start, _ = words(data, bounds, NOT_SPACE, LOWER)
    at = word_bounds(start, bounds)
    whole = shingles(h, q)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - q + 1]) if b - a >= q else shingles(h[a:b], b - a) if b > a else h[:0])
    return np.concatenate(out) if out else h[:0], np.array([x.size for x in out], np.int64)


def least_l(n: np.ndarray, divisor: int) -> np.ndarray:
    """The number of common prefix tokens a set of ``n`` wants for itself."""
    return np.maximum(n // divisor, 1)


def shared_l(n: np.ndarray, divisor: int) -> np.ndarray:
    """What it shares with any partner: the partner may be smaller and want fewer."""
    return least_l(-(-n * NUM // DEN), divisor)


def prefix_size(n: np.ndarray, l: np.ndarray | int = 1) -> np.ndarray:
    return np.where(n > 0, np.minimum(n - -(-n * NUM // DEN) + l, n), 0)


def _pack(bucket: np.ndarray, fields: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with the bytes of each field, in the order given."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(bucket) > 0))) if bucket.size else np.zeros(0, np.int64)
    ends = np.append(first[1:], bucket.size)[: first.size]
    out = [pa.array(bucket[first].astype(np.int64))]
    for v in fields.values():
        v = v[order]
        out.append(pa.array([v[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", *fields])


def _kind(fields) -> str:
    return ", ".join(["bucket long", *(f"{f} binary" for f in fields)])


def _pieces(batches, kinds: dict[str, str]):
    """(bucket, arrays) in pieces of about ``PIECE`` entries; rows come sorted by bucket."""
    now, held, size = None, [], 0
    for batch in batches:
        for b, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (b != now or size >= PIECE):
                yield now, [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
            now = b
            held.append([np.frombuffer(x, k) for x, k in zip(raw, kinds.values(), strict=True)])
            size += held[-1][0].size
    if held:
        yield now, [np.concatenate(x) for x in zip(*held, strict=True)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    if not keys[0].size:
        return np.zeros(0, np.int64)
    new = np.zeros(keys[0].size - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate(([True], new)))


def survey(docs: DataFrame) -> DataFrame:
    """Documents (d, h, m) with the size of their set, n."""
    return add_column(docs.select("d", "h", "m", "t"), "n", "long", "t", lambda b: pa.array(shingle_sets(b.column(b.schema.get_field_index("t")))[1])).drop("t")


def shared_tokens(docs: DataFrame, buckets: int) -> DataFrame:
    """(h, c): tokens of the first hash-order prefix that another text's prefix holds too (or more)."""
    bounded(docs)

    def prefixes(batches):
        for batch in batches:
            for part in blocks(batch, "t"):
                flat, n = shingle_sets(part.column(1))
                k = prefix_size(n, least_l(n, FIRST_L))
                flat, ids = flat[runs(np.cumsum(n) - n, k)], np.repeat(np.asarray(part.column(0)), k)
                # The token's low half: equal halves only count more.
                yield _pack((flat >> np.uint64(32)) % np.uint64(buckets), {"token": flat.astype(np.uint32), "id": ids})

    def count(batches):
        bucket, carry = None, None
        for b, (token, ids) in _pieces(batches, {"token": "<u4", "id": "<i8"}):
            if b != bucket:
                bucket, carry = b, (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool))
            token, ids = np.concatenate((carry[0], token)), np.concatenate((carry[1], ids))
            old = np.concatenate((carry[2], np.zeros(token.size - carry[2].size, bool)))
            order = np.lexsort((~old, ids, token))
            token, ids, old = token[order], ids[order], old[order]
            own = _starts(token, ids)
            token, ids, old = token[own], ids[own], old[own]
            first = _starts(token)
            size = np.diff(np.append(first, token.size))
            several = (size > 1) | np.logical_or.reduceat(old, first)
            who, c = np.unique(ids[np.repeat(several, size) & ~old], return_counts=True)
            carry = token[first], ids[first], several
            if who.size:
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(c.astype(np.int64))], ["h", "c"])

    packed = docs.select("h", "t").mapInArrow(prefixes, _kind(["token", "id"]))
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def sets_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(node, m, h, n, copies, tokens) of the kept texts (h, m, node, n, copies)."""
    known = kept.select(F.pmod("h", F.lit(1 << BITMAP)).alias("v")).distinct()
    packed = known.groupBy(F.shiftright("v", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(v % 64 as int)))").alias("x")).toPandas()
    full = np.zeros((1 << BITMAP) // 64, np.int64)
    full[packed["w"].to_numpy(np.int64)] = packed["x"].to_numpy(np.int64)
    box = docs.sparkSession.sparkContext.broadcast(full.view(np.uint8))
    bounded(docs)

    def run(batches):
        bits = np.unpackbits(box.value, bitorder="little").astype(bool)
        for batch in batches:
            near = bits[np.asarray(batch.column(1)) & ((1 << BITMAP) - 1)]
            few = batch.filter(pa.array(near))
            for part in blocks(few, "t"):
                flat, n = shingle_sets(part.column(3))
                ends = np.cumsum(n)
                raw = [flat[b - k : b].tobytes() for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(raw, pa.binary())], ["d", "m", "tokens"])

    found = docs.select("d", "h", "m", "t").mapInArrow(run, "d long, m string, tokens binary")
    return found.join(kept.select(F.col("node").alias("d"), "m", "h", "n", "copies"), ["d", "m"]).withColumnRenamed("d", "node")


def proposals(sets: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) between hashes of texts that share a token of the prefix by rarity; ``node`` is such a hash here."""

    def long_prefix(batch: pa.RecordBatch):
        n = np.asarray(batch.column(1))
        k = prefix_size(n, least_l(n, SECOND_L))
        flat = np.concatenate([np.frombuffer(x.as_buffer(), "<u8")[:i] for x, i in zip(batch.column(2), k.tolist(), strict=True)]) if len(n) else np.zeros(0, np.uint64)
        return flat, np.repeat(np.asarray(batch.column(0)), k), np.repeat(n, k)

    def counts(batches):
        for batch in batches:
            token, seen = np.unique(long_prefix(batch)[0], return_counts=True)
            yield _pack((token >> np.uint64(32)) % np.uint64(buckets), {"token": token, "node": seen.astype(np.int64), "n": np.zeros(token.size, np.uint32)})

    def sums(batches):
        bucket, have = None, None
        out = lambda: _pack(np.full(have[0].size, bucket), {"token": have[0], "node": have[1], "n": np.zeros(have[0].size, np.uint32)})
        for b, (token, seen, _) in _pieces(batches, {"token": "<u8", "node": "<i8", "n": "<u4"}):
            if b != bucket:
                if have is not None:
                    yield out()
                bucket, have = b, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token, of = np.unique(np.concatenate((have[0], token)), return_inverse=True)
            have = token, np.bincount(of, np.concatenate((have[1], seen)), minlength=token.size).astype(np.int64)
        if have is not None:
            yield out()

    def postings(batches):
        for batch in batches:
            flat, node, n = long_prefix(batch)
            yield _pack((flat >> np.uint64(32)) % np.uint64(buckets), {"token": flat, "node": node, "n": n.astype(np.uint32)})

    def answer(batches):
        """Frequencies come first in each bucket; each posting of a shared token is sent to its node."""
        bucket, df = None, None
        for batch in batches:
            for b, kind, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                token, node, n = (np.frombuffer(x, k) for x, k in zip(raw, ("<u8", "<i8", "<u4"), strict=True))
                if kind == 0:
                    bucket, df = b, (token, node)
                    continue
                assert b == bucket, "no frequencies for this bucket"
                f = df[1][np.searchsorted(df[0], token)]
                own = f > 1
                token, node, n, f = token[own], node[own], n[own], np.minimum(f[own], 1 << 31)
                yield _pack(mix(node.view(np.uint64)) % np.uint64(buckets), {"token": token, "node": node, "n": n, "f": f.astype(np.uint32)})

    def choose(batches):
        """The prefix by rarity of each node, packed by token again. Buckets of nodes are held whole: sets are bounded by texts."""
        held = []
        now = None

        def close():
            token, node, n, f = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((token, f, n, node))
            token, node, n = token[order], node[order], n[order].astype(np.int64)
            first = _starts(node, n)
            size = np.diff(np.append(first, node.size))
            n = n[first]
            long = prefix_size(n, least_l(n, SECOND_L))
            take = np.clip(long - shared_l(n, SECOND_L) + 1 - (long - size), 0, size)  # tokens of frequency 1 go first
            at = runs(first, take)
            yield _pack((token[at] >> np.uint64(32)) % np.uint64(buckets), {"token": token[at], "node": node[at]})

        for batch in batches:
            for b, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and b != now:
                    yield from close()
                    held = []
                now = b
                held.append([np.frombuffer(x, k) for x, k in zip(raw, ("<u8", "<i8", "<u4", "<u4"), strict=True)])
        if held:
            yield from close()

    def link(batches):
        bucket, carry = None, None
        for b, (token, node) in _pieces(batches, {"token": "<u8", "node": "<i8"}):
            if b != bucket:
                bucket, carry = b, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token, node = np.concatenate((carry[0], token)), np.concatenate((carry[1], node))
            order = np.lexsort((node, token))
            token, node = token[order], node[order]
            first = _starts(token)
            least = np.repeat(node[first], np.diff(np.append(first, token.size)))
            far = node != least
            pairs = np.unique(np.stack([node[far], least[far]], 1), axis=0)
            carry = token[first], node[first]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    own = sets.select(F.col("h").alias("node"), "n", "tokens")
    bounded(own)
    fields = _kind(["token", "node", "n"])
    deal = lambda x, *by: x.repartition(buckets, "bucket").sortWithinPartitions("bucket", *by)
    df = deal(own.mapInArrow(counts, fields)).mapInArrow(sums, fields).select("bucket", F.lit(0).alias("kind"), "token", "node", "n")
    both = df.unionByName(own.mapInArrow(postings, fields).select("bucket", F.lit(1).alias("kind"), "token", "node", "n"))
    answers = deal(both, "kind").mapInArrow(answer, _kind(["token", "node", "n", "f"]))
    chosen = deal(answers).mapInArrow(choose, _kind(["token", "node"]))
    return deal(chosen).mapInArrow(link, "a long, b long").distinct()


def verified(sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar sets on different sides (all pairs where ``sides`` is constant)."""
    size = np.array([x.size for x in sets], np.int64)
    owner = np.repeat(np.arange(size.size), size)
    token, flat = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(flat)
    order = np.argsort(flat, kind="stable")
    all_first, all_docs = np.concatenate(([0], np.cumsum(df))), owner[order]
    first = np.concatenate(([0], np.cumsum(size)))
    indexes = []
    for salt, rare in ORDERS:
        rank = mix(token ^ np.uint64(salt * 0x0101010101010101))
        by = np.lexsort((rank[flat], df[flat] if rare else np.zeros(flat.size), owner))
        own = by[runs(first[:-1], prefix_size(size))]
        t, d = flat[own], owner[own]
        o = np.argsort(t, kind="stable")
        indexes.append((np.concatenate(([0], np.cumsum(prefix_size(size)))), t, np.searchsorted(t[o], np.arange(token.size + 1)), d[o]))
    one_side = bool((sides == sides[0]).all())
    out = []
    for i in range(size.size):
        near = (size * DEN >= size[i] * NUM) & (size[i] * DEN >= size * NUM)
        near[: i + 1] = False
        if not one_side:
            near &= sides != sides[i]
        for bound, t, at, docs in indexes:
            own = t[bound[i] : bound[i + 1]]
            got = docs[runs(at[own], at[own + 1] - at[own])]
            hit = np.zeros(size.size, bool)
            hit[got] = True
            near &= hit
            if not near.any():
                break
        else:
            own = flat[first[i] : first[i + 1]]
            common = np.bincount(all_docs[runs(all_first[own], df[own])], minlength=size.size)
            linked = near & (common * DEN >= NUM * (size + size[i] - common))
            out += [(i, int(j)) for j in np.flatnonzero(linked)]
    return out


def _forest(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def links(members: DataFrame) -> DataFrame:
    """(a, b, links): per node of a group its forest root there and the documents it links with.

    ``members``: c, lo, hi (the group), block, node, copies, tokens, m; sorted by group in each partition.
    Repeated rows of a text are taken once.
    """

    def run(batches):
        key, group, seen = None, [], set()

        def close():
            # Between two blocks one of which has no set of the cluster there is nothing to compare: pairs of a block are counted in its own group.
            if len(group) < 2 or key[1] != key[2] and len({x[0] for x in group}) < 2:
                return
            node = np.array([x[1] for x in group], np.int64)
            pairs = verified([np.frombuffer(x[3], np.uint64) for x in group], np.array([x[0] for x in group]))
            if not pairs:
                return
            weight = np.zeros(len(group), np.int64)
            p = np.array(pairs)
            copies = np.array([x[2] for x in group], np.int64)
            np.add.at(weight, p[:, 0], copies[p[:, 1]])
            np.add.at(weight, p[:, 1], copies[p[:, 0]])
            root = node[_forest(len(group), pairs)]
            own = weight > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own]), pa.array(weight[own])], ["a", "b", "links"])

        for batch in batches:
            for c, lo, hi, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, lo, hi) != key:
                    yield from close()
                    key, group, seen = (c, lo, hi), [], set()
                if (rest[1], rest[4]) not in seen:
                    seen.add((rest[1], rest[4]))
                    group.append(rest)
        yield from close()

    return members.mapInArrow(run, "a long, b long, links long")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked id), n_links (documents it links with)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("d", F.xxhash64("t").alias("h"), F.md5("t").alias("m"), "t")
    known = cut_lineage(survey(rows))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(16, -(-total // (2 * BUCKET)))
    live = rows.filter("d is not null")
    shared = shared_tokens(live, buckets)
    nodes = known.filter("d is not null and n > 0").groupBy("h", "m").agg(F.min("d").alias("node"), F.max("n").alias("n"), F.count_distinct("d").alias("copies"))
    enough = F.greatest(F.floor(F.ceil(F.col("n") * NUM / DEN) / FIRST_L), F.lit(1))
    kept = cut_lineage(nodes.join(shared, "h").filter(F.col("c") >= enough).drop("c"))
    sets = cut_lineage(sets_of(live, kept))

    clusters = components(proposals(sets, buckets)).select(F.col("id").alias("h"), F.col("root").alias("c"))
    placed = cut_lineage(kept.join(clusters, "h").select("node", "m", "n", "c"))
    sizes = placed.groupBy("c").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("nb"))
    placed = placed.join(sizes, "c").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).drop("n")
    groups = sets.join(placed, ["node", "m"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    groups = groups.select("c", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "node", "copies", "tokens", "m")
    found = cut_lineage(links(groups.repartition("c", "lo", "hi").sortWithinPartitions("c", "lo", "hi")))

    classes = components(found.select("a", "b").unionByName(_same_id(known)))
    weights = found.groupBy("a").agg(F.sum("links").alias("links"))
    texts = nodes.join(classes, F.col("node") == F.col("id"), "left").join(weights, F.col("node") == F.col("a"), "left").select("h", "m", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = known.join(texts, ["h", "m"], "left")
    return out.select(
        F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("d").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("d"))).alias("component_id"),
        F.when(F.col("d").isNotNull() & (F.col("n") > 0), F.col("links")).otherwise(F.lit(0)).alias("n_links"),
    )


def _same_id(known: DataFrame) -> DataFrame:
    """Edges between the nodes of different texts under one id."""
    live = known.filter("d is not null and n > 0")
    twice = live.select("d", "h", "m").distinct().groupBy("d").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("d")
    node = live.groupBy("h", "m").agg(F.min("d").alias("a"))
    return live.select("d", "h", "m").join(twice, "d").join(node, ["h", "m"]).select("a", F.col("d").alias("b")).distinct()
