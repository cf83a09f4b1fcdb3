import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headrace.llm import queries, suffix

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """Rows (doc_id, order within an id, text); texts are told apart by themselves."""
    data = sorted({(suffix._FIRST if d is None else d, h, (t or "").encode()) for d, h, t in rows})
    seen, gone = set(), {}
    for d, h, b in data:
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cut[i : i + length] = True
            seen.add(w)
        gone[d, b] = cut
    out = []
    for d, h, t in rows:
        b, cut = np.frombuffer((t or "").encode(), np.uint8), gone[suffix._FIRST if d is None else d, (t or "").encode()]
        n = int((np.diff(np.concatenate(([0], cut.astype(int), [0]))) == 1).sum())
        out.append((d, b.size, int(cut.sum()), n, hashlib.sha256(b[~cut].tobytes()).hexdigest()))
    return sorted(out, key=str)


def keyed(df, seed=0):
    return [tuple(r) for r in df.select("doc_id", suffix.tie(seed, F.coalesce("text", F.lit(""))), "text").collect()]


def test_query_equals_brute_force(spark):
    got = sorted((tuple(r) for r in queries.QUERIES["op10_suffix"](spark, SF).collect()), key=str)
    assert got == brute(keyed(queries.table(spark, SF, "documents")))
    assert any(r[2] for r in got)


@pytest.mark.parametrize("small", [False, True])
def test_passages_runs_and_odd_rows(spark, monkeypatch, small):
    if small:
        for name, value in (("PIECE", 256), ("GROUP", 3), ("MERGE", 4000), ("SHARD", 600), ("BUCKET", 50)):
            monkeypatch.setattr(suffix, name, value)
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage, long = text(260), text(1500)
    rows = [(i, text(rnd.randint(0, 150)) + passage[rnd.randint(0, 60) : rnd.randint(130, 260)] + text(rnd.randint(0, 150))) for i in range(25)]
    rows += [(50, "x" * 5000), (51, "ab" * 200), (52, long), (53, long[:700] + "#" + long[701:]), (54, long[400:]), (55, None), (56, ""), (57, "y" * 99), (58, "y" * 100), (58, "y" * 100), (59, "y" * 101)]
    rows += [(None, passage), (None, passage), (60, passage), (60, "z" + passage), (61, text(300) * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit(1)).withColumn("kept", F.lit("x")).repartition(3)
    got = suffix.remove_repeats(df)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got.collect()), key=str) == brute(keyed(df))
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_one_passage_with_thousands_of_neighbours(spark, monkeypatch):
    groups, compare = [], suffix.compare

    def seen(reads):
        groups.append(reads.groupBy("g").count().agg(F.max("count")).first()[0] or 0)
        return compare(reads)

    monkeypatch.setattr(suffix, "compare", seen)
    monkeypatch.setattr(suffix, "GROUP", 40)
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcde ") for _ in range(n))
    passage, rare = text(220), text(180)
    rows = [(i, text(70) + passage + text(70)) for i in range(3000)] + [(4000 + i, text(50) + rare + text(50)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix.remove_repeats(df)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got.collect()), key=str) == brute(keyed(df))
    assert 0 < groups[0] <= 40


def test_texts_of_one_id_with_one_hash_are_told_apart(spark, monkeypatch):
    good = suffix.tie
    monkeypatch.setattr(suffix, "tie", lambda seed, text: F.lit(5).cast("long") if seed < 2 else good(seed, text))
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(256)
    rows = [(None, passage), (None, text(256)), (None, passage + "x"), (None, None), (3, text(300)), (3, passage[:150]), (3, passage[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix.remove_repeats(df).collect()), key=str)
    assert got == brute(keyed(df, 2))
    assert sum(r[2] == 0 for r in got) >= 3


def test_merge_gives_repeated_strings_in_order():
    rnd = random.Random(9)
    for length in (1, 3, 7, 12):
        reads = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))) for _ in range(30)]
        shards, names = [], []
        for part in (reads[:11], reads[11:12], reads[12:]):
            lens = np.array([len(x) + 1 for x in part])
            data = np.concatenate([np.append(np.frombuffer(x.encode(), np.uint8).astype(np.int32) + 1, 0) for x in part])
            shards.append((data, np.cumsum(lens) - 1))
            names.append("$".join(part) + "$")
        offset = np.concatenate([np.concatenate([np.arange(len(x) + 1) for x in n[:-1].split("$")]) for n in names])
        want = {}
        for k, name in enumerate(names):
            for i in range(len(name) - length + 1):
                if "$" not in (w := name[i : i + length]):
                    want.setdefault(w, []).append((k, i))
        want = {w: x for w, x in want.items() if len(x) > 1}
        for least in (None, length - offset):
            shard, place, group = suffix.merge(shards, length, least)
            got = {}
            for k, p, g in zip(shard.tolist(), place.tolist(), group.tolist(), strict=True):
                got.setdefault(g, []).append((k, p))
            strings = [{names[k][p : p + length] for k, p in x} for x in got.values()]
            assert all(len(x) == 1 for x in strings)
            assert [min(x) for x in strings] == sorted(want) and list(got) == sorted(got)
            assert {min(x): sorted(y) for x, y in zip(strings, got.values(), strict=True)} == want
