import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from headrace.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - size + 1, 1 if w else 0)):
            wins.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    lengths = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op6_decontaminate"](spark, SF).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_small_cases(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rnd = random.Random(3)
    voc = ["a", "B", "é", "x1", "zz", "漢字"]
    text = lambda n: rnd.choice(" ,.\n\x1f").join(rnd.choice(voc) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for i in range(40)] + [(3, text(12)), (None, "only here"), (99, None)]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)] + [(7, "only here"), (7, "only here"), (None, "x only here"), (8, None), (9, ""), (10, text(3000))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("mine")).withColumn("n_words", F.lit(1))
    h = decontaminate.benchmark_hits(d, spark.createDataFrame(items, "item_id long, text string"))
    assert h.columns == ["doc_id", "text", "n_words", "hits"]
    got = sorted(((r.doc_id, r.hits.n_words, sum(s.after - s["first"] for s in r.hits.spans), len(r.hits["items"]),
                   hashlib.sha256(",".join(r.hits["items"]).encode()).hexdigest(), bool(r.hits.spans)) for r in h.collect()), key=str)
    assert got == brute(docs, items)
    none = decontaminate.benchmark_hits(d, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter(F.size("hits.spans") > 0).count() == 0 and none.count() == len(docs)
    assert decontaminate.benchmark_hits(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
