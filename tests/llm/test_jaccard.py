import random
import re

import pytest
from pyspark.sql import functions as F

from headrace.llm import components, jaccard, queries

SF = "/root/testdata/sf0.001"


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = {d: set() for d in root}
    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if a == b or 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                if a != b:
                    n[a].add(b), n[b].add(a)
    return sorted(((d, len(s), None if d is None else find(d) if s else d) for (d, _), s in zip(rows, sets, strict=True)), key=str), {d: len(x) for d, x in n.items()}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.QUERIES["op5_jaccard"](spark, SF).collect()
    want, n = brute(rows)
    assert sorted((tuple(r)[:3] for r in got), key=str) == want
    assert {r.doc_id: r.n_links for r in got} == n and sum(n.values()) > 0


@pytest.mark.parametrize("block", [1_500_000, 900])
def test_drifting_copies_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIECE", 2000)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    line = [f"common{i}" for i in range(12)]
    rows = []
    for i in range(70):  # copies of copies, with a common line here and there
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join((line if i % 3 == 0 else []) + w)))
    rows += [(100 + i, " ".join(line + [f"u{i}_{j}" for j in range(rnd.randint(1, 40))])) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "A  B"), (205, "a b c"), (206, "long " * 9000), (207, "long " * 5000), (None, "a b"), (208, "a b"), (208, rows[0][1]), (209, rows[3][1]), (209, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("h", F.lit("x")).repartition(3)
    got = jaccard.jaccard_classes(df).collect()
    want, _ = brute(rows)
    assert sorted((tuple(r)[:3] for r in got), key=str) == want
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0


def test_links_of_blocks_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 120)
    rows = []
    for i in range(10):  # two or three long near copies in two blocks or three, of which some stay empty
        w = [f"w{i}_{j}" for j in range(100)]
        rows += [(10 * i + k, " ".join([*w[: 99 - k], f"x{k}"])) for k in range(2 + i % 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_classes(df).collect()
    want, n = brute(rows)
    assert sorted((tuple(r)[:3] for r in got), key=str) == want
    assert {r.doc_id: r.n_links for r in got} == n


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300 + i, 299) for i in range(50)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in root} == root
