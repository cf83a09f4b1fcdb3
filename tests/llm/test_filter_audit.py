import itertools
import re
from collections import Counter

from headrace.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """docs: (doc_id, lang, text); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, lang, text in docs:
        t = text or ""
        w = WORD.findall(t)
        f = set()
        if len(w) < 100:
            f.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            f.add("C")
        if set(t) & set("#$%&*|"):
            f.add("D")
        if d is not None and any(e is not None and e < d and (u or "") == t for e, _, u in docs):
            f.add("E")
        fails.append((lang or "", f, d in good, d in toxic))
    out = set()
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        rows, share = [], Counter()
        for order in itertools.permutations("ABCDE"):
            alive = list(own)
            for i, f in enumerate(order):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                share[f] += len(gone)
                rows.append(("".join(order), i + 1, f, len(alive), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out |= {(part, o, s, k, r, d, u, g, t, share[f]) for o, s, f, k, r, d, u, g, t in rows}
    return out


def audit(spark, docs, labels, **more):
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in docs], "doc_id long, lang string, text string, mask int, d long, part long").repartition(5)
    return filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more)


def rows():
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, "en", long), (2, "en", long), (3, "de", long), (3, "de", long), (None, "de", long), (None, None, None), (4, None, ""), (5, "", None), (6, "en", None),
        (7, "en", "A B C " * 50), (8, "en", "a\tb\x0bc\x1cd $"), (9, "fr", long + " #"), (10, "fr", long.upper()), (10, "fr", "other"), (11, "en", "Ä" * 9 + "A"), (-2, "fr", "other"),
    ]
    docs += [(100 + i, "en", "copy of all") for i in range(300)] + [(500 + i, "de", f"alone {i} " + "x" * (i % 7) * 2000) for i in range(300)]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (10, 1, 0), (10, 0, 0), (150, 1, None), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_equals_brute_force(spark):
    docs, labels = rows()
    got = [tuple(r) for r in audit(spark, docs, labels).collect()]
    want = brute(docs, labels)
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_small_sketch_only_costs_work_and_large_one_is_joined(spark, monkeypatch):
    docs, labels = rows()
    want = brute(docs, labels)
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    monkeypatch.setattr(filter_audit, "SKETCH_MB", 0)
    assert {tuple(r) for r in audit(spark, docs, labels, ).collect()} == want
    rows_ = filter_audit.mask_rows(df, cells=0)
    counts = filter_audit.mask_counts(rows_, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in filter_audit.interactions(counts).collect()} == want


def test_sketch_clears_unique_texts(spark):
    docs = spark.createDataFrame([(f"t{i % 900}",) for i in range(1000)], "t string").withColumn("d", filter_audit._digest(filter_audit.F.col("t"))).repartition(7)
    merged = filter_audit.sketch(docs, "d", 3)
    seen = {r.t for r in filter_audit.possible_repeats(docs, "d", merged, 3).filter("possible").collect()}
    assert {f"t{i}" for i in range(100)} <= seen and len(seen) < 110
    assert merged.count() == 3


def test_empty(spark):
    assert audit(spark, [], []).count() == 0
    assert audit(spark, [(1, None, None)], []).count() == 600
