import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from headrace.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark, monkeypatch):
    """Labelled rows that the bounded sample leaves out are predicted."""
    monkeypatch.setattr(toxicity, "SAMPLE", 1200)
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    few = toxicity.sample_labels(labels, toxicity.categories_of(labels)).select(F.col("k").alias("doc_id"))
    got = queries.QUERIES["op4_toxicity"](spark, SF).join(labels.select("doc_id", F.col("toxic").alias("label")).join(few, "doc_id", "left_anti"), "doc_id").toPandas()
    assert len(got) > 500
    # A tenth of the labels of these tables is wrong at random.
    assert (got["toxic"] == (got["label"] == 1)).mean() > 0.85


def test_chain_uses_out_of_fold_probabilities_of_earlier_categories():
    rnd = np.random.default_rng(1)
    texts, y = [], []
    for i in range(600):
        a = i % 2
        texts.append(("alpha " if a else "beta ") + " ".join(f"w{x}" for x in rnd.integers(0, 50, 5)))
        y.append((a, a if i % 10 else 1 - a))
    models = toxicity.fit_chain(pa.array(texts), np.array(y, float), np.arange(600) % 3)
    assert models[0].earlier.size == 0 and models[1].earlier.size == 1
    doc, f = toxicity.features(pa.array(["alpha x", "beta x", "", None]))
    first = models[0].score(4, doc, f, np.zeros((4, 0)))
    assert first[0] > 1 > -1 > first[1] and first[2] == first[3]
    second = models[1].score(4, doc, f, np.array([[3.0], [-3.0], [0], [0]]))
    assert models[1].earlier[0] > 0 and second[0] > second[1] + 1


def test_odd_rows(spark):
    train = [(i, ("you idiot " if i % 3 == 0 else "good day ") + f"word{i % 7}", 1, int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in train] + [(5, None, None), (None, 1, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    models = toxicity.train(docs, labels, toxicity.categories_of(labels))
    rows = [(1, None), (2, ""), (3, "idiot"), (3, "idiot"), (None, "good day"), (4, "good day " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit(1)).withColumn("toxic", F.lit(1))
    out = toxicity.score(df, models)
    got = {r.doc_id: r.toxicity for r in out.collect()}
    assert out.columns == ["doc_id", "text", "toxic", "toxicity"] and out.count() == len(rows)
    assert got[3][1] > 0.5 > got[None][1] and got[4][1] < 0.5 and got[1] == got[2]
    assert got[1][0] < 0.01  # no row has poor form
    assert toxicity.score(df.limit(0), models).count() == 0
    none = toxicity.train(docs, labels.limit(0), toxicity.categories_of(labels))
    assert all(r.toxicity[1] < 0.01 for r in toxicity.score(df, none).collect())
