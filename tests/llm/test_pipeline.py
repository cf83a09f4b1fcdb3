import os
import sys

import public_tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from headrace.llm import mixing, queries  # noqa: E402

from . import test_decontaminate, test_jaccard, test_mixing, test_tokens  # noqa: E402

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_equal_brute_force(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    toxic = {r.doc_id for r in queries.QUERIES["op4_toxicity"](spark, SF).filter("toxic").collect()}
    assert ids(clean) == [i for i in ids(docs) if i not in toxic] and clean.columns == docs.columns
    for name, (_, stage) in zip("abcd", corpus_pipeline.STAGES[:-1], strict=True):
        before = docs
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "b":
            want, _ = test_jaccard.brute(rows)
            assert ids(docs) == sorted(d for d, _, c in want if d == c) and len(want) > docs.count()
        if name == "c":
            items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
            assert ids(docs) == sorted(r[0] for r in test_decontaminate.brute(rows, items) if not r[-1])
        if name == "d":
            want = test_mixing.sql(f"select * from '{tmp_path}/c/*.parquet'")
            assert ids(docs) == sorted(r[0] for r in want if r[-1])
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).collect())
    assert got == test_tokens.want(rows) and got


def test_odd_rows_pass_every_stage(spark):
    a = " ".join(f"w{i}" for i in range(50))
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, None, None, None, None), (None, a, "en", "s", 1), (None, "other words", None, None, None), (3, "", "en", "s", 0), (4, "x " * 20_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("mix", F.lit(1)).withColumn("tokens", F.lit("z"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        n = out.count()
        assert n <= len(rows)
        if name == "near_copies":
            assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 1, 2, 3, 4]
        if name == "token_ids":
            assert n == len(rows)
        else:
            assert out.columns == docs.columns
