import duckdb
import pytest
from pyspark.sql import functions as F

from headrace.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


COLS = ["doc_id", "source", "lang", "topic", "n_tokens", "probability", "selected"]


def sql(view):
    con = duckdb.connect()
    con.execute(f"create view documents as {view}")
    return sorted(con.execute(f"select {', '.join(COLS)} from ({mixing.sql()})").fetchall(), key=str)


def test_query_equals_sql(spark):
    got = rows(queries.QUERIES["op7_mixing"](spark, SF), *COLS)
    assert got == sql(f"select * from '{SF}/documents.parquet'")
    assert 0.4 < sum(r[-1] for r in got) / len(got) < 1


def test_margins_reach_given_targets(spark):
    cells = spark.createDataFrame([(s, l, t, (i * 37) % 11 + 1) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "uvw")], "source string, lang string, topic string, mass long")
    want = {("source", "a"): 0.6, ("source", "b"): 0.3, ("source", "c"): 0.1, ("lang", "x"): 0.5, ("lang", "y"): 0.5, ("topic", "u"): 0.2, ("topic", "v"): 0.2, ("topic", "w"): 0.6}
    targets = spark.createDataFrame([(*k, v) for k, v in want.items()], "dimension string, value string, share double")
    raked = mixing.rake(cells, targets, 20).toPandas()
    for (d, v), share in want.items():
        assert raked.loc[raked[d] == v, "weight"].sum() == pytest.approx(share, abs=1e-6)
        kept = raked["mass"] * raked["probability"]
        assert kept[raked[d] == v].sum() / kept.sum() == pytest.approx(share, abs=1e-6)
    assert raked["probability"].max() == 1


def test_odd_rows(spark, tmp_path):
    data = [(1, None, None, None), (1, None, None, None), (None, "a", "x", "one two"), (2, "a", "x", ""), (3, "b", "y", "w " * 30_000), (4, "b", None, "a | b | c"), (5, "c", "x", "##### $$"), (5, "c", "x", "##### $$")]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, text string").withColumn("mix", F.lit(1)).withColumn("topic", F.lit("t")).withColumn("probability", F.lit(2))
    df.write.parquet(str(tmp_path / "d"))
    out = mixing.mix(df)
    got = sorted((tuple(r.asDict()[c] if c == "doc_id" else r.mix[c] for c in COLS) for r in out.withColumn("mix", F.col("mix").withField("probability", F.round("mix.probability", 6))).collect()), key=str)
    assert got == sql(f"select * from '{tmp_path}/d/*.parquet'")
    assert "probability" in out.columns and out.count() == len(data)
    assert mixing.mix(df.limit(0)).count() == 0
