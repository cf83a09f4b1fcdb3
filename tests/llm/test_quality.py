import duckdb
import pytest
from pyspark.sql import functions as F

from headrace.llm import quality, queries

SF = "/root/testdata/sf0.001"


def sql(view):
    con = duckdb.connect()
    con.execute(f"create view documents as {view}")
    cur = con.execute(quality.SQL)
    names = [x[0] for x in cur.description]
    return sorted(([dict(zip(names, r, strict=True)) for r in cur.fetchall()]), key=lambda r: str(sorted(r.items())))


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(sorted(r.items())))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    assert rows(queries.QUERIES["op1_quality"](spark, sf)) == sql(f"select * from '{sf}/documents.parquet'")


def test_odd_rows(spark, tmp_path, monkeypatch):
    a = " ".join(f"w{i}" for i in range(30))
    text = [None, "", " \n\t", a, a + "\n" + a, "a b " * 40, "x\x1cy # <é>", "Head  LINE 12\n" + a, "head line 7\n" + a + " z", "head line 1\nq", ("k " * 9 + "\n") * 3000]
    data = [(i, f"s{i % 2}", t) for i, t in enumerate(text)] + [(3, "s1", a), (None, None, a), (None, "s0", "head line 3\n"), (50, None, "head line 3\n" + a)] + [(100 + i, "s1", f"Head line {i}\nbody {chr(97 + i % 26) * (1 + i // 26)} " + a) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("n_words", F.lit("x")).withColumn("h", F.lit(1))
    df.write.parquet(str(tmp_path / "d"))
    got = rows(quality.judge(df))
    assert got == sql(f"select * from '{tmp_path}/d/*.parquet'")
    assert any(r["depleted"] for r in got) and sum(r["lost_words"] > 0 for r in got) >= 40
    assert quality.judge(df.limit(0)).count() == 0
    clean = quality.remove_lines(df, quality.line_verdicts(df))
    by = {r.doc_id: r.text for r in clean.collect() if r.doc_id is not None}
    assert by[105] == f"body f {a}" and 9 not in by and by[50] == "head line 3\n" + a
