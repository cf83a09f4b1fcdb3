import zlib

from pyspark.sql import functions as F

from headrace.llm import lang_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op8_language"](spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_odd_rows(spark):
    train = [(i, ("the cat and the dog of the house " if i % 2 else "der hund und die katze von dem haus ") * 10, "en" if i % 2 else "de") for i in range(20)]
    docs = spark.createDataFrame([*train, (98, None, "en"), (99, "the " * 100, None)], "doc_id long, text string, lang string")
    content = lang_id.dictionaries(docs, F.lit(True))
    assert set(content) == {"en", "de"}
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the cat"), (4, "the dog and the cat"), (None, "die katze und der hund"), (5, "der hund " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("language", F.lit(1)).withColumn("lang", F.lit("xx"))
    got = {r.doc_id: r.language for r in lang_id.identify(df, content).collect()}
    assert [got[i].lang for i in (1, 2, 3, 4, None, 5)] == ["und", "und", "und", "en", "de", "de"]
    assert got[1].score == 0 and got[1].rejected
    none = lang_id.dictionaries(docs.limit(0), F.lit(True))
    assert {r.language.lang for r in lang_id.identify(df, none).collect()} == {"und"}
    assert lang_id.identify(df.limit(0), content).count() == 0


def test_numbers_are_no_letters():
    content = {"de": b"der hund und die katze ", "en": b"the dog and the cat "}
    code = lang_id.Classifier(content)
    for text in ("²³", "½ ①", "Ⅷ ٣", "\u0301", "_", "中"):
        assert (code.predict(text)["lang"] == "und") == (text != "中")
    assert lang_id.fold("Über-all x² 9 e\u0301t\u00e9") == "über all x e\u0301t\u00e9"


def test_languages_with_only_short_or_long_texts_are_learned(spark):
    rows = [(i, "der hund und die katze", "de") for i in range(5)] + [(10 + i, "the dog and the cat " * 1000, "en") for i in range(3)]
    rows += [(20 + i, "le chien et le chat de la maison " * 20, "fr") for i in range(3)] + [(30, "le mot", "fr")]
    content = lang_id.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(content) == {"de", "en", "fr"}
    assert max(map(len, content.values())) <= lang_id.DICTIONARY and content["fr"].endswith(b"le mot")
    assert lang_id.Classifier(content).predict("die katze und der hund")["lang"] == "de"
