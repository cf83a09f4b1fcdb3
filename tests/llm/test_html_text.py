import html
import re
import time

from pyspark.sql import functions as F

from headrace.llm import html_text, queries

SF = "/root/testdata/sf0.001"


def test_query_equals_article_text(spark):
    rows = queries.table(spark, SF, "pages").collect()
    want = {}
    for r in rows:
        m = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[1])).split()) if m else ""
    got = queries.QUERIES["op9_html"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


LONG = "It was the best of the times and it was the worst of the times for all of us in the end"


def test_rules():
    t = html_text.main_text
    assert t(None) == "" and t("") == "" and t("<p>") == ""
    assert t(f"<body><p>{LONG}</p><p>short</p></body>") == f"{LONG} short"
    assert t(f"<body><p>short</p><div class='sidebar'><p>{LONG}</p></div></body>") == ""
    assert t(f"<article><h1>Ti&amp;tle</h1><p>a<b>b</b> c&nbsp;d<br>e<p>f</article><footer>{LONG}</footer>") == "Ti&tle ab c d e f"
    assert t(f"<main><script>var x='<p>{LONG}</p>'</script><!-- <p>no --><p>yes</main>") == "yes"
    assert t(f"<article><p>body</p><section id=comments><p>{LONG}</p></section><form><p>mail</form></article>") == "body"
    assert t(f"<div><p>{LONG}</p><ul><li><a href=x>One link</a><li><a href=y>More links</a></ul></div>") == LONG
    assert t("<article><p>cut off <b>here") == "cut off here"
    assert t("<article><p>a &lt;b&gt; &#233;&#x6f22; &amp;amp;</p></article>") == "a <b> é漢 &amp;"
    assert t("<article>x<script>never ends <p>y") == "x"


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article>x</article>"), (3, "u", "<p>" * 20_000), (4, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "url", "html", "text"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, "x"), (1, ""), (1, ""), (3, ""), (4, "")]
    assert html_text.extract_text(df.limit(0)).count() == 0


RU = "Это длинный абзац русского текста который содержит много слов и не имеет никаких ссылок внутри себя вообще совсем"


def test_pages_without_known_stop_words():
    t = html_text.main_text
    assert t(f"<body><nav><a href=x>{RU}</a></nav><p>{RU}</p><p>кратко</p><footer>{RU}</footer></body>") == f"{RU} кратко"
    assert t(f"<div><p>{RU}</p><p><a href=x>{RU}</a></p><p>{'长' * 60}</p></div>") == f"{RU} {'长' * 60}"
    # Stop words found: a long block without them is undecided and follows its neighbour.
    assert t(f"<div><p>{LONG}</p><div class=ad>{RU}</div></div>") == LONG


def test_no_text_is_lost():
    t = html_text.main_text
    # Characters that lower() lengthens before a script.
    assert t(f"<article><p>{'İ' * 20}</p><SCRIPT>var x = 1</Script ><p>next paragraph</p></article>") == f"{'İ' * 20} next paragraph"
    # Quotes inside an unquoted value, beside a name, or around '>'.
    assert t("<article><p title=it's>one</p><p data-x=a\"b>two</p><p ' class=\"x > y\">three</p><p title='a\"b>c'>four</p>") == "one two three four"
    assert t("<article>5 < 6 &lt; 7<p>x</article>") == "5 < 6 < 7 x"


def test_deep_nesting_is_linear():
    n = 60_000
    for page in ("<span>" * n + "</b>" * n, "<b>" * n + "<article>" + "<i>" * n + "</b>" * n, "<p>" * n, "<div><p>" * n, "<a b=\"" * n, "<ul><li>" * n + "</p>" * n, "<table><tr><td>" * n):
        start = time.time()
        html_text.main_text(page + "<article>x")
        assert time.time() - start < 20
