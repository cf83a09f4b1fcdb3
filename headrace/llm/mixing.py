"""Mixing sources to target weights by iterative proportional fitting, all in DataFrame functions.

Token counts are summed per cell (source, language, topic). Cell weights are
raked: each round scales them to the target shares of the sources, then of the
languages, then of the topics. A cell's factor is its raked mass over its own;
documents are kept with probability factor / largest factor, so the expected
tokens kept have the target shares without repeating a document, and a document
is kept if a uniform number made from its id is below that probability.

Targets are a table (dimension, value, share); ``tempered`` makes them from the
corpus itself. Values without a target keep no mass, targets for values that do
not occur are spread over the others of their dimension.

Only cells are raked, and a cell count is a product of dimensions, not of
documents: ``ROUNDS`` rounds are one plan of windows over that small table. Rows
meet their factor in a join that is broadcast if measured to be small and
otherwise on the cell, where adaptive execution splits large cells.

Defined cases: null source, language or topic is the value ""; a null or empty
text has no tokens and takes its cell's probability (0 for a cell without
tokens); rows with equal ids are kept or dropped together; a null id counts as
"" ; an empty table gives no rows; other columns pass through, those called like
the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rounds of raking, exponent of the shares in ``tempered`` targets, name of the draw.
ROUNDS, TEMPER, SEED = 8, 0.9, "mix"
DIMENSIONS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def topic_of(text: Column) -> Column:
    """A topic from the form of the text, for corpora without a topic column."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))
    bars = F.char_length(F.regexp_replace(t, "[^|]+", ""))
    signs = F.char_length(F.regexp_replace(t, "[^#*$%&]+", ""))
    capitals = F.char_length(F.regexp_replace(t, "[^A-Z]+", ""))
    return (
        F.when(t.contains("licensed under") | t.contains("All rights reserved"), "legal").when(50 * bars > n, "table")
        .when(25 * signs > n, "symbols").when(3 * capitals > n, "capitals").when(n < 400, "short").when(n < 4000, "medium").otherwise("long")
    )


def tempered(cells: DataFrame, power: float = TEMPER) -> DataFrame:
    """Targets from the corpus: token shares of each dimension raised to ``power`` and scaled to one."""
    rows = cells.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col("mass").alias("mass")) for d in DIMENSIONS])).alias("x")).select("x.*")
    sums = rows.groupBy("dimension", "value").agg(F.sum("mass").alias("m")).filter("m > 0")
    p = F.pow(F.col("m").cast("double"), F.lit(power))
    return sums.select("dimension", "value", (p / F.sum(p).over(Window.partitionBy("dimension"))).alias("share"))


def cells_of(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("mass"))


def rake(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``weight`` (share of tokens after raking) and ``probability``."""
    live = cells.filter("mass > 0")
    for d in DIMENSIONS:
        own = targets.filter(F.col("dimension") == d).select(F.col("value").alias(d), F.col("share").alias(f"__{d}"))
        live = live.join(own, d)
    live = live.withColumn("weight", F.col("mass").cast("double"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            live = live.withColumn("weight", F.col("weight") * F.col(f"__{d}") / F.sum("weight").over(Window.partitionBy(d)))
    total = F.sum("weight").over(Window.partitionBy())
    out = live.select(*DIMENSIONS, "mass", (F.col("weight") / total).alias("weight")).withColumn("__f", F.col("weight") / F.col("mass"))
    return out.select(*DIMENSIONS, "mass", "weight", F.round(F.col("__f") / F.max("__f").over(Window.partitionBy()), 9).alias("probability"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from a key: 13 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, targets: DataFrame | None = None, topic: str | None = None, name: str = "mix", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with a struct column ``name``: source, lang, topic, n_tokens, probability, selected."""
    named = docs.withColumn("__mix", F.struct(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(topic).cast("string"), F.lit("")).alias("topic") if topic else topic_of(F.col(text)).alias("topic"), n_tokens(F.col(text)).alias("n_tokens"),
    ))
    cells = cut_lineage(cells_of(named.select("__mix.*")))
    raked = cut_lineage(rake(cells, tempered(cells) if targets is None else targets, rounds)).select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("probability").alias("__p"))
    out = named.join(raked, [F.col(f"__mix.{d}") == F.col(f"__{d}") for d in DIMENSIONS], "left")
    p = F.coalesce(F.col("__p"), F.lit(0.0))
    return out.withColumn(name, F.struct("__mix.source", "__mix.lang", "__mix.topic", "__mix.n_tokens", p.alias("probability"), (uniform(F.col(doc_id)) < p).alias("selected"))).drop(*[f"__{d}" for d in DIMENSIONS], "__p", "__mix")


def sql(rounds: int = ROUNDS) -> str:
    """The same in SQL over ``documents`` with tempered targets; rounds are unrolled."""
    steps, last = [], "w0"
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"w{i}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (weight * s_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})")
            last = name
    count = lambda signs: f"length(regexp_replace(t, '[^{signs}]+', '', 'g'))"
    share = lambda d: f"sh_{d} AS (SELECT {d}, p / sum(p) OVER () AS s_{d} FROM (SELECT {d}, pow(CAST(sum(mass) AS DOUBLE), {TEMPER}) AS p FROM cells GROUP BY {d} HAVING sum(mass) > 0))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, greatest(length(coalesce(text, '')), 1) AS n FROM documents),
d AS (SELECT doc_id, source, lang,
    CASE WHEN contains(t, 'licensed under') OR contains(t, 'All rights reserved') THEN 'legal' WHEN 50 * {count('|')} > n THEN 'table'
         WHEN 25 * {count('#*$%&')} > n THEN 'symbols' WHEN 3 * {count('A-Z')} > n THEN 'capitals' WHEN n < 400 THEN 'short' WHEN n < 4000 THEN 'medium' ELSE 'long' END AS topic,
    len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_tokens FROM t),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS mass FROM d GROUP BY ALL),
{', '.join(share(x) for x in DIMENSIONS)},
w0 AS (SELECT source, lang, topic, mass, s_source, s_lang, s_topic, CAST(mass AS DOUBLE) AS weight FROM cells JOIN sh_source USING (source) JOIN sh_lang USING (lang) JOIN sh_topic USING (topic) WHERE mass > 0),
{', '.join(steps)},
f AS (SELECT source, lang, topic, weight / (sum(weight) OVER ()) / mass AS f FROM {last}),
p AS (SELECT source, lang, topic, round(f / max(f) OVER (), 9) AS p FROM f),
u AS (SELECT d.*, coalesce(p.p, 0) AS p, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / {float(16**13)!r} AS u FROM d LEFT JOIN p USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, u < p AS selected FROM u
"""
