"""Quality rules: text measures and cross-document line frequency, all in DataFrame functions.

Lines are normalised (case, white space, digits) and hashed. For every host the
documents that hold a line are counted; lines in more than ``MAX_DOCS``
documents of their host are boilerplate there and are removed, and a document
of which less than ``MIN_KEPT`` of the words stay is depleted and rejected.

Counting is by (host, line) after a distinct by (host, line, document), so the
largest host and the most frequent line are summed map-side. The list of
frequent lines is joined back on (host, line); one row a key stands against the
lines, which adaptive execution splits where a line is very frequent.

Defined cases: a null text has no words and no lines; a null host or id is a
value of its own; rows that repeat an id count as one document for their lines,
and rows with equal id, host and text share one verdict; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Most documents of a host a line may be in, least share of a document's words that must stay.
MAX_DOCS, MIN_KEPT = 30, 0.3
#: Base rules: least words, largest share (per cent) of words in repeated windows, words per window.
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8

_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)


def line_hash(line: Column) -> Column:
    """64-bit hash of a line without regard to case, white space and digits."""
    return F.xxhash64(F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, _SPACE, " "))), "[0-9]+", "0"))


def _pairs(a: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` further on."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, 1 + step, n), lambda x, y: F.xxhash64(x, y))


def window_hashes(word: Column) -> Column:
    """Hash of every window of eight words, in three doublings."""
    return let(F.transform(word, lambda w: F.xxhash64(w)), lambda h: let(_pairs(h, 1), lambda g: let(_pairs(g, 2), lambda k: _pairs(k, 4))))


def repeated_words(hashes: Column) -> Column:
    """Number of words in windows that occur twice or more."""

    def covered(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False)))
        return let(same, lambda e: let(
            F.array_sort(F.filter(F.transform(s, lambda a, j: F.when(F.get(e, j) | F.coalesce(F.get(e, j - 1), F.lit(False)), a["i"])), lambda i: i.isNotNull())),
            lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda n, x: n + x),
        ))

    ordered = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, covered)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text but with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("__w", words(F.col(text))).withColumn("__l", lines(F.col(text)))
    out = split.withColumns({
        "n_words": F.size("__w").cast("long"), "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "__g": window_hashes(F.col("__w")),
    }).drop("__w", "__l", text)
    out = out.withColumn("n_repeat_words", repeated_words(F.col("__g"))).drop("__g")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def line_verdicts(docs: DataFrame, max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per (doc_id, host, text_hash): line_words, lost_words, removed (line hashes), depleted."""
    rows = docs.select(F.col(doc_id).alias("d"), F.col(host).alias("h"), F.xxhash64(text).alias("t"), F.explode_outer(lines(F.col(text))).alias("l"))
    rows = cut_lineage(rows.select("d", "h", "t", F.when(F.col("l").isNotNull(), line_hash(F.col("l"))).alias("k"), F.coalesce(F.size(words(F.col("l"))), F.lit(0)).alias("n")))
    frequent = rows.filter("k is not null").select("h", "k", "d").distinct().groupBy("h", "k").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs)
    seen = rows.alias("r").join(frequent.alias("f"), (F.col("r.k") == F.col("f.k")) & F.col("r.h").eqNullSafe(F.col("f.h")), "left")
    lost = F.when(F.col("f.docs").isNotNull(), F.col("r.n")).otherwise(0)
    out = seen.groupBy("r.d", "r.h", "r.t").agg(
        F.sum("r.n").alias("line_words"), F.sum(lost).alias("lost_words"), F.collect_set(F.when(F.col("f.docs").isNotNull(), F.col("r.k"))).alias("removed")
    )
    depleted = F.col("line_words") - F.col("lost_words") < min_kept * F.col("line_words")
    return out.select(F.col("d").alias("doc_id"), F.col("h").alias("host"), F.col("t").alias("text_hash"), "line_words", "lost_words", "removed", depleted.alias("depleted"))


def remove_lines(docs: DataFrame, verdicts: DataFrame, name: str = "text", doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Documents that are not depleted, with frequent lines taken out of the column ``name``."""
    v = verdicts.filter(~F.col("depleted")).select(F.col("doc_id").alias("__d"), F.col("host").alias("__h"), F.col("text_hash").alias("__t"), F.col("removed").alias("__r"))
    on = docs[doc_id].eqNullSafe(F.col("__d")) & docs[host].eqNullSafe(F.col("__h")) & (F.xxhash64(docs[text]) == F.col("__t"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains("__r", line_hash(x)))
    return docs.join(v, on).withColumn(name, F.when(F.size("__r") == 0, F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__d", "__h", "__t", "__r")


def judge(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, lost_words, depleted, kept."""
    base = measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("__h"), F.xxhash64(text).alias("__t"), F.col(text).alias("text")))
    v = line_verdicts(docs, doc_id=doc_id, host=host, text=text).select(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("text_hash").alias("t"), "lost_words", "line_words", "depleted")
    out = base.join(v, base["doc_id"].eqNullSafe(v["d"]) & base["__h"].eqNullSafe(v["h"]) & (base["__t"] == v["t"]))
    # Equal rows are summed together in the verdict; each has its own share.
    share = F.when(F.col("line_words") > 0, F.expr("lost_words * n_words div line_words")).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", share.alias("lost_words"), "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


#: The same in SQL over ``documents``, with lines instead of their hashes.
SQL = f"""
WITH split AS (
  SELECT doc_id, source, text, row_number() OVER () AS r,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT r, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM split)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM wins) WHERE n > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - p, {WINDOW}))) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM twice) GROUP BY r),
ln AS (
  SELECT r, doc_id, source, k, len(list_filter(string_split_regex(k0, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT r, doc_id, source, k0, regexp_replace(lower(trim(regexp_replace(k0, '[\\x20\\x09-\\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS k
        FROM (SELECT r, doc_id, source, unnest(l) AS k0 FROM split))),
often AS (SELECT source, k FROM ln GROUP BY source, k HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
lost AS (SELECT r, sum(n) AS n FROM ln SEMI JOIN often ON ln.k = often.k AND ln.source IS NOT DISTINCT FROM often.source GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
  FROM split LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  n_words - lost_words < {MIN_KEPT} * n_words AS depleted,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND NOT (n_words - lost_words < {MIN_KEPT} * n_words) AS kept
FROM m
"""
