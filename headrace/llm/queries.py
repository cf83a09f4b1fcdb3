"""The registered query of each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, html_text, jaccard, lang_id, mixing, quality, secret_scan, suffix, tokens, toxicity, turn_repair

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE["op1_quality"] = quality.SQL


@query
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.token_output(docs, public_tokenizers.path(BPE))


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    file = public_tokenizers.path(BPE)
    return chat.chat_digests(chat.format_chats(rows.unionByName(extra), file), file)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    names = toxicity.categories_of(labels)
    scored = toxicity.score(docs, toxicity.train(docs, labels, names))
    p = {n: F.col("toxicity")[i] for i, n in enumerate(names)}
    return scored.select("doc_id", *[x.alias(f"p_{n}") for n, x in p.items()], (p["toxic"] >= toxicity.REJECT).alias("toxic"), (p["toxic"] < toxicity.REJECT).alias("kept"))


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit("hits")
    return hits.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hits.items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return mixed.select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", F.round("mix.probability", 6).alias("probability"), "mix.selected")


ORACLE["op7_mixing"] = mixing.sql()


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = lang_id.identify(docs.drop("lang"), lang_id.dictionaries(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


ORACLE["op13_filter_audit"] = filter_audit.SQL


@query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damaged_and_repaired(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE["op12_repair"] = turn_repair.sql()
