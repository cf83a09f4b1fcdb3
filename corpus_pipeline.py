"""A training corpus from the raw documents: toxicity, near copies, benchmark leaks, mixture, token files.

Each stage takes the documents its predecessor kept and, but for the last,
returns documents of the same columns. Null texts and ids, repeated rows and
empty tables are handled as the operators say; documents without an id are kept
by the near-copy stage, and rows that repeat an id leave it once, as the row with
the smallest text. Columns that a stage adds and drops take names no document
column has.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headrace.llm import decontaminate, jaccard, mixing, tokens, toxicity
from headrace.session import cut_lineage


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic probability, last of the chain, is below the limit."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = toxicity.categories_of(labels)
    p = free_name(docs, "p")
    scored = toxicity.score(docs, toxicity.train(docs, labels, names), p)
    return scored.filter(F.col(p)[list(names).index("toxic")] < toxicity.REJECT).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of linked texts."""
    first = jaccard.jaccard_classes(docs.select("doc_id", "text")).filter("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    name = free_name(docs, "hits")
    hits = decontaminate.benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name)
    return hits.filter(F.size(f"{name}.spans") == 0).select(*docs.columns)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the calibrated probability of their source, language and topic."""
    name = free_name(docs, "mix")
    return mixing.mix(docs, name=name).filter(F.col(f"{name}.selected")).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all documents; a row for each document read back from them."""
    return tokens.token_output(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_copies", keep_one_copy), ("decontamination", drop_leaks), ("mixing", sample_mixture), ("token_ids", write_tokens)]

#: The trained model, the classes and the token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
