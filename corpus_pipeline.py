"""The corpus pipeline: quality rules, n-gram Jaccard join, secret scans, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. All stages but the last return the columns of documents; extra
columns, whatever their names, pass through unchanged. Stages treat nulls, empty texts, repeated rows
and empty tables as the operators that they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwood.llm.common import discard, durable, n_partitions, quoted
from boxwood.llm.jaccard_join import link_classes
from boxwood.llm.mixing import mix
from boxwood.llm.packing import pack
from boxwood.llm.quality_rules import assess
from boxwood.llm.secret_scans import scan_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go."""
    whole = docs.withColumn("_row", F.struct(*map(quoted, docs.columns)))
    return assess(whole, also=("_row",), folded=False).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class, the row with the smallest id stays (of rows with that id, the first; null ids come last).

    Rows are told apart by a number of their own, so that rows with one id but
    different texts are judged each by itself. Documents without words are in no class and stay.
    """
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = durable(docs)  # rows are numbered anew at each reading
    number = "_n"
    while number in docs.columns:
        number += "_"
    rows = docs.withColumn(number, F.monotonically_increasing_id())
    classes = link_classes(rows, id_col=number)
    ids = rows.select(number, F.struct(F.col("doc_id").isNull(), "doc_id", number).alias("place"))
    least = classes.filter("n_shingles > 0").join(ids, number).groupBy("component_id").agg(F.min("place").alias("place"))
    stays = least.select(F.col("place")[number].alias(number)).unionByName(classes.filter("n_shingles = 0").select(number))
    return rows.join(stays, number, "left_semi").select(*map(quoted, docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the texts, and n_chars is counted anew."""
    whole = docs.withColumn("_row", F.struct(*(quoted(c) for c in docs.columns if c != "text")))
    clean = scan_secrets(whole, also=("_row",))
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast(dict(docs.dtypes)["n_chars"])}
    return clean.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: documents are repeated or left out, dealt to shards and shuffled in each."""
    return mix(docs, shards=n_partitions(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of each document."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing", mixing), ("best-fit packing", packing)]

#: Perplexity bands, shards and bins can't be expressed in SQL; tests/llm has a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = []
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
