"""The corpus pipeline: toxicity filter, near-duplicate removal, substring removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; between stages the
documents are written as Parquet and read again.  All but the last return the columns of ``documents``.

Cases: a null or empty text passes every filter as it is and is packed as its closing id; of equal rows that link one
stays, also where they repeat an id or have none; without labelled rows nothing is toxic; without a benchmark nothing
is contaminated; other columns of whatever name are carried along up to packing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.llm import decontaminate, ngramjoin, packing, suffixdedup, toxicity
from wrenfold.llm.storage import spent, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5."""
    model = toxicity.train(docs, _side(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: five-word shingles, a Jaccard coefficient of 0.8."""
    return ngramjoin.keep_one(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes under strings of 200 bytes that repeat."""
    cut = suffixdedup.cut_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return decontaminate.decontaminate(docs, _side(spark, sf_dir, "benchmark"), clean="documents")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the suffix arrays or the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with spent(spark) as tables:  # what a stage stores on its way, and what it has read, goes once its own table is written
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
            kept = tables.pop()
            tables += before
        before = [kept]
    return STAGES[-1][1](spark, docs, sf_dir)
