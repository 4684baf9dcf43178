"""Corpus pipeline: five stages over ``documents``, each written as Parquet and
reread as the next one's input.

Every stage works on all rows its predecessor kept, and its decision takes
effect: toxic documents go, repeated three-line windows are cut from the texts,
one document of each SimHash group stays, contaminated documents go, and what is
left is encoded. All but the last stage return the columns they were given,
``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerpanel.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from peerpanel.llm.common import stored
from peerpanel.llm.queries import tokenizer_path


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold; learns from
    all labels of the documents at hand."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later occurrences of repeated three-line windows; every document
    keeps its row, with empty text if nothing is left."""
    out = line_dedup.drop_repeated_windows(docs, counts=False)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each SimHash component:
    3-word shingles, at most 3 differing bits."""
    return simhash.keep_one_per_component(docs, width=3, radius=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a word inside an occurrence of a benchmark window."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, with the text they decode to as SHA-256."""
    path = tokenizer_path()
    ids = stored(bpe.encode_documents(docs, path).select("doc_id", "ids"), "pipeline-ids")
    return bpe.decode_documents(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

# Restoring obfuscated words, the trained score and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
