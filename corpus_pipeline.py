"""From documents to packed sequences: five stages, each written as Parquet and read again.

All stages but the last return the columns of documents, whatever they are called. Null ids and texts are kept as rows: a null text counts as
an empty one, which the classifier scores by its bias, the near-duplicate stage takes for a copy of other empty texts, and packing makes one end
token. Of repeated rows the near-duplicate stage keeps one. Very long texts are judged whole, and an empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, packing, pii, quality, setjoin, simhash
from quillspark.llm.base import stage, table, unstage
from quillspark.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labels, scores 0.5 or more."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, score_col="__score").where("__score >= 0.5").drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard similarity of 0.8 or more of five-word shingles links: by SimHash, confirmed in full, then exactly for the rest."""
    return simhash.first_of_each(docs, setjoin.near_copies(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text."""
    done = pii.replace(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids as little-endian uint32."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("pii_surrogates", replace_personal_data),
    ("cost_balanced_packing", pack_sequences),
]

#: SQL can express neither the classifier's fit nor the tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        before, docs = docs, stage(f(spark, docs, sf_dir), name)
        unstage(before)
    return docs
