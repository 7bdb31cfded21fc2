"""From documents to token ids in five stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all rows the one before has kept. Between stages the rows are written as Parquet in the shared folder
and read again, so each stage starts from files and a lost executor never leads back to an earlier one. All stages but
the last return the columns of ``documents``.

All stages alike: null texts count as empty ones and are kept, but for a near-duplicate of another empty text; null and
repeated ids are rows of their own; of equal rows the near-duplicate stage keeps one; an empty table gives an empty one;
texts of any length are worked on whole; further columns are dropped, whatever their names, as each stage takes the five
columns of ``documents`` by name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontamination, secrets, simhash, toxicity
from docloom.llm.shared import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score 0.5 or more go."""
    return toxicity.reject(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a passage of the benchmark go."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every secret in a text is replaced by a mark; all documents stay."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token ids of each text, with digests of the ids and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(docs, path, decoded="decoded")
    return both.select("doc_id", "ids", *bpe.digests())


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scans", secret_spans),
    ("byte_level_bpe", tokens),
]
#: SQL has no boosted trees, XXH64 or BPE; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
