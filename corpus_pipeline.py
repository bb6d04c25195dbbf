"""Corpus pipeline over the documents table: five stages, each over all that its predecessor kept.

toxicity      documents that the classifier rejects go
near_dedup    of each group of near-duplicates one document stays
substrings    passages that an earlier document has go out of the text
mixing        sources are drawn to their target weights; a document may come up to three times
encoding      byte-level BPE ids of every text, and the bytes they decode to

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of documents. Null texts pass
as empty ones, null doc_ids are linked with nothing, and repeated rows are rows of their own in every stage but
near_dedup, where rows with one doc_id stay or go together.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm import bpe, chaining, minmax, mixing as mixer, toxicity as toxic
from auditweave.llm.base import configure, shared_path, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model of the labelled rows in ``docs``."""
    configure(spark)
    model = toxic.train(docs, table(spark, sf_dir, "labels"))
    kept = toxic.scored(docs, model).where(F.col("score") < toxic.THRESHOLD)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: the smallest doc_id."""
    configure(spark)
    gone = minmax.near_duplicates(docs, k=5).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    configure(spark)
    return chaining.without_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    configure(spark)
    return mixer.mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    configure(spark)
    # Executors still hold what the stages before needed, so workers remember less than for the operator alone.
    return bpe.digests(docs, matches=100_000, chunks=50_000)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substrings", substrings), ("mixing", mixing), ("encoding", encoding)]

#: A fitted classifier, chains and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
