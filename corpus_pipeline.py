"""From documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept from Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.llm import dedup, mixing, packing, queries, simhash, toxicity
from stayspark.llm.token_files import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose likeliest grade is 0, by a model fitted on the labelled ones among them."""
    model = toxicity.fit_model(docs, queries.toxic_labels(spark, sf_dir), toxicity.Fit())
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the document with the smallest id; shingles and distance as in op9."""
    return simhash.drop_near_copies(docs, shingle=3, distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus mixed to the weights of its sources; a row for each stretch of a document taken."""
    return mixing.mixed_documents(docs, mixing.Mix())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece of a text, with its ids and their checksum."""
    # The workers have served four other stages by now: smaller slices and a smaller cache.
    pieces = packing.pack(docs, queries.word_bpe(), end=1, slice_bytes=2 << 20, cached=100_000)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Fitted models, fingerprints, pseudorandom draws and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    folder = new_folder(spark, "pipeline")
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
