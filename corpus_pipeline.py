"""A training corpus from ``documents``: toxic texts go, one document of each group of near copies stays, repeated passages and personal data are taken out, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next. All but the
last return the columns of ``documents``, whatever further columns the table has; n_chars follows the text. Null and empty texts pass
the filters and are packed as their end id. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import packing, privacy, repeats, setjoin, toxicity
from tessella.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PER_CLASS = 1500
SIZE, END_ID = 2048, 0

#: None: models, byte-level matches and packing are beyond SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select([c for c in COLUMNS if c in docs.columns])


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier calls toxic go."""
    model = toxicity.fit(*toxicity.training_rows(docs, table(spark, sf_dir, "labels"), "toxic", PER_CLASS))
    return toxicity.score(_columns(docs), model).where("predicted = 0").drop("score", "predicted")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the 4-word Jaccard join at 0.85 the document with the smallest doc_id stays; of equal rows, one."""
    kept = setjoin.classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    docs = _columns(docs)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi").dropDuplicates(["doc_id", "text"])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes or more, or of over 50 words, that occur twice go; the documents stay."""
    return _sized(repeats.remove(_columns(docs)))


def take_out_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind; disclosing terms are generalised or removed; the documents stay."""
    return _sized(privacy.sanitise(_columns(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most SIZE tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, SIZE)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("suffix_dedup", drop_repeats), ("pii", take_out_private), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
