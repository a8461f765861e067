"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, lines, minhash, mixing, quality
from skein.llm.base import drop_table, free, quoted, table, write_table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on the labelled ones among them.

    Null and empty texts are scored like any other; repeated rows are judged alike; rows without id are judged but not trained on; an empty table stays empty; all
    columns stay, whatever their names.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, predicted = free(docs.columns, "score", "predicted")
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return quality.classify(docs, model, keep=rest, names=(score, predicted)).where(F.col(predicted) == 1).select(*map(quoted, docs.columns))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; one of which nothing is left goes, its text stands elsewhere.

    Null and empty texts stay; rows that repeat an id and its text come out equal; null ids are the last documents, of which ties by text hash decide; n_chars
    follows the text; all columns stay, whatever their names.
    """
    return lines.without_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; five-word shingles, similarity 0.8.

    Texts without words and rows without id link with nothing and stay; of rows that repeat an id and its text one stays; all columns stay, whatever their names.
    """
    id_, hash_ = free(docs.columns, "kept_id", "hash")
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(id_)).distinct()
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi").withColumn(hash_, F.xxhash64("text"))
    return out.dropDuplicates(["doc_id", hash_]).select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are never taken; a null source is a source of its own; ties of keys go by id and size, and rows that repeat both are
    taken alike; all columns stay, whatever their names.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to, for each row; null and empty texts have no ids, repeated rows stay."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", delete_repeated_lines),
    ("near-duplicate removal", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier and the encoder have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done, docs = docs, write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_table(done)
    return STAGES[-1][1](spark, docs, sf_dir)
