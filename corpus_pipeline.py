"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestry.llm import decontam, quality, secrets, sentencepieces, simhash
from vestry.llm.common import drop_written, settle, written
from vestry.llm.queries import tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, each judged by its own text.

    Null, empty and very long texts, repeated rows and null ids are scored like
    any other; a score of just 0.5 is accepted, as are all rows where there are
    no labels.  An empty table gives none.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group.

    Texts without a word are one group; very long texts count whole; of rows of
    one id one stays; rows without an id stay.  An empty table gives none.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold too much of the benchmark.

    Of rows that share an id all go if one is contaminated; rows without an id
    stay, as do null and empty texts.  Very long texts are searched whole.  An
    empty benchmark contaminates nothing; an empty table gives none.
    """
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = written(found.where("contaminated and doc_id is not null").select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` brought in line.

    Null and empty texts stay as they are (a null text has null ``n_chars``);
    very long ones are masked whole; repeated rows and null ids have a row each.
    An empty table gives none.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with hashes of the ids and of the decoded text.

    A null or empty text has no ids; very long ones are encoded whole; repeated
    rows and null ids have a row each.  An empty table gives none.
    """
    return sentencepieces.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), keep_ids=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", tokenization),
]

#: The first stage trains a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each stage's rows are written as Parquet and read again.

    What a stage has written on the way to its rows is deleted once they stand,
    and they themselves once the next stage's do.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        docs = settle(lambda stage=stage, before=before: stage(spark, before, sf_dir), name)
        if k:
            drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
