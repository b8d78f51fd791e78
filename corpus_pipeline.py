"""Corpus pipeline: toxicity, near-duplicates, decontamination, personal data, source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.llm import crf, decontam, mixing, simhash, toxicity
from quillstrata.llm.common import remainder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3. The fold kept for checks is not learned from here either."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit_lexicon(docs.select("doc_id", "text"), labels, train=remainder(F.col("doc_id"), 4) != 2)
    return toxicity.score_toxicity(docs.select(*COLUMNS), lexicon).where(F.col("score") < 0.3).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    return simhash.keep_first(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside benchmark windows."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text."""
    return crf.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mix, with topic, tokens and the probability they were drawn with."""
    mixed = mixing.mix(docs.select(*COLUMNS), mixing.form_topic(F.col("text")))
    return mixed.where("mix.sampled").select(*COLUMNS, "mix.topic", "mix.n_tokens", "mix.probability")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("source mixing", mix_sources),
]

# The stages learn models and sample by hash: no SQL form. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
