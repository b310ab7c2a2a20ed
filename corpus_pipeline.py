"""From raw documents to a training mix, by the operators of loomlog.llm.

Each stage gets all that its predecessor kept. The result has the columns of `documents` and those of
the mix: n_tokens, posterior, domain, rate and copies (how often to show the document).
"""

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import decontamination, exact_dedup, mixing, quality_classifier, simhash_dedup
from loomlog.llm.common import new_path, table
from loomlog.llm.queries import ACCEPT, TARGETS, held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below ACCEPT go."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), exclude=held_out)
    return quality_classifier.accept(docs, model, ACCEPT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_rows(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates towards TARGETS; no domain gives up tokens, so that every document stays at least once."""
    known = docs.select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    weights = {d: w for d, w in TARGETS.items()}
    mixed = mixing.mix(docs, known, weights, never_below=True, lowest=1.0)
    return mixed.where("copies > 0")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("benchmark decontamination", decontaminate), ("mixing", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
