"""Helpers that the training-data operators share."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.sources.staging import new_path, shared_dir, stage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
