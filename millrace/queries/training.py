"""Queries of the training-data operators in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.packed_values import split_values
from millrace.session import read_table, spread


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per creator of each media record, in the order of the field."""
    media = spread(read_table(spark, sf_dir, "media_metadata").select("meta_row", "creator"))
    return split_values(media, "creator", read_table(spark, sf_dir, "creator_authority"), out="creator_name", keep=["meta_row"])


def p1_creator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields name each creator, and how often it comes first."""
    return p1_found(spark, sf_dir).groupBy("creator_name").agg(F.countDistinct("meta_row").alias("n_fields"), F.count_if(F.col("pos") == 0).alias("n_first"))


QUERIES = {"p1_found": p1_found, "p1_creator_counts": p1_creator_counts}
ORACLES: dict[str, str] = {}
