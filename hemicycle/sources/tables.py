"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemicycle.schemas import TABLES


def read_table(spark: SparkSession, data_dir: str, name: str, *columns: str) -> DataFrame:
    """One table; with ``columns``, only these, so that extra columns never reach a plan. Tables of the domain have the declared schema, so that no file is opened to infer it."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    df = reader.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
