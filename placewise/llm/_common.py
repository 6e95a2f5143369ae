"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from placewise.functions.session import checkpoint_dir, cut
from placewise.functions.text import let

__all__ = ["WHITE", "WORD", "cut", "fresh", "let", "shared_path", "table"]

#: Words are maximal runs of characters other than these ASCII white-space characters.
WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark compares them without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme of the store that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full

