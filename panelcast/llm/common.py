"""Shared folder, word splitting and column packing used by several operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelcast.session import shared_dir

#: A word is a run of anything but a blank and the control characters 9 to 13; ``bytes.split()``
#: with no argument splits at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several later jobs read to the cluster's shared folder and read it back.

    Unlike a cached table it survives lost executors, and its columns are read one by one.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, empty for null: what Python workers split and hash."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def n_words(name: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def total_bytes(df: DataFrame, name: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()[0]


def keep_others(df: DataFrame, new: list[str]) -> list[str]:
    """The columns of a table that an operator's own columns do not replace."""
    taken = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in taken]
