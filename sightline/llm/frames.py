"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import cut, ensure_checkpoint_dir  # noqa: F401  (re-exported)

#: The pattern of words that white space separates.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, keep: Sequence[str], made: Sequence[str]) -> list[Column]:
    """The columns to carry through; one whose name an operator makes itself comes out as in_<name>."""
    taken = {m.lower() for m in made}
    return [F.col(f"`{c}`").alias(f"in_{c}" if c.lower() in taken else c) for c in keep]


def with_text(df: DataFrame, keep: Sequence[str], made: Sequence[str], text_col: str) -> tuple[DataFrame, int, list[str]]:
    """The kept columns and the text, which is sent once: the frame, the text's place, the kept columns' new names."""
    own = kept(df, keep, made)
    names = df.select(*own).columns
    if text_col in keep:
        return df.select(*own), list(keep).index(text_col), names
    return df.select(*own, F.col(f"`{text_col}`").alias("__text")), len(names), names


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
