"""What the operators of this package share: tables, words, free column names, and the library's written tables and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components  # noqa: F401
from ..sources.shared import shared_dir, written  # noqa: F401

#: A word is a run of characters other than space and \t \n \v \f \r; in bytes that is what bytes.split() splits.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A-Z to a-z, byte by byte; other UTF-8 bytes stay.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got: name, with as many underscores before it as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text) -> F.Column:
    """The words of a text as an array; none for a null or empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def bucket_of(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 4; 2 is held out. Null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4
