"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session makes a temporary one; a cluster must name it,
    as executors can't read each other's disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="textkin-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, removed when the driver's JVM ends; a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textkin-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", compression).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the table of maybe_in: 2**MARK_BITS whatever the number of rows, 8 MB.
MARK_BITS = 26


def maybe_in(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose id stands in wanted, a table of one column, and a few others, without an exchange: by a bit table of fixed size.
    Past some ten million wanted ids it tells little, and more rows pass; none is lost."""
    return df.where(marked(id_col, wanted))


def marked(id_col: str, wanted: DataFrame) -> Column:
    """Whether an id stands in wanted, as maybe_in finds it."""
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - MARK_BITS)
    at = wanted.select(place(wanted.columns[0]).alias("place"))
    got = at.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")).toPandas()
    marks = np.zeros(1 << (MARK_BITS - 6), np.int64)
    marks[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = wanted.sparkSession.sparkContext.broadcast(marks)

    @F.pandas_udf("boolean")
    def stands(place: pd.Series) -> pd.Series:
        p = place.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 6] >> (p & 63)) & 1 == 1)

    return stands(place(id_col))
