"""Reading and writing catalogs: formats by suffix, separators and encodings, validation, versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a column's name by which the name column is found.
NAME_HINTS = ("наименование", "название", "name", "title", "товар", "продукт")


def sniffed(spark: SparkSession, path: str, lines: int = 50) -> tuple[str, str]:
    """(encoding, separator) of a text file by its first lines: UTF-8 if they are that, else Windows' Cyrillic; ';' if there are more of it than ','."""
    raw = b"\n".join(bytes(r[0]) for r in spark.read.text(path).limit(lines).select(F.col("value").cast("binary")).collect())
    try:
        raw.decode("utf-8")
        encoding = "UTF-8"
    except UnicodeDecodeError:
        encoding = "windows-1251"
    return encoding, ";" if raw.count(b";") > raw.count(b",") else ","


def cyrillic_csv(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """A CSV file in Windows' Cyrillic, which Spark's reader doesn't decode: lines are decoded batch by batch, then parsed. A field may not hold a line break."""
    import csv

    @F.pandas_udf("string")
    def decoded(lines: pd.Series) -> pd.Series:
        return lines.map(lambda b: None if b is None else bytes(b).decode("cp1251", "replace").rstrip("\r"))

    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("raw"))
    first = bytes(raw.first()[0]).decode("cp1251", "replace").rstrip("\r")
    names = next(csv.reader([first], delimiter=separator))
    shape = ", ".join(f"`{n}` string" for n in names)
    lines = raw.select(decoded("raw").alias("line")).where((F.col("line") != first) & (F.length("line") > 0))
    return lines.select(F.from_csv("line", shape, {"sep": separator}).alias("r")).select("r.*")


def load_catalog(spark: SparkSession, source, separator: str | None = None, encoding: str | None = None, schema: str | None = None) -> DataFrame:
    """A frame as it is; a list of dicts; or a path, by its suffix: csv (what isn't given is sniffed), json, parquet, xlsx. A path without a file
    is an empty frame of the schema, if one is given."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spark.createDataFrame(source, schema) if source or schema else spark.range(0).select()
    kind = source.rstrip("/").rsplit(".", 1)[-1].lower()
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    if schema and not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    if kind == "parquet":
        return spark.read.parquet(source)
    if kind == "json":
        return spark.read.json(source)
    if kind == "csv":
        if separator is None or encoding is None:
            found = sniffed(spark, source)
            encoding, separator = encoding or found[0], separator or found[1]
        if encoding.lower() in ("windows-1251", "cp1251"):
            return cyrillic_csv(spark, source, separator)
        return spark.read.csv(source, header=True, sep=separator, encoding=encoding, mode="PERMISSIVE")
    if kind in ("xlsx", "xlsm"):
        from . import workbook

        return workbook.read(spark, source)
    raise ValueError(f"no reader for .{kind}")


#: Columns of an input by which its kind is told, and those that it must have.
REQUIRED = ("Код", "Raw_Name", "Normalized_Name")


def input_kind(columns: list[str], kinds: dict[str, tuple[str, ...]], share: float = 0.8) -> str | None:
    """The first kind of which the columns hold at least that share; None if a required column is missing or none fits."""
    if not set(REQUIRED) <= set(columns):
        return None
    return next((k for k, names in kinds.items() if len(set(names) & set(columns)) >= share * len(names)), None)


def save_processed(df: DataFrame, path: str, category_col: str = "category", default: str = "общие_товары") -> None:
    """The whole table, a folder a category but the default one, and counts."""
    df.write.mode("overwrite").parquet(f"{path}/all")
    df.where(F.col(category_col) != default).write.mode("overwrite").partitionBy(category_col).parquet(f"{path}/categories")
    df.groupBy(category_col).agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/statistics")


def save_parameters(params: DataFrame, path: str, version: str) -> None:
    """(id, name, kind, value, ...) as a nested table, an array of structs an item, and counts by name beside it."""
    fields = [c for c in params.columns if c != "id"]
    params.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("parameters")).write.mode("overwrite").parquet(f"{path}/version={version}/parameters")
    params.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("id").alias("items")).write.mode("overwrite").json(f"{path}/version={version}/statistics")


def load_parameters(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}/parameters").select("id", F.explode("parameters").alias("p")).select("id", "p.*")


def items_from_database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A table of a database, read in `parts` ranges of its key; the driver is the caller's to provide."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: str | None = None) -> None:
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no writer for {kind}")
    writer = df.write.mode(mode)
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.option("header", True).format(kind).save(path)


def name_column(columns: list[str]) -> str:
    """The first column whose lower-cased name holds a hint, else the first column."""
    return next((c for c in columns if any(h in c.lower() for h in NAME_HINTS)), columns[0])


def valid(df: DataFrame, expected: list[str]) -> bool:
    return set(expected) <= set(df.columns) and not df.isEmpty()


def save_version(df: DataFrame, path: str, version: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the greatest version, numbers by their value and before them none; only that folder is read."""
    df = spark.read.parquet(path).withColumn("version", F.col("version").cast("string"))
    last = df.select("version").distinct().orderBy(F.col("version").try_cast("double").desc_nulls_last(), F.col("version").desc()).first()
    return df.where(F.col("version") == last[0]) if last else df


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key; of equal ones the new table's, then the one of the greatest hash."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    values = [c for c in old.columns if c != key]
    order = F.struct(F.col(version), F.col("_new"), F.xxhash64(*values))
    return both.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_r")).select(key, "_r.*")
