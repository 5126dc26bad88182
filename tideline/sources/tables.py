"""Named table sets, delimited files with declared schemas, and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_tables(
    spark: SparkSession, folder: str, names: Sequence[str], *, views: bool = False
) -> dict[str, DataFrame]:
    """A named set of Parquet tables, optionally registered as temporary views."""
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def read_csv(spark: SparkSession, path: str, schema: StructType | str, *, sep: str = ",") -> DataFrame:
    """Delimited text with a header; blank cells are missing, a byte-order mark is ignored."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=True)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-delimited text with a header."""
    return read_csv(spark, path, schema, sep="\t")


def write_csv(df: DataFrame, path: str, *, sep: str = ",", mode: str = "errorifexists") -> None:
    """Delimited text with a header, one file per partition."""
    df.write.csv(path, header=True, sep=sep, mode=mode)


def write_table(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """The assembled table as Parquet."""
    df.write.parquet(path, mode=mode)


def values_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A literal table written in the program."""
    return spark.createDataFrame(list(rows), schema)


