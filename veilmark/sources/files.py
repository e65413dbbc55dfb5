"""Files in and out: JSON results, images, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A transparent picture of one pixel, for payloads without an image (fixed value).
EMPTY_PNG = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNkYPhfDwAChwGA60e6kgAAAABJRU5ErkJggg=="


def read_results(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents that may span lines, under a given schema: nothing is inferred from the data."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_results(df: DataFrame, *paths: str) -> None:
    """The same rows as JSON lines to each path."""
    for p in paths:
        df.write.mode("overwrite").json(p)


def read_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def data_url(content: Column, mime: str = "image/png") -> Column:
    """Bytes as a data address; nothing and no bytes become the empty picture."""
    coded = F.regexp_replace(F.base64(content), r"\s", "")
    return F.concat(F.lit(f"data:{mime};base64,"), F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, F.lit(EMPTY_PNG)).otherwise(coded))


def from_data_url(url: Column) -> Column:
    return F.unbase64(F.substring_index(url, ",", -1))
