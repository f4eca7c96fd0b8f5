"""Results as JSON, runs as CSV that can be taken up again, texts and timings of earlier runs, uploads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Places that results are rounded to.
PLACES = 6
RUNS = "config string, doc string, lang string, cer double, elapsed double, chars int"


def rounded(rows: DataFrame) -> DataFrame:
    """Every floating-point column at PLACES places."""
    return rows.select(*(F.round(f.name, PLACES).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in rows.schema))


def result_path(folder: str, variant: str, model: str, retriever: str, k: int) -> str:
    """A folder a setting, so that a measurement replaces the same one only."""
    return f"{folder}/{variant}/{model.replace('/', '__')}/{retriever}_k{k}.json"


def write_results(rows: DataFrame, path: str) -> None:
    """One JSON object a row, stamped with the time of writing."""
    rounded(rows).withColumn("written_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs written so far; none where there is no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).csv(path, header=True)


def open_runs(planned: DataFrame, done: DataFrame) -> DataFrame:
    """What is planned as (config, doc) and not done."""
    return planned.join(done.select("config", "doc").distinct(), ["config", "doc"], "left_anti")


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds to the folder; each file has its header."""
    runs.select(*(field.split()[0] for field in RUNS.split(", "))).write.mode("append").csv(path, header=True)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc, text) of the text files of a folder, doc being a file's name without its suffix."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").select(name.alias("doc"), F.col("value").alias("text"))


def read_elapsed(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc, method, seconds): of repeated measurements the mean."""
    return spark.read.schema("doc string, method string, chars int, tr_ratio double, elapsed double").csv(path, header=True).groupBy("doc", "method").agg(F.avg("elapsed").alias("seconds"))


def upload_name(given: str) -> str:
    """The name an upload is kept under: no folders; an error where nothing is left."""
    name = re.split(r"[/\\]", given)[-1]
    if name in ("", ".", ".."):
        raise ValueError(f"no file name in {given!r}")
    return name


def save_upload(folder: str, given: str, content: bytes) -> str:
    """Writes an upload into a folder of the driver's; gives its path."""
    import os

    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, upload_name(given))
    with open(path, "wb") as f:
        f.write(content)
    return path
