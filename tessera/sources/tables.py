"""Reading and writing the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream. The path is a pattern, because a stream takes a single file by no other."""
    return spark.readStream.schema(read_table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def write_index(chunks: DataFrame, path: str) -> None:
    """Partitioned by variant and model; writing one of them leaves the others alone."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant", "model").parquet(path)


def read_index(spark: SparkSession, path: str, variant: str, model: str) -> DataFrame:
    """One index; an error where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        found = spark.read.parquet(path).where((F.col("variant") == F.lit(variant)) & (F.col("model") == F.lit(model)))
        if not found.isEmpty():
            return found
    raise FileNotFoundError(f"no index of variant {variant} and model {model} under {path}: write one with write_index")


def index_facts(index: DataFrame) -> DataFrame:
    """Rows (variant, model, documents, chunks, ocr_chunks, dim): what an index holds."""
    ocr = F.count_if(F.col("method") != "text_layer")
    return index.groupBy("variant", "model").agg(F.countDistinct("doc").alias("documents"), F.count("*").alias("chunks"), ocr.alias("ocr_chunks"), F.max(F.size("embedding")).alias("dim"))
