"""Pages of files: each file goes to a recogniser where it lies, and each page is routed by its text layer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import IMAGE_SUFFIXES, base_name, is_image
from tessera.operators.routing import route_pages
from tessera.providers import Recogniser

#: Columns that Spark gives of a file.
FILES = "path string, modificationTime timestamp, length long, content binary"
PAGES = "doc string, page_no int, text string, method string"


def scan_files(spark: SparkSession, folder: str, images: bool | None = None) -> DataFrame:
    """Rows (path, doc, content) of a folder's files; images: those with an image's suffix only, or all others."""
    files = spark.read.format("binaryFile").load(folder).select("path", base_name(F.col("path")).alias("doc"), "content")
    return files if images is None else files.where(is_image(F.col("path")) == F.lit(images))


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same of files as they arrive. Spark reads them, so the folder may be in any store that it reaches."""
    return spark.readStream.format("binaryFile").schema(FILES).load(folder).select("path", base_name(F.col("path")).alias("doc"), "content")


def extract_pages(files: DataFrame, recogniser: Recogniser) -> DataFrame:
    """Rows (doc, page_no, text, method), numbered from 1; an image is one page."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, doc, content in zip(batch["path"], batch["doc"], batch["content"], strict=True):
                found = recogniser.pages(path, content)
                if path.lower().rsplit(".", 1)[-1] in IMAGE_SUFFIXES:
                    found = found[:1]
                yield pd.DataFrame([(doc, n, text, method) for n, (text, method) in enumerate(found, 1)], columns=["doc", "page_no", "text", "method"])

    return files.mapInPandas(pages, PAGES)


def routed_pages(files: DataFrame, text_layer: Recogniser, recogniser: Recogniser) -> DataFrame:
    """Pages by their text layer where it is good, recognised where it isn't. Only files with a page to recognise are opened again."""
    own = route_pages(extract_pages(files, text_layer))
    poor = own.where("needs_ocr").select("doc", "page_no")
    again = extract_pages(files.join(poor.select("doc").distinct(), "doc", "left_semi"), recogniser).join(poor, ["doc", "page_no"], "left_semi")
    columns = ["doc", "page_no", "text", "method"]
    return own.where("not needs_ocr").select(*columns).unionByName(again.select(*columns))
