"""Which pages need optical recognition, why, and by which method; first matching reason wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Spread of the background's brightness from which a page image is a photo and is cleaned before recognition.
PHOTO_SPREAD = 25.0


def page_ratios(text: Column) -> dict[str, Column]:
    """What the router measures: length of the stripped text, share of misread letters, share of unprintable signs."""
    body = T.stripped(F.coalesce(text, F.lit("")))
    n = F.greatest(F.length(body), F.lit(1))
    return {
        "length": F.length(body),
        "misread_share": (F.length(body) - F.length(F.translate(body, T.MISREAD_LETTERS, ""))) / n,
        "garbage_share": F.regexp_count(body, F.lit(T.UNPRINTABLE)) / n,
    }


def reason(text: Column, image_share: Column) -> Column:
    body, measured = T.stripped(F.coalesce(text, F.lit(""))), page_ratios(text)
    return (
        F.when(measured["length"] < T.LEAST_CHARS, "no_text")
        .when(body.rlike(T.LOST_GLYPH), "broken_font")
        .when((measured["misread_share"] > T.MISREAD_SHARE) | body.rlike(T.MISREAD_PAIRS), "mojibake")
        .when(measured["garbage_share"] > T.GARBAGE_SHARE, "garbage_chars")
        .when((image_share > T.IMAGE_SHARE) & (measured["length"] < T.IMAGE_CHARS), "image_heavy")
        .otherwise("text_layer")
    )


def route_pages(pages: DataFrame, text_col: str = "text", image_share: Column | None = None) -> DataFrame:
    """The pages with `reason` and `needs_ocr`."""
    routed = pages.withColumn("reason", reason(F.col(text_col), F.lit(0.0) if image_share is None else F.coalesce(image_share, F.lit(0.0))))
    return routed.withColumn("needs_ocr", F.col("reason") != "text_layer")


def ocr_method(spread: Column) -> Column:
    return F.when(spread >= PHOTO_SPREAD, "ocr_preprocessed").otherwise("ocr_raw")


def ocr_confidence(words: DataFrame, page: str, confidence: str = "confidence") -> DataFrame:
    """Rows (page, confidence): mean over words that have one (negative: none); 0 where no word does."""
    good = F.col(confidence) >= 0
    return words.groupBy(page).agg(F.coalesce(F.avg(F.when(good, F.col(confidence))), F.lit(0.0)).alias("confidence"))


def majority_label(pages: DataFrame, group: str, label: str = "reason") -> DataFrame:
    """Rows (group, label): the commonest label; of equally common ones the first by name."""
    counts = pages.groupBy(group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def label_histogram(pages: DataFrame, label: str = "reason") -> DataFrame:
    return pages.groupBy(label).agg(F.count("*").alias("n"))
