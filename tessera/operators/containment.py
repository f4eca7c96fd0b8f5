"""Which texts contain which quotes, as an equi-join on a window of words instead of every text with every quote.

Where a text contains a quote, the quote's words but for the first and the last, which may be cut, stand in the
text one after the other. Of the windows of these words the quote's signature is the rarest over all texts, so
boilerplate that many texts share brings few candidates; candidates are then looked at letter by letter. A
quote of under three words has its letters, three at a time, in the place of words.

Texts are split where they are read. Only windows that some quote has go on: by broadcast if there are few, else
by a shuffle of their hashes. What is joined back to the texts are ids of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import bounded, written

#: Words of a window at most, and letters of a short quote's.
WORDS, LETTERS = 4, 3
#: Rows of hashes or ids up to which a side is broadcast.
MOST_BROADCAST = 1_000_000


def _windows(parts: Column, size: int) -> Column:
    """Hashes of each run of `size` parts."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - size + 1, F.lit(1)))
    return F.when(F.size(parts) >= size, F.transform(starts, lambda i: F.xxhash64(F.lit(size), F.array_join(F.slice(parts, i, size), " ")))).otherwise(F.array().cast("array<bigint>"))


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _letters(text: Column, size: int) -> Column:
    """Hashes of each run of letters; apart from those of words."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.xxhash64(F.lit(-size), F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))


def containing(texts: DataFrame, quotes: DataFrame, keys: Sequence[str], text_col: str = "text", quote_col: str = "quote") -> DataFrame:
    """Rows of texts with each distinct quote that they contain. Null and empty quotes are contained nowhere; ids may repeat and be null.

    keys: columns by which texts are found again; rows that share them are all looked at."""
    asked = quotes.select(F.col(quote_col).alias("_quote")).where(F.length("_quote") > 0).distinct()
    words = _words(F.col("_quote"))
    # What stands between the first and the last white space, if there are words.
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    sized = asked.withColumn("inner", inner).withColumn("size", F.when(F.size("inner") > 0, F.least(F.size("inner"), F.lit(WORDS))).otherwise(-F.least(F.length("_quote"), F.lit(LETTERS))))
    sizes = range(1, WORDS + 1), range(1, LETTERS + 1)
    own = F.coalesce(*(F.when(F.col("size") == n, _windows(F.col("inner"), n)) for n in sizes[0]), *(F.when(F.col("size") == -n, _letters(F.col("_quote"), n)) for n in sizes[1]))
    wanted = sized.select("_quote", "size", F.explode(F.array_distinct(own)).alias("window"))
    wanted = written(wanted, "windows")
    used = [r["size"] for r in wanted.select("size").distinct().collect()]
    split = texts.select(*keys, F.col(text_col).alias("text"), _words(F.col(text_col)).alias("words"))
    found = F.array_distinct(F.flatten(F.array(*(_windows(F.col("words"), n) if n > 0 else _letters(F.col("text"), -n) for n in used)))) if used else F.array().cast("array<bigint>")
    held = split.select(*keys, F.explode(found).alias("window")).join(bounded(wanted.select("window").distinct(), MOST_BROADCAST), "window", "left_semi")
    held = written(held, "windows-held")
    counts = held.groupBy("window").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "window", "left").groupBy("_quote").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "window")).alias("least")).where("least.n > 0").select("_quote", F.col("least.window").alias("window"))
    candidates = held.join(rarest, "window").select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_quote").distinct()
    candidates = written(candidates, "candidates")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    met = texts.join(bounded(candidates, MOST_BROADCAST), same)
    return met.where(F.col(text_col).contains(F.col("_quote"))).select(*texts.columns, F.col("_quote").alias(quote_col))
