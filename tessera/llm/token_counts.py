"""Token counts of whole texts, as the vocabulary's own library gives them.

An Arrow function encodes batches and returns lengths only. Batches are balanced by bytes, and long
texts are split at safe boundaries (see ``pieces``), so a worker's memory depends neither on the
batch nor on the longest text. One pass over the input, no shuffle.

Null text counts as empty (0 bytes, 0 tokens); null ids, repeated rows and ties pass through row by
row; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import codec
from .shared import byte_slices, in_arrow, named, struct


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens). vocabulary: path of a tokenizers .json or a sentencepiece .model file, on every worker."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(vocabulary, with_ids=False)
        for batch in batches:
            counts = [encoder.answers(batch.column(1)[a:b])[0] for a, b in byte_slices(batch.column(1))]
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], names=[id_col, "n_bytes", "n_tokens"])

    text = named(text_col).cast("string")
    rows = docs.select(named(id_col), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return in_arrow(rows, lengths, struct([docs.schema[id_col]], "n_bytes long, n_tokens long"))
