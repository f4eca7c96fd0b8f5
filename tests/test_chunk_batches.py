"""Functions over texts get them in batches bounded in bytes."""

import pytest

from tessera.operators.chunking import chunk_documents, chunk_grid, sentence_lines
from tessera.sources.shared import BATCH_BYTES, BATCH_SETTING


@pytest.mark.parametrize("cut", [lambda d: chunk_documents(d), lambda d: chunk_grid(d, [(600, 100)]), lambda d: sentence_lines(d, "text")])
def test_batches_are_bounded(spark, cut):
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.set(BATCH_SETTING, 1 << 30)
        assert cut(spark.createDataFrame([(1, "One sentence. " * 200)], "doc_id long, text string")).count() > 0
        assert int(spark.conf.get(BATCH_SETTING)) == BATCH_BYTES
    finally:
        spark.conf.set(BATCH_SETTING, before)
