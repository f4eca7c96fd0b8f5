"""Search over the chunks of a grid of sizes, against the chunks' texts."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk_search, lexical
from tessera.operators.chunking import chunk_grid
from tessera.operators.lexical import question_blocks, search_bm25

GRID = [(60, 10), (60, 25), (90, 0), (140, 150)]


def _texts():
    rng = np.random.default_rng(11)
    words = ["ab", "\u03a3\u0391\u03a3", "\u0130stanbul", "\ufb01ne", "e\u0301t", "\u00c7a", "x.y-z", "1,5", "\u2014", "\u0307", "\U0001d4b3y", "C\u0327a", "(b", "end.", "Why?", "so\u2026", "long" * 30]
    gaps = [" ", " ", " ", "\n", "  ", "-\n", "-\n\u0301", ". ", "\t\t"]
    texts = ["".join(w for _ in range(rng.integers(1, 120)) for w in (rng.choice(words), rng.choice(gaps))) for _ in range(50)]
    return [*texts, None, "", " \n ", "a", "w" * 500, "word " * 300, "A. " * 200]


def test_counts_and_places_are_those_of_the_texts(spark):
    """Lengths, counts and texts of chunks, of odd signs too, are what cutting all texts and taking their tokens gives."""
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "ab σας istanbul fine ét x.y-z 1,5 xy ça çaab none"), (2, "ab why end w word a")], "item_id int, text string")
    words = next(question_blocks(asked, "item_id", "text", "keep", None)).words
    cut = chunk_grid(docs, GRID).select("target", "overlap", "doc_id", "ordinal", "text", T.tokens(F.col("text")).alias("t")).collect()
    known = {w: i for i, w in enumerate(words.to_pylist())}
    expected = {}
    for r in cut:
        codes, times = np.unique([known[t] for t in r["t"] if t in known], return_counts=True)
        expected[r["target"], r["overlap"], r["doc_id"], r["ordinal"]] = (r["text"], len(r["t"]), codes.astype(int).tolist(), times.tolist())
    bodies = docs.select(F.col("doc_id").alias("of"), T.normalize(F.col("text")).alias("body"))
    counted = chunk_search.counted_chunks(docs, words, GRID)
    found = counted.join(bodies, F.col("chunk.doc_id") == F.col("of")).withColumn("text", chunk_search.chunk_text(F.col("body"), F.col("chunk"))).collect()
    got = {(r["target"], r["overlap"], r["chunk"]["doc_id"], r["chunk"]["ordinal"]): (r["text"], r["length"], r["words"], r["tf"]) for r in found}
    assert len(found) == len(cut) > 500 and got == expected
    assert any(r["chunk"]["n_rest"] for r in found) and any(e[2] for e in expected.values())


def test_finds_what_a_search_of_the_texts_finds(spark, monkeypatch):
    """Each size is ranked as a collection of its own, in blocks of questions too; without a question's word there are sizes alone."""
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(["ab ab x.y-z", "ça 1,5", "istanbul fine", None, "none", "a w", "end so why"])], "item_id int, text string")
    chunks = chunk_grid(docs, GRID).withColumn("chunk", F.struct("doc_id", "ordinal"))
    told = lambda rows: sorted((r["target"], r["overlap"], r["item_id"], r["rank"], r["chunk"]["doc_id"], r["chunk"]["ordinal"], round(r["score"], 9)) for r in rows.collect())
    brute = told(search_bm25(chunks, asked, 4, id_col="chunk", groups=("target", "overlap")))
    sizes = sorted(map(tuple, chunks.groupBy("target", "overlap").count().collect()))
    for block in (4096, 4):
        monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
        counts, found = chunk_search.search_chunks(docs, asked, 4, GRID)
        assert told(found) == brute and len(brute) > 60 and sorted(map(tuple, counts.collect())) == sizes
    counts, found = chunk_search.search_chunks(docs, asked.where("item_id = 3"), 4, GRID)
    assert found.collect() == [] and sorted(map(tuple, counts.collect())) == sizes


def test_texts_are_normalised_once_and_not_written(spark, monkeypatch):
    """The sweep writes no chunk's text, and a document's text is normalised and its tokens are found once for all sizes."""
    from tessera.plans import evaluation

    names, plans = [], []

    def noted(rows, name, write=lexical.written):
        names.append((name, rows.columns))
        plans.append(rows._jdf.queryExecution().executedPlan().toString() if name == "postings" else "")
        return write(rows, name)

    for module in (evaluation, lexical, chunk_search):
        monkeypatch.setattr(module, "written", noted)
    assert evaluation.chunk_sweep(spark, "/root/testdata/sf0.001").count() == 12
    assert all(not {"text", "body"} & set(columns) for _, columns in names)
    plan = next(p for p in plans if p)
    assert plan.count("regexp_extract_all") == 1 and plan.count("FileScan") == 1 and "Exchange" not in plan


def test_white_space_and_composed_texts_are_told_as_by_the_definition(spark):
    signs = ["", " ", "  ", "a", "\u00e9", "\ufb01", "\u00e9", "\u0416", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "\u3000", "\u200b", "(b"]
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([("".join(rng.choice(signs, n)),) for n in range(12) for _ in range(20)] + [(None,)], "t string")
    t = F.col("t")
    spaces = T.stripped(F.regexp_replace(t, f"{T.SPACE}+", " "))
    assert rows.where(~T.collapsed(t).eqNullSafe(spaces)).count() == 0
    # What is taken for composed is its own composition.
    assert rows.where(T.is_composed(t) & (T.nfkc(t) != t)).count() == 0 and rows.where(T.is_composed(t)).count() > 20 and rows.where(~T.is_composed(t)).count() > 20
