import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import error_rate, normalize, page_label
from tessera.operators import dense
from tessera.operators.answers import citations, grounding_gate, score_gate
from tessera.operators.chunking import LIMIT, TARGET, chunk_documents, chunk_pages, wrap
from tessera.operators.dense import search_dense
from tessera.operators.metrics import auc
from tessera.operators.rerank import reranking, search
from tessera.operators.routing import route_pages
from tessera.providers import LengthReranker
from tessera.streaming.upserts import replace_documents


def test_routes(spark):
    long = "a" * 119
    rows = [(1, None), (2, " " + long), (3, long + "b"), (4, long + "(cid:12)"), (5, long + "Ã©"), (6, long + "þ"), (7, long + "\u0001\u0002")]
    got = {r.doc_id: r.reason for r in route_pages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "no_text", 2: "no_text", 3: "text_layer", 4: "broken_font", 5: "mojibake", 6: "mojibake", 7: "garbage_chars"}


def _chunks_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {i: [] for i in range(len(texts))}
    for r in chunk_documents(rows).orderBy("doc_id", "ordinal").collect():
        found[r.doc_id].append(r)
    return list(found.values())


def test_chunks_keep_every_sentence_and_the_limit(spark):
    sentences = [f"Sentence {i} " + "word " * (i % 37) + "end." for i in range(200)]
    many, none, blank, word, short = _chunks_of(spark, [" ".join(sentences), None, " \n ", "x" * 3000, "One. Two."])
    texts = [c.text for c in many]
    assert all(len(c) <= LIMIT + TARGET for c in texts) and all(any(s in c for c in texts) for s in sentences)
    assert [c.chunk_id for c in many[:2]] == ["0#0000", "0#0001"]
    assert none == [] and blank == [] and [c.text for c in word] == ["x" * 3000] and [c.text for c in short] == ["One. Two."]


def test_lines_count_the_space_behind_each_word():
    assert wrap(np.array([399, 400, 50])) == [399, 451]
    assert wrap(np.array([900, 1])) == [900, 1] and wrap(np.array([], int)) == []


def test_chunks_tell_their_pages(spark):
    text = " ".join(["A sentence of the page."] * 40)
    pages = spark.createDataFrame([("d.pdf", n, text, m) for n, m in ((1, "text_layer"), (2, "ocr_raw"), (3, "ocr_raw"))], "doc string, page_no int, text string, method string")
    got = chunk_pages(pages).orderBy("ordinal").collect()
    assert got[0].chunk_id == "d#0000" and (got[0].page_start, got[-1].page_end) == (1, 3)
    assert {c.method for c in got} == {"text_layer", "mixed", "ocr_raw"}
    assert all(c.page_start <= c.page_end for c in got)


def test_gates_and_citations(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, "d", 1, 2), (1, 2, 0.8, "d", 3, 3), (2, 1, 0.001, "e", 1, 1)], "query_id int, rank int, score double, doc string, page_start int, page_end int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert {r.query_id: r.refused for r in score_gate(asked, hits).collect()} == {1: False, 2: True, 3: True}
    answers = spark.createDataFrame([(1, "<think>x</think>yes [2][1][2][9]"), (2, "no [YANITLANAMADI]"), (3, None)], "query_id int, answer string")
    out = {r.query_id: (r.answer, r.refused, r.reason) for r in grounding_gate(answers).collect()}
    assert out[1] == ("yes [2][1][2][9]", False, None) and out[2][1:] == (True, "no") and out[3][1:] == (True, "cevap üretilemedi")
    assert [(r.page_start, r.page_end) for r in citations(answers, hits).orderBy("place").collect()] == [(3, 3), (1, 2)]


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rate_counts_characters(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("é", "e"), ("", "abc"), ("ağaç", "agac")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", error_rate(F.col("a"), F.col("b")).alias("e")).collect()
    assert all(abs(r.e - _distance(r.a, r.b) / max(len(r.b), 1)) < 1e-12 for r in got)


def test_small_functions(spark):
    row = spark.createDataFrame([("ﬁne hy-\n phen  ation ", 2, 3)], "t string, a int, b int").select(normalize(F.col("t")).alias("t"), page_label(F.col("a"), F.col("b")).alias("l")).first()
    assert tuple(row) == ("fine hyphen ation", "s.2-3")
    assert auc(spark.createDataFrame([], "p boolean, s double"), F.col("p"), F.col("s")).first()["auc"] == 0
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {tuple(r) for r in replace_documents(old, new, "k").collect()} == {(1, "a"), (2, "c")}


def test_dense_passes_agree(spark, monkeypatch):
    """Questions in one pass and in several find the same."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)] + [(500, None), (501, [0.0] * 8), (502, [1.0] * 3)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    one = sorted(map(tuple, search_dense(rows, asked, 4).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 10)
    assert sorted(map(tuple, search_dense(rows, asked, 4).collect())) == one and len(one) >= 160


def test_reranking_an_unknown_base_is_an_error(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b" * 5000)], "chunk_id int, text string")
    base = {"plain": lambda questions, k: questions.select("query_id", F.lit(1).alias("chunk_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"))}
    with pytest.raises(ValueError, match="unknown base 'other'"):
        reranking(base, "other", texts, LengthReranker())
    with pytest.raises(ValueError, match="unknown retriever"):
        search(base, "other", texts, 3)
    found = reranking(base, "plain", texts, LengthReranker())(spark.createDataFrame([(7, "q")], "query_id int, question string"), 3).collect()
    assert [(r["query_id"], r["rank"], r["candidate_rank"]) for r in found] == [(7, 1, 1)]
