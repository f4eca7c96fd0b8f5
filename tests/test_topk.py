"""Best rows of queries by products in the tasks, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import topk
from tessera.operators.dense import search_dense


def _brute(rows, asked, k, allowed):
    found = set()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q, (v, key) in asked.items():
        scored = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, (w, own) in rows.items() if len(w) == len(v) and allowed(q, key, i, own))
        found |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return found


def test_dense_exclusion(spark, monkeypatch):
    """Keys, of which null is apart from none, and pairs that aren't to be found; copies, whose ties go to the smaller id; vectors of several lengths; many slices a task."""
    monkeypatch.setattr("tessera.operators.dense.CELLS", 200)
    rng = np.random.default_rng(5)
    rows = {i: ([float(x) for x in (rng.normal(size=6) if i % 3 else np.ones(6))], None if i % 11 == 0 else i % 4) for i in range(200)}
    rows |= {i: ([float(x) for x in rng.normal(size=4)], i % 4) for i in range(200, 260)}
    asked = {i: v for i, v in rows.items() if i % 5 == 0}
    table = spark.createDataFrame([(i, v, key) for i, (v, key) in rows.items()], "vec_id long, embedding array<double>, label int")
    queries = table.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    told = lambda found: {(q, n, i, round(s, 9)) for q, n, i, s in map(tuple, found.collect())}
    by_label = told(search_dense(table, queries, 7, apart=(F.col("label"), F.col("label"))))
    assert by_label == _brute(rows, asked, 7, lambda q, key, i, own: key is not None and own is not None and key != own)
    pairs = [(q, i) for q in asked for i in rows if (q + i) % 7 == 0 or q == i]
    banned = set(pairs)
    by_pairs = told(search_dense(table, queries, 7, exclude=spark.createDataFrame(pairs, "query_id long, vec_id long")))
    assert by_pairs == _brute(rows, asked, 7, lambda q, key, i, own: (q, i) not in banned)


def test_best_keeps_ties_by_id():
    import pyarrow as pa

    best = topk.Best(2, 1)
    for ids in ([9, 7], [8, 1], [3, 5]):
        best.add(np.ones((1, 2)), [pa.array(ids)])
        best.rows()
    assert best.rows()["id0"].to_pylist() == [1, 3]


def test_bm25_in_blocks_and_apart(spark, monkeypatch):
    """Blocks of questions, slices of a batch, an index, pairs and keys that aren't to be found all agree with scores by the definition."""
    from tessera.operators import lexical

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choice(words, rng.integers(1, 12))) for i in range(120)} | {120: None, 121: ""}
    asked = {i: " ".join(rng.choice([*words, "none"], 4)) for i in range(17)} | {17: "none", 18: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(asked.items()), "item_id long, text string")
    split = {i: (t or "").split() for i, t in texts.items()}
    average = sum(map(len, split.values())) / len(split)
    idf = {w: np.log(1 + (len(split) - n + 0.5) / (n + 0.5)) for w in words for n in [sum(w in t for t in split.values())]}

    def brute(allowed):
        rows = set()
        for q, text in asked.items():
            scored = []
            for i, t in split.items():
                score = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in (text or "").split() if w in t)
                if score > 0 and allowed(q, i):
                    scored.append((-round(float(score), 9), i))
            rows |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:5], 1)}
        return rows

    told = lambda found: {(q, n, i, round(s, 9)) for q, n, i, s in map(tuple, found.collect())}
    pairs = [(q, i) for q in asked for i in texts if (q * i) % 5 == 1]
    banned = set(pairs)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 6)
    monkeypatch.setattr(lexical, "CELLS", 100)
    assert told(lexical.search_bm25(docs, items, 5)) == brute(lambda q, i: True)
    assert told(lexical.search_bm25(docs, items, 5, apart=(F.col("item_id") % 3, F.col("doc_id") % 3))) == brute(lambda q, i: q % 3 != i % 3)
    assert told(lexical.search_bm25(docs, items, 5, exclude=spark.createDataFrame(pairs, "item_id long, doc_id long"))) == brute(lambda q, i: (q, i) not in banned)
    from tessera.sources.shared import shared_path

    path = shared_path(spark, "lexical")
    lexical.write_lexical_index(docs, path)
    assert told(lexical.search_lexical_index(spark, path, items, 5)) == brute(lambda q, i: True)
    assert lexical.search_bm25(docs, items.where("item_id >= 17"), 5).count() == 0


def test_texts_and_postings_are_not_shuffled_to_hits(spark):
    """Even where Spark broadcasts nothing of its own, a search shuffles what its tasks found, and texts stay where they lie."""
    from tessera.operators.lexical import search_bm25
    from tessera.plans.evaluation import _hits
    from tessera.sources.tables import read_table

    sf = "/root/testdata/sf0.001"
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_of = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
        search = plan_of(search_bm25(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), 5))
        hits = plan_of(_hits(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in search + hits
    assert search.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning" not in hits
