"""Quotes in texts, against every text with every quote."""

import random

from tessera.operators.containment import containing


def test_equals_all_pairs(spark):
    rng = random.Random(6)
    words = ["ab", "b", "abc", "x", "ş", "b,", "a-b"]
    texts = [(i if i % 7 else None, rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(60)] + [(3, None), (3, ""), (4, "ab " * 3000 + "tail end of it")]
    quotes = [(None,), ("",), ("b",), ("zz",), ("tail end of",), ("ail end of i",), (" ",), ("ab ab",)]
    for _, t in texts[:60]:
        if t:
            a = rng.randrange(len(t))
            quotes += [(t[a : a + rng.randrange(1, 25)],)] * 2
    rows = spark.createDataFrame([(*t, 1) for t in texts], "id int, text string, quotes int").repartition(3)
    got = sorted((str(r["id"]), str(r["text"]), r["quote"]) for r in containing(rows, spark.createDataFrame(quotes, "quote string"), ["id"]).collect())
    assert got == sorted((str(i), t, q) for i, t in texts if t is not None for q in {q for q, in quotes if q} if q in t)


def test_without_quotes_or_texts(spark):
    texts, quotes = spark.createDataFrame([(1, "a b c")], "id int, text string"), spark.createDataFrame([("a b",)], "quote string")
    assert containing(texts, quotes.limit(0), ["id"]).collect() == [] and containing(texts.limit(0), quotes, ["id"]).collect() == []
    plan = containing(texts, quotes, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
