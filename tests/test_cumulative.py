"""Sums below a value and ordered pairs, against every row with every other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera.operators.cumulative as cumulative
from tessera.operators.metrics import auc, best_thresholds, paired_auc


def _rows(rng, n, kind):
    draw = {"few": lambda: float(rng.randrange(4)), "spread": lambda: rng.gauss(0, 1), "outlier": lambda: 1e30 if rng.random() < 0.01 else rng.random(), "hot": lambda: 0.5 if rng.random() < 0.6 else rng.random()}[kind]
    return [(rng.random() < 0.4, draw(), draw()) for _ in range(n)]


@pytest.mark.parametrize("kind", ["few", "spread", "outlier", "hot"])
def test_equals_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(cumulative, "CUTS", 16)
    monkeypatch.setattr(cumulative, "CUTS_OF_PAIRS", 7)
    rows = _rows(random.Random(3), 300, kind)
    table = spark.createDataFrame([*rows, (None, 1.0, 1.0), (True, None, 0.0)], "p boolean, a double, b double").repartition(3)
    pos, neg = [r[1:] for r in rows if r[0]], [r[1:] for r in rows if not r[0]]
    pairs = [(x, y) for x in pos for y in neg]
    win = lambda x, y: 1.0 if x > y else 0.5 if x == y else 0.0
    got = paired_auc(table, F.col("p"), F.col("a"), F.col("b")).first()
    first, second = (sum(win(x[k], y[k]) for x, y in pairs) / len(pairs) for k in (0, 1))
    assert abs(got["auc_first"] - first) < 1e-12 and abs(got["auc_second"] - second) < 1e-12
    assert got["only_first"] == sum(x[0] > y[0] and x[1] <= y[1] for x, y in pairs) and got["only_second"] == sum(x[0] <= y[0] and x[1] > y[1] for x, y in pairs)
    counted = [(s, sum(r[1] == s for r in rows if r[0]), sum(r[1] == s for r in rows if not r[0])) for s in {r[1] for r in rows}]
    summed = cumulative.below(spark.createDataFrame(counted, "s double, pos long, neg long"), "s", ["pos", "neg"]).collect()
    assert {r["s"]: (r["below_pos"], r["below_neg"]) for r in summed} == {s: (sum(c[1] for c in counted if c[0] < s), sum(c[2] for c in counted if c[0] < s)) for s, _, _ in counted}
    best = best_thresholds(table, F.col("p"), F.col("b")).first()
    right = {s: sum(r[0] == (r[2] >= s) for r in [*rows, (True, None, 0.0)]) for s in {r[2] for r in rows} | {0.0}}
    assert best["threshold"] == min(s for s in right if right[s] == max(right.values()))


def test_stretches_are_bounded(spark):
    """One outlier and one frequent value leave the other values in stretches of equal size."""
    rng = random.Random(1)
    values = [(1e300,), *((0.25,) for _ in range(3000)), *((rng.random(),) for _ in range(6000))]
    table = spark.createDataFrame(values, "v double")
    (cuts,) = cumulative.cuts_of(table, ["v"], 64)
    counts = {r["k"]: r["count"] for r in table.select(cumulative.stretch(F.col("v"), cuts).alias("k")).groupBy("k").count().collect()}
    assert max(n for k, n in counts.items() if k % 2 == 0) < 2.5 * 9001 / 64
    expected = [2 * int(np.searchsorted(cuts, v, side="right")) - int(v in cuts) for (v,) in values[::50]]
    assert [r["k"] for r in spark.createDataFrame(values[::50], "v double").select(cumulative.stretch(F.col("v"), cuts).alias("k")).collect()] == expected


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "p boolean, a double, b double")
    assert auc(none, F.col("p"), F.col("a")).first()["auc"] == 0
    assert tuple(paired_auc(none, F.col("p"), F.col("a"), F.col("b")).first()) == (0.0, 0.0, 0.0, 0, 0)
    assert cumulative.below(spark.createDataFrame([], "s double, n long"), "s", ["n"]).collect() == []


def test_draws_by_their_first_bits():
    """The draws are the number of terms of the distribution below each share, whichever bits tell it."""
    from math import factorial

    import numpy as np

    from tessera.operators import metrics

    steps = np.cumsum([np.exp(-1) / factorial(k) for k in range(16)])
    keys, rounds = np.arange(3000, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), np.arange(200, dtype=np.uint64)
    x = keys[:, None] + (rounds[None] + np.uint64(4)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    assert (metrics.poisson(keys, rounds, 3) == np.searchsorted(steps, share, side="right")).all()


def test_scores_are_read_once(spark):
    """The input is read once, however often the paired measures look at it."""
    from pyspark.sql import functions as F

    from tessera.operators import metrics

    for measure in (metrics.paired_auc, metrics.paired_bootstrap):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("double")
        def noted(x, seen=seen):
            seen.add(1)
            return float(x % 7)

        rows = spark.range(60).withColumn("s", noted(F.col("id")))
        more = {"key": F.col("id"), "rounds": 20} if measure is metrics.paired_bootstrap else {}
        assert measure(rows, F.col("id") % 2 == 0, F.col("s"), F.col("id") * 1.0, **more).count() == 1
        # For the test of nulls and for the value.
        assert seen.value <= 120
